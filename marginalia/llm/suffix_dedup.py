"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

Every byte covered by a ``length``-byte string that also starts anywhere else is
removed. To judge all strings without gathering them in one place, each start is
routed by an *anchor*: the smallest gram hash inside its string, leftmost on ties.
Equal strings have equal anchors, so they meet in one group; consecutive starts with
one anchor form an interval, whose bytes are its *context*. Then:

1. Anchors are counted; those that occur once are no candidates.
2. Equal contexts are counted by digest; all starts of a context seen twice repeat.
3. Only for contexts seen once, in groups with other contexts, the bytes are fetched.
   A suffix array of a bounded chunk of groups is built by two-stage sorting (suffixes
   smaller than their successors are sorted directly, the others are induced by bucket
   scans), and adjacent common prefixes of ``length`` bytes mark the repeated starts.

A group of more than ``hot`` different contexts comes from a passage that many documents share. It is
never gathered: its strings are counted by their own hashes, those seen once go, and of each other
string two places are judged by suffix arrays for all of them (``repeated_in_wide``). Nothing is sampled
or capped. Contexts count as equal if their lengths, the hash of their anchor and a 128-bit digest of their
bytes are (XXH3, not made against adversaries), and strings of such a group if their digests are.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose nothing;
rows that repeat (even with equal ids) are documents of their own; a null id is a value;
an empty table gives an empty result; columns other than doc_id and text play no part.
Runs of one byte and other periodic texts, of any length, are judged in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import hot_join, mapped, materialise, ship, text_or_empty, texts, trim, with_columns

GRAM = 32  # bytes of an anchor's gram; a power of two
SECTION = 1 << 20  # starts judged at once
LONGEST = 4096  # starts of an interval; a longer one is cut
CHUNK = 1_000_000  # bytes that one suffix array covers, and at most one group of HOT contexts more
HOT = 16384  # contexts of a group that one task may judge, about 200 MB of them
INDEX = np.uint64((1 << 21) - 1)
_TABLE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def gram_hashes(s: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM`` bytes of ``s`` (uint8), by doubling."""
    h, width = _TABLE[s], 1
    for odd in _ODD:
        h = h[:-width] * odd + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def windowed_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive values, by doubling."""
    m, width = x, 1
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (w - width)], m[w - width :]) if w > width else m


def anchors(s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a ``length``-byte string: its anchor's hash and place."""
    h = gram_hashes(s)
    low = windowed_min((h & ~INDEX) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    at = (low & INDEX).astype(np.int64)
    return h[at], at


def intervals(data: bytes, ends: np.ndarray, length: int):
    """Yields (document number, start, number of starts, anchor hash, whether its anchor occurs in it twice), as arrays.

    ``data``: texts one after another; ``ends``: where each ends. Starts are places in ``data``.
    """
    s = np.frombuffer(data, np.uint8)
    for begin in range(0, max(0, len(s) - length + 1), SECTION):
        part = s[begin : begin + SECTION + length - 1]
        value, at = anchors(part, length)
        n = len(value)
        place = np.arange(begin, begin + n)
        doc = np.searchsorted(ends, place, side="right")
        fits = place + length <= ends[doc]
        cut = np.ones(n, bool)
        cut[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, n))
        if size.max() > LONGEST:
            more = -(-size // LONGEST)
            k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            first, size = np.repeat(first, more) + k * LONGEST, np.minimum(np.repeat(size, more) - k * LONGEST, LONGEST)
        first, size = first[ok := fits[first]], size[ok]
        yield doc[first], place[first], size, value[first], at[first] != at[first + size - 1]


def joined(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts of a batch one after another, where each begins, and where each ends."""
    parts = texts(batch)
    ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
    return b"".join(parts), ends - [len(x) for x in parts], ends


def two_stage_suffix_array(s: np.ndarray, depth: int, asked: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The suffixes of ``s`` (uint8) in order of their first ``depth`` bytes (at least).

    Suffixes smaller than their successor are sorted directly, eight bytes at a time; a scan over the buckets of
    first bytes, in order, places each other suffix at the head of its bucket when its successor is met.

    ``asked``: first and end of ranges of suffixes that are wanted. Then only these are ordered, and those after each
    range up to the next directly sorted one, from which the range's last suffixes are induced.
    """
    n = len(s)
    if n == 0:
        return np.empty(0, np.int64)
    differs = s[:-1] != s[1:]
    change = np.flatnonzero(differs)
    following = np.append(0, np.cumsum(differs))  # how many changes come before each place
    smaller = np.zeros(n, bool)
    known = following < len(change)
    where = change[following[known]]
    smaller[known] = s[where] < s[where + 1]

    needed = np.ones(n, bool)
    if asked is not None:
        direct = np.append(np.flatnonzero(smaller), n - 1)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, asked[0], 1)
        np.add.at(edge, direct[np.minimum(np.searchsorted(direct, asked[1]), len(direct) - 1)] + 1, -1)
        needed = np.cumsum(edge)[:-1] > 0

    words = eight_bytes(s)
    idx = np.flatnonzero(smaller & needed)
    group = np.zeros(len(idx), np.int64)
    out = np.empty(len(idx), np.int64)
    slot = np.arange(len(idx))
    for d in range(0, depth, 8):
        if not len(idx):
            break
        key = words[np.minimum(idx + d, n)]
        order = np.lexsort((key, group))
        idx, group, key = idx[order], group[order], key[order]
        new = np.ones(len(idx), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        out[slot[alone]] = idx[alone]
        idx, group, slot = idx[~alone], group[~alone], slot[~alone]
    out[slot] = idx

    count = np.bincount(s[needed], minlength=256)
    begin = np.cumsum(count) - count
    sorted_count = np.bincount(s[out], minlength=256)
    sa = np.empty(int(needed.sum()), np.int64)
    at = np.cumsum(sorted_count) - sorted_count
    for c in np.flatnonzero(sorted_count):
        sa[begin[c] + count[c] - sorted_count[c] : begin[c] + count[c]] = out[at[c] : at[c] + sorted_count[c]]
    head = begin.copy()

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        """Place the larger predecessors of ``scanned``; returns those that fell into bucket ``c`` itself."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before] & needed[before]]
        first = s[before]
        own = before[first == c]
        sa[head[c] : head[c] + len(own)] = own
        head[c] += len(own)
        rest = first != c
        before, first = before[rest], first[rest]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        kinds, starts, sizes = np.unique(first, return_index=True, return_counts=True)
        for k, i, m in zip(kinds.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            sa[head[k] : head[k] + m] = before[i : i + m]
            head[k] += m
        return own

    if needed[-1]:  # its successor is the empty suffix, the smallest
        sa[head[s[-1]]] = n - 1
        head[s[-1]] += 1
    for c in np.flatnonzero(count).tolist():
        front = sa[begin[c] : head[c]].copy()
        while len(front):
            front = induce(front, c)
        induce(sa[begin[c] + count[c] - sorted_count[c] : begin[c] + count[c]], c)
    return sa


def eight_bytes(s: np.ndarray) -> np.ndarray:
    """For each place (and the end) the next eight bytes as one number, zeros beyond the end."""
    x = np.zeros(len(s) + 8, np.uint64)
    x[: len(s)] = s
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x


def repeated_starts(s: np.ndarray, length: int, asked: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which (asked) places of ``s`` begin a ``length``-byte string that begins at another too (zeros fill the end)."""
    sa = two_stage_suffix_array(s, length, asked)
    hit = np.zeros(len(s), bool)
    if len(sa) < 2:
        return hit
    words = eight_bytes(s)
    left, right = sa[:-1], sa[1:]
    for d in range(0, length, 8):
        d = min(d, length - 8)
        same = words[np.minimum(left + d, len(s))] == words[np.minimum(right + d, len(s))]
        left, right = left[same], right[same]
    hit[left] = hit[right] = True
    return hit


def runs_of(mark: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, as (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def judge(contexts: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each (bytes, number of starts): runs of starts whose string begins elsewhere in ``contexts`` too."""
    total = sum(len(c) + 1 for c, _ in contexts)
    s, at, where = np.zeros(total, np.uint8), 0, []
    for c, _ in contexts:
        s[at : at + len(c)] = np.frombuffer(c, np.uint8) + 1  # UTF-8 has no byte 255, so 0 can separate
        where.append(at)
        at += len(c) + 1
    first = np.array(where)
    hit = repeated_starts(s, length, (first, first + [m for _, m in contexts]))
    return [runs_of(hit[i : i + m]) for i, (_, m) in zip(where, contexts, strict=True)]


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """Of ``docs`` (doc_id, th, text): rows (doc_id, th, a, b), the starts a to b (exclusive) of strings that repeat."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, _, ends = joined(batch)
        found = [(v, 1 + twice) for _, _, _, v, twice in intervals(data, ends, length)]
        v = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in found)])
        n = np.concatenate([np.empty(0, np.int64), *(x for _, x in found)])
        v, back = np.unique(v, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(np.bincount(back, n, len(v)).astype(np.int64))], names=["ah", "n"])

    def located(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, begins, ends = joined(batch)
        view, digest = memoryview(data), xxhash.xxh3_128_digest
        cols = [[np.empty(0, t)] for t in (np.int64, np.int64, np.int64, np.uint64, bool)]
        for found in intervals(data, ends, length):
            for c, x in zip(cols, found, strict=True):
                c.append(x)
        doc, start, size, v, twice = map(np.concatenate, cols)
        ch = pa.array([digest(view[i:j]) for i, j in zip(start.tolist(), (start + size + length - 1).tolist(), strict=True)], pa.binary())
        pick = pa.array(doc)
        arrays = [pa.array(v.view(np.int64)), ch, batch.column("doc_id").take(pick), batch.column("th").take(pick)]
        arrays += [pa.array(start - begins[doc]), pa.array(size.astype(np.int32)), pa.array(twice)]
        return pa.RecordBatch.from_arrays(arrays, names=["ah", "ch", "doc_id", "th", "p0", "m", "twice"])

    again = mapped(docs.select("text"), counted, "ah long, n long").groupBy("ah").agg(F.sum("n").alias("n")).filter("n >= 2").select("ah")
    rows = mapped(docs, located, f"ah long, ch binary, doc_id {id_type}, th long, p0 long, m int, twice boolean")
    found = materialise(hot_join(rows, again, ["ah"], "left_semi"), "suffix-candidates")

    same = found.groupBy("ah", "ch", "m").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(F.struct("doc_id", "th", "p0")).alias("at"))
    sure = same.filter("n >= 2").select("ah", "ch", "m")
    whole = hot_join(found, sure, ["ah", "ch", "m"], "left_semi").select("doc_id", "th", F.col("p0").alias("a"), (F.col("p0") + F.col("m")).alias("b"))

    groups = same.groupBy("ah").agg(F.count(F.lit(1)).alias("width"), F.min("n").alias("least"), F.max("twice").alias("any_twice"))
    groups = groups.filter("least = 1 and (width >= 2 or any_twice)").select("ah", "width")
    open_ = materialise(hot_join(same, groups, ["ah"]).select("ah", "ch", "m", "n", "width", "at.*"), "suffix-open")
    if not open_.filter(F.col("width") > hot).limit(1).count():
        return whole.unionByName(judged(contexts_of(docs, open_, length), length))
    contexts = materialise(contexts_of(docs, open_, length), "suffix-contexts")  # texts move once for both kinds
    few = judged(contexts.filter(F.col("width") <= hot), length)
    return whole.unionByName(few).unionByName(repeated_in_wide(contexts.filter(F.col("width") > hot), length))


def contexts_of(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``rows`` (ah, ch, m, n, width, p0, doc_id, th) with their bytes, ctx."""
    asked = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("ah", "ch", "m", "n", "width", "p0")).alias("asked")).withColumnsRenamed({"doc_id": "k1", "th": "k2"})
    fetched = asked.join(docs, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("k2"))).select("doc_id", "th", "asked", "text")
    types = {"ah": pa.int64(), "ch": pa.binary(), "m": pa.int32(), "n": pa.int64(), "width": pa.int64(), "p0": pa.int64(), "ctx": pa.binary()}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in types}
        doc = []
        for i, (text, asks) in enumerate(zip(texts(batch), batch.column("asked").to_pylist(), strict=True)):
            for q in asks:
                q["ctx"] = text[q["p0"] : q["p0"] + q["m"] + length - 1]
                for k, x in out.items():
                    x.append(q[k])
                doc.append(i)
        pick = pa.array(doc, pa.int64())
        arrays = [pa.array(v, types[k]) for k, v in out.items()]
        return pa.RecordBatch.from_arrays([*arrays, batch.column("doc_id").take(pick), batch.column("th").take(pick)], names=[*out, "doc_id", "th"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return mapped(fetched, cut, f"ah long, ch binary, m int, n long, width long, p0 long, ctx binary, doc_id {id_type}, th long")


def judged(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, a, b): of contexts seen once (n = 1) the starts whose string starts elsewhere in the group of ``ah`` too, by suffix arrays."""
    id_type = contexts.schema["doc_id"].dataType.simpleString()
    contexts = contexts.drop("width").repartition("ah").sortWithinPartitions("ah", "ch", "m", "p0", "doc_id", "th")

    def run(batches):
        held: list[tuple] = []
        size, group, last = 0, None, None

        def flush():
            runs = judge([(h[0], h[1]) for h in held], length)
            new = [(h[4], h[5], h[3] + a, h[3] + b) for h, r in zip(held, runs, strict=True) if h[2] == 1 for a, b in r]
            ids, ths, a, b = zip(*new, strict=True) if new else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(ths, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "th", "a", "b"])

        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            cols = {k: batch.column(k).to_pylist() for k in ("ah", "ch", "m", "n", "p0", "ctx", "doc_id", "th")}
            for ah, ch, m, n, p0, ctx, doc_id, th in zip(*cols.values(), strict=True):
                if ah != group and size > CHUNK:
                    yield flush()
                    held, size = [], 0
                group = ah
                if (key := (ah, ch, m, p0, doc_id, th)) != last:  # a row that repeats brings its contexts again
                    held.append((ctx, m, n, p0, doc_id, th))
                    size += len(ctx) + 1
                last = key
        if held:
            yield flush()
        trim()

    return contexts.mapInArrow(run, f"doc_id {id_type}, th long, a long, b long")


def string_hashes(s: np.ndarray, m: int, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each of the first ``m`` places, from those of the grams that cover them."""
    h, out = gram_hashes(s), np.zeros(m, np.uint64)
    for d in (*range(0, length - GRAM, GRAM), length - GRAM):
        out = out * _ODD[1] + h[d : d + m]
    out ^= out >> np.uint64(31)
    return out


def repeated_in_wide(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, a, b) as ``judged``, for (written) contexts whose groups are too wide to meet in one task.

    Such a group comes from a passage that many documents share and go on from differently, so nearly all of its strings are
    different. Strings are told apart by their own hashes, not by their group: those whose hash is seen once go before any
    bytes move. Of each string left, by its 128-bit digest, the first and the last place are judged by suffix arrays, and what holds for
    these two holds for all its places. No step gathers a group, or the places of one string.
    """
    id_type = contexts.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        return zip(texts(batch, "ctx"), batch.column("m").to_pylist(), strict=True)

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [string_hashes(np.frombuffer(ctx, np.uint8), m, length) for ctx, m in each(batch)]
        values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["h", "n"])

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, sh, digest = [np.empty(0, np.uint64)], [], xxhash.xxh3_128_digest
        for ctx, m in each(batch):
            view = memoryview(ctx)
            h.append(string_hashes(np.frombuffer(ctx, np.uint8), m, length))
            sh += [digest(view[i : i + length]) for i in range(m)]
        m = batch.column("m").to_numpy().astype(np.int64)
        pick = np.repeat(np.arange(batch.num_rows), m)
        p = batch.column("p0").to_numpy()[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(m) - m, m)
        pick = pa.array(pick)
        arrays = [pa.array(np.concatenate(h).view(np.int64)), pa.array(sh, pa.binary()), pa.array(p), batch.column("doc_id").take(pick), batch.column("th").take(pick)]
        return pa.RecordBatch.from_arrays(arrays, names=["h", "sh", "p", "doc_id", "th"])

    def pieces_of(df: DataFrame, spec, schema: str) -> DataFrame:
        return mapped(df.withColumnRenamed("ctx", "text"), lambda b: spec(b.rename_columns([{"text": "ctx"}.get(c, c) for c in b.schema.names])), schema)

    again = pieces_of(contexts.select("m", "ctx"), hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 2").select("h")
    again = materialise(again, "suffix-again")  # where it is small, by its own size on disk, the strings need no exchange
    places = pieces_of(contexts.select("m", "p0", "ctx", "doc_id", "th"), strings, f"h long, sh binary, p long, doc_id {id_type}, th long")
    places = materialise(hot_join(places, again, ["h"], "left_semi").drop("h"), "suffix-strings")
    at = F.struct("doc_id", "th", "p")
    ends = places.groupBy("sh").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("not (first <=> last)")
    ends = materialise(ends.select("sh", F.explode(F.array("first", "last")).alias("at")).select("sh", "at.*"), "suffix-ends")
    near = contexts.select(F.col("doc_id").alias("k1"), F.col("th").alias("k2"), "p0", "m", "ctx")
    inside = F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("k2")) & (F.col("p") >= F.col("p0")) & (F.col("p") < F.col("p0") + F.col("m"))
    ctx = F.substring("ctx", (F.col("p") - F.col("p0") + 1).cast("int"), F.lit(length))
    pairs = ends.join(near, inside).select(F.xxhash64("sh").alias("ah"), F.col("sh").alias("ch"), F.lit(1).alias("m"), F.lit(1).cast("long").alias("n"), F.col("p").alias("p0"), ctx.alias("ctx"), "doc_id", "th")
    sure = judged(pairs, length).withColumnsRenamed({"doc_id": "k1", "th": "k2"})
    sure = ends.join(sure, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("k2")) & (F.col("p") == F.col("a"))).select("sh").distinct()
    return hot_join(places, sure, ["sh"], "left_semi").select("doc_id", "th", F.col("p").alias("a"), (F.col("p") + 1).alias("b"))


def remove_repeats(df: DataFrame, length: int = 200, hot: int = HOT, kept: bool = False) -> DataFrame:
    """For each row of ``df`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256; with ``kept`` also the remaining bytes (cuts may fall inside a character)."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    docs = df.select("doc_id", text_or_empty(df).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(docs, length, hot).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "k1", "th": "k2"})
    both = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("k2")), "left").select("doc_id", "th", "spans", "text")

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, found in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"] + length - 1) for x in found or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            at, left = 0, []
            for a, b in merged:
                left.append(text[at:a])
                at = b
            rest = b"".join([*left, text[at:]])
            rows.append((len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
        n, gone, runs, sha, rest = zip(*rows, strict=True)
        new = {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha)}
        return with_columns(batch, new | ({"kept": pa.array(rest, pa.binary())} if kept else {}), drop=("th", "spans", "text"))

    return mapped(both, spec, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)
