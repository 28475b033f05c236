"""Benchmark decontamination with a generalised suffix automaton.

Test items are lower-cased (A-Z) and cut into words; one automaton holds all of them.
A document's words stream through it: each step keeps the length of the longest match
that ends there, and the state of that match leads, by suffix links, to every window
that ends there. A window is ``window`` consecutive item words; an item of fewer words
is a window of its own. Only stretches whose adjacent word pairs all occur in items can
hold a match, so the automaton runs on those; the pairs are looked up in bulk.

Items are dealt to blocks of about ``block_words`` words, long items in overlapping pieces.
Tasks build one automaton for each block and write it to the shared folder; the driver
broadcasts the blocks one by one and drops each after use, so its memory does not grow with
the benchmark. With one block the documents are matched in one pass and not shuffled; with
more, each block is a job that keeps the hits it finds, and a last pass joins them to the
documents, so a task never runs more than one Python worker with one automaton.

Defined cases: a null or empty text has no words and is clean; texts of any length are
matched whole, in time linear in their words; documents that repeat are judged each by
itself; an empty item has no window; items that repeat each count under their own id (rows
with equal ids once); null item ids are left out of the id list; an empty benchmark leaves
all documents clean; an empty table of documents gives an empty result; other columns may
have any names.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import mapped, materialise, text_or_empty, texts, with_columns

#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z: digits, a-z and every character beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


BLOCK_WORDS = 250_000  # benchmark words in one automaton, some hundred MB in a worker


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, word: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        new = len(self.next) - 1
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def extend(self, last: int, word: int) -> int:
        """Append ``word`` after state ``last``; returns the state of the longer prefix."""
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, p = len(self.next) - 1, last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def add(self, words: list[int]) -> None:
        state = 0
        for w in words:
            state = self.extend(state, w)

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest suffix of (match + ``word``) that occurs: its state and length."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        return (self.next[state][word], length + 1) if word in self.next[state] else (0, 0)

    def shortest(self, state: int, least: int) -> int:
        """The state, among ``state`` and its suffixes, that holds the suffix of ``least`` words."""
        while self.length[self.link[state]] >= least:
            state = self.link[state]
        return state


class ItemIndex:
    """The automaton of one block of items, and which items have a window that ends in a state."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.window, self.ids, self.vocabulary = window, [i for i, _ in items], {}
        seqs = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.translate(FOLD).split()] for _, text in items]
        self.automaton = SuffixAutomaton()
        for s in seqs:
            self.automaton.add(s)
        self.windows: dict[tuple[int, int], list[int]] = {}
        pairs = set()
        for k, s in enumerate(seqs):
            pairs.update(a * len(self.vocabulary) + b for a, b in zip(s, s[1:], strict=False))
            size = min(window, len(s))
            state = length = 0
            for j, w in enumerate(s):
                state, length = self.automaton.step(state, length, w)
                if size and j >= size - 1:
                    held = self.windows.setdefault((self.automaton.shortest(state, size), size), [])
                    if not held or held[-1] != k:
                        held.append(k)
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.sizes = sorted({size for _, size in self.windows})

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside occurrences of windows (merged, end exclusive), and the items they are of."""
        if not self.sizes or not words:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        linked = np.zeros(len(ids) + 1, bool)  # whether word i follows word i - 1 in some item
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(self.pairs) and len(both):
            key = ids[both - 1] * len(self.vocabulary) + ids[both]
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
            linked[both[found]] = True
        start = np.flatnonzero(known & ~linked[:-1])
        end = np.flatnonzero(known & ~linked[1:]) + 1
        enough = end - start >= self.sizes[0]
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        step, windows = self.automaton.step, self.windows
        for a, b in zip(start[enough].tolist(), end[enough].tolist(), strict=True):
            state = length = 0
            for j, w in enumerate(ids[a:b].tolist(), a + 1):
                state, length = step(state, length, w)
                for size in reversed(self.sizes):
                    if size <= length and (of := windows.get((self.automaton.shortest(state, size), size))):
                        items.update(of)
                        spans.append((j - size, j))
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_pieces(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """Distinct items as rows (item_id, words, n); one of more than ``piece_words`` words in pieces that overlap by all
    but one word of a window, so the pieces have the item's windows and no others."""

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item_id, text in zip(batch.column("item_id").to_pylist(), texts(batch), strict=True):
            words = text.translate(FOLD).split()
            step = max(1, piece_words - window + 1)
            for at in range(0, max(1, len(words) - window + 1), step):
                part = words[at : at + step + window - 1]
                rows.append((item_id, b" ".join(part), len(part)))
        ids, parts, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.binary()), pa.array(n, pa.int64())], names=["item_id", "words", "n"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty(benchmark).alias("text"))
    return mapped(rows, spec, "item_id string, words binary, n long").distinct()


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """A written table of (block, payload), a packed automaton each, and the number of blocks.

    Pieces of items are dealt to blocks by hash; a task builds each block's automaton, about ``block_words`` words.
    """
    pieces_ = item_pieces(benchmark, window, max(window, block_words // 8))
    total = pieces_.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)
    if not blocks:
        return pieces_, 0
    dealt = pieces_.filter("n > 0").select(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int").alias("block"), "item_id", "words")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "item_id")

    def run(batches):
        block, held = None, []

        def flush():
            payload = zlib.compress(pickle.dumps(ItemIndex(held, window)), 1)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([payload], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for at, item_id, words in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "words")), strict=True):
                if held and at != block:
                    yield flush()
                    held = []
                block = at
                held.append((item_id, words))
        if held:
            yield flush()

    return materialise(dealt.mapInArrow(run, "block int, payload binary"), "item-blocks", blocks), blocks


_opened: dict[str, ItemIndex] = {}
HITS = "hits array<struct<a: long, b: long>>, items array<string>"
SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def opened(key: str, sent) -> ItemIndex:
    """The automaton that the broadcast of this key carries; a worker keeps the last."""
    if key not in _opened:
        _opened.clear()
        _opened[key] = pickle.loads(zlib.decompress(sent.value)) if sent.value else ItemIndex([], 1)
    return _opened[key]


def block_sent(spark, table: DataFrame, block: int):
    """The broadcast of one block's automaton; the driver holds one at a time."""
    payload = [bytes(r["payload"]) for r in table.filter(F.col("block") == block).collect()]
    return spark.sparkContext.broadcast(payload[0] if payload else b"")


def matched(index: ItemIndex, batch: pa.RecordBatch) -> tuple[list[int], dict[str, pa.Array]]:
    """The number of words of each text, and its hits and items in one automaton."""
    n, hits, items = [], [], []
    for text in texts(batch):
        words = text.translate(FOLD).split()
        spans, of = index.match(words)
        n.append(len(words))
        hits.append([{"a": a, "b": b} for a, b in merge(spans)])
        items.append(sorted({index.ids[i] for i in of if index.ids[i] is not None}))
    return n, {"hits": pa.array(hits, SPANS), "items": pa.array(items, pa.list_(pa.string()))}


def block_hits(rows: DataFrame, table: DataFrame, block: int) -> DataFrame:
    """A written table (_at, hits, items) of the rows (_at, text) that one block's automaton finds anything in."""
    sent, key = block_sent(rows.sparkSession, table, block), uuid.uuid4().hex

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, new = matched(opened(key, sent), batch)
        return with_columns(batch, new, ("text",)).filter(pc.greater(pc.list_value_length(new["hits"]), 0))

    found = materialise(mapped(rows.select("_at", "text"), spec, f"_at long, {HITS}"), "block-hits")
    sent.destroy()
    return found


def match_items(df: DataFrame, benchmark: DataFrame, keep: list[str], window: int, block_words: int, last=None, last_schema: str = "") -> DataFrame:
    """Columns ``keep`` and text of ``df`` with n_words, hits (spans of words, merged) and items (ids as strings).

    A benchmark of one block is matched in one pass. One of more gets a job for each block over the texts, written once
    with a number each; a job keeps only what it finds, by number, and the last pass joins that to the texts. So a task
    runs one Python worker with one automaton, however many blocks there are.
    ``last`` maps the batches of the last pass to ``last_schema``.
    """
    df = df.select(*keep, text_or_empty(df).alias("text"))
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table, blocks = item_blocks(benchmark, window, block_words)
    schema = last_schema if last is not None else f"{given}, n_words long, {HITS}"
    if blocks <= 1:
        sent, key = block_sent(df.sparkSession, table, 0) if blocks else df.sparkSession.sparkContext.broadcast(b""), uuid.uuid4().hex

        def only(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, new = matched(opened(key, sent), batch)
            out = with_columns(batch, {"n_words": pa.array(n, pa.int64()), **new})
            return last(out) if last is not None else out

        return mapped(df, only, schema)
    rows = materialise(df.withColumn("_at", F.monotonically_increasing_id()), "texts")
    parts = [block_hits(rows, table, block) for block in range(blocks)]
    found = reduce(DataFrame.union, parts).groupBy("_at").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def combine(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [[{"a": a, "b": b} for a, b in merge([(x["a"], x["b"]) for x in h or ()])] for h in batch.column("hits").to_pylist()]
        items = [sorted(x or ()) for x in batch.column("items").to_pylist()]
        n = [len(t.translate(FOLD).split()) for t in texts(batch)]
        out = with_columns(batch, {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, SPANS), "items": pa.array(items, pa.list_(pa.string()))}, ("_at",))
        return last(out) if last is not None else out

    return mapped(rows.join(found, "_at", "left"), combine, schema)


def find_contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row (doc_id, text): n_words, n_hit, n_items, items_sha256 (ids sorted, comma-joined) and contaminated."""
    found = match_items(df, benchmark, ["doc_id"], window, block_words)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(text: bytes, hits: list[tuple[int, int]]) -> str:
    """``text`` without the bytes from the first to the last word of each span; what surrounds them stays."""
    at, out, k, places = 0, [], 0, []
    folded = text.translate(FOLD)
    for word in folded.split():  # where each word stands
        at = folded.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    at = 0
    for a, b in hits:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
        k += 1
    return b"".join([*out, text[at:]]).decode()


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``df``, with matching spans cut from ``text``. A document of which more than ``max_coverage`` of
    the words are hit goes altogether; others keep their remaining text, clean ones theirs unchanged (a null stays null)."""
    columns = df.columns
    prepared = df.select(F.struct(*columns).alias("_row"), "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("_row").field("text").to_pylist()
        spans = [[(x["a"], x["b"]) for x in h] for h in batch.column("hits").to_pylist()]
        few = [sum(b - a for a, b in h) <= max_coverage * max(n, 1) for h, n in zip(spans, batch.column("n_words").to_pylist(), strict=True)]
        new = [(remove_spans(t, h) if h else o) if f else None for t, h, o, f in zip(texts(batch), spans, old, few, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(new, pa.string())], names=["_row", "text"]).filter(pa.array(few, pa.bool_()))

    kept = match_items(prepared, benchmark, ["_row"], window, block_words, cut, f"_row {prepared.schema['_row'].dataType.simpleString()}, text string")
    return kept.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns))
