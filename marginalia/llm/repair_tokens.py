"""Token ids in a binary file format compressed by Re-Pair grammars.

Texts are encoded with a public byte-level vocabulary, and an end id follows each document.
Documents are dealt by ranges of their id to shards and written in that order, in blocks
of about ``block_tokens`` tokens. Each block is a grammar of its own: the most frequent
pairs of adjacent ids are replaced by new symbols, again and again; the block stores the
rules, the expansion length of each, and where each document's symbols begin, so any
document, or any token of it, decodes without the rest.

A written table has a row per block: shard, block, doc_ids, n_tokens and payload, the
block's bytes; ``pack``/``unpack`` define them. Parquet only contains the payloads, so any
store that Spark writes to holds the files, and a lost executor's blocks are written again.

Payload, little endian: magic ``RPG1``; six uint64 (documents, rules, symbols, tokens, bytes
of a symbol, first rule id); rules as uint32 pairs; expansion lengths as uint32; symbols
before each document, and its tokens, as uint64; symbols; CRC-32 of all before.

Defined cases: a null or empty text is its end id alone; texts of any length are encoded
whole, and one longer than a block makes a block of its own; rows with equal ids stand in
order of their text's hash, and equal rows (id and text) in one shard; null ids come first;
an empty table makes no block; columns other than doc_id and text play no part, whatever
their names. A pair that occurs fewer than ``LEAST`` times in a block stays as it is: a rule
costs eight bytes in the file, and its expansion length four.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, pieces, ship, text_or_empty, texts, trim

MAGIC = b"RPG1"
LEAST = 16  # occurrences for a rule
#: Control characters, and white space other than blanks and line ends in any reading of it.
ODD_ASCII = bytes(b for b in range(32) if b != 10)
ODD_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
ODD_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")
ODD_BYTES = ODD_ASCII + bytes({c[0] for c in ODD_LEADS})
FIRST = "\x01"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # no letter, digit or white space in any reading of it
LONGEST = 64
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
POOL = 800_000  # words
PIECE = 9_000_000  # bytes of text encoded at once; each piece indexes the pool once, and holds some ten times its bytes


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def special_strings(path: str) -> re.Pattern[bytes]:
    """Matches the strings that the library takes out of a text before it cuts words."""
    return re.compile(b"|".join(re.escape(t.content.encode()) for t in tokenizer(path).get_added_tokens_decoder().values()) or b"(?!)")


@lru_cache(maxsize=2)
def id_widths(path: str) -> np.ndarray:
    """How many bytes each id stands for: one for each character of its byte-level name."""
    names = tokenizer(path).get_vocab()
    out = np.zeros(max(names.values()) + 1, np.int64)
    for name, i in names.items():
        out[i] = len(name)
    return out


def byte_lengths(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False)


def cut_marks(words: pa.Array) -> list[pa.Array]:
    """Each word without the ASCII punctuation at its end, and that punctuation after ``FIRST``.

    The vocabulary's pattern starts a piece where punctuation follows a letter or digit, so the ids of both make those of
    the word. Where the last character before is none of ASCII's or Latin's (up to U+027F), or more than ``LONGEST`` marks
    follow, the word stays whole.
    """
    stems = pc.ascii_rtrim(words, characters=MARKS)
    ends, data = np.frombuffer(stems.buffers()[1], np.int64, len(stems) + 1)[1:], np.frombuffer(stems.buffers()[2] or b"", np.uint8)
    data = np.append(np.zeros(2, np.uint8), data)
    last, lead = data[ends + 1], data[ends]
    latin = (lead >= 0xC3) & (lead <= 0xC9) & (last >= 0x80) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    cut = (byte_lengths(stems) > 0) & (ALNUM[last] | latin) & (byte_lengths(words) - byte_lengths(stems) <= LONGEST)
    stems = pc.if_else(pa.array(cut), stems, words)
    size = byte_lengths(words) - byte_lengths(stems)
    offsets = np.append(0, np.cumsum(size + 1))
    marks = np.full(offsets[-1], ord(FIRST), np.uint8)
    has = np.flatnonzero(size)
    if len(has):
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)[1:]
        end, ends, size = offsets[1:][has], ends[has], size[has]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        for j in range(1, int(size.max()) + 1):
            marks[end - j] = data[ends - j]
            more = size > j
            end, ends, size = end[more], ends[more], size[more]
    return [stems, pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(marks))]


def spans(values: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[start : start + size]`` of each index in ``of``, joined, and where each begins, with the end."""
    size = size[of]
    upto = np.append(0, np.cumsum(size))
    at = np.repeat(start.astype(np.int32)[of] - upto[:-1].astype(np.int32), size)  # a pool and a batch both have less than 2**31 ids
    at += np.arange(upto[-1], dtype=np.int32)
    return values[at], upto


class Encoder:
    """Encodes texts through the library; the ids of words met before come from a pool of bounded size.

    The vocabulary's pattern starts a piece at every single blank between other characters, and makes a single line end
    a piece of its own, so a text without other white space is the sum of its words. Other texts, and those with a special
    token's string, are encoded whole. Words are told apart and put together again for a whole batch at once, and the
    punctuation at a word's end is a word of its own, so that the library sees "word", "word," and "word." once.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.words = pa.array([], pa.large_string())  # FIRST marks a word that no blank precedes
        self.ids, self.size, self.used = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def shrink(self) -> None:
        """Keep the words that more than one batch has used (at most half a pool of them)."""
        keep = self.used > 1
        if keep.sum() > POOL // 2:
            keep = np.zeros(len(self.used), bool)
            keep[np.argpartition(-self.used, POOL // 2)[: POOL // 2]] = True
        self.words, self.ids = self.words.filter(pa.array(keep)), self.ids[np.repeat(keep, self.size)]
        self.size, self.used = self.size[keep], np.ones(int(keep.sum()), np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(tokenizer(self.path).encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Add distinct words to the pool, many in one call of the library; where each ends follows from the bytes of its ids.

        Returns the places of ``words`` in the pool.
        """
        width = id_widths(self.path)
        alone = pc.is_in(words, pa.array([FIRST, "\n"], words.type)).to_numpy(zero_copy_only=False)
        marked = pc.starts_with(words, FIRST).to_numpy(zero_copy_only=False) & ~alone
        order = [np.flatnonzero(~marked & ~alone), np.flatnonzero(marked), np.flatnonzero(alone)]
        ids, sizes = [], []
        for skip, at in enumerate(order[:2]):
            if not len(at):
                continue
            group = words.take(pa.array(at))
            if skip:
                group = pc.utf8_slice_codeunits(group, 1)
            names = group.to_pylist()
            names = [names[a : a + 200] for a in range(0, len(names), 200)]
            joined = ["\n".join(p) + "\n" if skip else " " + " ".join(p) for p in names]
            got = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer(self.path).encode_batch_fast(joined, add_special_tokens=False)])
            edge = np.append(0, np.searchsorted(np.cumsum(width[got]), np.cumsum(byte_lengths(group) + 1) - skip) + 1)
            if skip:  # the line end after each word is not its own
                keep = np.ones(len(got), bool)
                edge[1:] += 1
                keep[edge[1:] - 1] = False
                got, edge = got[keep], edge - np.arange(len(edge))
            ids.append(got)
            sizes.append(np.diff(edge))
        for i in order[2]:
            ids.append(self.whole(words[i].as_py().replace(FIRST, "")))
            sizes.append(np.array([len(ids[-1])]))
        order = np.concatenate(order)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(self.size), len(self.size) + len(words))
        self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
        self.ids, self.size = np.concatenate([self.ids, *ids]), np.concatenate([self.size, *sizes]).astype(np.int32)
        self.used = np.append(self.used, np.zeros(len(words), np.int32))
        return place

    def is_plain(self, data: bytes) -> bool:
        """Whether a text is the sum of its words. Cheap tests come first; what follows is only asked of few texts."""
        if data[:1] == b" " or data[-1:] == b" " or b"  " in data.replace(b"\n", b" ") or special_strings(self.path).search(data):
            return False
        if len(data.translate(None, ODD_BYTES)) == len(data):
            return True
        if len(data.translate(None, ODD_ASCII)) < len(data):
            return False
        return not any(c in data for c in ODD_LEADS) or not ODD_SPACE.search(data.decode())

    def encode(self, many: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8."""
        out: list = [None] * len(many)
        plain = []
        for i, data in enumerate(many):
            if self.is_plain(data):
                plain.append(i)
            else:
                out[i] = self.whole(data.decode())
        if not plain:
            return out
        line = b" \n " + FIRST.encode()
        marked = pa.array([FIRST.encode() + many[i].replace(b"\n", line) for i in plain], pa.large_binary()).view(pa.large_string())
        split = pc.split_pattern(marked, " ")
        offsets, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        del marked, split
        parts, word = pa.concat_arrays(cut_marks(coded.dictionary)).dictionary_encode(), coded.indices.to_numpy()
        del coded
        if len(self.words) > POOL:
            self.shrink()
        at = np.full(len(parts.dictionary), -1)
        of = pc.index_in(self.words, value_set=parts.dictionary).fill_null(-1).to_numpy()  # the smaller side is the one indexed
        known = np.flatnonzero(of >= 0)
        at[of[known]] = known
        new = at < 0
        if new.any():
            at[new] = self.learn(parts.dictionary.filter(pa.array(new)))
        self.used[at] += 1
        of = at[parts.indices.to_numpy()].reshape(2, -1).T.ravel()  # each word's stem, then its marks
        ids, upto = spans(self.ids, np.cumsum(self.size) - self.size, self.size, of)
        upto = upto[::2]
        ids, upto = spans(ids, upto[:-1], np.diff(upto), word)
        edge = upto[offsets]
        for k, i in enumerate(plain):
            out[i] = ids[edge[k] : edge[k + 1]]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker: its cache outlives a task."""
    return Encoder(path)


HASH_BITS = 18
SORTED = 1 << 16  # so few pairs are told apart by a sort
DENSE = 16  # what a round removes is cut out when it is this part of a block or more


def pair_numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the pairs (a, b) may occur ``LEAST`` times, the number of each of those, and the pairs by number.

    Pairs in thin buckets of a hash table go; in the others each pair has a number of its own.
    """
    if len(a) < SORTED:
        pairs, number = np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)
        return np.arange(len(a)), number, pairs
    bucket = a.view(np.uint32) * np.uint32(0x9E3779B1)
    bucket ^= b.view(np.uint32) * np.uint32(0x85EBCA77)
    bucket >>= np.uint32(32 - HASH_BITS)
    bucket = bucket.astype(np.intp)
    thick = np.bincount(bucket, minlength=1 << HASH_BITS) >= LEAST
    may = np.flatnonzero(thick[bucket])
    number, key = (np.cumsum(thick, dtype=np.int32) - 1)[bucket[may]], a[may].astype(np.int64)
    key <<= 32
    key |= b[may]
    pairs = np.zeros(int(thick.sum()), np.int64)
    pairs[number] = key
    other = np.flatnonzero(pairs[number] != key)  # a bucket numbers one of its pairs, a sort the others
    more, at = np.unique(key[other], return_inverse=True)
    number[other] = len(pairs) + at
    return may, number, np.append(pairs, more)


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one block. ``ends``: true at the last id of each document. Returns symbols, their ``ends``, and rules.

    A round counts pairs exactly and takes all that occur ``LEAST`` times; of overlapping occurrences the more frequent
    pair wins, and in a run of one pair every second counts. A pair left with fewer waits for the next round; the most
    frequent one never does, so rounds go on until no pair occurs ``LEAST`` times. A pair stays within a document.

    After the first round only ``live`` places are looked at: those of pairs that were frequent, and beside new symbols.
    Any other pair has become no more frequent than it was.
    """
    x, ends, rules = ids.astype(np.int32), ends.copy(), []
    live, after, held = ~ends, None, None  # until a round removes little, symbols stand side by side
    while True:
        places = np.flatnonzero(live)
        if len(places) < LEAST:
            break
        behind = places + 1 if after is None else after[places]
        a, b = x[places], x[behind]
        may, number, pairs = pair_numbers(a, b)
        live[places] = False
        places, behind, a, b = places[may], behind[may], a[may], b[may]
        count = np.bincount(number, minlength=len(pairs))
        twin = np.flatnonzero(a == b)
        if len(twin):
            at = np.arange(len(twin))
            run = np.append(False, behind[twin[:-1]] == places[twin[1:]])
            twin = twin[(at - np.maximum.accumulate(np.where(run, 0, at))) % 2 == 1]  # each second of a run is no occurrence
            count -= np.bincount(number[twin], minlength=len(pairs))
        top = np.flatnonzero(count >= LEAST)
        if not len(top):
            break
        top = top[np.argsort(-count[top], kind="stable")]
        rank_of = np.full(len(pairs), -1, np.int32)
        rank_of[top] = np.arange(len(top))
        rank = rank_of[number]
        live[places[np.flatnonzero(rank >= 0)]] = True
        rank[twin] = -1
        free = np.flatnonzero(rank >= 0)
        places, behind, rank = places[free], behind[free], rank[free]
        near = behind[:-1] == places[1:]
        won = np.ones(len(places), bool)
        won[1:] &= ~(near & (rank[:-1] < rank[1:]))
        won[:-1] &= ~(near & (rank[1:] < rank[:-1]))
        used = np.bincount(rank[won], minlength=len(top)) >= LEAST
        won = np.flatnonzero(won & used[rank])
        places, gone, rank = places[won], behind[won], rank[won]
        new = np.cumsum(used) - 1 + first_rule + len(rules)
        rules += [(pair >> 32, pair & 0xFFFFFFFF) for pair in pairs[top[used]].tolist()]
        x[places], ends[places] = new[rank], ends[gone]
        if held is None:
            held = np.ones(len(x), bool)
        held[gone] = live[gone] = False
        if DENSE * len(gone) >= len(x):
            places = (np.cumsum(held, dtype=np.int32) - 1)[places]  # a block has less than 2**31 ids
            x, ends, live = x[held], ends[held], live[held]
            after = held = None
            left = places - 1
        else:
            if after is None:
                after, before = np.arange(1, len(x) + 1), np.arange(-1, len(x) - 1)
            after[places] = after[gone]
            inside = after[places] < len(x)
            before[after[places][inside]] = places[inside]
            left = before[places]
        left = left[left >= 0]
        live[places], live[left] = ~ends[places], ~ends[left]
    if held is not None:
        x, ends = x[held], ends[held]
    return x, ends, np.array(rules, np.uint32).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only uses symbols before it."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first_rule] if a >= first_rule else 1) + (out[b - first_rule] if b >= first_rule else 1))
    return np.array(out, np.uint32)


def pack(docs: list[np.ndarray], first_rule: int) -> bytes:
    """The payload of a block of documents, each an array of ids that is not empty."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ids, ends = np.concatenate(docs), np.zeros(int(sizes.sum()), bool)
    ends[np.cumsum(sizes) - 1] = True
    x, ends, rules = compress(ids, ends, first_rule)
    width = 2 if first_rule + len(rules) <= 1 << 16 else 4
    starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    head = struct.pack("<6Q", len(docs), len(rules), len(x), len(ids), width, first_rule)
    parts = [MAGIC, head, rules.astype("<u4").tobytes(), expansion_lengths(rules, first_rule).astype("<u4").tobytes(), starts.astype("<u8").tobytes(), sizes.astype("<u8").tobytes(), x.astype(f"<u{width}").tobytes()]
    data = b"".join(parts)
    return data + struct.pack("<I", zlib.crc32(data))


class Block:
    """A payload opened for reading."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole block")
        docs, n_rules, symbols, self.n_tokens, width, self.first_rule = struct.unpack_from("<6Q", data, 4)
        at = 52

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.starts, self.sizes, self.symbols = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64), take(f"<u{width}", symbols)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All expansions in one array, and where each symbol's begins and how long it is."""
        out: list[list[int]] = []
        for a, b in self.rules.tolist():
            out.append((out[a - self.first_rule] if a >= self.first_rule else [a]) + (out[b - self.first_rule] if b >= self.first_rule else [b]))
        flat = np.append(np.arange(self.first_rule, dtype=np.uint32), np.fromiter(chain.from_iterable(out), np.uint32))
        size = np.concatenate([np.ones(self.first_rule, np.int32), self.lengths.astype(np.int32)])
        return flat, (np.cumsum(size) - size).astype(np.int32), size

    def expand(self, x: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        flat, start, size = self.table
        n = size[x]
        upto = np.cumsum(n)
        at = np.repeat(start[x] - (upto - n), n)
        at += np.arange(len(at))
        return flat[at]

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        return self.expand(self.symbols[self.starts[k] : end])

    def token(self, k: int, i: int) -> int:
        """Token ``i`` of document ``k``, without expanding the rest: lengths lead down the grammar."""
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        x = self.symbols[self.starts[k] : end].astype(np.int64)
        size = np.ones(len(x), np.int64)
        rule = x >= self.first_rule
        size[rule] = self.lengths[x[rule] - self.first_rule]
        upto = np.cumsum(size)
        at = int(np.searchsorted(upto, i, side="right"))
        i, symbol = i - int(upto[at] - size[at]), int(x[at])
        while symbol >= self.first_rule:
            a, b = (int(v) for v in self.rules[symbol - self.first_rule])
            n = int(self.lengths[a - self.first_rule]) if a >= self.first_rule else 1
            symbol, i = (a, i) if i < n else (b, i - n)
        return symbol


def blocks(df: DataFrame, path: str, end_id: int, first_rule: int, block_tokens: int = 1_000_000) -> DataFrame:
    """Rows (shard, block, doc_ids, n_tokens, payload), in order of (doc_id, hash of the text).

    Texts are dealt to shards by range and encoded where they arrive: text compresses better on its way than ids do.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    docs = df.select("doc_id", text_or_empty(df).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    ranged = docs.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    ship(df.sparkSession)
    end = np.uint32(end_id)

    def run(batches):
        shard, block, ids, docs, held, id_type = TaskContext.get().partitionId(), 0, [], [], 0, None

        def flush():
            arrays = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.int64()), pa.array([pack(docs, first_rule)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "doc_ids", "n_tokens", "payload"])

        for b in (p for batch in batches for p in pieces(batch, chars=PIECE)):
            id_type = b.schema.field("doc_id").type
            for doc_id, data in zip(b.column("doc_id").to_pylist(), encoder(path).encode(texts(b)), strict=True):
                x = np.append(data, end)
                if docs and held + len(x) > block_tokens:
                    yield flush()
                    block, ids, docs, held = block + 1, [], [], 0
                ids.append(doc_id)
                docs.append(x)
                held += len(x)
        if docs:
            yield flush()
        trim()

    return ranged.mapInArrow(run, f"shard int, block int, doc_ids array<{kind}>, n_tokens long, payload binary")


def write_tokens(df: DataFrame, path: str, out: str | None = None, end_id: int = 0, block_tokens: int = 1_000_000) -> DataFrame:
    """Encode and write ``df`` (doc_id, text); returns the written table, read back. ``out``: a folder, else in the shared one.

    ``path``: a byte-level vocabulary of any size; symbols of rules begin after its last id.
    """
    first_rule = len(id_widths(path))
    if not 0 <= end_id < first_rule:
        raise ValueError("end_id is no id of the vocabulary")
    table = blocks(df, path, end_id, first_rule, block_tokens)
    if out is None:
        return materialise(table, "token-blocks")
    table.write.mode("overwrite").parquet(out)
    return df.sparkSession.read.schema(table.schema).parquet(out)


def read_tokens(table: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from a written table."""
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    sums = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard")) - F.col("n")  # a row per shard
    at = sums.select("shard", before.alias("shard_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    starts = table.select("shard", "block", "n_tokens").withColumn("in_shard", within).join(at, "shard")
    starts = starts.select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("start"))

    def run(batches):
        for b in batches:
            for shard, block, ids, payload in zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), b.column("doc_ids"), b.column("payload"), strict=True):
                opened = Block(payload.as_py())
                n = opened.sizes
                x, end = memoryview(opened.expand(opened.symbols).astype("<u4").tobytes()), np.append(0, 4 * np.cumsum(n)).tolist()
                crc = [zlib.crc32(x[i:j]) for i, j in zip(end, end[1:], strict=False)]
                at = [pa.array(np.full(len(n), v, np.int32)) for v in (shard, block)]
                yield pa.RecordBatch.from_arrays([*at, ids.values, pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "in_block", "n_tokens", "ids_crc32"])

    read = table.select("shard", "block", "doc_ids", "payload").mapInArrow(run, f"shard int, block int, doc_id {kind}, in_block long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")
