import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import packing as P
from marginalia.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def best_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(0, 64))
def test_the_fullest_combination(counts, room):
    got = P.fullest(counts, room)
    assert all(0 < k <= counts[n] for n, k in got.items())
    assert sum(n * k for n, k in got.items()) == best_sum(counts, room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), min_size=1, max_size=12))
def test_combinations_use_all_pieces_and_are_what_single_bins_would_be(counts):
    found = P.minimum_slack(counts, 50)
    used = Counter()
    for combination, times in found:
        assert sum(n * k for n, k in combination.items()) <= 50
        for n, k in combination.items():
            used[n] += k * times
    assert used == Counter(counts)
    left, bins = Counter(counts), 0
    while +left:  # one sequence after the other
        longest = max(+left)
        left[longest] -= 1
        for n, k in P.fullest(left, 50 - longest).items():
            left[n] -= k
        bins += 1
    assert bins == sum(t for _, t in found)
    table = P.places(found)
    length = np.repeat(list(counts), list(counts.values()))
    number = np.concatenate([np.arange(c) for c in counts.values()])
    covered(zip(length, *table.of(length, number), strict=True), 50)


def covered(rows, size):
    """Each sequence is gapless from 0 and within ``size``; returns how many there are."""
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def first_fit_decreasing(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(size - n)
        else:
            room[k] -= n
    return len(room)


@pytest.mark.parametrize("size", [2048, 64, 7])
def test_against_the_library_and_by_brute_force(spark, frame, prose, odd_rows, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(100 + i, prose(i, 1 + (i * 37) % 900)) for i in range(120)] + odd_rows
    df = frame(rows).repartition(5)
    got = P.checked_places(df, PATH, size).collect()
    want = Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
        want.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = covered(((r.length, r.sequence_id, r.offset) for r in got), size)
    lengths = [r.length for r in got]
    assert -(-sum(lengths) // size) <= n
    if size == 2048:
        assert n <= first_fit_decreasing(lengths, size)


def test_few_sequences_on_mixed_lengths():
    rng = random.Random(3)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(20000))
    bins = sum(t for _, t in P.minimum_slack(counts))
    assert bins - -(-sum(n * c for n, c in counts.items()) // 2048) <= 1


def test_sequences_hold_the_ids_of_their_pieces(spark, frame, prose):
    packed = P.pack_documents(frame([(i, prose(i, 60)) for i in range(50)]), PATH, 256)
    pieces = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in P.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(pieces[k] for k in sorted(pieces) if k[0] == r.sequence_id) and len(r.ids) == 4 * r.length <= 1024


def test_empty_table_clashing_columns_and_hot_lengths(spark, frame):
    assert P.checked_places(frame([]), PATH).collect() == []
    df = frame([(i, "") for i in range(5000)]).repartition(4)
    for c in ("task", "nth", "length", "ids", "piece", "start", "sequence_id", "offset", "_before", "n"):
        df = df.withColumn(c, F.lit("q"))
    got = P.checked_places(df, PATH).collect()
    assert sorted(r.doc_id for r in got) == list(range(5000)) and covered(((r.length, r.sequence_id, r.offset) for r in got), 2048) == 3


def test_an_end_id_outside_the_vocabulary_is_refused(spark, frame):
    with pytest.raises(ValueError, match="end_id"):
        P.encode_pieces(frame([(1, "a")]), PATH, end_id=10**7)
