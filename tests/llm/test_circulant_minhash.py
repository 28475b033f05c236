import random
from itertools import combinations

import numpy as np
import pytest

from marginalia.llm import circulant_minhash as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, k):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = [sets_of(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for j, (x, _) in enumerate(rows) if root(j) == root(i) and x is not None]
        c = min(ids) if ids and sets[i] else d
        out.append((str(d), len(sets[i]), c, d == c))
    return sorted(out, key=str)


def variants(prose, n, words, edits, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = prose(seed, words).split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("unit,block", [(1000, 256), (8, 3)])
def test_against_all_pairs(frame, prose, odd_rows, monkeypatch, unit, block):
    monkeypatch.setattr(C, "UNIT_ROWS", unit)
    monkeypatch.setattr(C, "BLOCK", block)
    texts = variants(prose, 40, 120, 8, 1) + variants(prose, 30, 60, 2, 2) + [prose(50 + i, 40) for i in range(20)]
    shared = prose(77, 90)
    texts += [shared + " " + prose(900 + i, 30) for i in range(20)]  # a passage that many share
    chain = prose(5, 200).split()  # each links to the next only
    texts += [" ".join(chain[8 * i : 8 * i + 110]) for i in range(10)]
    rows = [r for r in odd_rows if len(r[1] or "") < 9000] + [(1000 - i, t) for i, t in enumerate(texts)] + [(2000, texts[0].upper()), (2001, texts[0])]
    got = C.near_duplicates(frame(rows).withColumnRenamed("lang", "n")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(((str(r[0]), r[1], r[2], r[3]) for r in got), key=str) == brute(rows, 4)


def test_signature_is_the_shifted_minimum():
    s = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 500, dtype=np.uint64))
    t = s[:7]
    both = C.signatures([s, t])
    first = (C.mix64(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    for shift in (0, 1, 127):
        y = [(int(x) + shift) % 2**32 for x in first]
        out = []
        for v in y:
            v = v * 0x9E3779B1 % 2**32
            v ^= v >> 15
            v = v * 0x85EBCA77 % 2**32
            v ^= v >> 13
            out.append(v * 0xC2B2AE3D % 2**32)
        assert both[0, shift] == min(out)
    assert (both[1] >= both[0]).all()


def test_bands_find_links_of_080():
    rng, missed = np.random.default_rng(1), 0
    for _ in range(200):
        n = int(rng.integers(9, 200))
        u = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        m = max(1, n // 9)
        keys = C.band_keys(C.signatures([u[m:], u[: n - m]] if n > 20 else [u[1:], u]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_keep_one(frame, prose, odd_rows):
    texts = variants(prose, 12, 120, 3, 4)
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(texts))]
    df = frame(rows).withColumnRenamed("lang", "full")
    got = C.keep_one(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    want = {str(d) for d, _, _, kept in brute(rows, 5) if kept}
    assert {str(i) for i in ids} == want and ids.count(5) == 1
    assert C.keep_one(frame([])).count() == 0 and C.near_duplicates(frame([])).count() == 0


def test_keep_one_tells_unlinked_texts_of_one_id_apart(frame, prose):
    a, b, c, d = (prose(i, 60) for i in (61, 62, 63, 64))
    rows = [(None, a), (None, b), (None, b + " more"), (7, c), (7, d), (7, d + " more"), (8, c + " more"), (9, a)]
    got = sorted((r["doc_id"] or 0, r["text"][:40]) for r in C.keep_one(frame(rows)).collect())
    assert got == sorted([(9, a[:40]), (0, b[:40]), (7, c[:40]), (7, d[:40])])
