import hashlib
import math
from collections import defaultdict

import pytest

from marginalia.llm import mixing as M


def brute(rows, quality, weights=(5, 2, 1), most=3):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    total, per = sum(size), defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:  # share, cap, share the excess again
        left, by = total - sum(most * per[s] for s in full), sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and w[s] * left >= most * per[s] * by}
        if not over:
            break
        full |= over
    for s in order:
        target[s] = float(most * per[s]) if s in full else w[s] * left / by
    groups = defaultdict(int)
    key = {}
    for i, ((d, t, s), n) in enumerate(zip(rows, size, strict=True)):
        h = hashlib.md5(f"{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        q = {1: 2.0, 0: 0.5}.get(quality.get(d), 1.0)
        key[i] = -math.log((int(h[:13], 16) + 0.5) / 2**52) / q
        groups[s, key[i]] += n
    taken_keys, epochs = defaultdict(set), {}
    for s in order:
        epochs[s] = min(most, int(target[s] // per[s])) if per[s] else 0
        rest, upto = target[s] - epochs[s] * per[s], 0
        for k in sorted(k for g, k in groups if g == s):
            n = groups[s, k]
            if rest > 0 and 2 * upto + n <= 2 * rest:
                taken_keys[s].add(k)
            upto += n
    return [(d, n, per[s], target[s], n * (epochs[s] + (key[i] in taken_keys[s] and n > 0))) for i, ((d, t, s), n) in enumerate(zip(rows, size, strict=True))]


def sample(prose):
    rows = [(i, prose(i, 3 + i % 37), f"s{min(i % 7, 3)}") for i in range(300)]
    rows += [(400, prose(1, 9), None), (401, None, None), (402, "", "empty"), (7, rows[7][1], rows[7][2]), (None, "a b", "é"), (None, None, "z"), (403, "a\x1cb\xa0c d", "z")]
    return rows


@pytest.mark.parametrize("slice_rows,sent", [(2000, 10_000), (7, 10_000), (1, 10_000), (7, 2)])
def test_against_brute_force(spark, frame, prose, monkeypatch, slice_rows, sent):
    monkeypatch.setattr(M, "SENT_SOURCES", sent)
    rows = sample(prose)
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None, 0) for i in range(0, 300, 3)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    quality = {i: (i % 2 if i % 5 else None) for i in range(0, 300, 3)}
    quality[3] = max(x for x in (quality[3], 0) if x is not None)
    want = brute(rows, quality)
    got = M.mix(frame(rows).withColumnRenamed("lang", "size").drop("size"), labels, slice_rows=slice_rows).collect()
    text = lambda rs: sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in rs)
    assert text(got) == text(want)


def test_targets_are_met_and_limited(spark, frame, prose):
    rows = sample(prose)
    got = M.mix(frame(rows)).collect()
    by = defaultdict(list)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
        by[r["source_size"], r["target"]].append(r)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    for (source_size, target), rs in by.items():
        alike = sum(n == source_size for n in sizes.values())  # sources of one size and target are judged together
        target *= alike if target == 3 * source_size else 1
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)


def test_rows_are_repeated(frame, prose):
    df = frame(sample(prose)).withColumnRenamed("lang", "epochs")
    want = {(r["doc_id"], r["size"]): r["taken"] for r in M.mix(df).collect() if r["size"]}
    got = defaultdict(int)
    mixed = M.mixed_rows(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        n = len((r["text"] or "").encode().split())
        if n:
            got[r["doc_id"], n] += n
    seven = [k for k in want if k[0] == 7]
    for k, v in want.items():
        assert got.get(k, 0) == v * (2 if k in seven else 1)


def test_empty_table(frame):
    assert M.mix(frame([])).count() == 0 and M.mixed_rows(frame([])).count() == 0
