import zlib

import numpy as np
import pytest

from marginalia.llm import quality_gam as Q
from marginalia.llm import toxicity_mil as T


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit(x[:3000], y[:3000], n_pairs=2)
    assert ((m.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in m.pairs


def test_gam_without_labels_or_with_one_kind():
    x = np.zeros((0, 3))
    assert Q.fit(x, np.zeros(0)).scores(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert Q.fit(np.ones((8, 3)), np.ones(8)).scores(np.ones((1, 3)))[0] == pytest.approx(0.9)


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_held_out(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in Q.classify_quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == held(i) for i, r in got.items())
    truth = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if held(r["doc_id"]) and r["doc_id"] in got]
    y, s = np.array([t for t, _ in truth]), np.array([p for _, p in truth])
    assert auc(y, s) > 0.95 and ((s >= 0.5) == y).mean() > 0.95


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in T.classify_toxicity(docs, labels).collect()}
    truth = [(r["toxic"], got[r["doc_id"]]["score"]) for r in labels.collect() if held(r["doc_id"]) and r["doc_id"] in got]
    y, s = np.array([t for t, _ in truth]), np.array([p for _, p in truth])
    assert auc(y, s) > 0.85 and ((s >= 0.7) == y).mean() > 0.9


def test_scores_of_odd_rows(frame, odd_rows, tables):
    docs, labels = tables
    df = frame(odd_rows).withColumnRenamed("lang", "score")
    for got in (Q.score_quality(df, Q.fit_quality(docs, labels), ["doc_id"]), T.score_toxicity(df, T.fit_toxicity(docs, labels), ["doc_id"])):
        rows = got.collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.classify_quality(frame([]), labels).count() == 0 and T.classify_toxicity(frame([]), labels).count() == 0


def test_noisy_or_and_places():
    m = T.MilModel(bias=-4.0, weights={b"awful": 6.0})
    score, parts = m.score("Fine day. You are AWFUL! Bye".encode(), {})
    p = [1 / (1 + np.exp(4)), 1 / (1 + np.exp(-2)), 1 / (1 + np.exp(4))]
    assert score == pytest.approx(1 - np.prod([1 - x for x in p]))
    assert [(a, b) for a, b, x in parts if x > 0.5] == [(9, 23)]


def test_training_finds_the_sentence():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for i in range(300):
        bag = [[b"w%d" % k for k in rng.integers(0, 40, 6)] for _ in range(5)]
        if i % 3 == 0:
            bag[int(rng.integers(5))].append(b"vile")
        bags.append(bag)
        y.append(float(i % 3 == 0))
    m = T.train(bags, np.array(y), np.ones(300))
    assert m.weights[b"vile"] > 3 and m.bias < -2


def test_reject_keeps_columns(frame):
    m = T.MilModel(bias=-5.0, weights={b"awful": 9.0})
    df = frame([(1, "awful thing"), (2, "good thing"), (3, None)]).withColumnRenamed("lang", "score")
    kept = T.reject_toxic(df, m)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
