"""Sets, dictionaries and answers kept as tables, against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marginalia.functions.scalar import gumbel
from marginalia.operators import evaluate, marginal_store, particle_tables
from marginalia.operators.containment import smallest_holders
from marginalia.operators.dictionaries import StoredDictionary
from marginalia.operators.marginal_store import MarginalStore, private_choice
from marginalia.operators.snapshots import Snapshots, inverse_curves
from marginalia.plans.schema import Domain

SETS = "id long, attrs array<string>"


def brute_holders(measured, models):
    out = {}
    for i, a in measured:
        fits = [] if a is None or None in a else [(n, k) for k, b, n in models if b is not None and set(a) <= set(b)]
        out[i] = min(fits)[1] if fits else None
    return out


def test_containment_against_all_pairs(spark):
    rng = random.Random(5)
    names = [f"a{i}" for i in range(30)]
    some = lambda k: ["a0"] * (rng.random() < 0.8) + [rng.choice(names) for _ in range(rng.randint(0, k))]
    models = [(i, some(12), rng.randint(1, 20)) for i in range(300)] + [(900, [], 1), (901, None, 0), (902, ["a1", "a1", "a2"], 1)]
    measured = [(i, some(3)) for i in range(500)] + [(900, []), (901, None), (902, ["a1", None]), (903, ["nowhere"]), (904, ["a2", "a1", "a2"])]
    got = smallest_holders(spark.createDataFrame(measured, SETS), spark.createDataFrame(models, f"{SETS}, cells long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["id"]: r["model_id"] for r in got.collect()} == brute_holders(measured, models)
    assert got.count() == len(measured)


def test_containment_in_no_models_and_of_no_sets(spark):
    none = spark.createDataFrame([], f"{SETS}, cells long")
    one = spark.createDataFrame([(1, ["a"]), (2, [])], SETS)
    assert {tuple(r) for r in smallest_holders(one, none).collect()} == {(1, None), (2, None)}
    assert smallest_holders(none.drop("cells"), one.withColumn("cells", F.lit(1))).count() == 0


def test_dictionary_keeps_its_codes_when_extended(spark):
    first = ["b", "a", None, "c", "a"] + ["hot"] * 200
    later = ["d", "a", "", "é", "B", "hot", None]
    known = StoredDictionary.create(spark, StringType())
    column = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "k int, v string")
    assert known.size() == 0 and known.extend(column(first), "v") == 4
    before = {r["value"]: r["code"] for r in known.rows().collect()}
    assert before == {v: i for i, v in enumerate(sorted({"a", "b", "c", "hot"}))}
    assert known.forward(column(later), "v").filter("v is not null").count() == 2
    again = StoredDictionary.open(spark, known.path)
    assert again.extend(column(later), "v") == 4 and again.extend(column(later), "v") == 0
    after = {r["value"]: r["code"] for r in again.rows().collect()}
    assert after == before | {v: 4 + i for i, v in enumerate(sorted({"d", "", "é", "B"}))}
    back = again.backward(again.forward(column(first + later), "v", "code"), "code", "w").collect()
    assert len(back) == len(first + later) and all(r["v"] == r["w"] for r in back)
    assert again.backward(spark.createDataFrame([(99,), (None,)], "v long"), "v").filter("v is not null").count() == 0


def test_dictionary_needs_a_free_path(spark, tmp_path):
    at = f"file://{tmp_path}/words"
    StoredDictionary.create(spark, StringType(), at)
    with pytest.raises(Exception, match="(?i)exist"):
        StoredDictionary.create(spark, StringType(), at)
    assert StoredDictionary.open(spark, at).extend(spark.createDataFrame([], "v string"), "v") == 0


ABCD = Domain.fromdict({"a": 3, "b": 4, "c": 2, "d": 5})
THREE = list(combinations(ABCD.attrs, 3))


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(2)
    x = np.stack([np.minimum(rng.integers(0, n, 120), rng.integers(0, n, 120)) for n in ABCD.shape], axis=1)
    return x, spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int, d int")


def counts(x, clique):
    at = [ABCD.attrs.index(a) for a in clique]
    out = np.zeros([ABCD.shape[i] for i in at])
    np.add.at(out, tuple(x[:, i] for i in at), 1)
    return out


@pytest.mark.parametrize("kernel", [10**6, 0])
def test_stored_answers_and_scores(coded, monkeypatch, kernel):
    x, df = coded
    monkeypatch.setattr(marginal_store, "KERNEL_CELLS", kernel)
    store = MarginalStore.of(df, ABCD, THREE)
    assert store.total == 120
    wanted = [("b", "d"), ("c",), ("d", "a", "b"), ("a", "c")]
    got = store.answers(wanted).toPandas()
    for i, c in enumerate(wanted):
        flat = np.zeros(ABCD.size(c))
        mine = got[got["clique_id"] == i]
        flat[mine["cell"].to_numpy()] = mine["value"].to_numpy()
        assert (flat == counts(x, c).ravel()).all() and (mine["value"] > 0).all()
    with pytest.raises(KeyError):
        store.answers([ABCD.attrs])
    scores = {r["clique_id"]: r["score"] for r in store.scores(store.independent(), 2.0, [1.0, 2.0, 3.0, 4.0]).collect()}
    for i, c in enumerate(THREE):
        singles = [counts(x, (a,)) / 120 for a in c]
        model = 120 * np.einsum("i,j,k->ijk", *singles)
        want = (i + 1) * (np.abs(counts(x, c) - model).sum() - math.sqrt(2 / math.pi) * 2 * ABCD.size(c))
        assert scores[i] == pytest.approx(want, abs=1e-9)


def test_store_of_no_rows(spark, coded):
    store = MarginalStore.of(coded[1].limit(0), ABCD, THREE)
    assert store.total == 0 and {r["gap"] for r in store.gaps(store.independent()).collect()} == {0.0}


def test_private_choice_is_the_noised_maximum(spark):
    scores = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "clique_id int, score double")
    noise = {r["clique_id"]: r["g"] for r in scores.select("clique_id", gumbel(11, F.col("clique_id")).alias("g")).collect()}
    want = max(noise, key=lambda i: 0.5 * 0.8 / 2 * (i % 7) + noise[i])
    assert private_choice(scores, 0.8, 2.0, 11).first()[0] == want
    assert private_choice(scores.repartition(5), 0.8, 2.0, 11).first()[0] == want
    assert private_choice(scores, 1e6, 1.0, 3).first()[0] % 7 == 6
    # over many keys the share of each score follows the softmax
    many = spark.range(20000).crossJoin(spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "c int, score double"))
    drawn = many.groupBy("id").agg(F.max_by("c", F.col("score") * 0.5 + gumbel(5, F.col("id"), F.col("c"))).alias("c")).groupBy("c").count()
    p = np.exp([0, 0.5, 1.5]) / np.exp([0, 0.5, 1.5]).sum()
    for r in drawn.collect():
        assert r["count"] / 20000 == pytest.approx(p[r["c"]], abs=0.015)


def test_measured_while_written(spark, coded, tmp_path):
    x, df = coded
    cliques = [("a", "d"), ("c",)]
    truth = evaluate.marginals_kernel(df, ABCD, cliques)
    odd = df.filter("b < 2").unionByName(spark.createDataFrame([(None, 1, 0, 0), (9, 1, 1, 1)], "a int, b int, c int, d int"))
    got = {r["clique_id"]: r for r in evaluate.write_measured(odd, ABCD, cliques, truth, f"{tmp_path}/rows").collect()}
    part = x[x[:, 1] < 2]
    both = [counts(part, c) for c in cliques]
    both[1] = both[1] + 1  # the two odd rows have a c each
    for i, c in enumerate(cliques):
        gap = both[i] / both[i].sum() - counts(x, c) / 120
        assert got[i]["l1"] == pytest.approx(np.abs(gap).sum()) and got[i]["variation"] == pytest.approx(np.abs(gap).sum() / 2)
        assert got[i]["l2"] == pytest.approx(np.sqrt((gap**2).sum())) and got[i]["records"] == len(part) + 2
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/rows").collect())) == sorted(map(str, odd.collect()))


def test_measured_empty_and_too_large(coded, tmp_path):
    none = coded[1].limit(0)
    truth = evaluate.marginals_kernel(coded[1], ABCD, [("c",)])
    assert [tuple(r) for r in evaluate.write_measured(none, ABCD, [("c",)], truth, f"{tmp_path}/none").collect()] == [(0, 0, None, None, None)]
    empty = truth.limit(0)
    assert [r["l1"] for r in evaluate.write_measured(coded[1], ABCD, [("c",)], empty, f"{tmp_path}/all").collect()] == [None]
    with pytest.raises(ValueError, match="too many"):
        evaluate.write_measured(none, Domain.fromdict({"a": 3000, "b": 4, "c": 2, "d": 5}), [("a",)], truth, f"{tmp_path}/wide")


def test_snapshots_and_curves(spark):
    rng = np.random.default_rng(8)
    kept, clouds = Snapshots.create(spark), {}
    for epoch, n in ((0, 300), (5, 41), (7, 1)):
        clouds[epoch] = np.round(rng.random((n, 2)), 1)  # many ties
        points = [(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(clouds[epoch])]
        kept.add(spark.createDataFrame(points, "pid long, x_a double, x_b double, m_a double"), epoch)
    assert kept.rows([5]).count() == 41 and set(kept.rows().columns) == {"pid", "x_a", "x_b", "epoch"}
    shares, thetas = [0.0, 0.25, 0.5, 1.0], [(1.0, 0.0), (0.6, 0.8)]
    got = {(r["epoch"], r["proj"], r["share"]): r["z"] for r in inverse_curves(kept.rows(), ["x_a", "x_b"], thetas, shares).collect()}
    assert len(got) == 3 * 2 * 4
    for (epoch, proj, share), z in got.items():
        own = np.sort(clouds[epoch] @ np.array(thetas[proj]))
        assert z == pytest.approx(own[int(np.floor(share * (len(own) - 1)))])


def test_descent_leaves_snapshots(spark):
    domain = Domain.fromdict({"a": 4, "b": 5})
    kept = Snapshots.create(spark)
    engine = particle_tables.TableParticleInference(domain, iters=3, n_directions=2, p_mask=0.0, snapshots=kept, snapshot_every=2)
    cells = spark.createDataFrame([(i, 0.25) for i in range(4)], "cell long, value double")
    end = engine.estimate(particle_tables.Cloud.random(spark, domain, 50, 3), [(("a",), cells)])
    assert {(r["epoch"], r["count"]) for r in kept.rows().groupBy("epoch").count().collect()} == {(0, 50), (2, 50)}
    last = kept.rows([2]).drop("epoch")
    assert last.exceptAll(end.rows.select(*last.columns)).count() == 0


def test_containment_moves_a_part_of_each_model(spark):
    """A model's row for a member brings its more frequent members alone, as ints: the numbers here don't compress."""
    rng = np.random.default_rng(4)
    models = [(k, sorted(int(v) for v in rng.choice(2**62, 100)), 100) for k in range(300)]
    measured = [(k, m[1][k % 90 : k % 90 + 3]) for k, m in enumerate(models)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    left, right = spark.createDataFrame(measured, "id long, attrs array<long>"), spark.createDataFrame(models, "id long, attrs array<long>, cells int")
    as_at_size = {"spark.sql.shuffle.partitions": "100", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # a model's rows part
    were, before = {k: spark.conf.get(k) for k in as_at_size}, written()
    for k, v in as_at_size.items():
        spark.conf.set(k, v)
    try:
        got = dict(smallest_holders(left, right).collect())
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert got == {k: k for k in range(300)}
    assert written() - before < 300 * 100 * 100 * 4
