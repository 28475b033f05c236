import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import scalar as S
from marginalia.operators import discretize as D
from marginalia.operators import linear as L
from marginalia.operators import marginals as M
from marginalia.operators import noise as N
from marginalia.operators.factor import CliqueVector, Factor, containing_cliques, eliminate, kron_answer, primal_feasibility
from marginalia.plans.schema import Domain, all_kway
from marginalia.streaming.marginals import release, windowed_marginals

DOM = Domain(("a", "b", "c"), (3, 4, 2))


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(rng.integers(n)) for n in DOM.shape) + (float(rng.random()),) for _ in range(500)]
    return spark.createDataFrame(rows, "a int, b int, c int, w double").cache(), rows


def counts(rows, attrs, weighted=False):
    x = np.zeros(DOM.project(attrs).shape)
    for r in rows:
        x[tuple(r[DOM.attrs.index(a)] for a in attrs)] += r[3] if weighted else 1
    return x


def array(factor):
    return np.array(factor.vector()).reshape(factor.domain.shape)


# --- coding ----------------------------------------------------------------------------------------------------------


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, -1.0, 2.5)], "v double")
    got = M.marginal(df, Domain(("v",), (3,)), ("v",)).orderBy("v").collect()
    assert [r["value"] for r in got] == [1.0, 1.0, 3.0]


def test_equal_width_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 5, 10)], "v double")
    assert [r[0] for r in df.select(S.equal_width(F.col("v"), 0, 10, 5)).collect()] == [0, 0, 0, 1, 1, 2, 4]
    const = spark.createDataFrame([(3.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in const.select(S.equal_width(F.col("v"), 3, 3, 2)).collect()] == [0, None, None]


def test_coder_round_trip(spark):
    df = spark.createDataFrame([(True, 1, 0.5, "x"), (False, 4, 9.5, "y"), (True, 2, 3.0, None), (None, 3, 7.25, "x")], "t boolean, i int, f double, s string")
    coder = D.Coder.fit(df, 4)
    assert coder.domain == Domain(("t", "i", "f", "s"), (2, 4, 4, 2))
    back = coder.backward(coder.forward(df)).collect()
    for got, r in zip(sorted(back, key=lambda r: r["f"]), sorted(df.collect(), key=lambda r: r["f"]), strict=True):
        assert got["t"] == r["t"] and got["s"] == r["s"] and abs(got["f"] - r["f"]) <= 9 / 8 + 0.01 and abs(got["i"] - r["i"]) <= 0.5
    again = D.Coder.from_json(coder.to_json())
    assert again == coder and coder.bins(spark).count() == 12
    assert D.Coder.fit(df, 4, shared_cap=True).domain["f"] == 3
    wild = spark.createDataFrame([(True, 9, 99.0, "z")], df.schema)
    assert coder.forward(wild).first()["s"] is None


def test_first_appearance_order(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "a"), (9, "c")], "at int, s string")
    assert D.dictionary(df, "s", "at") == ["c", "a", "b"] and D.dictionary(df, "s") == ["a", "b", "c"]
    assert {(r["value"], r["code"]) for r in D.rank_codes(df, "s").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_supports(spark):
    y, factors, keep = D.compress_measurement([100, 1, 80, 2], 5)
    assert keep == [0, 2] and y == pytest.approx([100, 80, 3 / 2**0.5]) and factors[-1] == pytest.approx(0.5**0.5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 2, 3, 2])], "id int, a int")
    merged = D.merge_unsupported(df, {"a": keep}).orderBy("id")
    assert [r["a"] for r in merged.collect()] == [0, 2, 1, 2, 1]
    back = [r["a"] for r in D.split_unsupported(merged, {"a": keep}, Domain(("a",), (4,)), ["id"]).orderBy("id").collect()]
    assert (back[0], back[2], back[4]) == (0, 2, 2) and {back[1], back[3]} <= {1, 3}


def test_embedding(spark):
    e = D.Embedding(DOM, {"b": [0, 3]})
    df = spark.createDataFrame([(0, 0, 0), (2, 3, 1), (1, 1, 1)], "a int, b int, c int")
    x = e.embed(df)
    assert [r["x_a"] for r in x.collect()] == pytest.approx([1 / 6, 5 / 6, 0.5])
    assert [tuple(r) for r in e.discretize(x).collect()] == [(0, 0, 0), (2, 1, 1), (1, 0, 1)]
    assert e.centers(spark, ("a", "b")).count() == 6 and e.dims([("c", "a")]) == [(2, 0)]
    kept = e.without_merged(spark, ("a", "b"))
    assert kept.filter("kept").count() == 6 and kept.count() == 9 and e.without_merged(spark, ("a",)) is None
    wild = spark.createDataFrame([(1.5, -0.2)], "x_a double, x_c double")
    assert tuple(e.project_manifold(wild).first()) == (1.0, 0.0)
    assert D.clean(spark.createDataFrame([(1, 2), (None, 3)], "`a.b` int, c int"), True).columns == ["c"]


# --- marginals --------------------------------------------------------------------------------------------------------


def test_three_plans_agree(coded):
    df, rows = coded
    cliques = all_kway(DOM, 2) + [("a",), ("c", "a")]
    plans = [f(df, DOM, cliques) for f in (M.marginals_exploded, M.marginals_kernel)]
    got = [sorted(map(tuple, p.collect())) for p in plans]
    want = sorted((i, j, v) for i, c in enumerate(cliques) for j, v in enumerate(counts(rows, c).ravel()) if v)
    assert got[0] == want and got[1] == want
    full = M.dense(plans[0], DOM, cliques)
    assert full.count() == sum(DOM.size(c) for c in cliques) and full.agg(F.sum("value")).first()[0] == len(rows) * len(cliques)


def test_weighted_and_odd_codes(spark, coded):
    df, rows = coded
    got = {(r["clique_id"], r["cell"]): r["value"] for r in M.marginals_kernel(df, DOM, [("a", "b")], "w").collect()}
    want = counts(rows, ("a", "b"), True).ravel()
    assert all(got[0, j] == pytest.approx(v) for j, v in enumerate(want) if v)
    odd = spark.createDataFrame([(0, 0), (None, 1), (-1, 0), (3, 9), (2, 3)], "a int, b int")
    for f in (M.marginals_kernel, M.marginals_exploded):
        assert sorted(tuple(r) for r in f(odd, DOM.project(("a", "b")), [("a", "b"), ("a",)]).collect()) == [(0, 0, 1.0), (0, 11, 1.0), (1, 0, 1.0), (1, 2, 2.0)]
    assert M.marginals_kernel(odd.limit(0), DOM.project(("a", "b")), [("a",)]).count() == 0


@pytest.mark.parametrize("most", [0, M.JOINT_CELLS])
def test_rows_of_few_kinds_are_counted_by_kind(spark, monkeypatch, most):
    monkeypatch.setattr(M, "JOINT_CELLS", most)
    odd = spark.createDataFrame([(0, 0), (None, 1), (-1, 0), (3, 9), (2, 3), (2, 3), (None, None)], "a int, b int")
    got = M.marginals_kernel(odd, DOM.project(("a", "b")), [("b", "a"), ("a",)])
    assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (0, 11, 2.0), (1, 0, 1.0), (1, 2, 3.0)]


def test_cache_answers_subsets(coded):
    df, rows = coded
    cache = M.MarginalCache(df, DOM, [("a", "b", "c")])
    assert np.array_equal(cache[("c", "a")].reshape(2, 3), counts(rows, ("c", "a"))) and cache.total() == 500
    with pytest.raises(KeyError):
        cache[("z",)]
    with pytest.raises(ValueError):
        M.MarginalCache(df, DOM, [("a", "b", "c")], most_cells=5)


def test_weights_that_are_probabilities(spark):
    df = spark.createDataFrame([(0, 0.25)] * 4, "a int, weight double")
    assert M.rescaled_weights(df).agg(F.sum("weight")).first()[0] == 4.0
    assert M.rescaled_weights(df.withColumn("weight", F.lit(2.0))).agg(F.sum("weight")).first()[0] == 8.0


def test_stream_form_equals_table(spark, coded):
    df, rows = coded
    timed = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("w") * 7200).cast("long")))
    got = windowed_marginals(timed, DOM, [("a", "b")], "ts").groupBy("cell").agg(F.sum("value").alias("v"))
    want = counts(rows, ("a", "b")).ravel()
    assert {r["cell"]: r["v"] for r in got.collect()} == {j: v for j, v in enumerate(want) if v}
    one = M.marginals_exploded(df, DOM, [("a", "b")])
    assert release(one, DOM, [("a", "b")], 1.0, 3).count() == 12


def test_real_stream(spark, tmp_path, coded):
    df, rows = coded
    df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).drop("w").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a int, b int, c int, ts timestamp").parquet(f"{tmp_path}/in")
    q = windowed_marginals(stream, DOM, [("a",)], "ts").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("value")).first()[0] == 500


# --- factors ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((3, 4)), rng.random((4, 2))
    return Factor.from_values(spark, DOM.project(("a", "b")), x.ravel()), Factor.from_values(spark, DOM.project(("b", "c")), y.ravel()), x, y


def test_factor_algebra(spark, pair):
    f, g, x, y = pair
    ones = np.ones
    assert array(f * g) == pytest.approx(x[:, :, None] * y) and array(f + g) == pytest.approx(x[:, :, None] + y)
    assert array(f.logaddexp(g)) == pytest.approx(np.logaddexp(x[:, :, None], y + 0 * x[:, :, None]))
    assert array((f * 3.0 + 1.0)) == pytest.approx(3 * x + 1) and array(2.0 * f) == pytest.approx(2 * x)
    assert array(f.sum(["a"])) == pytest.approx(x.sum(0)) and f.sum().scalar() == pytest.approx(x.sum()) and array(f.sum([])) == pytest.approx(x)
    assert f.log().logsumexp().scalar() == pytest.approx(np.log(x.sum())) and array(f.max(["b"])) == pytest.approx(x.max(1)) and f.max().scalar() == x.max()
    assert array(f.project(("b", "a"))) == pytest.approx(x.T) and array(f.log().project(("b",), "logsumexp")) == pytest.approx(np.log(x.sum(0)))
    assert array(f.condition({"a": 1})) == pytest.approx(x[1]) and array(f.condition({"b": slice(1, 3)})) == pytest.approx(x[:, 1:3])
    assert array(f.expand(DOM)) == pytest.approx(x[:, :, None] * ones((1, 1, 2)))
    assert array(f / f.sum(["a"])) == pytest.approx(x / x.sum(0)) and array(f.transpose(("b", "a"))) == pytest.approx(x.T) and f.copy() is f
    h = f
    h *= f.sum(["a"])
    assert array(h) == pytest.approx(x * x.sum(0))
    h = f
    h += f.sum(["b"])
    assert array(h) == pytest.approx(x + x.sum(1, keepdims=True))
    zero = Factor.active(spark, DOM.project(("b",)), [(2,)])
    assert array(f - zero) == pytest.approx(x) and array(zero).tolist() == [0, 0, -np.inf, 0]
    assert zero.logsumexp().scalar() == pytest.approx(np.log(3)) and (zero.condition({"b": 2})).logsumexp().scalar() == -np.inf
    assert array(f / Factor.zeros(spark, f.domain)).sum() == 0 and array(Factor.uniform(spark, f.domain)).sum() == pytest.approx(1)
    assert len(set(Factor.random(spark, f.domain).vector())) == 12 and array(f.exp()) == pytest.approx(np.exp(x)) and array(Factor.ones(spark, f.domain)).sum() == 12
    disjoint = Factor.from_values(spark, Domain(("z",), (2,)), [1.0, 2.0])
    assert array(f * disjoint) == pytest.approx(x[:, :, None] * np.array([1, 2]))
    for bad in (lambda: f.project(("a",), "mean"), lambda: Factor.from_values(spark, f.domain, [1.0]), lambda: f.__imul__(g), lambda: f.expand(DOM.project(("a",))), lambda: f.transpose(("a",))):
        with pytest.raises(ValueError):
            bad()


def test_elimination(pair):
    f, g, x, y = pair
    assert array(eliminate([f, g], ["b"]).transpose(("a", "c"))) == pytest.approx(x @ y)
    assert array(eliminate([f.log(), g.log()], ["b"], log=True).exp().transpose(("a", "c"))) == pytest.approx(x @ y)
    q = np.tril(np.ones((3, 3)))
    got = kron_answer([f, g], [("a", q.tolist())], ["a", "b"])
    assert array(got.transpose(("a_answer", "c"))) == pytest.approx(q @ x @ y)


def test_clique_vectors(spark, coded):
    df, rows = coded
    v = CliqueVector.from_data(df, DOM, [("a", "b"), ("b", "c")])
    assert v.size() == 20 and array(v.factor(("b", "c"))) == pytest.approx(counts(rows, ("b", "c")))
    want = (counts(rows, ("a", "b")) ** 2).sum() + (counts(rows, ("b", "c")) ** 2).sum()
    assert v.dot(v).first()[0] == pytest.approx(want) and (v + v - v).dot(v).first()[0] == pytest.approx(want) and (2.0 * v).dot(v).first()[0] == pytest.approx(2 * want)
    assert v.log().exp().dot(v).first()[0] == pytest.approx(want) and CliqueVector.ones(spark, DOM, v.cliques).dot(v).first()[0] == 1000
    assert CliqueVector.uniform(spark, DOM, v.cliques).rows.agg(F.sum("value")).first()[0] == pytest.approx(2) and CliqueVector.random(spark, DOM, v.cliques).rows.count() == 20
    assert CliqueVector.zeros(spark, DOM, v.cliques).combine(v).dot(v).first()[0] == pytest.approx(want)
    assert primal_feasibility(v).first()["gap"] == 0
    assert [tuple(r) for r in containing_cliques(spark, DOM, v.cliques, [("b",), ("a",), ("a", "c")]).orderBy("measured_id").collect()] == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        v + CliqueVector.ones(spark, DOM, [("a",)])


# --- linear queries -----------------------------------------------------------------------------------------------------


def test_linear_queries(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2, 3, (3, 4)).astype(float), rng.integers(-2, 3, (4, 4)).astype(float) + 3 * np.eye(4)
    A, B = L.Matrix(a), L.Matrix(b)
    haar = np.array([[1] * 4, [1, 1, -1, -1], [1, -1, 0, 0], [0, 0, 1, -1]], float)
    cases = [
        (A, a), (A.T, a.T), (A.gram(), a.T @ a), (2 * A, 2 * a), (A * 2 * -3, -6 * a), (A + A, 2 * a), (A - A, 0 * a), (A @ B, a @ b), (A * B, a @ b), (A[1], a[1:2]), (abs(A), abs(a)), (A.squared(), a * a),
        (L.Identity(4), np.eye(4)), (L.Ones(3, 4), np.ones((3, 4))), (L.Ones(3, 4).gram(), 3 * np.ones((4, 4))), (L.vstack([A, B]), np.vstack([a, b])), (L.hstack([B, A.T]), np.hstack([b, a.T])),
        (L.block_diag([A, B]), np.block([[a, np.zeros((3, 4))], [np.zeros((4, 4)), b]])), (L.vstack([A, B]).gram(), a.T @ a + b.T @ b), (L.vstack([A, B]).T, np.vstack([a, b]).T), (L.block_diag([A, B]).gram(), np.block([[a.T @ a, np.zeros((4, 4))], [np.zeros((4, 4)), b.T @ b]])),
        (L.Kronecker([A, B]), np.kron(a, b)), (L.Kronecker([A, L.Identity(2)]), np.kron(a, np.eye(2))), (L.Kronecker([A, B]).gram(), np.kron(a.T @ a, b.T @ b)), (L.Kronecker([A, B]).T, np.kron(a, b).T), (L.Haar(4), haar), (L.prefix(3), np.tril(np.ones((3, 3)))),
        (B.inv(spark), np.linalg.inv(b)), (A.pinv(spark), np.linalg.pinv(a)), ((2 * B).inv(spark), np.linalg.inv(2 * b)), (L.Ones(3, 4).pinv(spark), np.linalg.pinv(np.ones((3, 4)))), (L.Kronecker([B, B]).inv(spark), np.linalg.inv(np.kron(b, b))), ((A @ B).T, (a @ b).T), ((-2 * A).gram(), 4 * a.T @ a),
    ]
    for q, want in cases:
        assert q.shape == want.shape and q.dense(spark) == pytest.approx(want)
        v = rng.random(want.shape[1])
        vec = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "cell long, value double")
        got = np.zeros(want.shape[0])
        for r in q.apply(vec).collect():
            got[r["row"]] = r["value"]
        assert got == pytest.approx(want @ v)
    for q, want in ((A, a), (-2 * A, -2 * a), (L.Kronecker([A, B]), np.kron(a, b)), (L.Haar(4), haar)):
        assert q.l1_sensitivity(spark) == pytest.approx(abs(want).sum(0).max()) and q.l2_sensitivity(spark) == pytest.approx(np.sqrt((want**2).sum(0).max()))
    assert B.trace(spark) == pytest.approx(np.trace(b)) and L.Kronecker([B, B]).trace(spark) == pytest.approx(np.trace(b) ** 2)
    assert A.sums(spark).first()[0] == pytest.approx(a.sum()) and {r["row"]: r["value"] for r in A.sums(spark, 1).collect()} == pytest.approx({i: s for i, s in enumerate(a.sum(1)) if (a[i] != 0).any()})
    assert L.Matrix(a) == L.Matrix(a.copy()) and hash(L.Matrix(a)) == hash(L.Matrix(a.copy())) and L.Matrix(a) != L.Matrix(b) and A.ndim == 2
    for bad in (lambda: A @ A, lambda: A + B, lambda: L.Haar(6), lambda: L.vstack([A, L.Identity(2)])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        A * "x"


# --- noise ------------------------------------------------------------------------------------------------------------------


def test_noise_moments(spark):
    df = spark.range(40_000).select(F.lit(0).alias("clique_id"), F.col("id").alias("cell"), F.lit(10.0).alias("value"))
    for f, scale, var in ((N.with_gaussian_noise, 3.0, 9.0), (N.with_laplace_noise, 2.0, 8.0)):
        y = np.array([r["y"] for r in f(df, scale, 5).select("y").collect()]) - 10
        assert abs(y.mean()) < 0.06 and y.var() == pytest.approx(var, rel=0.06)
        again = f(df.repartition(7), scale, 5).orderBy("cell").limit(50).collect()
        assert [r["y"] for r in again] == [r["y"] for r in f(df, scale, 5).orderBy("cell").limit(50).collect()]


def test_noise_reaches_empty_cells(spark, coded):
    df, _ = coded
    got = N.measure_rows(df.filter("a = 0"), DOM, [("a", "b"), ("c",)], [1.0, 2.0], 3)
    assert got.count() == 14 and got.filter("clique_id = 0 and cell >= 4 and y <> 0").count() == 8 and {r["sigma"] for r in got.select("sigma").distinct().collect()} == {1.0, 2.0}


def test_selection(spark):
    scores = spark.createDataFrame([(i, float(s)) for i, s in enumerate([1.0, 5.0, 3.0])], "candidate int, score double")
    p = {r["candidate"]: r["p"] for r in N.selection_probabilities(scores, 2.0, 2.0).collect()}
    e = np.exp(0.5 * np.array([1, 5, 3.0]))
    assert [p[i] for i in range(3)] == pytest.approx(e / e.sum())
    rng = np.random.default_rng(0)
    picks = [N.exponential_mechanism(rng, {"x": 1.0, "y": 5.0, "z": 3.0}, 2.0, 2.0) for _ in range(3000)]
    assert picks.count("y") / 3000 == pytest.approx(e[1] / e.sum(), abs=0.03)
    assert N.exponential_mechanism(rng, {"x": 1.0, "y": 5.0}, 2.0, 2.0, {"x": 1.0, "y": 0.0}) == "x"


def test_small_functions(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"))], "a double, b double")
    r = df.select(S.nan_to_num(F.col("a")), S.nan_to_num(F.col("b")), S.norm(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert r[0] == 0 and r[1] > 1e300 and r[2] == 5
    nested = df.select(F.struct(F.lit(1).alias("x"), F.struct(F.lit(2).alias("z")).alias("y")).alias("s"), F.lit(3).alias("q"))
    assert S.flatten_struct(nested).columns == ["s_x", "s_y_z", "q"]


def test_whole_numbers_of_doubles(spark):
    halves = [i / 2 for i in range(-9, 10)] + [0.49999999999999994, -0.49999999999999994, 28.999999999999996, 0.285 * 100, 1e15 + 0.5, None]
    df = spark.createDataFrame([(v,) for v in halves], "v double")
    assert df.filter(~S.whole(F.col("v")).eqNullSafe(F.round("v"))).count() == 0
    assert "round(" not in df.select(S.whole(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert df.limit(1).select(F.isnan(S.whole(F.lit(float("nan"))))).first()[0]
