import json
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import cli
from marginalia.operators import particles as K
from marginalia.operators import pgm as E
from marginalia.operators import transport as T
from marginalia.operators.evaluate import Evaluator, Logger, marginal_gaps, wasserstein
from marginalia.operators.mechanisms import AIM, MST, MWEM, KWay, filter_candidates, model_megabytes, pair_gaps
from marginalia.plans.graph import JunctionTree
from marginalia.plans.privacy import Budget
from marginalia.plans.schema import Domain, all_kway
from marginalia.sources import tables as Src

DOM = Domain(("a", "b", "c", "d"), (3, 2, 4, 2))
CLIQUES = [("a", "b"), ("b", "c"), ("c", "d")]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, 3000)
    b = (rng.random(3000) < 0.2 + 0.3 * a).astype(int)
    c = np.minimum(3, b * 2 + rng.integers(0, 2, 3000))
    d = (rng.random(3000) < 0.1 + 0.25 * c).astype(int)
    x = np.stack([a, np.minimum(b, 1), c, d], 1)
    return spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int, d int").cache(), x


def joint_of(model):
    log = np.zeros(DOM.shape)
    for c, p in model.potentials.items():
        log = log + E.Table(DOM.project(c), p)._like(DOM)
    e = np.exp(log - log.max())
    return e / e.sum() * model.total


def true(x, attrs):
    out = np.zeros(DOM.project(attrs).shape)
    np.add.at(out, tuple(x[:, DOM.axes(attrs)].T), 1)
    return out


def test_propagation_equals_brute_force():
    rng = np.random.default_rng(0)
    model = E.GraphicalModel.over(DOM, [("a", "b"), ("b", "c"), ("a", "c"), ("d",)], 100.0)
    model.potentials = {c: rng.normal(size=DOM.project(c).shape) for c in model.cliques}
    model.potentials[model.cliques[0]].flat[0] = -np.inf
    joint = joint_of(model)
    model.marginals = model.propagate()
    for c, m in model.marginals.items():
        assert m == pytest.approx(joint.sum(axis=DOM.axes(DOM.invert(c))))
    assert model.joint() == pytest.approx(joint)
    want = {q: np.transpose(joint.sum(axis=DOM.axes(DOM.invert(q))), [DOM.canonical(q).index(a) for a in q]) for q in [("d", "a"), ("c",), ("b", "d"), ("c", "a")]}
    for q, w in want.items():
        assert model.project(q) == pytest.approx(w)
    got = model.many(want)
    assert all(got[q] == pytest.approx(w) for q, w in want.items())


def test_fit_on_a_decomposable_model(spark, data, tmp_path):
    df, x = data
    model = E.GraphicalModel.over(DOM, CLIQUES).fit(df)
    for c in CLIQUES:
        assert model.propagate()[c] == pytest.approx(true(x, c), abs=1e-6)
    p = E.tree_potentials(df, DOM, JunctionTree(DOM, CLIQUES))
    got = np.array(E.tree_marginal(p, DOM, ("a", "d")).vector()).reshape(3, 2)
    assert got == pytest.approx(model.project(("a", "d")))
    model.save(spark, f"file://{tmp_path}/m")
    assert E.GraphicalModel.load(spark, f"file://{tmp_path}/m").project(("a", "d")) == pytest.approx(model.project(("a", "d")))


def test_mirror_descent_reaches_exact_measurements(data):
    _, x = data
    measured = [E.Measurement(c, true(x, c).ravel(), 1.0) for c in CLIQUES]
    model = E.FactoredInference(DOM, iters=2000).estimate(measured)
    assert model.total == pytest.approx(3000)
    for c in CLIQUES:
        assert np.abs(model.project(c) - true(x, c)).sum() < 6
    prefix = np.tril(np.ones((4, 4)))
    q = E.FactoredInference(DOM, iters=800).estimate([(prefix, prefix @ true(x, ("c",)), 1.0, "c")], 3000)
    assert q.project(("c",)) == pytest.approx(true(x, ("c",)), abs=2)
    empty = E.FactoredInference(DOM).estimate([], 10)
    assert empty.project(("a",)) == pytest.approx([10 / 3] * 3)
    zeros = E.FactoredInference(DOM, iters=200, structural_zeros={("a", "b"): [(0, 0)]}).estimate(measured)
    assert zeros.project(("a", "b"))[0, 0] == 0


@pytest.mark.parametrize("total", [6e4, 3.6e7, 2.16e8])
def test_descent_at_any_total(total):
    """Steps shrink with the total: noise far below a row needs one far under 2^-25."""
    x = np.array([[5.0, 1], [2, 8], [4, 4]])
    x *= total / x.sum()
    model = E.FactoredInference(DOM).estimate([E.Measurement(("a", "b"), x.ravel(), 0.02)], total)
    assert model.project(("a", "b")) == pytest.approx(x, rel=1e-6)


def test_options_of_inference(data):
    _, x = data
    measured = [E.Measurement(("a", "b"), true(x, ("a", "b")).ravel(), 1.0)]
    log = Logger({("a", "b"): true(x, ("a", "b"))}, frequency=1)
    engine = E.FactoredInference(DOM, iters=30, warm_start=True, callback=log)
    engine.estimate(measured)
    first = engine.final_loss
    engine.estimate(measured)
    assert engine.final_loss <= first and log.rows[-1]["l1"] < log.rows[0]["l1"] + 1e-9
    slow = E.FactoredInference(DOM, iters=5, lr=None)
    slow.estimate(measured)
    assert np.isfinite(slow.final_loss)
    own = E.FactoredInference(DOM, iters=50, metric=lambda mu: (float(sum(((m - 5) ** 2).sum() for m in mu.values())), {c: 2 * (m - 5) for c, m in mu.items()}))
    own.estimate(measured, 30.0)
    assert own.model.project(("a", "b")) == pytest.approx(np.full((3, 2), 5.0), abs=0.01)


def test_bad_measurements():
    for bad in ((None, [1.0], 1.0, "z"), (None, [1.0], 1.0, "a"), (None, [1.0, 1, 1], 0.0, "a"), (np.eye(2), [1.0, 1], 1.0, "a")):
        with pytest.raises(ValueError):
            E.fix_measurements(DOM, [bad])
    ms = E.fix_measurements(DOM, [(None, [10.0, 20, 30], 2.0, "a"), (np.ones((1, 2)), [70.0], 1.0, ("b",)), (np.eye(4)[:2], [1.0, 2], 1.0, "c")])
    w1, w2 = 1 / (4 * 3), 1 / 1
    assert E.estimate_total(ms) == pytest.approx((60 * w1 + 70 * w2) / (w1 + w2)) and E.estimate_total([]) == 1.0


@pytest.mark.parametrize("method", ["sample", "round"])
def test_sampling(spark, data, method):
    df, x = data
    model = E.GraphicalModel.over(DOM, CLIQUES).fit(df)
    rows = model.synthetic(spark, 6000, method, seed=4).cache()
    assert rows.count() == 6000 and rows.columns == list(DOM.attrs)
    for c in CLIQUES:
        got = np.zeros(DOM.project(c).shape)
        for r in rows.groupBy(*c).count().collect():
            got[tuple(r[a] for a in c)] = r["count"]
        assert np.abs(got / 6000 - true(x, c) / 3000).sum() < (0.08 if method == "sample" else 0.05)
    again = model.synthetic(spark, 6000, method, seed=4)
    assert rows.exceptAll(again).count() == 0


def test_allocation(spark):
    df = spark.createDataFrame([("x", 0, 1.0, 10), ("x", 1, 1.0, 10), ("x", 2, 1.0, 10), ("y", 0, 3.0, 7), ("y", 1, 4.0, 7)], "g string, cell int, value double, total int")
    got = {(r["g"], r["cell"]): r["n"] for r in E.round_allocation(df, "total", ["g"]).collect()}
    assert got == {("x", 0): 4, ("x", 1): 3, ("x", 2): 3, ("y", 0): 3, ("y", 1): 4}


# --- transport -----------------------------------------------------------------------------------------------------------


def test_w1(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random(60), rng.random(60)
    a, b = (spark.createDataFrame([(float(v),) for v in s], "z double") for s in (x, y))
    thetas = [(1.0,)]
    got = T.sliced_w1(a, b, ["z"], thetas).first()["sw1"]
    assert got == pytest.approx(np.abs(np.sort(x) - np.sort(y)).mean()) and T.sliced_w1(a, a, ["z"], thetas).first()["sw1"] == pytest.approx(0, abs=1e-12)
    shifted = a.select((F.col("z") + 0.25).alias("z"))
    assert T.sliced_w1(a, shifted, ["z"], thetas).first()["sw1"] == pytest.approx(0.25)


def test_w2_and_gradient(spark):
    rng = np.random.default_rng(1)
    x, y, thetas = rng.random((30, 2)), rng.random((30, 2)), T.directions(2, 4, 7)
    a, b = (spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(s)], "pid int, x double, y double") for s in (x, y))
    value, grad = 0.0, np.zeros_like(x)
    for t in thetas:
        zx, zy = x @ t, np.sort(y @ t)
        gap = np.empty(30)
        gap[np.argsort(zx)] = np.sort(zx) - zy
        value += (gap**2).mean() / 4
        grad += 100 * 2 * gap[:, None] * t / 4
    assert T.sliced_w2(a, b, ["x", "y"], thetas.tolist()).first()[0] == pytest.approx(value)
    got = T.sliced_w2_gradient(a, b, ["x", "y"], thetas.tolist()).orderBy("pid").collect()
    assert np.array([(r["g_x"], r["g_y"]) for r in got]) == pytest.approx(grad)


def test_sw1_gradient_by_differences():
    rng = np.random.default_rng(3)
    u, v, pts, th = rng.dirichlet(np.ones(9)), rng.dirichlet(np.ones(9)), rng.random((9, 2)), T.directions(2, 5)
    _, g = K.sliced_w1_value_and_gradient(u, v, pts, th)
    for i, j in ((0, 3), (5, 2)):
        step = np.zeros(9)
        step[i], step[j] = 1e-7, -1e-7
        num = (K.sliced_w1_value_and_gradient(u + step, v, pts, th)[0] - K.sliced_w1_value_and_gradient(u - step, v, pts, th)[0]) / 2e-7
        assert g[i] - g[j] == pytest.approx(num, abs=1e-5)


def test_distances(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 3.0)], "i int, x double, y double")
    b = a.withColumnRenamed("i", "j")
    got = {(r["i"], r["j"]): r["dist"] for r in T.distances(a, b, ["x", "y"]).collect()}
    assert got[0, 1] == 3.0 and {(r["i"], r["j"]): r["dist"] for r in T.distances(a, b, ["x", "y"], 2).collect()}[0, 1] == pytest.approx(10**0.5)


def test_sinkhorn():
    rng = np.random.default_rng(0)
    a, b, x = rng.dirichlet(np.ones(5)), rng.dirichlet(np.ones(5)), np.sort(rng.random(5))
    cost = np.abs(x[:, None] - x[None, :])
    value, plan = T.sinkhorn_gradient_locations(a, b, cost, 0.005)
    assert plan.sum(1) == pytest.approx(a, abs=1e-6) and value == pytest.approx((np.abs(np.cumsum(a - b))[:-1] * np.diff(x)).sum(), abs=0.01)
    assert np.abs(T.sinkhorn_divergence_gradient(a, a, cost, cost, 0.5)).max() < 1e-6
    assert T.sinkhorn_gradient_weights(a, b, cost, 0.05)[1] == pytest.approx(T.sinkhorn_gradient(a, b, cost, 0.05))
    p = T.nearest_probability(np.array([0.5, -0.1, 0.6, 0.0]), np.abs(np.subtract.outer(np.arange(4), np.arange(4))).astype(float))
    assert p.sum() == pytest.approx(1) and (p >= 0).all() and T.nearest_probability(a, cost) is not None


@pytest.mark.parametrize("seed", range(8))
def test_nearest_probability_against_all_moves(seed):
    """Whole units of a tenth: every way to fill the negative cells from what exceeds a total of 1."""
    rng = np.random.default_rng(seed)
    n = 4
    x = rng.random((n, 2))
    cost = np.abs(x[:, None] - x[None]).max(-1) * rng.choice([0.5, 3.0])
    v = rng.integers(-2, 7, n).astype(float)
    v[v.argmax()] += max(0, 10 - np.maximum(v, 0).sum() + rng.integers(0, 3))

    def best(have, need, spare):
        j = next((j for j in range(n) if need[j]), None)
        if j is None or not spare:
            return 2.0 * sum(need)
        out = 2.0 + best(have, [m - (k == j) for k, m in enumerate(need)], spare)
        for i in range(n):
            if have[i]:
                out = min(out, cost[i, j] + best([h - (k == i) for k, h in enumerate(have)], [m - (k == j) for k, m in enumerate(need)], spare - 1))
        return out

    have, need = [int(max(0, y)) for y in v], [int(max(0, -y)) for y in v]
    spare = max(0, sum(have) - 10)
    p = T.nearest_probability(v / 10, cost)
    assert p.sum() == pytest.approx(1) and (p >= 0).all()
    if sum(need) and spare >= sum(need):  # all of it can be moved; what is left tells what was, up to scale
        left = p * (sum(have) - sum(need)) if best(have, need, spare) < 2.0 * sum(need) and (cost < 2).all() else None
        if left is not None:
            moved = np.array(have) - left
            assert (moved > -1e-6).all() and moved.sum() == pytest.approx(sum(need))
            ways = best([round(m) for m in moved], need, sum(need))
            assert ways == pytest.approx(best(have, need, spare))


def test_nearest_probability_keeps_what_is_one():
    cost = np.abs(np.subtract.outer(np.arange(3), np.arange(3))).astype(float)
    assert T.nearest_probability(np.array([0.2, 0.5, 0.3]), cost) == pytest.approx([0.2, 0.5, 0.3])
    assert T.nearest_probability(np.array([-0.2, -0.5, 0.0]), cost) == pytest.approx([1 / 3] * 3)
    assert T.nearest_probability(np.array([0.4, -0.5, 0.4]), cost) == pytest.approx([0.5, 0, 0.5])  # too little to give any away


# --- particles -------------------------------------------------------------------------------------------------------------


def test_projection_and_quantisation(spark):
    pts = K.cell_centers(Domain(("a", "b"), (3, 2)), ("a", "b"))
    v = np.array([0.4, -0.05, 0.3, 0.1, 0.2, 0.05])
    p = K.project_to_probabilities(v, pts, iters=200, n_directions=10)
    assert p.sum() == pytest.approx(1) and (p >= 0).all() and np.abs(p - np.maximum(v, 0)).sum() < 0.25
    q = K.quantise(pts, p, 500)
    assert len(q) == 500
    cells = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "cell int, p double")
    counts = {r["cell"]: r["count"] for r in K.quantise_rows(cells, 500).groupBy("cell").count().collect()}
    assert sum(counts.values()) == 500 and all(abs(counts.get(i, 0) - 500 * x) <= 1 for i, x in enumerate(p))
    m = K.mask((50, 4), 80, np.random.default_rng(0))
    assert (m == 0).sum() == 160


def test_particles_fit_marginals(spark, data, tmp_path):
    _, x = data
    measured = [E.Measurement(c, true(x, c).ravel(), 1.0) for c in CLIQUES]
    engine = K.ParticleInference(DOM, n_particles=1500, iters=60, proj_iters=20, proj_directions=10)
    model = engine.estimate(spark, measured)
    for c in CLIQUES:
        assert np.abs(model.project(c) / 1500 - true(x, c) / 3000).sum() < 0.35
    assert model.datavector().sum() == pytest.approx(1500) and model.synthetic(spark).count() == 1500 and model.synthetic(spark, 77).count() == 77
    model.save(spark, f"file://{tmp_path}/p")
    assert K.ParticleModel.load(spark, f"file://{tmp_path}/p").x == pytest.approx(model.x)
    con = K.ThresholdConstraint([[1.0, 0, 0, 0]], [0.5], [0.9])
    held = K.ParticleInference(DOM, n_particles=500, iters=30, proj_iters=5, proj_directions=5, constraint=con, scale_reg=200.0, p_mask=0).estimate(spark, measured)
    free = K.ParticleInference(DOM, n_particles=500, iters=30, proj_iters=5, proj_directions=5, p_mask=0).estimate(spark, measured)
    assert con(held.x)[0] < con(free.x)[0]
    loss, g = con(held.x)
    step = np.zeros_like(held.x)
    step[3, 0] = 1e-6
    assert (con(held.x + step)[0] - con(held.x - step)[0]) / 2e-6 == pytest.approx(g[3, 0], abs=1e-6)
    init = K.ParticleInference(DOM, iters=1, proj_iters=2, proj_directions=2, data_init=x[:200]).estimate(spark, measured)
    assert len(init.x) == 200


# --- mechanisms and evaluation ------------------------------------------------------------------------------------------------


def test_evaluation(spark, data):
    df, x = data
    other = df.withColumn("d", 1 - F.col("d"))
    gaps = {r["clique_id"]: (r["l1"], r["l2"]) for r in marginal_gaps(df, other, DOM, [("d",), ("a",)]).collect()}
    p = true(x, ("d",)) / 3000
    assert gaps[0][0] == pytest.approx(2 * abs(p[0] - p[1])) and gaps[1] == (0, 0)
    w = {r["clique_id"]: r["w1"] for r in wasserstein(df, other, DOM, [("d",), ("a", "b")]).collect()}
    assert w[0] == pytest.approx(0.5 * abs(p[0] - p[1])) and w[1] == pytest.approx(0, abs=1e-9)
    ev = Evaluator(df, other, DOM, all_kway(DOM, 2), undo=lambda s: s.withColumn("d", 1 - F.col("d")), n_directions=5)
    metrics, each = ev.evaluate()
    assert metrics["l1_max"] == pytest.approx(0) and metrics["w_max"] == pytest.approx(0, abs=1e-9) and len(each) == 6
    ev.set_compression(lambda s: s)
    ev.update_synth(df.limit(1000))
    assert ev.evaluate()[0]["l1_avg"] > 0
    empty = marginal_gaps(df, df.limit(0), DOM, [("d",)]).first()
    assert empty["l1"] == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["kway", "mst", "mwem", "aim"])
def test_utility_grows_with_epsilon(spark, data, name):
    df, _ = data
    errors = []
    for eps in (0.02, 20.0):
        b = Budget(eps, 1e-5, seed=3)
        mech = {"kway": lambda b=b: KWay(b), "mst": lambda b=b: MST(b, 200), "mwem": lambda b=b: MWEM(b, 3), "aim": lambda b=b: AIM(b, 6)}[name]()
        synth = mech.run(df, DOM, E.FactoredInference(DOM, iters=150), all_kway(DOM, 2), 2000)
        assert synth.count() == 2000
        errors.append(marginal_gaps(df, synth, DOM, all_kway(DOM, 2)).agg(F.avg("l1")).first()[0])
    assert errors[1] < errors[0] and errors[1] < 0.35


def test_budgets_are_kept(spark, data):
    df, _ = data
    b = Budget(1.0, 1e-5)
    for rounds in (4, 6):
        aim = AIM(b, rounds, structural_zeros={("a", "b"): [(0, 0)]})
        engine = E.FactoredInference(DOM, iters=30)
        aim.run(df, DOM, engine, all_kway(DOM, 2), 10)
        assert aim.spent <= b.rho * (1 + 1e-9) and engine.model.project(("a", "b"))[0, 0] == 0
    for rounds in (1, 2, 3):
        with pytest.raises(ValueError):
            AIM(b, rounds).run(df, DOM, engine, all_kway(DOM, 2))
    mwem = MWEM(b, 3, max_model_mb=0.0)
    mwem.run(df, DOM, E.FactoredInference(DOM, iters=5), all_kway(DOM, 2), 10)
    assert mwem.measured == []


def test_candidates(spark, data):
    df, x = data
    model = E.GraphicalModel.over(DOM, CLIQUES)
    assert filter_candidates({("a", "b"): 1.0, ("a", "d"): 1.0}, model, 0.0) == {("a", "b"): 1.0} and model_megabytes(DOM, CLIQUES) == pytest.approx((6 + 8 + 8) * 8 / 2**20)
    got = {r["clique_id"]: r["gap"] for r in pair_gaps(df, DOM).collect()}
    for i, (p, q) in enumerate(all_kway(DOM, 2)):
        want = np.abs(true(x, (p, q)) - np.outer(true(x, (p,)), true(x, (q,))) / 3000).sum()
        assert got[i] == pytest.approx(want)


# --- sources and command line ----------------------------------------------------------------------------------------------------


def test_sources(spark, data, tmp_path):
    df, _ = data
    at = f"file://{tmp_path}"
    Src.write_synthetic(df, f"{at}/csv")
    Src.write_domain(spark, DOM, f"{at}/domain")
    ds = Src.Dataset.load(spark, f"{at}/csv", f"{at}/domain")
    assert ds.records == 3000 and ds.df.exceptAll(Src.Dataset.of(df, DOM).df).count() == 0 and ds.domain == DOM
    assert ds.project(("a",)).df.columns == ["a", "weight"] and ds.drop(("a",)).domain == DOM.project(("b", "c", "d")) and ds.datavector(("b",)).count() == 2
    with pytest.raises(ValueError):
        Src.Dataset.of(df.drop("a"), DOM)
    u = Src.Dataset.synthetic(spark, DOM, 5000, 1)
    assert u.df.groupBy("a").count().count() == 3 and u.df.filter("c > 3 or c < 0").count() == 0
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    train, test = Src.split(keyed, ["k"])
    assert train.count() + test.count() == 3000 and 450 < test.count() < 750 and train.join(test, "k").count() == 0
    Src.append_result(spark, {"x": 1, "y": 2.5, "z": "s", "t": True}, f"{at}/log")
    Src.append_result(spark, {"x": 2, "y": 1.5, "z": "r", "t": False}, f"{at}/log")
    assert spark.read.parquet(f"{at}/log").count() == 2
    raw = spark.createDataFrame([(i, float(i % 17), "uvw"[i % 3]) for i in range(200)], "id int, `v.x` double, s string")
    raw.write.parquet(f"{at}/raw.parquet")
    tr, te, otr, ote, coder = Src.fetch_and_prepare(spark, f"{at}/raw.parquet", 8, "id")
    assert tr.count() == otr.count() and te.count() == ote.count() and tr.count() + te.count() == 200 and coder.domain == Domain(("vx", "s"), (8, 3))
    Src.save_processed(spark, tr, otr, coder, f"{at}/done")
    assert Src.load_coder(spark, f"{at}/done") == coder
    cat = spark.createDataFrame([("p", 10, 50_000), ("q", 99, 50_000), ("r", 10, 10)], "name string, features int, rows long")
    assert [r["name"] for r in Src.eligible(cat).collect()] == ["p"]


def test_constraint_from_the_command_line(spark, data, tmp_path):
    df, x = data
    at = f"file://{tmp_path}"
    df.write.parquet(f"{at}/rows.parquet")
    Src.write_text(spark, json.dumps(DOM.config), f"{at}/domain")
    asked = tmp_path / "asked.json"
    asked.write_text(json.dumps({"thetas": [[1.0, 0.5, 0.0, 0.0]], "taus": [0.6]}))
    given = ["--data", f"{at}/rows.parquet", "--domain", f"{at}/domain", "--preset", "particles", "--iters", "3", "--n-particles", "300", "--iters-proj", "3", "--num-projections-proj", "3"]
    row = cli.main([*given, "--constraint", str(asked), "--scale-reg", "5", "--seed", "4"])
    assert row["scale_reg"] == 5 and row["loss"] >= 0
    con = K.measured_constraint(df, DOM, [[1.0, 0.5, 0.0, 0.0]], [0.6], Budget(50.0, 1e-2, seed=1))
    pts = (2 * x + 1) / (2 * np.array(DOM.shape))
    assert con.answers[0] == pytest.approx((1 / (1 + np.exp(-5 * (pts[:, 0] + 0.5 * pts[:, 1] - 0.6)))).mean(), abs=0.01)
    with pytest.raises(ValueError):
        cli.main([*given, "--scale-reg", "5"])


def test_logger_of_either_engine(spark, data):
    _, x = data
    measured = [E.Measurement(c, true(x, c).ravel(), 1.0) for c in CLIQUES]
    engine = E.FactoredInference(DOM, iters=20)
    log = Logger({c: true(x, c) for c in CLIQUES} | {("a",): true(x, ("a",))}, 5, engine)
    engine.callback = log
    engine.estimate(measured)
    assert log.rows[0]["l2_loss"] >= log.rows[-1]["l2_loss"] and log.rows[-1]["feasibility"] < 1 and log.rows[-1]["variation"] < 0.5
    points = K.ParticleInference(DOM, n_particles=400, iters=10, proj_iters=3, proj_directions=3)
    points.callback = log2 = Logger({c: true(x, c) for c in CLIQUES}, 9, points)
    points.estimate(spark, measured)
    assert len(log2.rows) == 2 and log2.rows[-1]["l1"] < log2.rows[0]["l1"] and log2.rows[-1]["feasibility"] == pytest.approx(0, abs=1e-6)


def test_command_line(spark, data, tmp_path):
    df, _ = data
    at = f"file://{tmp_path}"
    df.write.parquet(f"{at}/rows.parquet")
    Src.write_text(spark, json.dumps(DOM.config), f"{at}/domain")
    row = cli.main(["--data", f"{at}/rows.parquet", "--domain", f"{at}/domain", "--preset", "mst", "--iters", "60", "--out", f"{at}/out", "--results", f"{at}/log", "--records", "500"])
    assert row["mechanism"] == "mst" and row["l1_avg"] < 1 and spark.read.csv(f"{at}/out", header=True).count() == 500 and spark.read.parquet(f"{at}/log").count() == 1
    with pytest.raises(ValueError):
        cli.make(cli.parser().parse_args(["--data", "x", "--domain", "y", "--mechanism", "aim", "--engine", "particles"]), DOM)
    assert cli.make(cli.parser().parse_args(["--data", "x", "--domain", "y", "--preset", "particles"]), DOM)[1].n_particles == 100_000
    assert all(len(p) == 2 for p in cli.PRESETS.values()) and len(list(product(range(2), repeat=2))) == 4


def test_tasks_of_a_drawn_column_grow_in_number(spark):
    n = 2_000_000
    shares = spark.createDataFrame([(0, [0.25, 1.0])], "_given long, _upto array<double>")
    got = E.draw_column(spark.range(n).withColumnRenamed("id", "_row"), "a", 2, F.lit(0).cast("long"), F.broadcast(shares), "round", 0, n)
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == n and max(sizes) < n / 2 and got.rdd.getNumPartitions() == 8
    assert abs(got.filter("a = 0").count() - n / 4) <= 100


def test_rounded_rows_are_not_shuffled(spark, data):
    df, x = data
    n = 230_000
    made = E.GraphicalModel.over(DOM, CLIQUES).fit(df).synthetic(spark, n, seed=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and made.rdd.getNumPartitions() == 4
    for c in CLIQUES:
        want, got = true(x, c), np.zeros(DOM.project(c).shape)
        for r in made.groupBy(*c).count().collect():
            got[tuple(r[a] for a in c)] = r["count"]
        assert got.sum() == n and not got[want == 0].any()
        assert np.abs(got - want * n / 3000).max() < 4 * DOM.size(c)  # less than a row a group and block, and what parents were off
    one = E.GraphicalModel.over(DOM, CLIQUES).fit(df)
    assert one.synthetic(spark, 0).count() == 0 and one.synthetic(spark, 1).count() == 1 and one.synthetic(spark, 7, seed=-1).count() == 7


@pytest.mark.parametrize("groups", [1, 5, 70_000])
def test_rounded_codes(groups):
    rng = np.random.default_rng(groups)
    p = rng.random((groups, 6))
    p[:, [0, 3, 5]] = 0
    p /= p.sum(axis=1, keepdims=True)
    upto = np.cumsum(p, axis=1)
    upto[:, 4:] = 1.0
    given = rng.integers(0, groups, 9000)
    made = E.rounded_codes(rng, given, upto)
    got, rows = np.zeros((groups, 6)), np.bincount(given, minlength=groups)
    np.add.at(got, (given, made), 1)
    assert np.abs(got - p * rows[:, None]).max() < 2 and np.abs(np.cumsum(got, axis=1) - upto * rows[:, None]).max() < 1 and not got[:, [0, 3, 5]].any()
    assert groups > 5 or abs(np.corrcoef(np.arange(9000), made)[0, 1]) < 0.05  # in no order
    assert len(E.rounded_codes(rng, given[:0], upto)) == 0


def test_rows_of_large_conditional_tables(spark, data, monkeypatch):
    df, x = data
    monkeypatch.setattr(E, "SENT_CELLS", 10)
    made = E.GraphicalModel.over(DOM, CLIQUES).fit(df).synthetic(spark, 6000, seed=4)
    got = {tuple(r[:2]): r["count"] for r in made.groupBy("b", "c").count().collect()}
    assert "Window" in made._jdf.queryExecution().executedPlan().toString() and sum(got.values()) == 6000
    assert all(abs(got.get(k, 0) - 2 * v) < 40 for k, v in np.ndenumerate(true(x, ("b", "c"))))
