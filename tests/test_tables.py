"""The engines on tables against their forms in one process."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.operators import particle_tables as PT
from marginalia.operators import particles as P
from marginalia.operators import pgm_tables as GT
from marginalia.operators import transport as T
from marginalia.operators import transport_tables as TT
from marginalia.operators.factor import Factor
from marginalia.operators.pgm import FactoredInference, GraphicalModel, Measurement
from marginalia.plans.schema import Domain
from marginalia.storage import numbered

ABC = Domain.fromdict({"a": 4, "b": 5, "c": 3})


def cloud_of(spark, x):
    points = pd.DataFrame(x, columns=["x_a", "x_b", "x_c"])
    points.insert(0, "pid", np.arange(len(x)))
    return PT.Cloud.of_rows(ABC, spark.createDataFrame(points))


def points_of(cloud):
    return cloud.rows.toPandas().sort_values("pid")[["x_a", "x_b", "x_c"]].to_numpy()


def shares(rng, clique):
    p = rng.random(ABC.size(clique)) * (rng.random(ABC.size(clique)) < 0.7)
    return p / p.sum()


def test_particle_descent_takes_the_steps_of_the_one_in_one_process(spark):
    rng = np.random.default_rng(4)
    x, cliques = rng.random((300, 3)), [("a", "b"), ("c",), ("b", "c")]
    p = {c: shares(rng, c) for c in cliques}
    same = {"iters": 2, "batch_size": 2, "n_directions": 3, "p_mask": 0.0, "decay_every": 1, "seed": 7}
    near = P.ParticleInference(ABC, **same)
    near.cliques, near.total = [], 1.0
    model = P.ParticleModel(ABC, x.copy(), np.full(300, 1 / 300))
    near._descend(model, [(ABC.axes(c), P.quantise(P.cell_centers(ABC, c), p[c], 300)) for c in cliques])
    far = PT.TableParticleInference(ABC, **same)
    cells = [(c, spark.createDataFrame([(i, float(v)) for i, v in enumerate(p[c])], "cell long, value double")) for c in cliques]
    got = far.estimate(cloud_of(spark, x), cells)
    assert np.abs(points_of(got) - model.x).max() < 1e-9 and got.t == 4 and far.losses[1] < far.losses[0]
    assert got.project(["a"]).agg(F.sum("value")).first()[0] == 300


def test_threshold_constraint_and_mask(spark):
    rng = np.random.default_rng(5)
    x, clique = rng.random((200, 3)), ("a", "c")
    p, thetas, taus, answers = shares(rng, clique), [[0.6, 0.8, 0.0], [0.0, 0.5, 0.5]], [0.7, 0.4], [0.9, 0.2]
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "cell long, value double")
    target = PT.Target.of_marginal(ABC, clique, cells, 200)
    lines = T.directions(2, 3, 1)
    cloud = cloud_of(spark, x)
    got, _ = PT.step(cloud, [(target, lines)], 0.1, 30.0, 3, PT.Thresholds(thetas, taus, answers), 2.0)
    held = cloud.rows.select("pid", *(PT.kept(3, 1, a, 30.0).alias(a) for a in ABC)).toPandas().sort_values("pid")[list("abc")].to_numpy()
    y, grad = P.quantise(P.cell_centers(ABC, clique), p, 200), np.zeros_like(x)
    for theta in lines:
        z = x[:, [0, 2]] @ theta
        gap = np.empty(200)
        gap[np.argsort(z, kind="stable")] = np.sort(z) - np.sort(y @ theta)
        grad[:, [0, 2]] += 200 * gap[:, None] * theta / 3
    grad += 200 * P.ThresholdConstraint(np.array(thetas), np.array(taus), np.array(answers))(x)[1]
    adam, want = P.Adam(x.shape, 0.1), x.copy()
    adam.step(want, grad * held, sparse=True)
    assert np.abs(points_of(got) - np.clip(want, 0, 1)).max() < 1e-9 and 0.6 < held.mean() < 0.8


def test_ranks_do_not_depend_on_how_rows_are_dealt(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 10).alias("z"), "id")
    got = [sorted((r.g, r.id, r.pos) for r in numbered(df.repartition(n), [F.col("g"), F.col("z"), F.col("id")], ("g",)).collect()) for n in (1, 6)]
    assert got[0] == got[1] and {(r[1] // 2 == r[2]) for r in got[0]} == {True}


FIVE = Domain.fromdict({"a": 3, "b": 2, "c": 4, "d": 2, "e": 3, "f": 2})


@pytest.mark.parametrize("cliques", [[("a", "b"), ("b", "c"), ("c", "d")], [("a", "b"), ("a", "c"), ("a", "d", "e"), ("f",)], [("a", "b", "c")]])
def test_propagation_equals_the_dense_one(spark, cliques):
    rng = np.random.default_rng(2)
    model = GraphicalModel.over(FIVE, cliques, 50.0)
    for k, c in enumerate(model.cliques):
        x = rng.normal(0, 3, model.potentials[c].shape)
        if k == 0:
            x.flat[0] = -np.inf
        model.potentials[c] = x
    tables = {c: Factor.from_values(spark, FIVE.project(c), model.potentials[c].ravel()) for c in model.cliques}
    rows, log_z = GT.propagate(tables, model.tree, 50.0)
    want = model.propagate()
    got = rows.toPandas()
    for i, c in enumerate(model.cliques):
        assert np.abs(got[got.part == i].sort_values("cell").value.to_numpy() - want[c].ravel()).max() < 1e-9
    assert abs(log_z - model.propagate(log_z=True)) < 1e-9


@pytest.mark.parametrize("lr", [None, 1.0])
def test_mirror_descent_takes_the_steps_of_the_dense_one(spark, lr):
    rng = np.random.default_rng(3)
    small = FIVE.project(("a", "b", "c"))
    given = [(("a", "b"), rng.random(6) * 20, 2.0), (("b", "c"), rng.random(8) * 15, 3.0), (("b",), np.array([20.0, 33.0]), 1.0)]
    dense = FactoredInference(small, iters=2, lr=lr, order=small.attrs)
    model = dense.estimate([Measurement(c, y, s) for c, y, s in given], 55.0)
    far = GT.TableInference(small, 2, lr, order=small.attrs)
    tables = [(c, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "cell long, y double"), s) for c, y, s in given]
    tree, rows = far.estimate(spark, tables, 55.0)
    got = rows.toPandas()
    assert tree.cliques == model.cliques and abs(far.losses[-1] - dense.final_loss) < 1e-9 and far.losses[-1] < far.losses[0]
    for i, c in enumerate(tree.cliques):
        assert np.abs(got[got.part == i].sort_values("cell").value.to_numpy() - model.marginals[c].ravel()).max() < 1e-9


def test_separable_sinkhorn_equals_the_dense_one(spark):
    grid, reg = Domain.fromdict({"x": 3, "y": 4}), 0.1
    rng = np.random.default_rng(6)
    a, b = rng.random(12), rng.random(12)
    a[3] = 0.0
    a, b = a / a.sum(), b / b.sum()
    at = P.cell_centers(grid, ("x", "y"))
    cost = ((at[:, None] - at[None]) ** 2).sum(-1)
    cells = spark.createDataFrame([(i // 4, i % 4, float(a[i]), float(b[i])) for i in range(12)], "x int, y int, a double, b double")
    state = TT.sinkhorn(cells, grid, reg, 4, 0.0)
    f, g, plan = T.sinkhorn(a, b, cost, reg, 4, 0.0)
    got = state.toPandas().sort_values(["x", "y"])
    assert np.allclose(np.exp(got.f / reg), np.exp(f / reg), atol=1e-9) and np.abs(got.g.to_numpy() - g).max() < 1e-9
    assert abs(TT.transport_cost(state, grid, reg) - (plan * cost).sum()) < 1e-9
    own = TT.symmetric(cells, grid, reg, 3, 0.0, weight="b").toPandas().sort_values(["x", "y"]).own.to_numpy()
    assert np.abs(own - T.symmetric_potential(b, cost, reg, 3, 0.0)).max() < 1e-9
    text = TT.spread(cells.select("x", "y", F.col("a").alias("value")), grid, reg)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_debiased_gradient(spark):
    grid, reg = Domain.fromdict({"x": 3}), 0.3
    a, b = np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.3, 0.6])
    at = P.cell_centers(grid, ("x",))
    cost = ((at[:, None] - at[None]) ** 2).sum(-1)
    cells = spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in range(3)], "x int, a double, b double")
    got = TT.divergence_gradient(cells, grid, reg, 12, 0.0).toPandas().sort_values("x").gradient.to_numpy()
    assert np.abs(got - T.sinkhorn_divergence_gradient(a, b, cost, cost, reg)).max() < 1e-4


@pytest.mark.parametrize("p,coords", [(math.inf, "abc"), (2.0, "ab"), (1.0, "a")])
def test_nearest_centres(spark, p, coords):
    rng = np.random.default_rng(8)
    centres = np.concatenate([rng.random((150, 3)), 0.5 + rng.random((100, 3)) * 1e-3, np.repeat([[0.25, 0.25, 0.25]], 5, 0)])[:, : len(coords)]
    points = np.concatenate([rng.random((200, 3)) * 3 - 1, np.full((3, 3), 0.25), [[50, -50, 0]]])[:, : len(coords)]
    left = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)] + [(999, *[None] * len(coords))], "i long, " + ", ".join(f"{c} double" for c in coords))
    right = spark.createDataFrame([(j, *map(float, x)) for j, x in enumerate(centres)] + [(998, *[None] * len(coords))], "j long, " + ", ".join(f"{c} double" for c in coords))
    gap = np.abs(points[:, None] - centres[None])
    dist = gap.max(-1) if p == math.inf else (gap**p).sum(-1) ** (1 / p)
    got = {r.i: (r.j, r.dist) for r in TT.nearest_centres(left, right, list(coords), p=p).collect()}
    assert set(got) == set(range(len(points)))
    assert all(abs(got[i][1] - dist[i].min()) < 1e-12 and abs(dist[i][got[i][0]] - dist[i].min()) < 1e-12 for i in got)
    assert {got[i][0] for i in (200, 201, 202)} == {250}


def test_nearest_of_no_centres(spark):
    none = spark.createDataFrame([], "j long, a double")
    some = spark.createDataFrame([(1, 0.5)], "i long, a double")
    assert TT.nearest_centres(some, none, ["a"]).collect() == [] and TT.nearest_centres(none.withColumnRenamed("j", "i"), some.withColumnRenamed("i", "j"), ["a"]).collect() == []


def test_nearest_across_a_gap(spark):
    """All centres are far in one coordinate, so each point has thousands equally near, and no cell around it has any."""
    rng = np.random.default_rng(9)
    centres, points = rng.random((40_000, 3)) * [1, 1, 0], rng.random((3000, 3)) * [1, 1, 0] + [0, 0, 0.5]
    left, right = (spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).coalesce(1).withColumn(k, F.monotonically_increasing_id()) for x, k in ((points, "i"), (centres, "j")))
    got = {r.i: (r.j, r.dist) for r in TT.nearest_centres(left, right, ["a", "b", "c"]).collect()}
    want = {i: (int((np.abs(x - centres).max(-1) <= 0.5).argmax()), 0.5) for i, x in enumerate(points)}
    assert got == want


def test_table_descent_at_a_large_total(spark):
    one, y = Domain.fromdict({"a": 3}), np.array([1.8e7, 1.2e7, 6e6])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "cell long, y double")
    engine = GT.TableInference(one, 1)
    engine.estimate(spark, [(("a",), rows, 0.5)], float(y.sum()))
    assert engine.losses[1] < engine.losses[0]
