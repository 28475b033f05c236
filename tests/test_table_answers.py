"""Mechanisms whose answers and models are tables, against their array forms."""

from itertools import combinations

import numpy as np
import pytest

from marginalia.operators import mechanisms as M
from marginalia.operators.pgm import FactoredInference, GraphicalModel
from marginalia.operators.pgm_tables import TableInference, nearest_histograms
from marginalia.operators.table_answers import TableAnswers, TableModel
from marginalia.plans.graph import JunctionTree
from marginalia.plans.privacy import Budget
from marginalia.plans.schema import Domain

ABCD = Domain.fromdict({"a": 3, "b": 4, "c": 2, "d": 3})
PAIRS = list(combinations(ABCD.attrs, 2))
SURE = Budget(3000.0, 1e-6, seed=3)  # noise far below a row


@pytest.fixture(scope="module")
def coded(spark):
    """b follows a, d follows b; c is on its own."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 3, 400)
    b = np.where(rng.random(400) < 0.8, a, rng.integers(0, 4, 400))
    d = np.where(rng.random(400) < 0.7, np.minimum(b, 2), rng.integers(0, 3, 400))
    x = np.stack([a, b, rng.integers(0, 2, 400), d], axis=1)
    return x, spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int, d int")


def counts(x, clique, names=ABCD.attrs):
    at = [names.index(a) for a in clique]
    out = np.zeros([ABCD[a] for a in clique])
    np.add.at(out, tuple(x[:, i] for i in at), 1)
    return out


def as_tables(spark, model):
    rows = [(i, j, float(v)) for i, c in enumerate(model.cliques) for j, v in enumerate(np.ravel(model.marginals[c]))]
    return TableModel(model.domain, model.tree, spark.createDataFrame(rows, "part int, cell long, value double"), model.total)


@pytest.mark.parametrize("cliques", [[("a", "b"), ("b", "d"), ("c",)], [("a", "b"), ("b", "c"), ("c", "d")], [("a",), ("b",), ("c",), ("d",)]])
def test_marginals_of_a_table_model(spark, coded, cliques):
    model = GraphicalModel.over(ABCD, cliques, 400.0).fit(coded[1])
    wanted = [("a", "d"), ("d", "a"), ("c", "a"), ("b",), ("a", "c", "d"), ("b", "a")]
    got = as_tables(spark, model).answers(wanted).toPandas()
    for i, c in enumerate(wanted):
        mine = got[got["clique_id"] == i].sort_values("cell")
        assert len(mine) == ABCD.size(c) and np.allclose(mine["model"], model.project(c).ravel(), atol=1e-8)


def test_rows_of_a_table_model(spark, coded):
    model = as_tables(spark, GraphicalModel.over(ABCD, [("a", "b"), ("b", "d"), ("c",)], 400.0).fit(coded[1]))
    for method, slack in (("round", 20), ("sample", 100)):
        rows = model.synthetic(spark, 400, method, 5)
        x = np.array(rows.collect())
        assert rows.columns == list(ABCD.attrs) and len(x) == 400 and sorted(map(tuple, x)) == sorted(map(tuple, rows.collect()))
        assert np.abs(counts(x, ("a", "b")) - counts(coded[0], ("a", "b"))).sum() <= slack
    with pytest.raises(ValueError, match="method"):
        model.synthetic(spark, 5, "other")
    assert model.synthetic(spark, 0).count() == 0


def test_nearest_histograms(spark):
    rng = np.random.default_rng(1)
    noisy = [rng.normal(3, 6, n) for n in (1, 2, 5, 30)] + [np.zeros(4), np.array([5.0, 5.0, -1.0])]
    rows = spark.createDataFrame([(i, j, float(v)) for i, y in enumerate(noisy) for j, v in enumerate(y)], "part int, cell long, y double")
    got = nearest_histograms(rows, 10.0).toPandas()
    for i, y in enumerate(noisy):
        x = got[got["part"] == i].sort_values("cell")["value"].to_numpy()
        cuts = np.linspace(y.min() - 20, y.max(), 200_001)  # the answer cuts all cells alike
        best = min(cuts, key=lambda t: abs(np.maximum(y - t, 0).sum() - 10)) if len(y) < 6 else None
        assert x.sum() == pytest.approx(10) and (x >= 0).all()
        if best is not None:
            assert np.allclose(x, np.maximum(y - best, 0), atol=1e-3)


def test_gaps_and_moves_equal_the_arrays(spark, coded):
    x, df = coded
    held = TableAnswers(df, ABCD, [*PAIRS, ("a",), ("a", "b", "d")], TableInference(ABCD, 0), 1)
    assert held.total() == 400 and set(held.store.cliques) == {("a", "b", "d"), ("a", "c"), ("b", "c"), ("c", "d")}
    model = GraphicalModel.over(ABCD, [("a", "b"), ("c",), ("d",)], 380.0).fit(df)
    held.model = as_tables(spark, model)
    gaps = held.gaps(PAIRS)
    for c in PAIRS:
        assert gaps[c] == pytest.approx(np.abs(counts(x, c) - model.project(c)).sum(), abs=1e-8)
    flat = GraphicalModel.over(ABCD, [("a",), ("b",), ("c",), ("d",)], 400.0).fit(df)
    assert held.moved(as_tables(spark, flat), ("b", "a")) == pytest.approx(np.abs(flat.project(("b", "a")) - model.project(("b", "a"))).sum(), abs=1e-8)


def test_noise_is_drawn_once_and_not_shared(spark, coded):
    x, df = coded
    held = TableAnswers(df, ABCD, PAIRS, TableInference(ABCD, 0), 9)
    held.measure([("c",), ("c",)], 2.0)
    held.measure([("c",)], 2.0)
    noise = [np.array([r["y"] for r in rows.orderBy("cell").collect()]) - counts(x, ("c",)) for _, rows, _ in held.measured]
    again = np.array([r["y"] for r in held.measured[0][1].orderBy("cell").collect()]) - counts(x, ("c",))
    assert (noise[0] == again).all() and len({v for n in noise for v in n}) == 6
    assert held._total(None) == pytest.approx(400 + np.mean([n.sum() for n in noise])) and held._total(7) == 7.0


def near(spark, rows, x, cliques, most):
    y = np.array(rows.collect())
    assert len(y) == len(x)
    for c in cliques:
        assert np.abs(counts(y, c) - counts(x, c)).sum() <= most, c


def test_tree_mechanism_on_tables(spark, coded):
    x, df = coded
    arrays, tables = M.MST(SURE, selection_iters=300), M.MST(SURE)
    arrays.run(df, ABCD, FactoredInference(ABCD, iters=50))
    rows = tables.run(df, ABCD, TableInference(ABCD, 1, 1e-5, warm=True))
    assert {frozenset(e) for e in tables.tree} == {frozenset(e) for e in arrays.tree} >= {frozenset("ab"), frozenset("bd")}
    near(spark, rows, x, [("a", "b"), ("b", "d")], 40)


def test_adaptive_mechanisms_on_tables(spark, coded):
    x, df = coded
    held = M.MWEM(SURE, rounds=2)
    rows = held.run(df, ABCD, TableInference(ABCD, 1, 1e-5, warm=True), [("a", "b"), ("b", "d"), ("a", "c")])
    assert {c for c, _, _ in held.measured} == {("a", "b"), ("b", "d")} and rows.count() == 400
    near(spark, rows, x, [("a", "b"), ("b", "d")], 40)
    aim = M.AIM(SURE, rounds=6)
    assert aim.run(df, ABCD, TableInference(ABCD, 0, warm=True), [("a", "b"), ("b", "d")], 50).count() == 50
    assert aim.spent <= SURE.rho * (1 + 1e-9) and {("a",), ("b",), ("c",), ("d",)} < {c for c, _, _ in aim.measured}
    with pytest.raises(ValueError, match="structural zeros"):
        M.AIM(SURE, rounds=6, structural_zeros={("a",): [(0,)]}).run(df, ABCD, TableInference(ABCD, 1), [("a", "b")])


def test_a_model_of_nothing_measured(spark, coded):
    tree, rows = TableInference(ABCD, 5).estimate(spark, [], 24.0)
    assert isinstance(tree, JunctionTree)
    got = rows.toPandas().groupby("part")["value"]
    assert np.allclose(got.sum(), 24.0) and np.allclose(got.max(), got.min())
