"""Registered queries of the small operators: schemas, factors, linear queries, calibration, distances, sources.

Their SQL says the same by other means: formulas over generated rows, counts, or values worked out by hand.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from marginalia.functions import scalar as S
from marginalia.operators import discretize, evaluate, factor, linear, marginals, mechanisms, noise, particles, pgm, transport
from marginalia.operators.factor import Factor
from marginalia.plans import privacy as P
from marginalia.plans.graph import JunctionTree, elimination_order
from marginalia.plans.privacy import Budget
from marginalia.plans.schema import Domain, all_kway, downward_closure
from marginalia.queries import D, FG, LINEITEM, SMALL, TREE, _eval_sql, coded_lineitem, counted, grid_sql, parity_rows, query, stated, table
from marginalia.sources.tables import Dataset, eligible, split

# --- schemas --------------------------------------------------------------------------------------------------------------

ABC, BCD = Domain(("a", "b", "c"), (10, 20, 5)), Domain(("b", "c", "d"), (20, 5, 7))


def pairs_sql(rows: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") t(op, result)"


@stated(pairs_sql({"project": "c:5 a:10", "marginalize": "b:20", "invert": "a c", "axes": "2 0", "transpose": "c:5 b:20 a:10", "merge": "a:10 b:20 c:5 d:7", "contains": "True False", "size": "1000 50", "sort_size": "c:5 a:10 b:20", "sort_name": "a:10 b:20 c:5", "canonical": "a c", "item": "20", "iterate": "a b c", "length": "3", "equal": "True False", "member": "True False"}))
def schema_algebra(spark, sf_dir):
    """P04-P16."""
    show = lambda d: " ".join(f"{a}:{n}" for a, n in d.config.items())
    got = {
        "project": show(ABC.project(("c", "a"))), "marginalize": show(ABC.marginalize(("a", "c"))), "invert": " ".join(ABC.invert(("b",))),
        "axes": " ".join(map(str, ABC.axes(("c", "a")))), "transpose": show(ABC.transpose(("c", "b", "a"))), "merge": show(ABC.merge(BCD)),
        "contains": f"{ABC.contains(ABC.project(('b',)))} {ABC.contains(BCD)}", "size": f"{ABC.size()} {ABC.size(('a', 'c'))}",
        "sort_size": show(ABC.sort("size")), "sort_name": show(ABC.transpose(("b", "c", "a")).sort("name")), "canonical": " ".join(ABC.canonical(("c", "a"))),
        "item": str(ABC["b"]), "iterate": " ".join(ABC), "length": str(len(ABC)), "equal": f"{ABC == Domain(('a', 'b', 'c'), (10, 20, 5))} {ABC == BCD}", "member": f"{'a' in ABC} {'d' in ABC}",
    }
    return spark.createDataFrame(list(got.items()), "op string, result string")


CHAIN = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")]
RING = Domain(tuple("abcde"), (2, 3, 4, 5, 6))


#: Fans out from a, the smallest: abc, acd, ade.
@stated("SELECT * FROM (VALUES ('cells', 2 * 3 * 4 + 2 * 4 * 5 + 2 * 5 * 6), ('best_cells', 124), ('cliques', 3), ('megabyte_bytes', 8 * 124), ('candidates', 1), ('first_by_length', 1)) t(what, n)")
def elimination_cells(spark, sf_dir):
    """A ring of five attributes."""
    tree, best = JunctionTree(RING, CHAIN), JunctionTree(RING, CHAIN, 200)
    model = pgm.GraphicalModel.over(RING, CHAIN)
    fits = mechanisms.filter_candidates({("a", "b"): 1.0, ("b", "d"): 1.0, ("c", "e"): 1.0}, model, 0.0)
    assert sorted(elimination_order(RING, CHAIN)) == list("abcde")
    rows = [("cells", tree.size()), ("best_cells", best.size()), ("cliques", len(tree.cliques)), ("megabyte_bytes", round(mechanisms.model_megabytes(RING, CHAIN) * 2**20)), ("candidates", len(fits)), ("first_by_length", len(downward_closure([("a", "b")])[0]))]
    return spark.createDataFrame(rows, "what string, n int")


# --- factors ----------------------------------------------------------------------------------------------------------------


@query(f"{FG} SELECT dc, rf, f.v + h.v AS value FROM f JOIN h USING (rf)")
def factor_add_within(spark, sf_dir):
    """J03."""
    f = counted(spark, sf_dir, "dc", "rf")
    f += counted(spark, sf_dir, "rf")
    return f.rows.select("dc", "rf", "value")


@query(f"{FG} SELECT dc, rf, f.v * h.v AS value FROM f JOIN h USING (rf)")
def factor_multiply_within(spark, sf_dir):
    """J04."""
    f = counted(spark, sf_dir, "dc", "rf")
    f *= counted(spark, sf_dir, "rf")
    return f.rows.select("dc", "rf", "value")


@stated(f"""SELECT kind, rf, ls, CASE kind WHEN 'zeros' THEN 0.0 WHEN 'ones' THEN 1.0 WHEN 'uniform' THEN 1.0 / 6 WHEN 'given' THEN rf * 2.0 + ls WHEN 'copy' THEN rf * 2.0 + ls END::DOUBLE AS value
  FROM (SELECT unnest(['zeros', 'ones', 'uniform', 'given', 'copy']) AS kind) CROSS JOIN (SELECT g_rf.rf, g_ls.ls FROM {grid_sql(('rf', 3), ('ls', 2))})""")
def factor_constructors(spark, sf_dir):
    """F03-F05, F09."""
    domain = TREE.project(("rf", "ls"))
    given = Factor.from_values(spark, domain, list(range(6)))
    assert given.vector() == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    made = {"zeros": Factor.zeros(spark, domain), "ones": Factor.ones(spark, domain), "uniform": Factor.uniform(spark, domain), "given": given, "copy": given.copy()}
    parts = [f.rows.select(F.lit(k).alias("kind"), "rf", "ls", "value") for k, f in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@stated("SELECT * FROM (VALUES ('zeros', 0.0::DOUBLE, 39), ('ones', 39.0::DOUBLE, 39), ('uniform', 2.0::DOUBLE, 39)) t(kind, total, cells)")
def clique_constructors(spark, sf_dir):
    """Vectors over the cliques (dc, rf) and (rf, ls) of 33 and 6 cells."""
    V, cliques = factor.CliqueVector, [("dc", "rf"), ("rf", "ls")]
    made = {"zeros": V.zeros(spark, TREE, cliques), "ones": V.ones(spark, TREE, cliques), "uniform": V.uniform(spark, TREE, cliques)}
    rows = [(k, round(float(v.rows.agg(F.sum("value")).first()[0]), 9), v.size()) for k, v in made.items()]
    return spark.createDataFrame(rows, "kind string, total double, cells int")


# --- graphical models ----------------------------------------------------------------------------------------------------------


def _model(spark, sf_dir) -> tuple[pgm.GraphicalModel, dict]:
    cliques = [("dc", "rf"), ("rf", "ls")]
    rows = coded_lineitem(spark, sf_dir)
    found = {}
    for c in cliques:
        part = TREE.project(c)
        x = np.zeros(part.size())
        for r in marginals.marginal(rows, TREE, c).select(S.cell_of(c, part.strides()).alias("cell"), "value").collect():
            x[r["cell"]] = r["value"]
        found[c] = x.reshape(part.shape)
    model = pgm.GraphicalModel.over(TREE, cliques, float(found[cliques[0]].sum()))
    model.potentials = model.mle({c: found[tuple(sorted(c, key=TREE.attrs.index))] / model.total for c in model.cliques})
    return model, found


def _rows(spark, clique, x) -> DataFrame:
    cells = np.array(list(np.ndindex(x.shape)))
    return spark.createDataFrame([(*map(int, i), round(float(v), 4)) for i, v in zip(cells, x.ravel(), strict=True)], ", ".join(f"{a} int" for a in clique) + ", value double")


@query(f"{FG} SELECT dc, rf, round(v, 4) AS value FROM f")
def pgm_propagate(spark, sf_dir):
    """Potentials of the data's marginals give the marginals back."""
    model, _ = _model(spark, sf_dir)
    return _rows(spark, ("dc", "rf"), model.propagate()[("dc", "rf")])


@query(f"{FG} SELECT dc, ls, round(sum(CASE WHEN h.v > 0 THEN f.v * g.v / h.v ELSE 0 END), 4) AS value FROM f JOIN g USING (rf) JOIN h USING (rf) GROUP BY dc, ls")
def pgm_project_across(spark, sf_dir):
    """A marginal that no clique holds."""
    model, _ = _model(spark, sf_dir)
    return _rows(spark, ("dc", "ls"), model.project(("dc", "ls")))


@query(f"{FG} SELECT dc, ls, round(sum(CASE WHEN h.v > 0 THEN f.v * g.v / h.v ELSE 0 END), 4) AS value FROM f JOIN g USING (rf) JOIN h USING (rf) GROUP BY dc, ls")
def pgm_many_marginals(spark, sf_dir):
    """J16."""
    model, _ = _model(spark, sf_dir)
    return _rows(spark, ("dc", "ls"), model.many([("dc", "ls")])[("dc", "ls")])


@query("SELECT * FROM (VALUES ('l1', 0.0::DOUBLE), ('l2', 0.0::DOUBLE), ('variation', 0.0::DOUBLE), ('feasibility', 0.0::DOUBLE), ('l1_loss', 0.0::DOUBLE), ('l2_loss', 0.0::DOUBLE), ('rows', 1.0::DOUBLE)) t(what, value)")
def logger_of_exact_fit(spark, sf_dir):
    """A fit to exact answers leaves nothing to log."""
    model, found = _model(spark, sf_dir)
    engine = pgm.FactoredInference(TREE)
    engine.groups = {("dc", "rf"): [pgm.Measurement(("dc", "rf"), found["dc", "rf"].ravel(), 1.0)]}
    log = evaluate.Logger({("dc", "rf"): found["dc", "rf"], ("ls",): found["rf", "ls"].sum(0)}, engine=engine)
    mu = model.propagate()
    log(mu)
    log(mu)
    rows = [(k, round(log.rows[0][k], 3) + 0.0) for k in ("l1", "l2", "variation", "feasibility", "l1_loss", "l2_loss")]
    return spark.createDataFrame([*rows, ("rows", float(len(log.rows)))], "what string, value double")


@query(f"WITH {D}, n AS (SELECT rf, count(*) AS n FROM d GROUP BY rf) SELECT rf AS pick FROM n ORDER BY n DESC, rf LIMIT 1")
def sharp_selection(spark, sf_dir):
    """With a large epsilon the exponential mechanism picks the best."""
    counts = {r["rf"]: r["value"] for r in counted(spark, sf_dir, "rf").rows.collect()}
    pick = noise.exponential_mechanism(np.random.default_rng(0), counts, 1e6, 1.0)
    return spark.createDataFrame([(int(pick),)], "pick int")


# --- linear queries ------------------------------------------------------------------------------------------------------------

_A, _B = [[1.0, 2.0], [0.0, -3.0]], [[4.0, 0.0], [1.0, 1.0]]
#: What each construction must be, by matrix arithmetic.
_WANT = {
    "identity": np.eye(3), "ones": np.ones((2, 3)), "weighted": 2.5 * np.ones((2, 2)), "sum": np.array(_A) + _B, "difference": np.array(_A) - _B,
    "block_diag": np.block([[np.array(_A), np.zeros((2, 2))], [np.zeros((2, 2)), np.array(_B)]]), "vstack": np.vstack([_A, _B]), "hstack": np.hstack([_A, _B]),
    "product": np.array(_A) @ _B, "matmul": np.array(_A) @ _B, "kronecker": np.kron(_A, _B), "transpose": np.array(_A).T, "gram": np.array(_A).T @ _A, "row": np.array(_A)[1:2],
    "abs": np.abs(_A), "squared": np.square(_A), "scaled": 3 * np.array(_A), "inv": np.linalg.inv(_A), "pinv": np.linalg.pinv(np.ones((2, 3))), "dense": np.array(_A),
}


def _entries_sql(want: dict[str, np.ndarray]) -> str:
    rows = [f"('{k}', {i}, {j}, {round(float(x[i, j]), 9)}::DOUBLE)" for k, x in want.items() for i, j in zip(*np.nonzero(np.abs(x) > 1e-12), strict=True)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(op, row, cell, coef)"


@stated(_entries_sql(_WANT))
def linear_constructions(spark, sf_dir):
    """Their entries."""
    a, b = linear.Matrix(_A), linear.Matrix(_B)
    made = {
        "identity": linear.Identity(3), "ones": linear.Ones(2, 3), "weighted": linear.Weighted(linear.Ones(2, 2), 2.5), "sum": a + b, "difference": a - b,
        "block_diag": linear.block_diag([a, b]), "vstack": linear.vstack([a, b]), "hstack": linear.hstack([a, b]), "product": a * b, "matmul": a @ b,
        "kronecker": linear.Kronecker([a, b]), "transpose": a.T, "gram": a.gram(), "row": a[1], "abs": abs(a), "squared": a.squared(), "scaled": 3 * a,
        "inv": a.inv(spark), "pinv": linear.Ones(2, 3).pinv(spark), "dense": linear.Matrix(a.dense(spark)),
    }
    out = None
    for k, q in made.items():
        part = q.coo(spark).select(F.lit(k).alias("op"), F.col("row").cast("int").alias("row"), F.col("cell").cast("int").alias("cell"), F.round("coef", 9).alias("coef"))
        out = part if out is None else out.unionByName(part)
    return out.filter("abs(coef) > 1e-12")


@stated("SELECT * FROM (VALUES ('trace', -2.0::DOUBLE), ('l1', 5.0::DOUBLE), ('l2', sqrt(13.0::DOUBLE)), ('total', 0.0::DOUBLE), ('column0', 1.0::DOUBLE), ('column1', -1.0::DOUBLE), ('row0', 3.0::DOUBLE), ('row1', -3.0::DOUBLE), ('diag0', 1.0::DOUBLE), ('diag1', -3.0::DOUBLE), ('equal', 1.0::DOUBLE), ('rows', 2.0::DOUBLE)) t(what, value)")
def linear_norms(spark, sf_dir):
    """Of the matrix (1, 2; 0, -3)."""
    a = linear.Matrix(_A)
    values = {"trace": a.trace(spark), "l1": a.l1_sensitivity(spark), "l2": a.l2_sensitivity(spark), "equal": float(a == linear.Matrix(_A) and hash(a) == hash(linear.Matrix(_A))), "rows": float(a.shape[0])}
    for axis, name in ((0, "column"), (1, "row")):
        values |= {f"{name}{r[0]}": float(r[1]) for r in a.sums(spark, axis).collect()}
    values["total"] = float(a.sums(spark).first()[-1])
    values |= {f"diag{r[0]}": float(r[1]) for r in a.diag(spark).collect()}
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "what string, value double")


# --- privacy ----------------------------------------------------------------------------------------------------------------------

_CLOSED = """VALUES ('cdp_delta_standard', exp(-0.81::DOUBLE / 0.4)), ('subsample_eps', ln(1 + 0.1::DOUBLE * (exp(1.0::DOUBLE) - 1))), ('subsample_delta', 1e-6::DOUBLE),
  ('subsample_inverse_eps', 1.0::DOUBLE), ('subsample_inverse_delta', 1.0::DOUBLE), ('subsample_prob', (exp(0.5::DOUBLE) - 1) / (exp(1.0::DOUBLE) - 1)),
  ('gaussian', sqrt(0.5::DOUBLE) / (sqrt(ln(1e5::DOUBLE) + 1) - sqrt(ln(1e5::DOUBLE)))), ('laplace', 2.0::DOUBLE), ('laplace_sampled', 1 / ln(1 + (exp(0.5::DOUBLE) - 1) / 0.1)),
  ('randresponse', 1 / (1 + exp(-1.0::DOUBLE))), ('classical', sqrt(2 * ln(1.25e5::DOUBLE))), ('sensitivity', 2.0::DOUBLE), ('marginal_sensitivity', sqrt(2.0::DOUBLE)),
  ('laplace_scale', 6.0::DOUBLE), ('normal_cdf_0', 0.5::DOUBLE)"""


@stated(f"SELECT name, round(value, 9) AS value FROM ({_CLOSED}) t(name, value)")
def privacy_closed_forms(spark, sf_dir):
    """Against their formulas."""
    e, d = P.subsample_epsdelta(1.0, 1e-5, 0.1)
    b = Budget(0.5, 1e-5)
    values = {
        "cdp_delta_standard": P.cdp_delta_standard(0.1, 1.0), "subsample_eps": e, "subsample_delta": d, "subsample_inverse_eps": P.subsample_epsdelta_inverse(e, d, 0.1)[0],
        "subsample_inverse_delta": P.subsample_epsdelta_inverse(1.0, 0.5, 0.1)[1], "subsample_prob": P.subsample_prob(1.0, 0.0, 0.5, 0.0), "gaussian": P.gaussian_mech(1.0, 1e-5),
        "laplace": P.laplace_mech(0.5, 0), "laplace_sampled": P.laplace_mech(0.5, 0, prob=0.1), "randresponse": P.randresponse_mech(1.0, 0), "classical": P.classical_gaussian_mech(1.0, 1e-5),
        "sensitivity": b.sensitivity, "marginal_sensitivity": b.marginal_sensitivity, "laplace_scale": b.laplace_noise_scale(1.5, 0.5), "normal_cdf_0": P.normal_cdf(0.0),
    }
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in values.items()], "name string, value double")


_CDP = "(SELECT min((a - 1) * (a * {rho}::DOUBLE - {eps}::DOUBLE) + a * ln(1 - 1 / a) - ln(a - 1)) FROM (SELECT 1.01::DOUBLE + range / 2000.0::DOUBLE AS a FROM range(200000)))"


@stated(f"""SELECT name, round(value, 4) AS value FROM (VALUES ('log_delta', {_CDP.format(rho=0.1, eps=1.5)}), ('log_delta_small', {_CDP.format(rho=0.02, eps=1.0)}),
  ('eps_round_trip', ln(1e-5::DOUBLE)), ('rho_round_trip', ln(1e-6::DOUBLE))) t(name, value)""")
def privacy_concentrated(spark, sf_dir):
    """The least delta over orders, against a search over a grid of them; eps and rho lead back to their delta."""
    values = {"log_delta": P.cdp_delta(0.1, 1.5), "log_delta_small": P.cdp_delta(0.02, 1.0), "eps_round_trip": P.cdp_delta(0.3, P.cdp_eps(0.3, 1e-5)), "rho_round_trip": P.cdp_delta(P.cdp_rho(2.0, 1e-6), 2.0)}
    return spark.createDataFrame([(k, round(math.log(v), 4)) for k, v in values.items()], "name string, value double")


def _phi(x: str) -> str:
    """The normal distribution function by Simpson's rule from -12 to x."""
    return f"(SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(-12.0::DOUBLE + i * (({x}) + 12.0::DOUBLE) / 4000, 2) / 2)) * (({x}) + 12.0::DOUBLE) / 12000 / sqrt(2 * pi()) FROM (SELECT range AS i FROM range(4001)))"


@stated(f"SELECT * FROM (SELECT sigma, round({_phi('1 / (2 * sigma) - sigma')} - exp(1.0::DOUBLE) * {_phi('-1 / (2 * sigma) - sigma')}, 7) AS delta, round(1e-5::DOUBLE, 7) AS wanted FROM (SELECT 3.730632::DOUBLE AS sigma))")
def privacy_analytic_gaussian(spark, sf_dir):
    """The tail at the calibrated deviation, against numeric integration."""
    sigma = P.ana_gaussian_mech(1.0, 1e-5)
    delta = P.normal_cdf(1 / (2 * sigma) - sigma) - math.e * P.normal_cdf(-1 / (2 * sigma) - sigma)
    return spark.createDataFrame([(round(sigma, 6), round(delta, 7), round(1e-5, 7))], "sigma double, delta double, wanted double")


@stated("""WITH RECURSIVE f(n, v) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT n + 1, v + ln(n + 1.0::DOUBLE) FROM f WHERE n < 64),
  c(a, q, s) AS (VALUES (2, 0.1::DOUBLE, 1.0::DOUBLE), (8, 0.01::DOUBLE, 1.5::DOUBLE), (32, 0.001::DOUBLE, 2.0::DOUBLE), (64, 0.5::DOUBLE, 4.0::DOUBLE))
  SELECT a, q, s, round(greatest(0, ln(sum(exp(fa.v - fj.v - fr.v + (a - fj.n) * ln(1 - q) + fj.n * ln(q) + fj.n * (fj.n - 1) / (2 * s * s))))) / (a - 1), 8) AS rdp
  FROM c JOIN f fa ON fa.n = a JOIN f fj ON fj.n <= a JOIN f fr ON fr.n = a - fj.n GROUP BY a, q, s""")
def privacy_subsampled_divergence(spark, sf_dir):
    """The divergence of a sampled Gaussian at whole orders, by its binomial sum."""
    rows = [(a, q, s, round(P.rdp_subsampled(lambda x, s=s: P.rdp_gaussian(s, x), q, a, True), 8)) for a, q, s in ((2, 0.1, 1.0), (8, 0.01, 1.5), (32, 0.001, 2.0), (64, 0.5, 4.0))]
    return spark.createDataFrame(rows, "a int, q double, s double, rdp double")


@stated("SELECT * FROM (VALUES ('grows_with_prob', true), ('meets_unsampled', true), ('private_when_rare', true), ('laplace_grows', true), ('prob_of_little_noise', true), ('k_costs', true)) t(what, holds)")
def privacy_subsampled_order(spark, sf_dir):
    """Noise grows with the sampling probability up to the unsampled noise, and never vanishes."""
    sigma = [P.gaussian_mech(1.0, 1e-5, prob=p) for p in (0.01, 0.1, 0.5, 0.9)]
    b = [P.laplace_mech(1.0, 1e-5, prob=p) for p in (0.01, 0.5, 1.0)]
    holds = {
        "grows_with_prob": sigma == sorted(sigma), "meets_unsampled": abs(P.gaussian_mech(1.0, 1e-5, prob=1 - 1e-9) / P.gaussian_mech(1.0, 1e-5) - 1) < 0.02, "private_when_rare": sigma[0] > 0.3,
        "laplace_grows": b == sorted(b), "prob_of_little_noise": P.subsampled_prob_for(lambda a: P.rdp_gaussian(0.01, a), 1.0, 1e-5) < 1e-3, "k_costs": P.gaussian_mech(1.0, 1e-5, 100, 0.1) > sigma[1],
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in holds.items()], "what string, holds boolean")


# --- distances and transport -----------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT c_custkey AS i, least(greatest((c_acctbal + 1000) / 11000.0::DOUBLE, 0), 1) AS a, c_nationkey / 25.0::DOUBLE AS b FROM customer), c(j, a, b) AS (VALUES (0, 0.25::DOUBLE, 0.25::DOUBLE), (1, 0.75::DOUBLE, 0.5::DOUBLE))
  SELECT i, j, round(greatest(abs(x.a - c.a), abs(x.b - c.b)), 9) AS far, round(sqrt((x.a - c.a) * (x.a - c.a) + (x.b - c.b) * (x.b - c.b)), 9) AS near FROM x, c""")
def distances_to_centers(spark, sf_dir):
    """Points against centres, by the largest gap and by length."""
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), S.clamp_unit((F.col("c_acctbal") + 1000) / F.lit(11000.0)).alias("a"), (F.col("c_nationkey") / F.lit(25.0)).alias("b"))
    c = spark.createDataFrame([(0, 0.25, 0.25), (1, 0.75, 0.5)], "j int, a double, b double")
    far, near = (transport.distances(x, c, ["a", "b"], p).withColumnRenamed("dist", n) for p, n in ((math.inf, "far"), (2, "near")))
    return far.join(near, ["i", "j"]).select("i", "j", F.round("far", 9).alias("far"), F.round("near", 9).alias("near"))


@stated("SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.0::DOUBLE), (2, 0.5::DOUBLE), (3, 0.0::DOUBLE)) t(cell, p)")
def nearest_probability(spark, sf_dir):
    """0.1 beyond a total of 1 fills the negative cell from its nearer neighbour, 2, as 0 is dearer."""
    cost = np.array([[0, 0.6, 1, 1], [0.6, 0, 0.4, 1], [1, 0.4, 0, 1], [1, 1, 1, 0]])
    p = transport.nearest_probability(np.array([0.5, -0.1, 0.6, 0.0]), cost)
    return spark.createDataFrame([(i, round(float(v), 9)) for i, v in enumerate(p)], "cell int, p double")


@query(f"WITH s AS ({_eval_sql(SMALL, 'sum(abs(g)) AS l1, sqrt(sum(g * g)) AS l2')}) SELECT round(avg(l1), 7) AS l1_avg, round(max(l1), 7) AS l1_max, round(avg(l2), 7) AS l2_avg, round(max(l2), 7) AS l2_max FROM s")
def evaluator_run(spark, sf_dir):
    """The whole evaluator, with a table set later and an undo step."""
    real, synth = parity_rows(spark, sf_dir)
    tool = evaluate.Evaluator(real, real, SMALL, all_kway(SMALL, 2), n_directions=1)
    tool.update_synth(synth)
    tool.set_compression(lambda df: df)
    got = tool.evaluate()[0]
    return spark.createDataFrame([tuple(round(got[k], 7) for k in ("l1_avg", "l1_max", "l2_avg", "l2_max"))], "l1_avg double, l1_max double, l2_avg double, l2_max double")


# --- particles ---------------------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(s_nationkey AS INT) AS nation, CAST(CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END AS INT) AS rich, CAST(count(*) AS DOUBLE) AS value FROM supplier GROUP BY ALL")
def particles_of_rows(spark, sf_dir):
    """A model that begins with the rows has their histogram."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("nation"), F.when(F.col("s_acctbal") < 0, 0).otherwise(1).alias("rich"))
    domain = Domain(("nation", "rich"), (25, 2))
    model = particles.ParticleModel.from_codes(domain, rows.toPandas().to_numpy())
    x = model.project(("nation", "rich"))
    assert np.allclose(model.datavector(False), x)
    return spark.createDataFrame([(*map(int, i), round(float(v), 6)) for i, v in np.ndenumerate(x) if v > 0.5], "nation int, rich int, value double")


# --- coding and sources --------------------------------------------------------------------------------------------------------------------

_CODES = """WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_size) AS slo, max(p_size) AS shi FROM part), s AS (SELECT *, CAST(least(16, shi - slo + 1) AS INT) AS sk FROM b),
  br AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS bc FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)),
  ty AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS tc FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)),
  c AS (SELECT p_brand, p_type, bc, tc, CAST(least(greatest(ceil((p_retailprice - lo) / (hi - lo) * 16) - 1, 0), 15) AS INT) AS pc,
    CAST(least(greatest(ceil((CAST(p_size AS DOUBLE) - slo) / CAST(shi - slo AS DOUBLE) * sk) - 1, 0), sk - 1) AS INT) AS sc, lo, hi, slo, shi, sk FROM part LEFT JOIN br USING (p_brand) LEFT JOIN ty USING (p_type), s)"""


@query(f"{_CODES} SELECT bc AS p_brand, tc AS p_type, sc AS p_size, pc AS p_retailprice FROM c")
def table_codes(spark, sf_dir):
    """A whole table coded at once."""
    df = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_retailprice")
    return discretize.Coder.fit(df, 16).forward(df)


@query(f"""{_CODES} SELECT p_brand, p_type, round(CASE WHEN sc = 0 THEN (slo - 0.001 * (shi - slo) + slo + (shi - slo) / CAST(sk AS DOUBLE)) / 2 ELSE slo + (sc + 0.5) * (shi - slo) / CAST(sk AS DOUBLE) END, 6) AS p_size,
  round(CASE WHEN pc = 0 THEN (lo - 0.001 * (hi - lo) + lo + (hi - lo) / 16) / 2 ELSE lo + (pc + 0.5) * (hi - lo) / 16 END, 6) AS p_retailprice FROM c""")
def table_backward(spark, sf_dir):
    """Codes back to values, by a coder that was saved and loaded."""
    df = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_retailprice")
    coder = discretize.Coder.from_json(discretize.Coder.fit(df, 16).to_json())
    back = coder.backward(coder.forward(df))
    return back.select("p_brand", "p_type", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query(f"WITH {D} SELECT rf, ls, count(*) AS n, sum(l_quantity) AS weight FROM d GROUP BY rf, ls")
def dataset_project_drop(spark, sf_dir):
    """Checked, projected twice, weights kept."""
    data = Dataset.of(coded_lineitem(spark, sf_dir, "l_quantity"), LINEITEM, "l_quantity").project(("rf", "ls", "dc")).drop(("dc",))
    assert data.domain.attrs == ("rf", "ls")
    return data.df.groupBy("rf", "ls").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("SELECT count(*) AS records, count(*) AS together, CAST(0 AS BIGINT) AS shared, true AS near_a_fifth FROM customer")
def split_parts(spark, sf_dir):
    """The parts are disjoint, make up the table, and the test part is about a fifth."""
    rows = table(spark, sf_dir, "customer")
    train, test = split(rows, ["c_custkey"])
    n, a, b = rows.count(), train.count(), test.count()
    shared = train.join(test, "c_custkey", "left_semi").count()
    return spark.createDataFrame([(n, a + b, shared, abs(b / n - 0.2) < 0.2 / math.sqrt(n) * 10)], "records long, together long, shared long, near_a_fifth boolean")


@query("SELECT name, features, row_count AS rows FROM (VALUES ('region', 2, (SELECT count(*) FROM region)), ('customer', 5, (SELECT count(*) FROM customer)), ('lineitem', 11, (SELECT count(*) FROM lineitem))) t(name, features, row_count) WHERE features <= 10 AND row_count >= 50")
def catalogue_eligible(spark, sf_dir):
    """Which tables are neither too wide nor too short."""
    rows = [(n, len((t := table(spark, sf_dir, n)).columns), t.count()) for n in ("region", "customer", "lineitem")]
    return eligible(spark.createDataFrame(rows, "name string, features int, rows long"), 10, 50)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def flattened_props(spark, sf_dir):
    """A JSON text as a struct, its fields as columns, dots gone from names."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    nested = S.flatten_struct(rows, ".")
    return S.clean_names(nested.withColumnRenamed("props.k", "props_.k"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IS NOT NULL AND p_partkey IS NOT NULL")
def cleaned_rows(spark, sf_dir):
    """Nulls go, and on request the first column."""
    return discretize.clean(table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("p_part.key"), "p_size"), True)


@stated("SELECT s.range AS code, CASE WHEN s.range IN (1, 4) THEN 'kept' ELSE 'merged' END AS what FROM range(6) s")
def merged_and_split(spark, sf_dir):
    """Merged codes come back as some code that was merged."""
    domain, keep = Domain(("a",), (6,)), {"a": [1, 4]}
    rows = spark.range(6000).select("id", (F.col("id") % 6).cast("int").alias("a"))
    back = discretize.split_unsupported(discretize.merge_unsupported(rows, keep), keep, domain, ["id"])
    seen = back.groupBy(F.col("a").cast("long").alias("code")).agg(F.min(F.col("id") % 6).alias("lo"), F.max(F.col("id") % 6).alias("hi"))
    own = (F.col("lo") == F.col("code")) & (F.col("hi") == F.col("code"))
    return seen.select("code", F.when(own, "kept").otherwise("merged").alias("what"))
