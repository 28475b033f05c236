"""Registered queries of the engines whose state is kept in tables, and their SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import particle_tables, pgm_tables, transport_tables
from marginalia.operators.factor import Factor
from marginalia.operators.marginals import dense, marginals_exploded
from marginalia.plans.graph import JunctionTree
from marginalia.plans.schema import Domain
from marginalia.queries import LINEITEM, THETAS, D, coded_lineitem, grid_sql, lower, query, table
from marginalia.storage import materialise

# --- particles -----------------------------------------------------------------------------------------------------------

PLACES = Domain.fromdict({"acct": 8, "nation": 25})
RATE = 0.1

_X = "least(greatest(({acct} + 1000) / 11000.0::DOUBLE, 0), 1)"
_LINES = [(0, *t, 4) for t in THETAS] + [(1, 0.0, 1.0, 1)]  # clique, direction, directions of the clique
PARTICLES_SQL = f"""
WITH x AS (SELECT c_custkey AS pid, {_X.format(acct='c_acctbal')} AS xa, (2 * c_nationkey + 1) / 50.0::DOUBLE AS xn FROM customer),
n AS (SELECT count(*) AS n FROM x),
s AS (SELECT CAST(least(greatest(ceil({_X.format(acct='s_acctbal')} * 8) - 1, 0), 7) AS INT) AS a, s_nationkey AS b FROM supplier),
c AS (
  SELECT 0 AS k, a * 25 + b AS cell, (2 * a + 1) / 16.0::DOUBLE AS ya, (2 * b + 1) / 50.0::DOUBLE AS yn, count(*) AS v FROM s GROUP BY a, b
  UNION ALL SELECT 1, b, 0.0::DOUBLE, (2 * b + 1) / 50.0::DOUBLE, count(*) FROM s GROUP BY b),
u AS (SELECT *, CAST(floor(sum(v) OVER (PARTITION BY k ORDER BY cell) / CAST(sum(v) OVER (PARTITION BY k) AS DOUBLE) * n + 0.5) AS BIGINT) AS upto FROM c, n),
q AS (SELECT *, upto - coalesce(lag(upto) OVER (PARTITION BY k ORDER BY cell), 0) AS copies FROM u),
t(proj, k, ta, tn, many) AS (VALUES {', '.join(f'({i}, {k}, {a}::DOUBLE, {b}::DOUBLE, {m})' for i, (k, a, b, m) in enumerate(_LINES))}),
p AS (SELECT proj, pid, z, row_number() OVER (PARTITION BY proj ORDER BY z, pid) - 1 AS r, ta, tn, many FROM (SELECT proj, pid, CASE WHEN k = 1 THEN xn * tn ELSE xa * ta + xn * tn END AS z, ta, tn, many FROM x, t)),
y AS (SELECT proj, z, sum(copies) OVER w - copies AS f, sum(copies) OVER w - 1 AS l
  FROM (SELECT proj, cell, copies, CASE WHEN t.k = 1 THEN yn * tn ELSE ya * ta + yn * tn END AS z FROM q JOIN t USING (k) WHERE copies > 0) WINDOW w AS (PARTITION BY proj ORDER BY z, cell)),
g AS (SELECT pid, sum(200 * ta / many * (p.z - y.z)) AS ga, sum(200 * tn / many * (p.z - y.z)) AS gn FROM p JOIN y ON y.proj = p.proj AND p.r BETWEEN f AND l GROUP BY pid)
SELECT pid, round(least(greatest(xa - {RATE} * ga / (abs(ga) + 1e-8), 0), 1), 5) AS x_acct, round(least(greatest(xn - {RATE} * gn / (abs(gn) + 1e-8), 0), 1), 5) AS x_nation FROM x JOIN g USING (pid)
"""


def _scaled(account: str):
    return F.least(F.greatest((F.col(account) + 1000) / 11000.0, F.lit(0.0)), F.lit(1.0))


def customer_points(spark, sf_dir) -> DataFrame:
    """A point (pid, x_acct, x_nation) for each customer."""
    nation = (2 * F.col("c_nationkey") + 1) / 50.0
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), _scaled("c_acctbal").alias("x_acct"), nation.alias("x_nation"))


@query(PARTICLES_SQL)
def particle_step(spark, sf_dir) -> DataFrame:
    """Customers as points, one step toward two marginals of the suppliers."""
    cloud = particle_tables.Cloud.of_rows(PLACES, customer_points(spark, sf_dir))
    supplier = table(spark, sf_dir, "supplier").select(F.least(F.greatest(F.ceil(_scaled("s_acctbal") * 8) - 1, F.lit(0)), F.lit(7)).cast("int").alias("acct"), F.col("s_nationkey").alias("nation"))
    batch = []
    for clique, cell, thetas in ((("acct", "nation"), F.col("acct") * 25 + F.col("nation"), np.array(THETAS)), (("nation",), F.col("nation"), np.ones((1, 1)))):
        shares = supplier.groupBy(cell.cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("value"))
        batch.append((particle_tables.Target.of_marginal(PLACES, clique, shares, cloud.n), thetas))
    moved, _ = particle_tables.step(cloud, batch, RATE)
    return moved.rows.select("pid", F.round("x_acct", 5).alias("x_acct"), F.round("x_nation", 5).alias("x_nation"))


# --- graphical models -----------------------------------------------------------------------------------------------------

CHAIN5 = LINEITEM.project(("q", "dc", "rf", "ls", "mo", "tx"))
CLIQUES5 = (("q", "dc"), ("dc", "rf"), ("rf", "ls"), ("ls", "mo"), ("mo", "tx"))
_GRID5 = grid_sql(*CHAIN5.config.items())
_POT = ", ".join(f"p{i} AS (SELECT {a}, {b}, ln(1 + count(*)) / {i + 2}.0::DOUBLE AS t FROM d GROUP BY {a}, {b})" for i, (a, b) in enumerate(CLIQUES5))
_SUM5 = " + ".join(f"coalesce(p{i}.t, 0)" for i in range(5))
_JOIN5 = " ".join(f"LEFT JOIN p{i} ON p{i}.{a} = g_{a}.{a} AND p{i}.{b} = g_{b}.{b}" for i, (a, b) in enumerate(CLIQUES5))
_PARTS5 = " UNION ALL ".join(f"SELECT '{a},{b}' AS clique, CAST({a} * {CHAIN5[b]} + {b} AS BIGINT) AS cell, sum(v) AS v FROM j GROUP BY {a}, {b}" for a, b in CLIQUES5)


@query(f"""WITH {D}, {_POT}, e AS (SELECT {', '.join(f'g_{a}.{a}' for a in CHAIN5)}, {_SUM5} AS t FROM {_GRID5} {_JOIN5}),
  top AS (SELECT max(t) AS m FROM e), j AS (SELECT e.*, exp(t - m) AS v FROM e, top), z AS (SELECT sum(v) AS z FROM j), n AS (SELECT count(*) AS n FROM d)
  SELECT clique, cell, round(v / z * n, 5) AS value FROM ({_PARTS5}), z, n""")
def chain_propagation(spark, sf_dir) -> DataFrame:
    """All clique marginals of a model of five cliques, with potentials that no data has as its own."""
    tree = JunctionTree(CHAIN5, CLIQUES5, CHAIN5.attrs)
    rows = coded_lineitem(spark, sf_dir).select(*CHAIN5.attrs)
    counts = materialise(dense(marginals_exploded(rows, CHAIN5, tree.cliques), CHAIN5, tree.cliques), "chain-counts")
    potentials = {}
    for i, c in enumerate(tree.cliques):
        own = CHAIN5.project(c)
        weight = 1.0 / (next(k for k, given in enumerate(CLIQUES5) if set(given) == set(c)) + 2)
        potentials[c] = pgm_tables.unpacked(counts.withColumnRenamed("clique_id", "part"), i, own).map(lambda v, w=weight: F.log(1 + v) * w)
    found, _ = pgm_tables.propagate(potentials, tree, float(rows.count()))
    out = []
    for i, c in enumerate(tree.cliques):
        given = next(g for g in CLIQUES5 if set(g) == set(c))
        part = pgm_tables.unpacked(found, i, CHAIN5.project(c)).transpose(given)
        cell = (F.col(given[0]) * CHAIN5[given[1]] + F.col(given[1])).cast("long")
        out.append(part.rows.select(F.lit(",".join(given)).alias("clique"), cell.alias("cell"), F.round("value", 5).alias("value")))
    return reduce(DataFrame.union, out)


TWO = LINEITEM.project(("dc", "rf", "ls"))
STEPS = 3
_NOISE = "(cell * 7919 % 13 - 6)"


def _mirror_sql() -> str:
    """Steps one after the other over all cells of the three attributes."""
    cell = {"f": ("dc", "rf", "dc * 3 + rf", 4.0), "g": ("rf", "ls", "rf * 2 + ls", 9.0)}
    parts = [f"WITH {D}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)"]
    for name, (a, b, number, _) in cell.items():
        parts.append(f"y_{name} AS (SELECT {a}, {b}, v + {_NOISE} AS y FROM (SELECT g_{a}.{a}, g_{b}.{b}, CAST(coalesce(m.v, 0) AS DOUBLE) AS v, {number.replace(a, f'g_{a}.{a}').replace(b, f'g_{b}.{b}')} AS cell FROM {grid_sql((a, TWO[a]), (b, TWO[b]))} LEFT JOIN (SELECT {a}, {b}, count(*) AS v FROM d GROUP BY {a}, {b}) m ON m.{a} = g_{a}.{a} AND m.{b} = g_{b}.{b}))")
        parts.append(f"{name}0 AS (SELECT {a}, {b}, 0.0::DOUBLE AS t FROM y_{name})")
    for k in range(STEPS + 1):
        parts.append(f"j{k} AS (SELECT dc, rf, ls, exp(f.t + g.t) AS v FROM f{k} f JOIN g{k} g USING (rf))")
        parts.append(f"z{k} AS (SELECT sum(v) AS z FROM j{k})")
        for name, (a, b, _, sigma) in cell.items():
            parts.append(f"m_{name}{k} AS (SELECT {a}, {b}, sum(v) / z * n AS mu FROM j{k}, z{k}, n GROUP BY {a}, {b}, z, n)")
            if k < STEPS:
                parts.append(f"{name}{k + 1} AS (SELECT {a}, {b}, t - 2 / (n * n) * ((mu - y) / {sigma} / {sigma}) AS t FROM {name}{k} JOIN m_{name}{k} USING ({a}, {b}) JOIN y_{name} USING ({a}, {b}), n)")
    return ", ".join(parts) + f" SELECT 'dc,rf' AS clique, CAST(dc * 3 + rf AS BIGINT) AS cell, round(mu, 5) AS value FROM m_f{STEPS} UNION ALL SELECT 'rf,ls', CAST(rf * 2 + ls AS BIGINT), round(mu, 5) FROM m_g{STEPS}"


@query(_mirror_sql())
def mirror_descent(spark, sf_dir) -> DataFrame:
    """Three steps of mirror descent toward two marginals that disagree a little."""
    rows = coded_lineitem(spark, sf_dir).select(*TWO.attrs)
    cliques = [("dc", "rf"), ("rf", "ls")]
    counts = materialise(dense(marginals_exploded(rows, TWO, cliques), TWO, cliques), "mirror-counts")
    noisy = F.col("value") + (F.col("cell") * 7919 % 13 - 6)
    measured = [(c, counts.filter(F.col("clique_id") == i).select("cell", noisy.alias("y")), s) for i, (c, s) in enumerate(zip(cliques, (4.0, 9.0), strict=True))]
    tree, found = pgm_tables.TableInference(TWO, STEPS, None, order=TWO.attrs).estimate(spark, measured, float(rows.count()))
    names = F.array(*(F.lit(",".join(c)) for c in tree.cliques))
    return found.select(F.element_at(names, F.col("part") + 1).alias("clique"), "cell", F.round("value", 5).alias("value"))


# --- transport ---------------------------------------------------------------------------------------------------------------

PLANE = LINEITEM.project(("q", "dc"))
REG, ROUNDS = 0.05, 20
_COST = "(pow(abs((2 * x.q + 1) / 20.0::DOUBLE - (2 * y.q + 1) / 20.0::DOUBLE), 2) + pow(abs((2 * x.dc + 1) / 22.0::DOUBLE - (2 * y.dc + 1) / 22.0::DOUBLE), 2))"


def _sinkhorn_sql() -> str:
    parts = [f"""WITH {D}, c AS (SELECT g_q.q, g_dc.dc, 1.0::DOUBLE + coalesce(f, 0) AS na, 1.0::DOUBLE + coalesce(o, 0) AS nb FROM {grid_sql(('q', 10), ('dc', 11))}
      LEFT JOIN (SELECT q, dc, count(*) FILTER (ls = 0) AS f, count(*) FILTER (ls = 1) AS o FROM d GROUP BY q, dc) m ON m.q = g_q.q AND m.dc = g_dc.dc)""",
      "w AS (SELECT q, dc, na / sum(na) OVER () AS a, nb / sum(nb) OVER () AS b FROM c)", "g0 AS (SELECT q, dc, 0.0::DOUBLE AS v FROM w)"]
    for k in range(1, ROUNDS + 1):
        for to, source, weight in ((f"f{k}", f"g{k - 1}", "a"), (f"g{k}", f"f{k}", "b")):
            terms = f"SELECT x.q, x.dc, x.{weight} AS weight, (y.v - {_COST}) / {REG} AS e FROM w x, {source} y"
            parts.append(f"{to} AS MATERIALIZED (SELECT q, dc, {REG} * (ln(max(weight)) - (max(top) + ln(sum(exp(e - top))))) AS v FROM (SELECT *, max(e) OVER (PARTITION BY q, dc) AS top FROM ({terms})) GROUP BY q, dc)")
    return ", ".join(parts) + f" SELECT q, dc, round(f.v, 6) AS f, round(g.v, 6) AS g FROM f{ROUNDS} f JOIN g{ROUNDS} g USING (q, dc)"


@query(_sinkhorn_sql())
def sinkhorn_potentials(spark, sf_dir) -> DataFrame:
    """Twenty rounds between the marginals of shipped and open items, an attribute at a time."""
    counts = dense(marginals_exploded(coded_lineitem(spark, sf_dir), LINEITEM, [("q", "dc", "ls")]), LINEITEM, [("q", "dc", "ls")])
    halves = counts.groupBy(F.floor(F.col("cell") / 2).alias("at")).agg(*((1 + F.sum(F.when(F.col("cell") % 2 == k, F.col("value")).otherwise(0.0))).alias(n) for k, n in enumerate("ab")))
    sums = halves.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    cells = halves.select(F.floor(F.col("at") / 11).cast("int").alias("q"), (F.col("at") % 11).cast("int").alias("dc"), (F.col("a") / sums["a"]).alias("a"), (F.col("b") / sums["b"]).alias("b"))
    state = transport_tables.sinkhorn(cells, PLANE, REG, ROUNDS, tol=0.0)
    return state.select("q", "dc", lower(F.col("f")).alias("f"), lower(F.col("g")).alias("g"))


@query("""WITH x AS (SELECT c_custkey AS i, (c_acctbal + 1000) / 11000.0::DOUBLE AS a, (c_custkey * 7919 % 1000) / 1000.0::DOUBLE AS b, c_nationkey / 25.0::DOUBLE AS c FROM customer),
  y AS (SELECT l_orderkey * 8 + l_linenumber AS j, l_quantity / 50.0::DOUBLE AS a, (l_extendedprice - floor(l_extendedprice / 1000) * 1000) / 1000 AS b, l_discount * 10 AS c FROM lineitem),
  k AS (SELECT i, j, greatest(abs(x.a - y.a), abs(x.b - y.b), abs(x.c - y.c)) AS dist FROM x, y),
  m AS (SELECT i, min(dist) AS dist FROM k GROUP BY i)
  SELECT i, min(j) AS j, round(m.dist, 9) AS dist FROM m JOIN k USING (i) WHERE k.dist = m.dist GROUP BY i, m.dist""")
def nearest_of_many(spark, sf_dir) -> DataFrame:
    """For each customer the nearest of all line items as centres."""
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), ((F.col("c_acctbal") + 1000) / 11000.0).alias("a"), (F.col("c_custkey") * 7919 % 1000 / 1000.0).alias("b"), (F.col("c_nationkey") / 25.0).alias("c"))
    price = F.col("l_extendedprice")
    y = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("j"), (F.col("l_quantity") / 50.0).alias("a"), ((price - F.floor(price / 1000) * 1000) / 1000).alias("b"), (F.col("l_discount") * 10).alias("c"))
    return transport_tables.nearest_centres(x, y, ["a", "b", "c"]).select("i", "j", F.round("dist", 9).alias("dist"))
