"""Registered queries of sets, dictionaries and answers that are kept as tables, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marginalia.operators import evaluate, mechanisms
from marginalia.operators.containment import smallest_holders
from marginalia.operators.dictionaries import StoredDictionary
from marginalia.operators.marginal_store import MarginalStore
from marginalia.operators.marginals import clique_names, marginals_kernel
from marginalia.operators.pgm import FactoredInference
from marginalia.operators.pgm_tables import TableInference
from marginalia.operators.snapshots import Snapshots, inverse_curves
from marginalia.plans.privacy import Budget
from marginalia.plans.schema import all_kway
from marginalia.queries import LINEITEM, SMALL, THETAS, D, coded_lineitem, query, table
from marginalia.storage import materialise, shared_dir
from marginalia.table_queries import PARTICLES_SQL, customer_points, particle_step

# --- sets ------------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS attrs FROM lineitem GROUP BY 1),
  b AS (SELECT o_custkey AS id, list(DISTINCT l_suppkey) AS attrs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT a.id, min_by(b.id, len(b.attrs) * 100000000 + b.id) AS model_id FROM a JOIN b ON list_has_all(b.attrs, a.attrs) GROUP BY a.id""")
def set_containment(spark, sf_dir) -> DataFrame:
    """Each order's suppliers within the fewest that one customer has."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers = F.collect_set("l_suppkey").alias("attrs")
    measured = lines.groupBy(F.col("l_orderkey").alias("id")).agg(suppliers)
    models = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(suppliers)
    return smallest_holders(measured, models.withColumn("cells", F.size("attrs")))


# --- dictionaries ----------------------------------------------------------------------------------------------------------

_PART = "CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_linestatus, {_PART} AS v FROM lineitem),
  f AS (SELECT v, min(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS late FROM x GROUP BY v),
  c AS (SELECT v, row_number() OVER (ORDER BY late, v) - 1 AS code FROM f)
  SELECT l_orderkey, l_linenumber, code, v AS original FROM x JOIN c USING (v)""")
def dictionary_extended(spark, sf_dir) -> DataFrame:
    """Offers coded by a dictionary of the shipped lines, extended by all lines, and decoded."""
    lines = table(spark, sf_dir, "lineitem")
    offers = lines.select("l_orderkey", "l_linenumber", "l_linestatus", F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("code"))
    known = StoredDictionary.create(spark, StringType())
    known.extend(offers.filter("l_linestatus = 'F'"), "code")
    known.extend(offers, "code")
    coded = known.forward(offers.drop("l_linestatus"), "code")
    return known.backward(coded, "code", "original")


# --- stored answers --------------------------------------------------------------------------------------------------------

TRIPLES = all_kway(LINEITEM, 3)
PAIRS = all_kway(LINEITEM, 2)
SIGMA = 5.0


def _gap(i: int, clique: tuple[str, ...]) -> str:
    """The distance over all cells of a clique, empty ones too."""
    cross = " CROSS JOIN ".join(f"s_{a}" for a in clique)
    product = " * ".join(f"s_{a}.p" for a in clique)
    same = " AND ".join(f"m.{a} = s_{a}.{a}" for a in clique)
    cells = LINEITEM.size(clique)
    return f"""SELECT {i} AS clique_id, round(gap + (n - mass) - sqrt(2 / pi()) * {SIGMA} * {cells}, 3) AS score FROM (
      SELECT sum(abs(coalesce(m.v, 0) - n.n * {product})) AS gap, sum(n.n * {product}) AS mass, any_value(n.n) AS n
      FROM {cross} CROSS JOIN n LEFT JOIN (SELECT {', '.join(clique)}, count(*) AS v FROM d GROUP BY {', '.join(clique)}) m ON {same})"""


_SHARES = ", ".join(f"s_{a} AS (SELECT {a}, count(*) / CAST((SELECT n FROM n) AS DOUBLE) AS p FROM d GROUP BY {a})" for a in LINEITEM)


@query(f"WITH {D}, n AS (SELECT count(*) AS n FROM d), {_SHARES} " + " UNION ALL ".join(_gap(i, c) for i, c in enumerate(TRIPLES)))
def stored_scores(spark, sf_dir) -> DataFrame:
    """Scores of all three-way marginals against independence, from answers left as a table."""
    store = MarginalStore.of(coded_lineitem(spark, sf_dir), LINEITEM, TRIPLES)
    return store.scores(store.independent(), SIGMA).select("clique_id", F.round("score", 3).alias("score"))


def _count(i: int, clique: tuple[str, ...]) -> str:
    strides = LINEITEM.project(clique).strides()
    cell = " + ".join(f"{a} * {s}" for a, s in zip(clique, strides, strict=True))
    return f"SELECT {i} AS clique_id, CAST({cell} AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS value FROM d GROUP BY {', '.join(clique)}"


@query(f"WITH {D} " + " UNION ALL ".join(_count(i, c) for i, c in enumerate(PAIRS)))
def stored_answers(spark, sf_dir) -> DataFrame:
    """All two-way marginals summed out of the stored three-way ones."""
    return MarginalStore.of(coded_lineitem(spark, sf_dir), LINEITEM, TRIPLES).answers(PAIRS)


# --- mechanisms, where noise is far below a row --------------------------------------------------------------------------------

SURE = Budget(10_000.0, 1e-6, seed=0)  # to test the machinery: what is measured must come back
NEAR = 0.05  # of the rows, in L1
EDGES = all_kway(SMALL, 2)


def _edge(a: str, b: str) -> str:
    cells = f"(SELECT s_{a}.{a}, s_{b}.{b}, n.n * s_{a}.p * s_{b}.p AS m FROM s_{a}, s_{b}, n)"
    return f"SELECT '{a}' AS a, '{b}' AS b, sum(abs(coalesce(v, 0) - m)) AS gap FROM {cells} LEFT JOIN (SELECT {a}, {b}, count(*) AS v FROM d GROUP BY ALL) USING ({a}, {b})"


_SMALL_SHARES = ", ".join(f"s_{a} AS (SELECT {a}, count(*) / CAST((SELECT n FROM n) AS DOUBLE) AS p FROM d GROUP BY {a})" for a in SMALL)


def near(old: DataFrame, made: DataFrame, domain, cliques, name: str) -> DataFrame:
    """(mechanism, clique, cells, near): cells that rows fill, and whether ``made``'s marginal is near theirs. ``old``: the
    rows' marginals (clique, cell, old), of these cliques and maybe more."""
    names = clique_names(cliques)
    new = named(marginals_kernel(made, domain, cliques), cliques, "new")
    gap = F.sum(F.abs(F.coalesce("old", F.lit(0.0)) - F.coalesce("new", F.lit(0.0)))) / F.sum("old") <= NEAR
    found = old.filter(F.col("clique").isin(names)).join(new, ["clique", "cell"], "full").groupBy("clique").agg(F.count("old").alias("cells"), gap.alias("near"))
    return found.select(F.lit(name).alias("mechanism"), "clique", "cells", "near")


def named(answers: DataFrame, cliques, value: str) -> DataFrame:
    """(clique, cell, ``value``), cliques by name."""
    names = F.array(*map(F.lit, clique_names(cliques)))
    return answers.select(F.element_at(names, F.col("clique_id") + 1).alias("clique"), "cell", F.col("value").alias(value))


def _filled(name: str, cliques) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS mechanism, '{'|'.join(c)}' AS clique, count(*) AS cells, true AS near FROM (SELECT DISTINCT {', '.join(c)} FROM d)" for c in cliques)


SINGLES = [(a,) for a in SMALL]


@query(f"WITH {D} {_filled('kway', EDGES)} UNION ALL {_filled('mwem', EDGES)} UNION ALL {_filled('mst', SINGLES)} UNION ALL {_filled('aim', SINGLES)}")
def mechanisms_recover(spark, sf_dir) -> DataFrame:
    """With next to no noise the synthetic rows have the marginals that were measured."""
    rows, engine = coded_lineitem(spark, sf_dir).select(*SMALL), lambda: FactoredInference(SMALL)
    made = {
        "kway": (mechanisms.KWay(SURE).run(rows, SMALL, engine(), EDGES), EDGES),
        "mwem": (mechanisms.MWEM(SURE).run(rows, SMALL, engine(), EDGES), EDGES),
        "mst": (mechanisms.MST(SURE).run(rows, SMALL, engine()), SINGLES),
        "aim": (mechanisms.AIM(SURE).run(rows, SMALL, engine(), EDGES), SINGLES),
    }
    asked = [*EDGES, *SINGLES]
    old = materialise(named(marginals_kernel(rows, SMALL, asked), asked, "old"), "old-marginals")  # of all mechanisms, in one scan
    return reduce(DataFrame.union, (near(old, x, SMALL, cliques, name) for name, (x, cliques) in made.items()))


@query(f"""WITH RECURSIVE {D}, n AS (SELECT count(*) AS n FROM d), {_SMALL_SHARES}, e AS ({' UNION ALL '.join(_edge(*c) for c in EDGES)}),
  t AS (SELECT ['{SMALL.attrs[0]}'] AS seen, '' AS a, '' AS b UNION ALL
    SELECT list_distinct(seen || [e.a, e.b]), e.a, e.b FROM t JOIN e ON list_contains(seen, e.a) <> list_contains(seen, e.b) QUALIFY row_number() OVER (ORDER BY gap DESC) = 1),
  c AS ({_filled('mst', EDGES)})
  SELECT mechanism, clique, cells, near FROM c JOIN t ON clique = a || '|' || b""")
def mst_on_tables(spark, sf_dir) -> DataFrame:
    """M05, M06, N08, E11 with answers, measurements and model as tables: the tree is the greatest spanning one, and
    the synthetic rows have its marginals."""
    rows = coded_lineitem(spark, sf_dir).select(*SMALL)
    held = mechanisms.MST(SURE)
    made = held.run(rows, SMALL, TableInference(SMALL, 0, warm=True))
    edges = [SMALL.canonical(e) for e in held.tree]
    return near(named(marginals_kernel(rows, SMALL, edges), edges, "old"), made, SMALL, edges, "mst")


# --- metrics beside the work, data of plots ----------------------------------------------------------------------------------

WATCHED = [("dc", "rf"), ("ls",), ("mo",)]


def _watched(i: int, clique: tuple[str, ...]) -> str:
    keys = ", ".join(clique)
    return f"""SELECT {i} AS clique_id, (SELECT count(*) FROM f) AS records, round(sum(abs(coalesce(a, 0) - coalesce(b, 0))), 8) AS l1, round(sqrt(sum(pow(coalesce(a, 0) - coalesce(b, 0), 2))), 8) AS l2,
      round(sum(abs(coalesce(a, 0) - coalesce(b, 0))) / 2, 8) AS variation
      FROM (SELECT {keys}, count(*) / CAST((SELECT count(*) FROM f) AS DOUBLE) AS a FROM f GROUP BY ALL) FULL JOIN (SELECT {keys}, count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE) AS b FROM d GROUP BY ALL) USING ({keys})"""


@query(f"WITH {D}, f AS (SELECT * FROM d WHERE q < 5) " + " UNION ALL ".join(_watched(i, c) for i, c in enumerate(WATCHED)))
def write_and_measure(spark, sf_dir) -> DataFrame:
    """Lines of small quantity are written and, in the same scan, measured against all lines."""
    lines = coded_lineitem(spark, sf_dir)
    truth = marginals_kernel(lines, LINEITEM, WATCHED)
    log = evaluate.write_measured(lines.filter("q < 5"), LINEITEM, WATCHED, truth, f"{shared_dir(spark)}/measured-{uuid.uuid4().hex}")
    return log.select("clique_id", "records", *(F.round(c, 8).alias(c) for c in ("l1", "l2", "variation")))


SHARES = tuple(i / 20 for i in range(21))


@query(f"""WITH e1 AS ({PARTICLES_SQL}), e0 AS (SELECT c_custkey AS pid, round(least(greatest((c_acctbal + 1000) / 11000.0::DOUBLE, 0), 1), 5) AS x_acct, round((2 * c_nationkey + 1) / 50.0::DOUBLE, 5) AS x_nation FROM customer),
  x AS (SELECT 0 AS epoch, * FROM e0 UNION ALL SELECT 1, * FROM e1), t(proj, a, b) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(THETAS))}),
  r AS (SELECT epoch, proj, z, row_number() OVER (PARTITION BY epoch, proj ORDER BY z) - 1 AS pos, count(*) OVER (PARTITION BY epoch, proj) AS n FROM (SELECT epoch, proj, a * x_acct + b * x_nation AS z FROM x, t)),
  s(share) AS (VALUES {', '.join(f'({s}::DOUBLE)' for s in SHARES)})
  SELECT epoch, proj, share, round(z, 6) AS z FROM r JOIN s ON pos = floor(share * (n - 1))""")
def inverse_distribution_curves(spark, sf_dir) -> DataFrame:
    """Curves of the customers' points before and after a step, from appended snapshots."""
    kept = Snapshots.create(spark)
    start = customer_points(spark, sf_dir)
    kept.add(start.select("pid", *(F.round(c, 5).alias(c) for c in ("x_acct", "x_nation"))), 0)
    kept.add(particle_step(spark, sf_dir), 1)
    curves = inverse_curves(kept.rows(), ["x_acct", "x_nation"], THETAS, SHARES)
    return curves.select("epoch", "proj", "share", F.round("z", 6).alias("z"))
