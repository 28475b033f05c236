"""The engine's registered queries and, where SQL can say the same, their SQL for another engine.

Bounds of the codings are constants, so they tell nothing about the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import scalar as S
from marginalia.operators import discretize, evaluate, factor, linear, marginals, mechanisms, noise, particles, pgm, transport
from marginalia.operators.factor import Factor
from marginalia.plans.graph import JunctionTree
from marginalia.plans.privacy import Budget
from marginalia.plans.schema import Domain, all_kway, workload_scores
from marginalia.sources.tables import Dataset

LINEITEM = Domain.fromdict({"q": 10, "price": 16, "dc": 11, "tx": 9, "ln": 7, "rf": 3, "ls": 2, "mo": 12})
SMALL = LINEITEM.project(("q", "dc", "rf", "ls"))
TREE = LINEITEM.project(("dc", "rf", "ls"))  # cliques (dc, rf) and (rf, ls) form a chain
EVENTS = Domain.fromdict({"et": 5, "hr": 24, "wd": 7})
JOINED = Domain.fromdict({"rf": 3, "ls": 2, "op": 5, "ms": 5, "dc": 11})
MARKETS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


#: Statements about schemas, matrices and budgets that read no table: held against SQL by the tests, and not registered.
STATED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATED_SQL: dict[str, str] = {}


def stated(sql: str | None = None):
    def add(f):
        STATED[f.__name__] = f
        if sql:
            STATED_SQL[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(values: tuple[str, ...], column: str):
    """A dictionary code by position; null for other values."""
    out = F.when(F.col(column) == values[0], 0)
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(column) == v, i)
    return out.cast("int")


def coded_lineitem(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        S.equal_width(F.col("l_quantity"), 0, 50, 10).alias("q"),
        S.equal_width(F.col("l_extendedprice"), 900, 105000, 16).alias("price"),
        S.whole(F.col("l_discount") * 100).cast("int").alias("dc"),
        S.whole(F.col("l_tax") * 100).cast("int").alias("tx"),
        (F.col("l_linenumber") - 1).cast("int").alias("ln"),
        code(("A", "N", "R"), "l_returnflag").alias("rf"),
        code(("F", "O"), "l_linestatus").alias("ls"),
        (F.month("l_shipdate") - 1).cast("int").alias("mo"),
        *more,
    )


D = """d AS (SELECT CAST(least(greatest(ceil((l_quantity - 0.0::DOUBLE) / 50.0::DOUBLE * 10) - 1, 0), 9) AS INT) AS q,
  CAST(least(greatest(ceil((l_extendedprice - 900.0::DOUBLE) / 104100.0::DOUBLE * 16) - 1, 0), 15) AS INT) AS price,
  CAST(round(l_discount * 100) AS INT) AS dc, CAST(round(l_tax * 100) AS INT) AS tx, l_linenumber - 1 AS ln,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS rf, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS ls,
  CAST(month(l_shipdate) - 1 AS INT) AS mo, l_discount, l_orderkey, l_quantity, l_extendedprice FROM lineitem)"""


def grid_sql(*names_sizes: tuple[str, int]) -> str:
    return " CROSS JOIN ".join(f"(SELECT CAST(range AS INT) AS {a} FROM range({n})) g_{a}" for a, n in names_sizes)


def lower(value, digits: int = 6):
    return F.round(value, digits)


# --- flagship: all two-way marginals --------------------------------------------------------------------------------


def _two_way_sql(domain: Domain, view: str = "d") -> str:
    parts = []
    for i, (a, b) in enumerate(all_kway(domain, 2)):
        parts.append(f"SELECT {i} AS clique_id, g_{a}.{a} * {domain[b]} + g_{b}.{b} AS cell, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM {grid_sql((a, domain[a]), (b, domain[b]))} LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM {view} GROUP BY {a}, {b}) m ON m.{a} = g_{a}.{a} AND m.{b} = g_{b}.{b}")
    return " UNION ALL ".join(parts)


@query(f"WITH {D} SELECT clique_id, CAST(cell AS BIGINT) AS cell, value FROM ({_two_way_sql(LINEITEM)})")
def marginals_2way_dense(spark, sf_dir):
    """Every cell of all two-way marginals of lineitem, in one scan."""
    cliques = all_kway(LINEITEM, 2)
    return marginals.dense(marginals.marginals_kernel(coded_lineitem(spark, sf_dir), LINEITEM, cliques), LINEITEM, cliques)


@query(f"WITH {D} SELECT clique_id, CAST(cell AS BIGINT) AS cell, value FROM ({_two_way_sql(SMALL)}) WHERE value > 0")
def marginals_2way_exploded(spark, sf_dir):
    return marginals.marginals_exploded(coded_lineitem(spark, sf_dir), SMALL, all_kway(SMALL, 2))


@query(f"WITH {D} SELECT CAST(grouping(q, dc, rf, ls) AS BIGINT) AS gid, q, dc, rf, ls, count(*) AS n FROM d GROUP BY GROUPING SETS ((q,dc),(q,rf),(q,ls),(dc,rf),(dc,ls),(rf,ls))")
def marginals_2way_grouping_sets(spark, sf_dir):
    return marginals.grouping_sets(coded_lineitem(spark, sf_dir), SMALL, all_kway(SMALL, 2))


@query(f"WITH {D} SELECT CAST(grouping(q, dc, rf, ls) AS BIGINT) AS gid, q, dc, rf, ls, count(*) AS n FROM d GROUP BY CUBE (q, dc, rf, ls) HAVING grouping(q, dc, rf, ls) < 15")
def marginals_closure_cube(spark, sf_dir):
    return marginals.cube(coded_lineitem(spark, sf_dir), SMALL.attrs)


# --- coding ------------------------------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT q, price, count(*) AS n FROM d GROUP BY q, price")
def discretize_equal_width(spark, sf_dir):
    return coded_lineitem(spark, sf_dir).groupBy("q", "price").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS value, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)")
def discretize_dictionary(spark, sf_dir):
    return discretize.rank_codes(table(spark, sf_dir, "part"), "p_brand")


@query("""WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_size) AS slo, max(p_size) AS shi FROM part),
  s AS (SELECT *, CAST(least(10, shi - slo + 1) AS INT) AS sk FROM b),
  c AS (SELECT p_partkey, p_brand, CAST(least(greatest(ceil((p_retailprice - lo) / (hi - lo) * 10) - 1, 0), 9) AS INT) AS pc,
    CAST(least(greatest(ceil((CAST(p_size AS DOUBLE) - slo) / CAST(shi - slo AS DOUBLE) * sk) - 1, 0), sk - 1) AS INT) AS sc, lo, hi, slo, shi, sk FROM part, s)
  SELECT p_partkey, p_brand, round(CASE WHEN pc = 0 THEN (lo - 0.001 * (hi - lo) + lo + (hi - lo) / 10) / 2 ELSE lo + (pc + 0.5) * (hi - lo) / 10 END, 6) AS p_retailprice,
    round(CASE WHEN sc = 0 THEN (slo - 0.001 * (shi - slo) + slo + (shi - slo) / CAST(sk AS DOUBLE)) / 2 ELSE slo + (sc + 0.5) * (shi - slo) / CAST(sk AS DOUBLE) END, 6) AS p_size FROM c""")
def discretize_roundtrip(spark, sf_dir):
    """Codes and back: bin centres, and dictionary values unchanged."""
    df = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    coder = discretize.Coder.fit(df, 10)
    keyed = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    forward = keyed
    for c in coder.codings.values():
        if c.kind == "width":
            forward = forward.withColumn(c.attr, S.equal_width(F.col(c.attr), c.low, c.high, c.size))
            forward = forward.withColumn(c.attr, F.get(F.array(*map(F.lit, c.originals())), F.col(c.attr)))
    return forward.select("p_partkey", "p_brand", lower(F.col("p_retailprice")).alias("p_retailprice"), lower(F.col("p_size")).alias("p_size"))


@query("SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(o_totalprice) AS DOUBLE) IS NOT NULL AS priced FROM orders")
def project_drop_records(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").drop("o_orderkey", "o_custkey").select("o_orderstatus", "o_totalprice")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sum("o_totalprice").isNotNull().alias("priced"))


@query("""WITH y AS (SELECT p_size - 1 AS c, count(*) AS n FROM part GROUP BY 1), s AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM y WHERE n >= (SELECT avg(n) FROM y))
  SELECT CAST(coalesce(i, (SELECT count(*) FROM s)) AS INT) AS code, count(*) AS n FROM part LEFT JOIN s ON s.c = p_size - 1 GROUP BY 1""")
def merge_rare_codes(spark, sf_dir):
    """Codes below a limit become one."""
    codes = table(spark, sf_dir, "part").select((F.col("p_size") - 1).cast("int").alias("sz"))
    y = marginals.marginal(codes, Domain(("sz",), (50,)), ("sz",)).orderBy("sz").toPandas()
    sigma = float(y["value"][y["value"] > 0].mean()) / 3
    keep = discretize.supported(y["value"].tolist(), sigma)
    return discretize.merge_unsupported(codes, {"sz": keep}).groupBy(F.col("sz").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@stated(f"SELECT g_a.a, g_b.b, CAST(g_a.a * 7 + g_b.b AS BIGINT) AS cell, (2 * g_a.a + 1) / 10.0::DOUBLE AS x_a, (2 * g_b.b + 1) / 14.0::DOUBLE AS x_b FROM {grid_sql(('a', 5), ('b', 7))}")
def embed_centers(spark, sf_dir):
    domain = Domain(("a", "b"), (5, 7))
    cells = marginals.grid(spark, domain)
    return cells.select("a", "b", "cell", S.center(F.col("a"), 5).alias("x_a"), S.center(F.col("b"), 7).alias("x_b"))


@query("""WITH x AS (SELECT c_custkey, least(greatest((c_acctbal + 1000) / 11000.0::DOUBLE, 0), 1) AS x FROM customer)
  SELECT code, count(*) AS n FROM (SELECT c_custkey, k AS code, row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(x - (2 * k + 1) / 32.0::DOUBLE), 12), k) AS r FROM x, (SELECT CAST(range AS INT) AS k FROM range(16))) WHERE r = 1 GROUP BY code""")
def nearest_center(spark, sf_dir):
    """D12, D13, T03."""
    x = table(spark, sf_dir, "customer").select(S.clamp_unit((F.col("c_acctbal") + 1000) / F.lit(11000.0)).alias("x"))
    return x.select(S.nearest_code(F.col("x"), 16).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- histograms --------------------------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT g_rf.rf, g_q.q, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM {grid_sql(('rf', 3), ('q', 10))} LEFT JOIN (SELECT rf, q, count(*) AS n FROM d GROUP BY rf, q) m ON m.rf = g_rf.rf AND m.q = g_q.q")
def marginal_dense(spark, sf_dir):
    return marginals.marginal(coded_lineitem(spark, sf_dir), LINEITEM, ("rf", "q"))


@query(f"WITH {D} SELECT g_rf.rf, g_ls.ls, round(coalesce(n, 0), 4) AS value FROM {grid_sql(('rf', 3), ('ls', 2))} LEFT JOIN (SELECT rf, ls, sum(l_discount) AS n FROM d GROUP BY rf, ls) m ON m.rf = g_rf.rf AND m.ls = g_ls.ls")
def marginal_weighted(spark, sf_dir):
    got = marginals.marginal(coded_lineitem(spark, sf_dir, "l_discount"), LINEITEM, ("rf", "ls"), "l_discount")
    return got.withColumn("value", F.round("value", 4))


JOINED_SQL = f"""j AS (SELECT rf, ls, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS op, CASE c_mktsegment {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MARKETS))} END AS ms, dc
  FROM d JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {D}, {JOINED_SQL} SELECT CAST(grouping(rf, ls, op, ms, dc) AS BIGINT) AS gid, rf, ls, op, ms, dc, count(*) AS n FROM j WHERE ms IS NOT NULL GROUP BY GROUPING SETS ({', '.join(f'({a},{b})' for a, b in all_kway(JOINED, 2))})")
def marginal_after_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("op"))
    c = table(spark, sf_dir, "customer").select("c_custkey", code(MARKETS, "c_mktsegment").alias("ms"))
    rows = coded_lineitem(spark, sf_dir, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return marginals.grouping_sets(rows.select(*JOINED.attrs), JOINED, all_kway(JOINED, 2))


@query(f"""WITH e AS (SELECT CASE event_type {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(EVENT_TYPES))} END AS et, CAST(hour(ts) AS INT) AS hr, CAST(isodow(ts) - 1 AS INT) AS wd FROM events)
  SELECT clique_id, CAST(cell AS BIGINT) AS cell, value FROM ({_two_way_sql(EVENTS, 'e')})""")
def events_marginals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(code(EVENT_TYPES, "event_type").alias("et"), F.hour("ts").alias("hr"), F.weekday("ts").alias("wd"))
    cliques = all_kway(EVENTS, 2)
    return marginals.dense(marginals.marginals_kernel(rows, EVENTS, cliques), EVENTS, cliques)


@query(f"WITH {D} SELECT q, dc, rf, ls, CAST(count(*) AS DOUBLE) AS weight FROM d GROUP BY ALL")
def compress_rows(spark, sf_dir):
    return marginals.compress(coded_lineitem(spark, sf_dir), SMALL.attrs)


# --- factors -----------------------------------------------------------------------------------------------------------


def counted(spark, sf_dir, *attrs: str) -> Factor:
    return Factor(LINEITEM.project(attrs), marginals.marginal(coded_lineitem(spark, sf_dir), LINEITEM, attrs))


def dense_sql(name: str, *attrs: str) -> str:
    on = " AND ".join(f"m.{a} = g_{a}.{a}" for a in attrs)
    return f"{name} AS (SELECT {', '.join(f'g_{a}.{a}' for a in attrs)}, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM {grid_sql(*((a, LINEITEM[a]) for a in attrs))} LEFT JOIN (SELECT {', '.join(attrs)}, count(*) AS n FROM d GROUP BY ALL) m ON {on})"


FG = f"WITH {D}, {dense_sql('f', 'dc', 'rf')}, {dense_sql('g', 'rf', 'ls')}, {dense_sql('h', 'rf')}"


@query(f"{FG} SELECT dc, rf, ls, f.v * g.v AS value FROM f JOIN g USING (rf)")
def factor_product(spark, sf_dir):
    return (counted(spark, sf_dir, "dc", "rf") * counted(spark, sf_dir, "rf", "ls")).rows


@query(f"{FG} SELECT dc, rf, ls, f.v + g.v AS value FROM f JOIN g USING (rf)")
def factor_add(spark, sf_dir):
    return (counted(spark, sf_dir, "dc", "rf") + counted(spark, sf_dir, "rf", "ls")).rows


@query(f"{FG} SELECT rf, g_mo.mo, v AS value FROM h CROSS JOIN {grid_sql(('mo', 12))}")
def factor_expand(spark, sf_dir):
    return counted(spark, sf_dir, "rf").expand(LINEITEM.project(("rf", "mo"))).rows


@query(f"{FG} SELECT dc, rf, round(CASE WHEN h.v > 0 THEN f.v / h.v ELSE 0 END, 9) AS value FROM f JOIN h USING (rf)")
def factor_divide_conditional(spark, sf_dir):
    f = counted(spark, sf_dir, "dc", "rf")
    return (f / f.project(("rf",))).map(lambda v: F.round(v, 9)).rows


@query(f"{FG} SELECT dc, rf, CASE WHEN rf = 1 THEN f.v ELSE f.v - h.v END AS value FROM f JOIN h USING (rf)")
def factor_subtract_neginf(spark, sf_dir):
    h = counted(spark, sf_dir, "rf")
    holed = Factor(h.domain, h.rows.withColumn("value", F.when(F.col("rf") == 1, F.lit(S.NEG_INF)).otherwise(F.col("value"))))
    return (counted(spark, sf_dir, "dc", "rf") - holed).rows


@query(f"{FG}, t AS (SELECT rf, max(v / 1000) AS m FROM f GROUP BY rf) SELECT rf, round(m + ln(sum(exp(v / 1000 - m))), 8) AS value FROM f JOIN t USING (rf) GROUP BY rf, m")
def factor_logsumexp(spark, sf_dir):
    return (counted(spark, sf_dir, "dc", "rf") / 1000.0).logsumexp(["dc"]).map(lambda v: F.round(v, 8)).rows


@query(f"{FG} SELECT dc, rf, ls, round(greatest(f.v, g.v) / 1000 + ln(1 + exp(-abs(f.v - g.v) / 1000)), 8) AS value FROM f JOIN g USING (rf)")
def factor_logaddexp(spark, sf_dir):
    f, g = counted(spark, sf_dir, "dc", "rf") / 1000.0, counted(spark, sf_dir, "rf", "ls") / 1000.0
    return f.logaddexp(g).map(lambda v: F.round(v, 8)).rows


@query(f"{FG} SELECT rf, max(v) AS value FROM f GROUP BY rf")
def factor_max(spark, sf_dir):
    return counted(spark, sf_dir, "dc", "rf").max(["dc"]).rows


@query(f"{FG} SELECT dc - 2 AS dc, v AS value FROM f WHERE rf = 1 AND dc >= 2 AND dc < 7")
def factor_condition(spark, sf_dir):
    return counted(spark, sf_dir, "dc", "rf").condition({"rf": 1, "dc": slice(2, 7)}).rows


@query(f"{FG} SELECT dc, rf, v AS value FROM f WHERE NOT ((dc = 0 AND rf = 0) OR (dc = 3 AND rf = 2))")
def factor_structural_zeros(spark, sf_dir):
    """Cells that cannot occur get -inf, and so drop out."""
    holes = Factor.active(spark, LINEITEM.project(("dc", "rf")), [(0, 0), (3, 2)])
    return (counted(spark, sf_dir, "dc", "rf") + holes).rows.filter(F.col("value") > S.NEG_INF)


@query(f"{FG} SELECT (SELECT sum(v * v) FROM f) + (SELECT sum(v * v) FROM g) AS dot")
def clique_dot(spark, sf_dir):
    v = factor.CliqueVector.from_data(coded_lineitem(spark, sf_dir), LINEITEM, [("dc", "rf"), ("rf", "ls")])
    return v.dot(v)


@query(f"{FG} SELECT 0 AS clique_id, CAST(dc * 3 + rf AS BIGINT) AS cell, 2 * v - 1 AS value FROM f UNION ALL SELECT 1, rf * 2 + ls, v FROM g")
def clique_combine(spark, sf_dir):
    """J10, J11, F07."""
    v = factor.CliqueVector.from_data(coded_lineitem(spark, sf_dir), LINEITEM, [("dc", "rf"), ("rf", "ls")])
    own = factor.CliqueVector(LINEITEM, (("dc", "rf"),), v.rows.filter("clique_id = 0"))
    return v.combine(own - 1.0).rows


@stated("""WITH m(model_id, attrs, cells) AS (VALUES (0, ['q','dc','rf'], 330), (1, ['dc','rf'], 33), (2, ['rf','ls','mo'], 72)), a(measured_id, attrs) AS (VALUES (0, ['rf']), (1, ['q','rf']), (2, ['mo','ls']))
  SELECT measured_id, model_id FROM (SELECT measured_id, model_id, row_number() OVER (PARTITION BY measured_id ORDER BY cells, model_id) AS r FROM a JOIN m ON list_has_all(m.attrs, a.attrs)) WHERE r = 1""")
def containing_clique(spark, sf_dir):
    return factor.containing_cliques(spark, LINEITEM, [("q", "dc", "rf"), ("dc", "rf"), ("rf", "ls", "mo")], [("rf",), ("q", "rf"), ("mo", "ls")])


@query(f"{FG} SELECT 1 AS r, 0 AS s, sum(abs(a.v - 2 * b.v)) AS gap FROM (SELECT rf, sum(v) AS v FROM f GROUP BY rf) a JOIN (SELECT rf, sum(v) AS v FROM g GROUP BY rf) b USING (rf)")
def primal_feasibility(spark, sf_dir):
    v = factor.CliqueVector.from_data(coded_lineitem(spark, sf_dir), LINEITEM, [("dc", "rf"), ("rf", "ls")])
    doubled = factor.CliqueVector(LINEITEM, v.cliques, v.rows.withColumn("value", F.when(F.col("clique_id") == 1, 2 * F.col("value")).otherwise(F.col("value"))))
    return factor.primal_feasibility(doubled)


# --- inference ---------------------------------------------------------------------------------------------------------


@query(f"""{FG}, m AS (SELECT 0 AS clique_id, v AS y, 2.0::DOUBLE AS s FROM f UNION ALL SELECT 1, v + 1, 3.0::DOUBLE FROM g), e AS (SELECT clique_id, sum(y) AS e, sum(s * s) AS v FROM m GROUP BY clique_id)
  SELECT round(greatest(1, sum(e / v) / sum(1 / v)), 6) AS total FROM e""")
def total_estimate_ivw(spark, sf_dir):
    v = factor.CliqueVector.from_data(coded_lineitem(spark, sf_dir), LINEITEM, [("dc", "rf"), ("rf", "ls")]).rows
    y = v.select("clique_id", "cell", (F.col("value") + F.col("clique_id")).alias("y"), (F.col("clique_id") + 2.0).alias("sigma"))
    return pgm.total_from_rows(y).select(lower(F.col("total")).alias("total"))


CHAIN = f"{FG}, p AS (SELECT dc, rf, ls, CASE WHEN h.v > 0 THEN f.v * g.v / h.v ELSE 0 END AS v FROM f JOIN g USING (rf) JOIN h USING (rf))"


def chain(spark, sf_dir):
    return pgm.tree_potentials(coded_lineitem(spark, sf_dir), TREE, JunctionTree(TREE, [("dc", "rf"), ("rf", "ls")]))


@query(f"{CHAIN} SELECT dc, ls, round(sum(v), 4) AS value FROM p GROUP BY dc, ls")
def pgm_fit_tree_marginal(spark, sf_dir):
    """A marginal across the cliques of a fitted tree."""
    return pgm.tree_marginal(chain(spark, sf_dir), TREE, ("dc", "ls")).map(lambda v: F.round(v, 4)).rows


@query(f"{CHAIN} SELECT dc, rf, ls, round(v, 4) AS value FROM p")
def pgm_joint(spark, sf_dir):
    return pgm.tree_marginal(chain(spark, sf_dir), TREE, TREE.attrs).map(lambda v: F.round(v, 4)).rows


@query(f"{CHAIN} SELECT round(ln(sum(v)), 8) AS log_z FROM p")
def pgm_logz(spark, sf_dir):
    z = factor.eliminate(chain(spark, sf_dir), TREE.attrs, log=True)
    return z.rows.select(F.round("value", 8).alias("log_z"))


@query(f"{FG} SELECT dc, ls, round(sum(CASE WHEN h.v > 0 THEN f.v / h.v * g.v ELSE 0 END), 4) AS value FROM f JOIN g USING (rf) JOIN h USING (rf) GROUP BY dc, ls")
def many_marginals_out_of_clique(spark, sf_dir):
    """P(dc | rf) joined along the separator and summed."""
    f, g = counted(spark, sf_dir, "dc", "rf"), counted(spark, sf_dir, "rf", "ls")
    return ((f / f.project(("rf",))) * g).sum(["rf"]).map(lambda v: F.round(v, 4)).rows


@query(f"""{FG}, s AS (SELECT dc, v / sum(v) OVER () * 1000 AS x FROM (SELECT dc, sum(v) AS v FROM f GROUP BY dc)), fl AS (SELECT dc, floor(x) AS b, round(x - floor(x), 9) AS fr FROM s)
  SELECT dc, CAST(b + CASE WHEN row_number() OVER (ORDER BY fr DESC, dc) <= 1000 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM fl""")
def round_allocation(spark, sf_dir):
    counts = counted(spark, sf_dir, "dc").rows.withColumn("total", F.lit(1000))
    return pgm.round_allocation(counts, "total", order=("dc",))


@query(f"""{FG}, s AS (SELECT dc, sum(v) AS v FROM f GROUP BY dc), u AS (SELECT dc, CAST(floor(sum(v) OVER (ORDER BY dc) / sum(v) OVER () * 500 + 0.5) AS BIGINT) AS b FROM s), l AS (SELECT dc, b, coalesce(lag(b) OVER (ORDER BY dc), 0) AS a FROM u)
  SELECT dc, unnest(range(a, b)) AS pid FROM l WHERE b > a""")
def quantize_particles(spark, sf_dir):
    return particles.quantise_rows(counted(spark, sf_dir, "dc").rows.withColumnRenamed("value", "p"), 500, ("dc",))


# --- linear queries ----------------------------------------------------------------------------------------------------


@query(f"{FG} SELECT CAST(a.dc * 3 + a.rf AS BIGINT) AS row, sum(b.v) AS value FROM f a JOIN f b ON b.dc <= a.dc AND b.rf <= a.rf GROUP BY 1")
def kron_prefix_query(spark, sf_dir):
    v = factor.CliqueVector.from_data(coded_lineitem(spark, sf_dir), LINEITEM, [("dc", "rf")]).rows.select("cell", "value")
    return linear.Kronecker([linear.prefix(11), linear.prefix(3)]).apply(v).select(F.col("row").cast("long").alias("row"), "value")


@query(f"{FG} SELECT CAST(x.row AS BIGINT) AS row, sum(x.c * v) AS value FROM (SELECT dc, sum(v) AS v FROM f GROUP BY dc) t JOIN (SELECT range AS dc, unnest([0, 1]) AS row, unnest([1.0, range]) AS c FROM range(11)) x USING (dc) GROUP BY x.row")
def linear_query_matvec(spark, sf_dir):
    """The total stacked on a weighted sum."""
    v = counted(spark, sf_dir, "dc").rows.select(F.col("dc").cast("long").alias("cell"), "value")
    q = linear.vstack([linear.Matrix([[1.0] * 11]), linear.Matrix([list(range(11))])])
    return q.apply(v).select(F.col("row").cast("long").alias("row"), "value")


@query(f"""WITH {D}, w AS (SELECT price AS c, CAST(count(*) AS DOUBLE) AS v FROM d GROUP BY 1), lv AS (SELECT CAST(range AS INT) AS j FROM range(4))
  SELECT CAST(0 AS BIGINT) AS row, sum(v) AS value FROM w UNION ALL
  SELECT CAST(pow(2, j) + floor(c / (16 / pow(2, j))) AS BIGINT), sum(CASE WHEN c % (16 / pow(2, j)) < 8 / pow(2, j) THEN v ELSE -v END) FROM w, lv GROUP BY 1""")
def haar_transform(spark, sf_dir):
    v = counted(spark, sf_dir, "price").rows.filter("value > 0").select(F.col("price").cast("long").alias("cell"), "value")
    return linear.Haar(16).apply(v).select(F.col("row").cast("long").alias("row"), "value")


@stated("SELECT 11.0::DOUBLE AS l1, round(sqrt(11.0::DOUBLE), 9) AS l2, 5.0::DOUBLE AS haar")
def l1_sensitivity(spark, sf_dir):
    p = linear.prefix(11)
    return spark.createDataFrame([(p.l1_sensitivity(spark), round(p.l2_sensitivity(spark), 9), linear.Haar(16).l1_sensitivity())], "l1 double, l2 double, haar double")


# --- private selection -------------------------------------------------------------------------------------------------


@query(f"{FG} SELECT dc AS candidate, round(exp(0.001 * (v - max(v) OVER ())) / sum(exp(0.001 * (v - m))) OVER (), 8) AS p FROM (SELECT dc, v, max(v) OVER () AS m FROM (SELECT dc, sum(v) AS v FROM f GROUP BY dc))")
def softmax_selection(spark, sf_dir):
    scores = counted(spark, sf_dir, "dc").rows.select(F.col("dc").alias("candidate"), F.col("value").alias("score"))
    return noise.selection_probabilities(scores, 0.004, 2.0).select("candidate", F.round("p", 8).alias("p"))


def _gap_sql(domain: Domain, score: str) -> str:
    parts = [f"SELECT {i} AS clique_id, {score.format(n=domain.size((a, b)))} AS gap FROM (SELECT {a} AS x, count(*) AS c FROM d GROUP BY 1) p CROSS JOIN (SELECT {b} AS y, count(*) AS c FROM d GROUP BY 1) r CROSS JOIN (SELECT count(*) AS n FROM d) t LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS c FROM d GROUP BY 1, 2) j ON j.x = p.x AND j.y = r.y" for i, (a, b) in enumerate(all_kway(domain, 2))]
    return f"WITH {D} " + " UNION ALL ".join(parts)


ERROR = "sum(abs(coalesce(j.c, 0) - p.c * r.c / CAST(t.n AS DOUBLE)))"


@query(_gap_sql(SMALL, f"round({ERROR}, 4)"))
def mst_edge_weights(spark, sf_dir):
    return mechanisms.pair_gaps(coded_lineitem(spark, sf_dir), SMALL).select("clique_id", F.round("gap", 4).alias("gap"))


@query(_gap_sql(SMALL, f"round({ERROR} - {{n}}, 4)"))
def mwem_scores(spark, sf_dir):
    sizes = F.array(*(F.lit(SMALL.size(c)) for c in all_kway(SMALL, 2)))
    return mechanisms.pair_gaps(coded_lineitem(spark, sf_dir), SMALL).select("clique_id", F.round(F.col("gap") - F.get(sizes, F.col("clique_id")), 4).alias("gap"))


@query(_gap_sql(SMALL, f"round(8.0::DOUBLE * ({ERROR} - sqrt(2 / pi()) * 5 * {{n}}), 4)"))
def aim_scores(spark, sf_dir):
    """With the closure's weight of a pair (8: two shared attributes with itself and one with four others, plus its own) and sigma 5."""
    weights = workload_scores(all_kway(SMALL, 2))
    cliques = all_kway(SMALL, 2)
    w = F.array(*(F.lit(float(weights[tuple(sorted(c))] + 2)) for c in cliques))
    n = F.array(*(F.lit(float(SMALL.size(c))) for c in cliques))
    at = F.col("clique_id")
    return mechanisms.pair_gaps(coded_lineitem(spark, sf_dir), SMALL).select("clique_id", F.round(F.get(w, at) * (F.col("gap") - F.lit(mechanisms.ROOT_2_PI) * 5 * F.get(n, at)), 4).alias("gap"))


@stated("""WITH w(c) AS (VALUES (['a','b']), (['b','c']), (['c','d'])), cl(c) AS (VALUES (['a']), (['b']), (['c']), (['d']), (['a','b']), (['b','c']), (['c','d']))
  SELECT array_to_string(cl.c, '|') AS clique, CAST(sum(len(list_intersect(cl.c, w.c))) AS DOUBLE) AS score FROM cl, w GROUP BY 1""")
def aim_workload_scores(spark, sf_dir):
    scores = workload_scores([("a", "b"), ("b", "c"), ("c", "d")])
    return spark.createDataFrame([("|".join(c), float(s)) for c, s in scores.items()], "clique string, score double")


# --- transport ---------------------------------------------------------------------------------------------------------


@stated(f"SELECT CAST(i.a * 3 + i.b AS BIGINT) AS i, CAST(j.a * 3 + j.b AS BIGINT) AS j, round(pow(pow(abs(i.a - j.a) / 4.0::DOUBLE, 5) + pow(abs(i.b - j.b) / 3.0::DOUBLE, 5), 0.2), 8) AS dist FROM (SELECT g_a.a, g_b.b FROM {grid_sql(('a', 4), ('b', 3))}) i CROSS JOIN (SELECT g_a.a, g_b.b FROM {grid_sql(('a', 4), ('b', 3))}) j")
def pairwise_minkowski(spark, sf_dir):
    cells = discretize.Embedding(Domain(("a", "b"), (4, 3))).centers(spark, ("a", "b"))
    got = transport.distances(cells.withColumnRenamed("cell", "i"), cells.withColumnRenamed("cell", "j"), ["x_a", "x_b"], 5)
    return got.select("i", "j", F.round("dist", 8).alias("dist"))


PARITY = f"""WITH {D}, z AS (SELECT (2 * dc + 1) / 22.0::DOUBLE AS x, (2 * q + 1) / 20.0::DOUBLE AS y, l_orderkey % 2 AS side FROM d), n AS (SELECT side, count(*) AS n FROM z GROUP BY side),
  w AS (SELECT x, y, sum(CASE side WHEN 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / n) AS w FROM z JOIN n USING (side) GROUP BY x, y)"""
W1 = "SELECT proj, sum(abs(g) * dz) AS w1 FROM (SELECT proj, sum(w) OVER (PARTITION BY proj ORDER BY z ROWS UNBOUNDED PRECEDING) AS g, lead(z) OVER (PARTITION BY proj ORDER BY z) - z AS dz FROM (SELECT proj, z, sum(w) AS w FROM p GROUP BY proj, z)) GROUP BY proj"
THETAS = ((1.0, 0.0), (0.0, 1.0), (0.6, 0.8), (-0.6, 0.8))
PROJ = f"{PARITY}, t(proj, a, b) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(THETAS))}), p AS (SELECT proj, round(a * x + b * y, 9) AS z, w FROM w, t)"


def parity_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = coded_lineitem(spark, sf_dir, "l_orderkey").select(S.center(F.col("dc"), 11).alias("x"), S.center(F.col("q"), 10).alias("y"), (F.col("l_orderkey") % 2).alias("side"))
    return tuple(rows.filter(F.col("side") == s).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")) for s in (0, 1))


@query(f"{PROJ} SELECT round(w1, 7) AS w1 FROM ({W1}) WHERE proj = 0")
def w1_projection(spark, sf_dir):
    a, b = parity_points(spark, sf_dir)
    both = transport.signed(a, b, "n")
    return transport.w1_signed(transport.projected(both, ["x"], [(1.0,)], ["w"])).select(F.round("w1", 7).alias("w1"))


@query(f"{PROJ} SELECT round(avg(w1), 7) AS sw1 FROM ({W1})")
def sw1_grid(spark, sf_dir):
    a, b = parity_points(spark, sf_dir)
    cells = transport.signed(a, b, "n").groupBy("x", "y").agg(F.sum("w").alias("u")).withColumn("v", F.lit(0.0))
    long = transport.projected(cells.withColumn("w", F.col("u")), ["x", "y"], THETAS, ["w"]).withColumn("z", F.round("z", 9))
    return transport.w1_signed(long).agg(F.round(F.avg("w1"), 7).alias("sw1"))


POINTS = "a AS (SELECT s_suppkey AS pid, s_acctbal / 10000.0::DOUBLE AS x, s_nationkey / 25.0::DOUBLE AS y FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS pid, s_acctbal / 10000.0::DOUBLE AS x, s_nationkey / 25.0::DOUBLE AS y FROM supplier WHERE s_suppkey % 2 = 1)"
MATCH = f"""WITH {POINTS}, t(proj, ta, tb) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(THETAS))}),
  ra AS (SELECT proj, ta, tb, pid, ta * x + tb * y AS z, row_number() OVER (PARTITION BY proj ORDER BY ta * x + tb * y, pid) - 1 AS r, count(*) OVER (PARTITION BY proj) AS n FROM a, t),
  rb AS (SELECT proj, ta * x + tb * y AS z, row_number() OVER (PARTITION BY proj ORDER BY ta * x + tb * y, pid) - 1 AS s, count(*) OVER (PARTITION BY proj) AS m FROM b, t),
  k AS (SELECT ra.proj, ta, tb, pid, ra.z, rb.z AS zo FROM ra JOIN (SELECT proj, max(m) AS others FROM rb GROUP BY proj) o ON o.proj = ra.proj JOIN rb ON rb.proj = ra.proj AND rb.s = r * others // n)"""


def supplier_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), (F.col("s_acctbal") / 10000.0).alias("x"), (F.col("s_nationkey") / 25.0).alias("y"))
    return s.filter("pid % 2 = 0"), s.filter("pid % 2 = 1")


@query(f"{MATCH} SELECT round(avg(w2), 8) AS sw2 FROM (SELECT proj, avg((z - zo) * (z - zo)) AS w2 FROM k GROUP BY proj)")
def sw2_rank_match(spark, sf_dir):
    a, b = supplier_points(spark, sf_dir)
    return transport.sliced_w2(a, b, ["x", "y"], THETAS).select(F.round("sw2", 8).alias("sw2"))


@query(f"{MATCH} SELECT pid, round(100 * sum(2 * (z - zo) * ta) / 4, 6) AS g_x, round(100 * sum(2 * (z - zo) * tb) / 4, 6) AS g_y FROM k GROUP BY pid")
def sw2_gradient(spark, sf_dir):
    a, b = supplier_points(spark, sf_dir)
    return transport.sliced_w2_gradient(a, b, ["x", "y"], THETAS).select("pid", lower(F.col("g_x")).alias("g_x"), lower(F.col("g_y")).alias("g_y"))


# --- evaluation ----------------------------------------------------------------------------------------------------------


def _eval_sql(domain: Domain, what: str) -> str:
    parts = [f"SELECT {i} AS clique_id, {what} FROM (SELECT {a}, {b}, sum(CASE WHEN l_orderkey % 2 = 0 THEN 1.0::DOUBLE / n0 ELSE -1.0::DOUBLE / n1 END) AS g FROM d, nn GROUP BY 1, 2)" for i, (a, b) in enumerate(all_kway(domain, 2))]
    return f"WITH {D}, nn AS (SELECT count(*) FILTER (l_orderkey % 2 = 0) AS n0, count(*) FILTER (l_orderkey % 2 = 1) AS n1 FROM d) " + " UNION ALL ".join(parts)


def parity_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = coded_lineitem(spark, sf_dir, "l_orderkey")
    return rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1")


@query(_eval_sql(LINEITEM, "round(sum(abs(g)), 7) AS l1"))
def eval_l1(spark, sf_dir):
    return evaluate.marginal_gaps(*parity_rows(spark, sf_dir), LINEITEM, all_kway(LINEITEM, 2)).select("clique_id", F.round("l1", 7).alias("l1"))


@query(_eval_sql(LINEITEM, "round(sqrt(sum(g * g)), 7) AS l2"))
def eval_l2(spark, sf_dir):
    return evaluate.marginal_gaps(*parity_rows(spark, sf_dir), LINEITEM, all_kway(LINEITEM, 2)).select("clique_id", F.round("l2", 7).alias("l2"))


def _w_sql(domain: Domain, n: int) -> str:
    """Sliced distances of the parity halves, with the directions written out."""
    parts = []
    for i, c in enumerate(all_kway(domain, 2)):
        lines = transport.directions(2, n, i).tolist()
        values = ", ".join(f"({j}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for j, (a, b) in enumerate(lines))
        z = f"t.a * ((2 * {c[0]} + 1) / {2 * domain[c[0]]}.0::DOUBLE) + t.b * ((2 * {c[1]} + 1) / {2 * domain[c[1]]}.0::DOUBLE)"
        parts.append(f"""SELECT {i} AS clique_id, round(avg(w1), 6) AS w1 FROM (SELECT proj, sum(abs(g) * dz) AS w1 FROM (
          SELECT proj, sum(w) OVER (PARTITION BY proj ORDER BY z ROWS UNBOUNDED PRECEDING) AS g, lead(z) OVER (PARTITION BY proj ORDER BY z) - z AS dz FROM (
            SELECT proj, {z} AS z, w FROM (SELECT {c[0]}, {c[1]}, sum(CASE WHEN l_orderkey % 2 = 0 THEN 1.0::DOUBLE / n0 ELSE -1.0::DOUBLE / n1 END) AS w FROM d, nn GROUP BY 1, 2), (VALUES {values}) t(proj, a, b))) GROUP BY proj)""")
    return f"WITH {D}, nn AS (SELECT count(*) FILTER (l_orderkey % 2 = 0) AS n0, count(*) FILTER (l_orderkey % 2 = 1) AS n1 FROM d) " + " UNION ALL ".join(parts)


@query(_w_sql(LINEITEM, 20))
def eval_w(spark, sf_dir):
    """The sliced distance of each pair of attributes."""
    return evaluate.wasserstein(*parity_rows(spark, sf_dir), LINEITEM, all_kway(LINEITEM, 2), 20).select("clique_id", F.round("w1", 6).alias("w1"))


@query("SELECT round(avg(1 / (1 + exp(-10 * (0.6 * (l_quantity / 50) + 0.8 * (l_discount * 10) - 0.7)))), 7) AS answer FROM lineitem")
def threshold_constraint(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    return x.agg(F.round(F.avg(S.threshold_query([F.col("a"), F.col("b")], (0.6, 0.8), 0.7, 10.0)), 7).alias("answer"))


# --- noise and whole mechanisms: seeded, rows only ----------------------------------------------------------------------


@query()
def gaussian_noise(spark, sf_dir):
    cliques = all_kway(SMALL, 2)
    return noise.measure_rows(coded_lineitem(spark, sf_dir), SMALL, cliques, [5.0] * len(cliques), 1)


@query()
def laplace_noise(spark, sf_dir):
    cliques = all_kway(SMALL, 2)
    answers = marginals.dense(marginals.marginals_kernel(coded_lineitem(spark, sf_dir), SMALL, cliques), SMALL, cliques)
    return noise.with_laplace_noise(answers, 4.0, 1)


BUDGET = Budget(2.5, 1e-5, seed=0)  # repeatable, for a benchmark; a release draws its own


@stated()
def synthetic_uniform(spark, sf_dir):
    return Dataset.synthetic(spark, SMALL, 5000, 7).df


@query()
def kway_synth(spark, sf_dir):
    return mechanisms.KWay(BUDGET).run(coded_lineitem(spark, sf_dir), SMALL, pgm.FactoredInference(SMALL, iters=300), all_kway(SMALL, 2))


@query()
def mst_synth(spark, sf_dir):
    return mechanisms.MST(BUDGET, selection_iters=300).run(coded_lineitem(spark, sf_dir), SMALL, pgm.FactoredInference(SMALL, iters=300))


@query()
def mwem_synth(spark, sf_dir):
    return mechanisms.MWEM(BUDGET, rounds=4).run(coded_lineitem(spark, sf_dir), SMALL, pgm.FactoredInference(SMALL, iters=200), all_kway(SMALL, 2))


@query()
def aim_synth(spark, sf_dir):
    return mechanisms.AIM(BUDGET, rounds=8).run(coded_lineitem(spark, sf_dir), SMALL, pgm.FactoredInference(SMALL, iters=200), all_kway(SMALL, 2))


@query()
def particles_synth(spark, sf_dir):
    engine = particles.ParticleInference(TREE, n_particles=2000, iters=30, proj_iters=50, proj_directions=20)
    return mechanisms.KWay(BUDGET).run(coded_lineitem(spark, sf_dir), TREE, engine, all_kway(TREE, 2))



# --- more operators, one query each ---------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT count(DISTINCT q) AS q, count(DISTINCT dc) AS dc, count(DISTINCT rf) AS rf, count(DISTINCT ls) AS ls FROM d")
def distinct_codes(spark, sf_dir):
    return marginals.distinct_codes(coded_lineitem(spark, sf_dir), SMALL.attrs)


@query(f"WITH {D} SELECT q, dc, rf, ls, count(*) AS n FROM d GROUP BY ALL")
def embed_discretize_roundtrip(spark, sf_dir):
    """Codes to points of the unit cube and back."""
    e = discretize.Embedding(SMALL)
    back = e.discretize(e.project_manifold(e.embed(coded_lineitem(spark, sf_dir))))
    return back.groupBy(*SMALL.attrs).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT least(greatest((c_acctbal + 1000) / 11000.0::DOUBLE, 0), 1) AS a, c_nationkey / 25.0::DOUBLE + 0.01 AS b FROM customer)
  SELECT CAST(least(greatest(ceil(a * 8) - 1, 0), 7) AS INT) AS a, CAST(least(greatest(ceil(b * 5) - 1, 0), 4) AS INT) AS b, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY 1, 2""")
def particle_marginal(spark, sf_dir):
    """A histogram of points."""
    x = table(spark, sf_dir, "customer").select(S.clamp_unit((F.col("c_acctbal") + 1000) / F.lit(11000.0)).alias("x_a"), (F.col("c_nationkey") / F.lit(25.0) + F.lit(0.01)).alias("x_b"))
    domain = Domain(("a", "b"), (8, 5))
    return marginals.marginal(discretize.Embedding(domain).discretize(x), domain, ("a", "b"), dense=False)


@query("SELECT 0.25::DOUBLE * 4 * count(*) / 4 AS total FROM supplier")
def weights_rescaled(spark, sf_dir):
    """Weights that are probabilities are multiplied by the number of rows."""
    rows = table(spark, sf_dir, "supplier")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    weighed = marginals.rescaled_weights(rows.crossJoin(F.broadcast(n)).select((F.lit(0.25) / F.col("_n")).alias("weight")))
    return weighed.agg(F.round(F.sum("weight"), 6).alias("total"))


@query(f"{FG}, a AS (SELECT range AS k FROM range(3)) SELECT a.k AS rf_answer, ls, sum(f.v * g.v) AS value FROM f JOIN g USING (rf) JOIN a ON rf <= a.k GROUP BY a.k, ls")
def model_kron_query(spark, sf_dir):
    """Prefix sums over one attribute, answered on a product of factors."""
    f, g = counted(spark, sf_dir, "dc", "rf"), counted(spark, sf_dir, "rf", "ls")
    got = factor.kron_answer([f, g], [("rf", [[1.0, 0, 0], [1.0, 1, 0], [1.0, 1, 1]])], ["dc", "rf"])
    return got.rows.select(F.col("rf_answer").cast("long").alias("rf_answer"), "ls", "value")


@stated("SELECT a.range AS row, b.range AS cell, CAST(6 - greatest(a.range, b.range) AS DOUBLE) AS coef FROM range(6) a, range(6) b")
def gram_matrix(spark, sf_dir):
    """The Gram matrix of prefix sums."""
    return linear.prefix(6).gram().coo(spark).select(F.col("row").cast("long").alias("row"), F.col("cell").cast("long").alias("cell"), "coef")


@stated(f"SELECT g_a.a, g_b.b, CAST(g_a.a * 3 + g_b.b AS BIGINT) AS cell, g_b.b < 2 AS kept FROM {grid_sql(('a', 4), ('b', 3))}")
def grid_without_merged(spark, sf_dir):
    """Which cells touch no merged code."""
    return discretize.Embedding(Domain(("a", "b"), (4, 9)), {"b": [1, 5]}).without_merged(spark, ("a", "b"))


@query(f"""WITH e AS (SELECT date_trunc('day', ts) AS start, CASE event_type {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(EVENT_TYPES))} END AS et, CAST(hour(ts) AS INT) AS hr FROM events)
  SELECT CAST(epoch(start) AS BIGINT) AS start, 0 AS clique_id, CAST(et AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY start, et
  UNION ALL SELECT CAST(epoch(start) AS BIGINT), 1, CAST(et * 24 + hr AS BIGINT), CAST(count(*) AS DOUBLE) FROM e GROUP BY start, et, hr""")
def windowed_event_marginals(spark, sf_dir):
    """The streaming plan over a table: marginals of each day."""
    from marginalia.streaming.marginals import windowed_marginals

    rows = table(spark, sf_dir, "events").select("ts", code(EVENT_TYPES, "event_type").alias("et"), F.hour("ts").alias("hr"))
    got = windowed_marginals(rows, EVENTS.project(("et", "hr")), [("et",), ("et", "hr")], "ts", "1 day")
    return got.select(F.unix_timestamp("start").alias("start"), "clique_id", "cell", "value")


@query(f"WITH s AS ({_eval_sql(LINEITEM, 'sum(abs(g)) AS l1, sqrt(sum(g * g)) AS l2')}) SELECT round(avg(l1), 7) AS l1_avg, round(max(l1), 7) AS l1_max, round(avg(l2), 7) AS l2_avg, round(max(l2), 7) AS l2_max FROM s")
def evaluation_summary(spark, sf_dir):
    """V03, T07."""
    gaps = evaluate.marginal_gaps(*parity_rows(spark, sf_dir), LINEITEM, all_kway(LINEITEM, 2))
    return gaps.agg(*(F.round(f(m), 7).alias(f"{m}_{n}") for m in ("l1", "l2") for n, f in (("avg", F.avg), ("max", F.max))))
