"""Entropic transport and nearest centres on tables (O02-O05, J17-J20, T03), without pairs of all cells or of all points.

The cost of moving between two cells of a grid is taken as a sum over attributes, so the kernel
is a product of small ones: what a cell receives from all others is gathered one attribute
at a time, each time by a join on that attribute's codes. A grid of N cells and attributes of
k codes costs N k rows for an attribute, not N². Everything is in log space.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.scalar import NEG_INF, center
from marginalia.plans.schema import Domain
from marginalia.storage import materialise

SENT_CODES = 1_000_000  # rows of one attribute's cost table that are broadcast


def log_total(values: Column) -> Column:
    """The log of the summed exponentials of an array; -inf if all are -inf."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda so_far, v: so_far + F.exp(v - top))
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.log(total))


def spread(rows: DataFrame, domain: Domain, reg: float, p: float = 2.0, weigh: str | None = None) -> DataFrame:
    """(attrs, value): for each cell x the log of the sum over cells y of exp(value(y) - cost(x, y) / reg).

    cost: the sum over attributes of |centre - centre|^p. ``weigh``: the summands are multiplied by that attribute's cost.
    An attribute's pass collects, for each cell, as many numbers as the attribute has codes.
    """
    spark = rows.sparkSession
    for a, k in domain.config.items():
        code = spark.range(k * k).select((F.col("id") % k).cast("int").alias("_to"), F.floor(F.col("id") / k).cast("int").alias(a))
        cost = F.pow(F.abs(center(F.col("_to"), k) - center(F.col(a), k)), F.lit(float(p)))
        bent = -cost / reg + (F.when(cost > 0, F.log(cost)).otherwise(F.lit(NEG_INF)) if a == weigh else F.lit(0.0))
        code = code.select("_to", a, bent.alias("_bent"))
        rest = [b for b in domain if b != a]
        met = rows.join(F.broadcast(code) if k * k <= SENT_CODES else code, a)
        met = met.groupBy(*rest, "_to").agg(F.collect_list(F.col("value") + F.col("_bent")).alias("_all"))
        rows = met.select(*rest, F.col("_to").alias(a), log_total(F.col("_all")).alias("value"))
    return rows.select(*domain.attrs, "value")


def log_or_none(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(NEG_INF))


def scaled(state: DataFrame, domain: Domain, potential: Column) -> DataFrame:
    return state.select(*domain.attrs, potential.alias("value"))


def sinkhorn(cells: DataFrame, domain: Domain, reg: float, rounds: int = 1000, tol: float = 1e-9, p: float = 2.0) -> DataFrame:
    """Potentials of entropic transport between two weightings of a grid: (attrs, a, b, f, g), written after each round.

    ``cells``: (attrs, a, b) of all cells of ``domain``. A round makes f from g, then g from f; it ends when no g moves by ``tol``.
    """
    keys = list(domain.attrs)
    state = materialise(cells.select(*keys, "a", "b", F.lit(0.0).alias("f"), F.lit(0.0).alias("g")), "sinkhorn")
    for _ in range(rounds):
        got = spread(scaled(state, domain, F.col("g") / reg), domain, reg, p)
        half = state.join(got, keys).withColumn("f", reg * (log_or_none(F.col("a")) - F.col("value"))).drop("value")
        back = spread(scaled(half, domain, F.col("f") / reg), domain, reg, p)
        new = half.join(back, keys).withColumn("_new", reg * (log_or_none(F.col("b")) - F.col("value")))
        moved = F.when((F.col("_new") == NEG_INF) & (F.col("g") == NEG_INF), 0.0).otherwise(F.abs(F.col("_new") - F.col("g")))
        written = materialise(new.select(*keys, "a", "b", "f", F.col("_new").alias("g"), moved.alias("_moved")), "sinkhorn")
        state = written.drop("_moved")
        if tol > 0 and (written.agg(F.max("_moved")).first()[0] or 0.0) < tol:
            break
    return state


def transport_cost(state: DataFrame, domain: Domain, reg: float, p: float = 2.0) -> float:
    """The cost of the plan that the potentials stand for, an attribute at a time; the plan itself is never made."""
    keys, total = list(domain.attrs), 0.0
    for a in domain:
        got = spread(scaled(state, domain, F.col("g") / reg), domain, reg, p, weigh=a)
        total += state.join(got, keys).agg(F.sum(F.exp(F.col("f") / reg + F.col("value")))).first()[0] or 0.0
    return total


def symmetric(cells: DataFrame, domain: Domain, reg: float, rounds: int = 1000, tol: float = 1e-12, p: float = 2.0, weight: str = "a") -> DataFrame:
    """The potential of a weighting against itself, (attrs, own), by averaged updates."""
    keys = list(domain.attrs)
    state = materialise(cells.select(*keys, F.col(weight).alias("a"), F.lit(0.0).alias("own")), "sinkhorn-own")
    for _ in range(rounds):
        got = spread(scaled(state, domain, F.col("own") / reg + log_or_none(F.col("a"))), domain, reg, p)
        new = ((F.col("own") - reg * F.col("value")) / 2).alias("_new")
        written = materialise(state.join(got, keys).select(*keys, "a", new, F.abs(new - F.col("own")).alias("_moved")), "sinkhorn-own")
        state = written.select(*keys, "a", F.col("_new").alias("own"))
        if tol > 0 and (written.agg(F.max("_moved")).first()[0] or 0.0) < tol:
            break
    return state.select(*keys, (F.col("own") + reg * log_or_none(F.col("a"))).alias("own"))


def divergence_gradient(cells: DataFrame, domain: Domain, reg: float, rounds: int = 1000, tol: float = 1e-9, p: float = 2.0) -> DataFrame:
    """(attrs, gradient), the debiased gradient in a; both potentials share their free constant equally."""
    keys = list(domain.attrs)
    state = sinkhorn(cells, domain, reg, rounds, tol, p)
    sums = state.agg(F.sum(F.col("g") * F.col("b")).alias("g"), F.sum(F.col("f") * F.col("a")).alias("f")).first()
    shift = (sums["g"] - sums["f"]) / 2
    own = symmetric(cells, domain, reg, rounds, 1e-12, p)
    return state.join(own, keys).select(*keys, (F.col("f") + shift - F.col("own")).alias("gradient"))


# --- nearest centre ------------------------------------------------------------------------------------------------------

LEAF = 16  # centres of a leaf, about
SENT_NODES = 50_000  # nodes of one level of the tree that are broadcast
POINTS_TASK = 20_000  # points of a task while they go down
DIVIDED = 6  # coordinates that divide nodes; boxes are over all


def apart(x: Sequence[Column], y: Sequence[Column], p: float) -> Column:
    """``minkowski`` over columns."""
    gaps = [F.abs(a - b) for a, b in zip(x, y, strict=True)]
    if p == math.inf:
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return F.pow(sum((F.pow(g, F.lit(float(p))) for g in gaps), F.lit(0.0)), F.lit(1.0 / p))


def nearest_centres(points: DataFrame, centres: DataFrame, coords: Sequence[str], keys: tuple[str, str] = ("i", "j"), p: float = math.inf) -> DataFrame:
    """(i, j, dist), the nearest centre of each point in the p norm, of equal ones the smallest j.

    Centres form a tree whose nodes halve in each coordinate; a node knows the box around its centres and its centre of
    smallest j, its head. Points go down a level at a time, by an equi-join of the nodes they are still at with these nodes'
    children. All heads met give a best (dist, j); a child whose box is not nearer, or as near without a smaller j, is
    left. So a node all of whose centres are as far as its head is done with at once, however many they are, and a point
    never meets empty space. What is left at the leaves meets their centres. Levels of few nodes are broadcast and
    need no shuffle. Centres at one place are one centre. A null coordinate, or no centre at all, gives no row.
    """
    i, j = keys
    x, y, low, high = ([F.col(f"_{n}{k}") for k in range(len(coords))] for n in ("x", "y", "lo", "hi"))
    put = [f"_p{k}" for k in range(min(len(coords), DIVIDED))]
    named = lambda n: [F.col(c).cast("double").alias(f"_{n}{k}") for k, c in enumerate(coords)]
    centres = centres.dropna(subset=list(coords)).groupBy(*coords).agg(F.min(j).alias(j)).select(F.col(j).alias("_j"), *named("y"))
    centres = materialise(centres, "centres")
    box = centres.agg(F.count(F.lit(1)).alias("n"), *(f(f"_y{k}").alias(f"{n}{k}") for k in range(len(put)) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if not box["n"]:
        return points.sparkSession.createDataFrame([], f"{i} {points.schema[i].dataType.simpleString()}, {j} {centres.schema['_j'].dataType.simpleString()}, dist double")
    bits = min(30, 60 // len(put))
    width = (max(float(box[f"hi{k}"]) - float(box[f"lo{k}"]) for k in range(len(put))) or 1.0) / 2**bits
    index = centres.select("*", *(F.least(F.floor((y[k] - float(box[f"lo{k}"])) / width), F.lit(2**bits - 1)).cast("long").alias(c) for k, c in enumerate(put)))

    def up(levels: int) -> list[Column]:
        return [F.shiftright(c, levels).alias(c) for c in put]

    def number(level: int, levels: int = 0) -> Column:
        """A node of ``level``, from the places of nodes ``levels`` below."""
        return sum((F.shiftright(c, levels) * F.lit(1 << (level * k)) for k, c in enumerate(put)), F.lit(0).cast("long"))

    def crowd(level: int) -> float:
        """How many centres share a centre's node, on average."""
        return index.groupBy(*up(bits - level)).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]

    depth = min(bits, max(1, math.ceil(math.log2(max(1.0, box["n"] / LEAF)) / len(put))))
    while depth < bits and crowd(depth) > 4 * LEAF:
        depth += 1
    head = F.struct("_j", *(f"_y{k}" for k in range(len(coords)))).alias("_head")
    nodes = index.select(*up(bits - depth), head, *(F.col(f"_y{k}").alias(f"_{n}{k}") for n in ("lo", "hi") for k in range(len(coords))))
    tree = []
    for level in range(depth, 0, -1):
        around = [f(f"_{n}{k}").alias(f"_{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(len(coords))]
        nodes = materialise(nodes.groupBy(*put).agg(F.min("_head").alias("_head"), *around), "centre-nodes")
        tree.insert(0, nodes.select(number(level).alias("_node"), number(level - 1, 1).alias("_at"), "_head", *low, *high))
        nodes = nodes.select(*up(1), "_head", *low, *high)

    def reach(dist: Column, smallest: Column) -> Column:
        return F.struct(dist.alias("dist"), smallest.alias("j"))

    # powers may be off in their last places; a greatest gap is not
    least = apart(x, [F.least(F.greatest(a, b), c) for a, b, c in zip(x, low, high, strict=True)], p) * F.lit(1.0 if p == math.inf else 1 - 1e-12)
    near, best = reach(least, F.col("_head._j")), F.col("_best")
    of_head = F.when(F.col("_head").isNotNull(), reach(apart(x, [F.col(f"_head._y{k}") for k in range(len(coords))], p), F.col("_head._j")))
    known, alone = F.min(of_head).over(Window.partitionBy("_i")), F.col("_node").isNull()
    # beside its nodes a point has a row at none, which keeps its best
    given = points.dropna(subset=list(coords)).select(F.col(i).alias("_i"), *named("x"))
    tasks = max(4 * points.sparkSession.sparkContext.defaultParallelism, given.count() // POINTS_TASK)
    front = given.repartition(tasks, "_i").select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(None).cast("long"))).alias("_at"), F.lit(None).cast(f"struct<dist:double,j:{centres.schema['_j'].dataType.simpleString()}>").alias("_best"))
    written = False
    for level in tree:
        if level.count() <= SENT_NODES:
            met = front.join(F.broadcast(level), "_at", "left")
        else:
            front, written = front if written else materialise(front, "nearest"), True
            met = front.filter("_at is not null").join(level.hint("merge"), "_at").unionByName(front.filter("_at is null"), allowMissingColumns=True)
        met = met.filter(alone | best.isNull() | (near < best)).withColumn("_best", F.least(best, known))
        front = met.filter(alone | (near < best)).select("_i", *x, F.col("_node").alias("_at"), "_best")
        front = materialise(front, "nearest") if written else front
    front = front if written else materialise(front, "nearest")
    leaves = index.select(number(depth, bits - depth).alias("_at"), "_j", *y)
    met = front.filter("_at is not null").join(leaves.hint("merge"), "_at").select("_i", "_best", reach(apart(x, y, p), F.col("_j")).alias("_near"))
    closer = met.filter(F.col("_near") < best).select("_i", F.col("_near").alias("_best"))
    found = closer.union(front.filter("_at is null").select("_i", "_best")).groupBy("_i").agg(F.min("_best").alias("_best"))
    return found.select(F.col("_i").alias(i), F.col("_best.j").alias(j), F.col("_best.dist").alias("dist"))
