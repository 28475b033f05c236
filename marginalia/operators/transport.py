"""Optimal transport in windows (W01-W04, J17-J23, O01-O05). One-dimensional distances are sorts; projections reduce to them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.scalar import minkowski


MOST_CENTRES = 100_000


def directions(d: int, n: int, seed: int = 0) -> np.ndarray:
    """Unit vectors, uniform on the sphere; for one dimension 1."""
    if d == 1:
        return np.ones((n, 1))
    v = np.random.default_rng(seed).standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def projected(df: DataFrame, coords: Sequence[str], thetas: Sequence[Sequence[float]], keep: Sequence[str] = ()) -> DataFrame:
    """A row for each (row, direction): ``keep``, proj and z, the point's place along the direction."""
    dots = [F.struct(F.lit(i).alias("proj"), sum((F.lit(float(t)) * F.col(c) for t, c in zip(theta, coords, strict=True)), F.lit(0.0)).alias("z")) for i, theta in enumerate(thetas)]
    return df.select(*keep, F.explode(F.array(*dots)).alias("p")).select(*keep, "p.proj", "p.z")


def sliced_up(points: DataFrame, by: Sequence[str], slices: int) -> DataFrame:
    """``points`` with ``slice``: equal parts of each group's range of z, so that no task has to sort a whole group.

    Even where one slice holds most of a group the results are the same; only the sort is less evenly spread.
    """
    ends = points.groupBy(*by).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("z") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices)).otherwise(0)
    return points.join(ends, list(by)).withColumn("slice", F.least(place, F.lit(slices - 1)).cast("int")).drop("_lo", "_hi")


def w1_signed(points: DataFrame, by: Sequence[str] = ("proj",), slices: int = 32) -> DataFrame:
    """For each ``by``: the integral of |sum of signed weights up to z|, as w1. Points: (by, z, w); weights of the
    first sample are positive and of the second negative, each summing to 1. Equal z are added before any window.

    The running sum has two levels: over slices of z, then within each slice.
    """
    places = sliced_up(points.groupBy(*by, "z").agg(F.sum("w").alias("w")), by, slices)
    across = Window.partitionBy(*by).orderBy("slice")
    sums = places.groupBy(*by, "slice").agg(F.sum("w").alias("_w"), F.min("z").alias("_z"))
    sums = sums.select(*by, "slice", (F.sum("_w").over(across) - F.col("_w")).alias("_before"), F.lead("_z").over(across).alias("_next"))
    within = Window.partitionBy(*by, "slice").orderBy("z")
    upto = F.col("_before") + F.sum("w").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = places.join(sums, [*by, "slice"]).select(*by, F.abs(upto).alias("gap"), (F.coalesce(F.lead("z").over(within), F.col("_next")) - F.col("z")).alias("dz"))
    return steps.groupBy(*by).agg(F.coalesce(F.sum(F.col("gap") * F.col("dz")), F.lit(0.0)).alias("w1"))


def signed(real: DataFrame, synth: DataFrame, weight: str | None = None) -> DataFrame:
    """Both samples as one, with normalised weights ``w``, negative for the second. A sample of no weight gives null."""
    def part(df: DataFrame, sign: int) -> DataFrame:
        w = F.col(weight) if weight else F.lit(1.0)
        return df.withColumn("w", sign * w / df.select(w.alias("_w")).agg(F.sum("_w")).scalar())
    return part(real, 1).unionByName(part(synth, -1))


def sliced_w1(real: DataFrame, synth: DataFrame, coords: Sequence[str], thetas: Sequence[Sequence[float]], weight: str | None = None) -> DataFrame:
    """The mean over directions of the weighted 1-D distance, one row sw1. Equal points are merged first."""
    cols = [*coords, *([weight] if weight else [])]
    both = signed(real.select(*cols), synth.select(*cols), weight).groupBy(*coords).agg(F.sum("w").alias("w")).filter("w <> 0")
    return w1_signed(projected(both, coords, thetas, ["w"])).agg(F.sum("w1").alias("_s")).select((F.coalesce("_s", F.lit(0.0)) / len(thetas)).alias("sw1"))


def sliced_w1_grid(cells: DataFrame, coords: Sequence[str], thetas: Sequence[Sequence[float]], u: str = "u", v: str = "v") -> DataFrame:
    """Between two weightings of the same points, one row sw1."""
    return w1_signed(projected(cells.withColumn("w", F.col(u) - F.col(v)), coords, thetas, ["w"])).agg(F.avg("w1").alias("sw1"))


def rank_match(x: DataFrame, y: DataFrame, coords: Sequence[str], thetas: Sequence[Sequence[float]], key: str = "pid", slices: int = 32) -> DataFrame:
    """Along each direction the i-th smallest of x with the i-th smallest of y: (proj, key, z, z_other).

    Unequal numbers are matched by quantile: rank r of n meets rank floor(r m / n) of m.
    """
    def ranked(df: DataFrame, name: str) -> DataFrame:
        long = sliced_up(projected(df, coords, thetas, [key]), ["proj"], slices)
        sizes = long.groupBy("proj", "slice").agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.select("proj", "slice", (F.sum("_n").over(Window.partitionBy("proj").orderBy("slice")) - F.col("_n")).alias("_before"))
        rank = F.col("_before") + F.row_number().over(Window.partitionBy("proj", "slice").orderBy("z", key)) - 1
        return long.join(sizes, ["proj", "slice"]).select("proj", key, "z", rank.alias(name))
    a, b = ranked(x, "r"), ranked(y, "s")
    sizes = a.groupBy("proj").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("proj").agg(F.count(F.lit(1)).alias("m")), "proj")
    a = a.join(F.broadcast(sizes), "proj").withColumn("s", F.floor(F.col("r") * F.col("m") / F.col("n")).cast("long"))
    return a.join(b.select("proj", "s", F.col("z").alias("z_other")), ["proj", "s"]).select("proj", key, "z", "z_other")


def sliced_w2(x: DataFrame, y: DataFrame, coords: Sequence[str], thetas: Sequence[Sequence[float]], key: str = "pid") -> DataFrame:
    """The mean over directions of the mean squared gap of matched ranks, one row sw2."""
    gaps = rank_match(x, y, coords, thetas, key)
    return gaps.groupBy("proj").agg(F.avg(F.pow(F.col("z") - F.col("z_other"), 2)).alias("w2")).agg(F.avg("w2").alias("sw2"))


def sliced_w2_gradient(x: DataFrame, y: DataFrame, coords: Sequence[str], thetas: Sequence[Sequence[float]], key: str = "pid", scale: float = 100.0) -> DataFrame:
    """For each point the mean over directions of 2 (z - z_other) theta, times ``scale``: (key, g_<coord>)."""
    gaps = rank_match(x, y, coords, thetas, key)
    table = F.array(*(F.array(*(F.lit(float(t)) for t in theta)) for theta in thetas))
    pull = 2 * (F.col("z") - F.col("z_other"))
    return gaps.groupBy(key).agg(*((F.sum(pull * F.get(F.get(table, F.col("proj")), F.lit(j))) / len(thetas) * scale).alias("g_" + c) for j, c in enumerate(coords)))


def distances(a: DataFrame, b: DataFrame, coords: Sequence[str], p: float = math.inf, keys: tuple[str, str] = ("i", "j")) -> DataFrame:
    """(i, j, dist) of every point of ``a`` with every row of ``b``, a set of at most ``MOST_CENTRES`` centres."""
    if b.limit(MOST_CENTRES + 1).count() > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    left = a.select(keys[0], F.array(*coords).alias("_a"))
    right = b.select(keys[1], F.array(*coords).alias("_b"))
    return left.crossJoin(F.broadcast(right)).select(*keys, minkowski(F.col("_a"), F.col("_b"), p).alias("dist"))


# --- entropic transport on small vectors ----------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def sinkhorn(a: np.ndarray, b: np.ndarray, cost: np.ndarray, reg: float, iters: int = 1000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dual potentials f, g and the plan of entropic transport between weights a and b, in log space."""
    with np.errstate(divide="ignore"):
        la, lb = np.log(a), np.log(b)
    f, g = np.zeros(len(a)), np.zeros(len(b))
    for _ in range(iters):
        f = reg * (la - _lse((g[None, :] - cost) / reg, 1))
        f = np.where(np.isfinite(f), f, -np.inf)
        new = reg * (lb - _lse((f[:, None] - cost) / reg, 0))
        moved = np.nanmax(np.abs(np.where(np.isfinite(new), new - g, 0.0)), initial=0.0)
        g = new
        if moved < tol:
            break
    return f, g, np.exp((f[:, None] + g[None, :] - cost) / reg)


def symmetric_potential(a: np.ndarray, cost: np.ndarray, reg: float, iters: int = 1000, tol: float = 1e-12) -> np.ndarray:
    """The one potential of a against itself, by averaged updates, which settle fast."""
    with np.errstate(divide="ignore"):
        la = np.log(a)
    f = np.zeros(len(a))
    for _ in range(iters):
        new = (f + reg * -_lse((f[None, :] - cost) / reg + la[None, :], 1)) / 2
        moved, f = np.abs(new - f).max(), new
        if moved < tol:
            break
    return f + reg * la


def sinkhorn_gradient_weights(a: np.ndarray, b: np.ndarray, cost: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """The transport cost and its gradient in a."""
    f, _, plan = sinkhorn(a, b, cost, reg)
    return float((plan * cost).sum()), f


def sinkhorn_gradient_locations(a: np.ndarray, b: np.ndarray, cost: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """The transport cost and the plan, along which points are drawn."""
    _, _, plan = sinkhorn(a, b, cost, reg)
    return float((plan * cost).sum()), plan


def sinkhorn_divergence_gradient(a: np.ndarray, b: np.ndarray, cost: np.ndarray, own: np.ndarray, reg: float) -> np.ndarray:
    """The debiased gradient in a: potential against b less half the sum of both potentials against itself."""
    f, g, _ = sinkhorn(a, b, cost, reg)
    shift = ((g * b).sum() - (f * a).sum()) / 2  # potentials are fixed up to a constant; both sides share it equally
    return f + shift - symmetric_potential(a, own, reg)


def sinkhorn_gradient(a: np.ndarray, b: np.ndarray, cost: np.ndarray, reg: float, most: float = 1e6) -> np.ndarray:
    """The potential in a, without infinities."""
    return np.clip(sinkhorn(a, b, cost, reg)[0], -most, most)


CREATED = 2.0  # what a unit of new mass costs; moving it costs the distance


def nearest_probability(signed_weights: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The probability vector nearest to signed weights, if a unit moves at ``cost`` and is made at ``CREATED``.

    The linear program in its transport form: mass at positive cells first serves the total of 1 where it lies, for
    nothing; what is beyond that fills negative cells, by successive cheapest paths, as long as moving is cheaper than
    making; the rest is made. Where solutions tie, the mass that stays is scaled as a whole.
    """
    v = np.asarray(signed_weights, float)
    have, want = np.flatnonzero(v > 0), np.flatnonzero(v < 0)
    if not len(have):
        return np.full(len(v), 1 / len(v))
    left, need = v[have].copy(), -v[want]
    spare, flow = left.sum() - 1, np.zeros((len(have), len(want)))
    price = np.asarray(cost, float)[np.ix_(have, want)]
    while spare > 1e-12 and need.size and need.max() > 1e-12:
        at, into = np.where(left > 1e-12, 0.0, np.inf), np.full(len(want), np.inf)  # cheapest way to each cell
        by, back = np.full(len(want), -1), np.full(len(have), -1)
        for _ in range(len(v)):
            ways = at[:, None] + price
            near, first = ways.min(axis=0), ways.argmin(axis=0)
            better = near < into - 1e-12
            into[better], by[better] = near[better], first[better]
            undo = np.where(flow > 1e-12, into[None, :] - price, np.inf)  # a cell served by another way frees its mass
            cheap, where = undo.min(axis=1), undo.argmin(axis=1)
            again = cheap < at - 1e-12
            at[again], back[again] = cheap[again], where[again]
            if not better.any() and not again.any():
                break
        j = int(np.where(need > 1e-12, into, np.inf).argmin())
        if need[j] <= 1e-12 or into[j] >= CREATED:
            break
        path, i = [], int(by[j])
        path.append((i, j))
        while back[i] >= 0:
            j2 = int(back[i])
            path.append((i, j2))
            i = int(by[j2])
            path.append((i, j2))
        most = min(spare, need[j], left[i], *(flow[a, b] for a, b in path[1::2]))
        for step, (a, b) in enumerate(path):
            flow[a, b] += most if step % 2 == 0 else -most
        left[i] -= most
        need[j] -= most
        spare -= most
    out = np.zeros(len(v))
    out[have] = np.maximum(left, 0)
    return out / out.sum()
