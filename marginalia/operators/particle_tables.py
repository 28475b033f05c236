"""Particle descent on tables (K02, K03, K08, K10, K11): the cloud's points and moments are rows, of any number.

A state is a written table (pid, x_<attr>, m_<attr>, v_<attr>); a batch of cliques reads it and writes
the next one. Along each direction points are ranked by ranges over all tasks; a rank meets the target's cell whose
run of ranks holds it, found by an equi-join on blocks of ranks, since a target has few cells and many ranks. Pulls
are added up by point, and the optimiser's step is column arithmetic. The driver holds directions and scalars.

``particles.ParticleInference`` is the same descent for clouds that fit one process; without a
mask both take the same steps for the same seed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.scalar import clamp_unit, threshold_query, uniform
from marginalia.operators.discretize import Embedding
from marginalia.operators.marginals import marginal
from marginalia.operators.snapshots import Snapshots
from marginalia.operators.transport import directions
from marginalia.plans.schema import Clique, Domain
from marginalia.storage import materialise, numbered

BLOCK = 64  # ranks
BETAS, EPS = (0.9, 0.999), 1e-8


@dataclass(frozen=True)
class Cloud:
    """Points in the unit cube with the optimiser's moments; ``t`` steps have been taken."""

    domain: Domain
    rows: DataFrame
    n: int
    t: int = 0

    @classmethod
    def of_rows(cls, domain: Domain, points: DataFrame, n: int | None = None) -> Cloud:
        """``points``: (pid, x_<attr>); pids are distinct."""
        zeros = [F.lit(0.0).alias(f"{p}_{a}") for p in "mv" for a in domain]
        rows = materialise(points.select("pid", *("x_" + a for a in domain), *zeros), "cloud")
        return cls(domain, rows, rows.count() if n is None else n)

    @classmethod
    def random(cls, spark: SparkSession, domain: Domain, n: int, seed: int = 0) -> Cloud:
        coords = [uniform(seed, F.lit(a), F.col("id")).alias("x_" + a) for a in domain]
        return cls.of_rows(domain, spark.range(n).select(F.col("id").alias("pid"), *coords), n)

    def project(self, attrs: Sequence[str], embedding: Embedding | None = None) -> DataFrame:
        """(attrs, value): how many points fall into each cell."""
        return marginal(self.coded(embedding), self.domain, attrs)

    def coded(self, embedding: Embedding | None = None) -> DataFrame:
        """A coded row for each point."""
        return (embedding or Embedding(self.domain)).discretize(self.rows)


@dataclass(frozen=True)
class Target:
    """A clique's marginal as ``copies`` of its cells: (cell, x_<attr>, copies), together as many as there are points.

    Its rows are bounded by the cells of the clique.
    """

    clique: Clique
    cells: DataFrame

    @classmethod
    def of_marginal(cls, domain: Domain, clique: Sequence[str], cells: DataFrame, n: int, value: str = "value") -> Target:
        """``cells``: (cell, value), not negative; whole copies by running sums."""
        centres = Embedding(domain).centers(cells.sparkSession, clique)
        order = Window.orderBy("cell")  # the cells of a clique
        share = F.sum(value).over(order) / F.sum(value).over(Window.partitionBy())
        upto = cells.select("cell", F.floor(share * n + 0.5).cast("long").alias("upto"))
        copies = upto.select("cell", (F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))).alias("copies")).filter("copies > 0")
        return cls(tuple(clique), materialise(centres.join(copies, "cell"), "cloud-target"))


def along(theta: Sequence[float], attrs: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col("x_" + a) * F.lit(float(t)) for a, t in zip(attrs, theta, strict=True)))


def gaps(rows: DataFrame, batch: Sequence[tuple[Target, np.ndarray]]) -> DataFrame:
    """(pid, proj, gap): how far each point lies, along each direction of each clique, beyond the target's point of its rank."""
    lines = [(target, theta) for target, thetas in batch for theta in thetas]
    here = F.array(*(F.struct(F.lit(i).alias("proj"), along(theta, target.clique).alias("z")) for i, (target, theta) in enumerate(lines)))
    long = rows.select("pid", F.explode(here).alias("_p")).select("pid", "_p.proj", "_p.z")
    ranked = numbered(long, [F.col("proj"), F.col("z"), F.col("pid")], ("proj",), "cloud-ranks")
    there = reduce(DataFrame.union, (target.cells.select(F.lit(i).alias("_proj"), along(theta, target.clique).alias("_z"), "cell", "copies") for i, (target, theta) in enumerate(lines)))
    order = Window.partitionBy("_proj").orderBy("_z", "cell")  # the cells of a clique
    upto = F.sum("copies").over(order)
    there = there.select("_proj", "_z", (upto - F.col("copies")).alias("_from"), (upto - 1).alias("_last"))
    blocks = F.sequence(F.floor(F.col("_from") / BLOCK), F.floor(F.col("_last") / BLOCK))
    there = there.select("*", F.explode(blocks).alias("_block"))
    met = ranked.withColumn("_of", F.floor(F.col("pos") / BLOCK)).join(there, (F.col("proj") == F.col("_proj")) & (F.col("_of") == F.col("_block")) & F.col("pos").between(F.col("_from"), F.col("_last")))
    return met.select("pid", "proj", (F.col("z") - F.col("_z")).alias("gap"))


def pulls(rows: DataFrame, domain: Domain, batch: Sequence[tuple[Target, np.ndarray]]) -> DataFrame:
    """W02 for several cliques at once: (pid, g_<attr>, loss), 100 times the gradient, and each point's squared gaps.

    A clique's gradient is the mean over its directions.
    """
    lines = [(target, theta, len(thetas)) for target, thetas in batch for theta in thetas]
    slopes = [[200.0 * float(theta[target.clique.index(a)]) / n if a in target.clique else 0.0 for target, theta, n in lines] for a in domain]
    share = F.element_at(F.array(*(F.lit(1.0 / n) for _, _, n in lines)), F.col("proj") + 1)
    sums = [F.sum(F.element_at(F.array(*map(F.lit, s)), F.col("proj") + 1) * F.col("gap")).alias("g_" + a) for a, s in zip(domain, slopes, strict=True)]
    return gaps(rows, batch).groupBy("pid").agg(*sums, F.sum(F.col("gap") * F.col("gap") * share).alias("loss"))


def kept(seed: int, t: int, attr: str, percent: float) -> Column:
    """Whether a coordinate moves in step ``t``; each is held with ``percent`` percent, by a digest of its name."""
    return uniform(seed, F.lit(t), F.lit(attr), F.col("pid")) >= percent / 100


def adam(x: Column, m: Column, v: Column, g: Column, t: int, rate: float) -> tuple[Column, Column, Column]:
    """The sparse step; where the gradient is 0 nothing moves. The point stays in the unit interval."""
    b1, b2 = BETAS
    m2, v2 = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
    moved = x - rate * (m2 / (1 - b1**t)) / (F.sqrt(v2 / (1 - b2**t)) + EPS)
    still = g == 0
    return clamp_unit(F.when(still, x).otherwise(moved)), F.when(still, m).otherwise(m2), F.when(still, v).otherwise(v2)


@dataclass(frozen=True)
class Thresholds:
    """Pulls the means of smooth threshold queries toward ``answers``."""

    thetas: Sequence[Sequence[float]]
    taus: Sequence[float]
    answers: Sequence[float]
    sigma: float = 10.0

    def slopes(self, cloud: Cloud) -> list[Column]:
        """The gradient of half the squared misses in each coordinate of a point. The means come from one aggregation."""
        attrs = cloud.domain.attrs
        smooth = [threshold_query([F.col("x_" + a) for a in attrs], theta, tau, self.sigma) for theta, tau in zip(self.thetas, self.taus, strict=True)]
        means = cloud.rows.agg(*(F.avg(s).alias(f"m{i}") for i, s in enumerate(smooth))).first()
        force = [s * (1 - s) * (self.sigma / cloud.n * (means[i] - self.answers[i])) for i, s in enumerate(smooth)]
        return [sum((f * float(theta[j]) for f, theta in zip(force, self.thetas, strict=True)), F.lit(0.0)) for j in range(len(attrs))]


def step(cloud: Cloud, batch: Sequence[tuple[Target, np.ndarray]], rate: float, p_mask: float = 0.0, seed: int = 0, constraint: Thresholds | None = None, scale_reg: float = 0.0) -> tuple[Cloud, float]:
    """The cloud after one step on a batch of cliques with their directions, and the batch's loss before it. One job writes both."""
    t, domain = cloud.t + 1, cloud.domain
    pulled = pulls(cloud.rows, domain, batch).withColumnRenamed("pid", "_pid")
    both = cloud.rows.join(pulled, F.col("pid") == F.col("_pid"), "left")
    extra = constraint.slopes(cloud) if constraint is not None and scale_reg else None
    columns = {}
    for j, a in enumerate(domain):
        g = F.coalesce(F.col("g_" + a), F.lit(0.0))
        if extra is not None:
            g = g + 100 * scale_reg * extra[j]
        if p_mask:
            g = F.when(kept(seed, t, a, p_mask), g).otherwise(0.0)
        columns["_g_" + a] = g
    both = both.withColumns(columns)
    out = []
    for a in domain:
        out += [c.alias(f"{p}_{a}") for p, c in zip("xmv", adam(F.col("x_" + a), F.col("m_" + a), F.col("v_" + a), F.col("_g_" + a), t, rate), strict=True)]
    seen = Observation()
    written = materialise(both.select("pid", *out, "loss").observe(seen, F.sum("loss").alias("loss")).drop("loss").select(*cloud.rows.columns), "cloud")
    return replace(cloud, rows=written, t=t), float(seen.get["loss"] or 0.0) / max(1, cloud.n)


@dataclass
class TableParticleInference:
    """K01-K03, K08 on tables; options as in ``particles.ParticleInference``."""

    domain: Domain
    iters: int = 1000
    lr: float = 0.1
    batch_size: int = 5
    n_directions: int = 10
    p_mask: float = 80.0
    decay_every: int = 50
    decay: float = 0.75
    seed: int = 0
    constraint: Thresholds | None = None
    scale_reg: float = 0.0
    losses: list[float] = field(default_factory=list)
    snapshots: Snapshots | None = None  # where points go every ``snapshot_every`` epochs, and at the end
    snapshot_every: int = 50

    def descend(self, cloud: Cloud, targets: Sequence[Target]) -> Cloud:
        rng, rate = np.random.default_rng(self.seed + 1), self.lr
        for epoch in range(self.iters):
            order, losses = rng.permutation(len(targets)), []
            for a in range(0, len(order), self.batch_size):
                batch = []
                for k in order[a : a + self.batch_size]:
                    d = len(targets[k].clique)
                    batch.append((targets[k], directions(d, self.n_directions if d > 1 else 1, int(rng.integers(1 << 31)))))
                cloud, loss = step(cloud, batch, rate, self.p_mask, self.seed, self.constraint, self.scale_reg)
                losses.append(loss)
            self.losses.append(sum(losses))
            if self.snapshots is not None and (epoch % self.snapshot_every == 0 or epoch == self.iters - 1):
                self.snapshots.add(cloud.rows, epoch)
            if (epoch + 1) % self.decay_every == 0:
                rate *= self.decay
        return cloud

    def estimate(self, cloud: Cloud, marginals: Iterable[tuple[Sequence[str], DataFrame]]) -> Cloud:
        """``marginals``: cliques with their shares (cell, value), noisy ones projected to probabilities before."""
        return self.descend(cloud, [Target.of_marginal(self.domain, c, cells, cloud.n) for c, cells in marginals])
