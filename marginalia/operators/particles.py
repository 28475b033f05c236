"""Particle engine (K01-K13): a cloud of weighted points whose sliced transport distance to noisy marginals is small.

The state is small (points times attributes), so the descent runs on arrays in one process;
the projection of signed marginals to probabilities, independent for each clique, is dealt to
tasks by ``applyInPandas``. ``transport.sliced_w2_gradient`` is the DataFrame form of one step.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.scalar import threshold_query, uniform
from marginalia.operators.discretize import Embedding
from marginalia.operators.pgm import Measurement, estimate_total, fix_measurements
from marginalia.operators.transport import directions
from marginalia.plans.privacy import Budget, ana_gaussian_mech
from marginalia.plans.schema import Clique, Domain
from marginalia.shipping import ship


class Adam:
    """Adam whose moments and values move only where the gradient is not zero."""

    def __init__(self, shape: tuple[int, ...], rate: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> None:
        self.m, self.v, self.t, self.rate, self.betas, self.eps = np.zeros(shape), np.zeros(shape), 0, rate, betas, eps

    def step(self, x: np.ndarray, grad: np.ndarray, sparse: bool = False) -> None:
        self.t += 1
        at = grad != 0 if sparse else np.ones(grad.shape, bool)
        b1, b2 = self.betas
        self.m[at] = b1 * self.m[at] + (1 - b1) * grad[at]
        self.v[at] = b2 * self.v[at] + (1 - b2) * grad[at] ** 2
        x[at] -= self.rate * (self.m[at] / (1 - b1**self.t)) / (np.sqrt(self.v[at] / (1 - b2**self.t)) + self.eps)


def sliced_w1_value_and_gradient(u: np.ndarray, v: np.ndarray, points: np.ndarray, thetas: np.ndarray) -> tuple[float, np.ndarray]:
    """W01 between two weightings of points, and its gradient in u: the reverse cumulative sum of signed gaps."""
    total, grad = 0.0, np.zeros(len(u))
    for z in thetas @ points.T:
        order = np.argsort(z, kind="stable")
        gap = np.diff(z[order])
        lead = np.cumsum((u - v)[order])[:-1]
        total += float((gap * np.abs(lead)).sum())
        signed = np.sign(lead) * gap
        grad[order[:-1]] += np.cumsum(signed[::-1])[::-1]
    return total / len(thetas), grad / len(thetas)


def project_to_probabilities(v: np.ndarray, points: np.ndarray, iters: int = 1750, n_directions: int = 200, rate: float = 0.1, decay_every: int = 100, decay: float = 0.8, seed: int = 0) -> np.ndarray:
    """The probability vector nearest to signed weights ``v`` in sliced W1, over softmax logits, with fresh directions."""
    start = np.maximum(v, 0)
    start = start / start.sum() if start.sum() > 0 else np.full(len(v), 1 / len(v))
    logits, adam = np.log(start + 1e-9), Adam((len(v),), rate)
    rng = np.random.default_rng(seed)
    best, best_loss = start, np.inf
    for t in range(iters):
        e = np.exp(logits - logits.max())
        u = e / e.sum()
        thetas = directions(points.shape[1], n_directions if points.shape[1] > 1 else 1, int(rng.integers(1 << 31)))
        loss, g = sliced_w1_value_and_gradient(u, v, points, thetas)
        if loss < best_loss:
            best, best_loss = u, loss
        adam.step(logits, u * (g - u @ g))
        if (t + 1) % decay_every == 0:
            adam.rate *= decay
    return best


def cell_centers(domain: Domain, clique: Sequence[str]) -> np.ndarray:
    """the centres (2i+1)/2k of a clique's cells, row-major."""
    axes = [(2 * np.arange(domain[a]) + 1) / (2 * domain[a]) for a in clique]
    return np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(axes))


def projection_step(spark: SparkSession, domain: Domain, measurements: Sequence[Measurement], total: float, iters: int = 1750, n_directions: int = 200, rate: float = 0.1, seed: int = 0) -> list[np.ndarray]:
    """Each clique's noisy counts as probabilities. Cliques are independent, so they are dealt to tasks."""
    ship(spark)
    rows = [(i, j, float(x)) for i, m in enumerate(measurements) for j, x in enumerate(m.y / total)]
    cliques = [m.clique for m in measurements]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        pdf = pdf.sort_values("cell")
        v = pdf["v"].to_numpy()
        if (v >= 0).all() and abs(v.sum() - 1) < 1e-9:
            return pdf.rename(columns={"v": "p"})
        p = project_to_probabilities(v, cell_centers(domain, cliques[i]), iters, n_directions, rate, seed=seed + i)
        return pd.DataFrame({"clique_id": i, "cell": pdf["cell"], "p": p})

    given = spark.createDataFrame(pd.DataFrame(rows, columns=["clique_id", "cell", "v"]), "clique_id int, cell long, v double")
    got = given.groupBy("clique_id").applyInPandas(one, "clique_id int, cell long, p double").toPandas()
    return [got[got["clique_id"] == i].sort_values("cell")["p"].to_numpy() for i in range(len(cliques))]


def quantise(points: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """N points in proportion to p: whole copies, and what is left to the cells where the running sum passes a whole number."""
    p = p / p.sum()
    return points[np.repeat(np.arange(len(p)), np.diff(np.floor(np.append(0, np.cumsum(p)) * n + 0.5)).astype(int))][:n]


def quantise_rows(cells: DataFrame, n: int, keys: Sequence[str] = ("cell",), value: str = "p") -> DataFrame:
    """K07 as a plan: (keys, pid): point r goes to the first cell whose running share times n passes r."""
    order = Window.orderBy(*keys)  # one row for each cell of one clique
    share = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum(value).over(Window.partitionBy())
    upto = cells.withColumn("_upto", F.floor(share * n + 0.5).cast("long"))
    upto = upto.withColumn("_from", F.coalesce(F.lag("_upto").over(order), F.lit(0)))
    return upto.filter("_upto > _from").select(*keys, F.explode(F.sequence(F.col("_from"), F.col("_upto") - 1)).alias("pid"))


def mask(shape: tuple[int, int], percent: float, rng: np.random.Generator) -> np.ndarray:
    """Zero exactly int(N D percent / 100) entries."""
    out = np.ones(shape[0] * shape[1])
    out[rng.choice(len(out), int(len(out) * percent / 100), replace=False)] = 0
    return out.reshape(shape)


@dataclass
class ParticleModel:
    """Points in the unit cube, one coordinate per attribute, with weights that sum to 1."""

    domain: Domain
    x: np.ndarray
    w: np.ndarray
    embedding: Embedding | None = None

    @classmethod
    def random(cls, domain: Domain, n: int, seed: int = 0, embedding: Embedding | None = None) -> ParticleModel:
        return cls(domain, np.random.default_rng(seed).random((n, len(domain))), np.full(n, 1 / n), embedding)

    @classmethod
    def from_codes(cls, domain: Domain, codes: np.ndarray, embedding: Embedding | None = None) -> ParticleModel:
        k = np.array(domain.shape)
        return cls(domain, (2 * np.asarray(codes) + 1) / (2 * k), np.full(len(codes), 1 / len(codes)), embedding)

    def codes(self) -> np.ndarray:
        """D12."""
        k = np.array(self.domain.shape)
        return np.clip(np.ceil(self.x * k) - 1, 0, k - 1).astype(int)

    def project(self, attrs: Sequence[str]) -> np.ndarray:
        """Weighted counts of the clique's cells; they sum to the number of points."""
        part, codes = self.domain.project(attrs), self.codes()[:, self.domain.axes(attrs)]
        cell = codes @ np.array(part.strides())
        return np.bincount(cell, self.w * len(self.w), part.size()).reshape(part.shape)

    def datavector(self, flatten: bool = True) -> np.ndarray:
        """G07."""
        x = self.project(self.domain.attrs)
        return x.ravel() if flatten else x

    def rows(self, spark: SparkSession) -> DataFrame:
        """(pid, x_<attr>..., w)."""
        pdf = pd.DataFrame(self.x, columns=["x_" + a for a in self.domain])
        pdf.insert(0, "pid", np.arange(len(pdf)))
        return spark.createDataFrame(pdf.assign(w=self.w))

    def synthetic(self, spark: SparkSession, records: int | None = None, seed: int = 0) -> DataFrame:
        """Coded rows, one for each point, or ``records`` drawn from the points."""
        embedding = self.embedding or Embedding(self.domain)
        points = self.rows(spark)
        if records is None or records == len(self.x):
            return embedding.discretize(points)
        n = len(self.x)
        draws = spark.range(records).select(F.floor(uniform(seed, F.col("id")) * n).cast("long").alias("pid"))
        return embedding.discretize(draws.join(points, "pid"))

    def save(self, spark: SparkSession, path: str) -> None:
        """S14."""
        self.rows(spark).write.mode("overwrite").parquet(f"{path}/particles")
        spark.createDataFrame([(json.dumps(self.domain.config),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ParticleModel:
        domain = Domain.fromdict(json.loads(spark.read.text(f"{path}/meta").first()[0]))
        got = spark.read.parquet(f"{path}/particles").toPandas().sort_values("pid")
        return cls(domain, got[["x_" + a for a in domain]].to_numpy(), got["w"].to_numpy())


@dataclass
class ParticleInference:
    """Fits particles to noisy marginals by gradient steps on sliced W2, clique batches at a time."""

    domain: Domain
    n_particles: int = 100_000
    iters: int = 1000
    lr: float = 0.1
    batch_size: int = 5
    n_directions: int = 10
    p_mask: float = 80.0
    decay_every: int = 50
    decay: float = 0.75
    proj_iters: int = 1750
    proj_directions: int = 200
    proj_lr: float = 0.1
    seed: int = 0
    data_init: np.ndarray | None = None
    embedding: Embedding | None = None
    constraint: Callable[[np.ndarray], tuple[float, np.ndarray]] | None = None  # X03: loss and gradient of the points
    scale_reg: float = 0.0
    callback: Callable[[Mapping[Clique, np.ndarray]], None] | None = None
    _known: dict = field(default_factory=dict)

    def estimate(self, spark: SparkSession, measurements: Iterable[Measurement | tuple], total: float | None = None) -> ParticleModel:
        """K02."""
        measured = fix_measurements(self.domain, measurements)
        total = estimate_total(measured) if total is None else total
        if self.data_init is not None:
            model = ParticleModel.from_codes(self.domain, self.data_init, self.embedding)
        else:
            model = ParticleModel.random(self.domain, self.n_particles, self.seed, self.embedding)
        new = [m for m in measured if self._key(m) not in self._known]
        if new:
            found = projection_step(spark, self.domain, new, total, self.proj_iters, self.proj_directions, self.proj_lr, self.seed)
            self._known.update((self._key(m), p) for m, p in zip(new, found, strict=True))
        self.cliques, self.total, self.measured = list(dict.fromkeys(m.clique for m in measured)), total, measured
        targets = [(self.domain.axes(m.clique), quantise(cell_centers(self.domain, m.clique), self._known[self._key(m)], len(model.x))) for m in measured]
        self.final_loss = self._descend(model, targets)
        return model

    @staticmethod
    def _key(m: Measurement) -> tuple:
        return (m.clique, m.y.tobytes())

    def _descend(self, model: ParticleModel, targets: Sequence[tuple[tuple[int, ...], np.ndarray]]) -> float:
        rng, adam, losses = np.random.default_rng(self.seed + 1), Adam(model.x.shape, self.lr), np.zeros(len(targets))
        for epoch in range(self.iters):
            order = rng.permutation(len(targets))
            for a in range(0, len(order), self.batch_size):
                grad = np.zeros_like(model.x)
                for k in order[a : a + self.batch_size]:
                    axes, y = targets[k]
                    x = model.x[:, axes]
                    thetas = directions(len(axes), self.n_directions if len(axes) > 1 else 1, int(rng.integers(1 << 31)))
                    pull, value = np.zeros_like(x), 0.0
                    for theta in thetas:
                        zx, zy = x @ theta, np.sort(y @ theta)
                        place = np.argsort(zx, kind="stable")
                        gap = np.empty(len(x))
                        gap[place] = zx[place] - zy[np.arange(len(x)) * len(zy) // len(x)]
                        pull += 2 * gap[:, None] * theta
                        value += float((gap**2).mean())
                    losses[k] = value / len(thetas)
                    grad[:, axes] += 100 * pull / len(thetas)
                if self.constraint is not None and self.scale_reg:
                    grad += 100 * self.scale_reg * self.constraint(model.x)[1]
                if self.p_mask:
                    grad *= mask(grad.shape, self.p_mask, rng)
                adam.step(model.x, grad, sparse=True)
                np.clip(model.x, 0, 1, out=model.x)
            if (epoch + 1) % self.decay_every == 0:
                adam.rate *= self.decay
            if self.callback is not None:
                self.callback({c: model.project(c) * (self.total / len(model.x)) for c in self.cliques})
        return float(losses.sum())


@dataclass
class ThresholdConstraint:
    """Pulls the mean of smooth threshold queries toward given answers: half the squared miss, with its gradient."""

    thetas: np.ndarray
    taus: np.ndarray
    answers: np.ndarray
    sigma: float = 10.0

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        s = 1 / (1 + np.exp(-self.sigma * (x @ np.asarray(self.thetas).T - self.taus)))
        miss = s.mean(axis=0) - self.answers
        slope = (self.sigma / len(x)) * s * (1 - s) * miss
        return float(0.5 * (miss**2).sum()), slope @ np.asarray(self.thetas)


def measured_constraint(df: DataFrame, domain: Domain, thetas: Sequence[Sequence[float]], taus: Sequence[float], budget: Budget, sigma: float = 5.0) -> ThresholdConstraint:
    """The queries' noisy means over the rows of ``df`` as a constraint. A row moves each mean by 1 / N at most."""
    points = Embedding(domain).embed(df)
    x = [F.col("x_" + a) for a in domain]
    means = [F.avg(threshold_query(x, theta, tau, sigma)).alias(f"m{i}") for i, (theta, tau) in enumerate(zip(thetas, taus, strict=True))]
    row = points.agg(F.count(F.lit(1)).alias("n"), *means).first()
    noise = ana_gaussian_mech(budget.epsilon, budget.delta) * len(means) ** 0.5 / max(1, row["n"])
    answers = np.array(row[1:], float) + np.random.default_rng(budget.seed).normal(0, noise, len(means))
    return ThresholdConstraint(np.array(thetas, float), np.array(taus, float), answers, sigma)
