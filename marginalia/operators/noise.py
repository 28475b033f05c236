"""Noise on dense answers and private selection.

Noise is keyed by (seed, clique, cell), so a run repeats whatever the partitioning; a real
release needs a secret, unpredictable seed. It is only added to dense answers: a cell
without rows needs noise as much as any.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scalar import laplace, normal, softmax
from marginalia.operators.marginals import MarginalCache, dense, marginals_kernel
from marginalia.operators.pgm import Measurement
from marginalia.plans.schema import Clique, Domain


def with_gaussian_noise(answers: DataFrame, sigma: float | str, seed: int) -> DataFrame:
    """(clique_id, cell, value) with y, the value plus normal noise; ``sigma`` is a number or a column's name."""
    s = F.col(sigma) if isinstance(sigma, str) else F.lit(float(sigma))
    return answers.withColumn("y", F.col("value") + normal(s, seed, F.col("clique_id"), F.col("cell"))).withColumn("sigma", s)


def with_laplace_noise(answers: DataFrame, b: float, seed: int) -> DataFrame:
    """N06."""
    return answers.withColumn("y", F.col("value") + laplace(b, seed, F.col("clique_id"), F.col("cell"))).withColumn("sigma", F.lit(float(b)))


def selection_probabilities(scores: DataFrame, epsilon: float, sensitivity: float, base: str | None = None) -> DataFrame:
    """(candidate, score) with p, the exponential mechanism's probability of each candidate. Candidates are few."""
    return scores.withColumn("p", softmax(F.col("score"), 0.5 * epsilon / sensitivity, F.col(base) if base else None))


def exponential_mechanism(rng: np.random.Generator, scores: dict, epsilon: float, sensitivity: float, base: dict | None = None):
    """N02 on the driver: one key of ``scores``."""
    keys = list(scores)
    z = 0.5 * epsilon / sensitivity * np.array([scores[k] for k in keys], float)
    if base is not None:
        with np.errstate(divide="ignore"):
            z = z + np.log([base[k] for k in keys])
    p = np.exp(z - z.max())
    return keys[int(rng.choice(len(keys), p=p / p.sum()))]


def measure_rows(df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], sigmas: Sequence[float], seed: int) -> DataFrame:
    """N08 as one lazy plan: (clique_id, cell, y, sigma) of all cliques: one scan, dense cells, then noise."""
    answers = dense(marginals_kernel(df, domain, cliques), domain, cliques)
    s = F.get(F.array(*(F.lit(float(x)) for x in sigmas)), F.col("clique_id"))
    return with_gaussian_noise(answers.withColumn("sigma", s), "sigma", seed).select("clique_id", "cell", "y", "sigma")


def measure(cache: MarginalCache, cliques: Sequence[Clique], sigma: float, rng: np.random.Generator, weights: Sequence[float] | None = None) -> list[Measurement]:
    """Noisy answers with deviation sigma / weight, weights scaled to unit L2 norm (equal by default)."""
    w = np.ones(len(cliques)) if weights is None else np.array(weights, float)
    w = w / np.linalg.norm(w)
    out = []
    for c, wi in zip(cliques, w, strict=True):
        x = cache[c]
        out.append(Measurement(tuple(c), x + rng.normal(0, sigma / wi, len(x)), sigma / wi))
    return out


def measure_noisy_marginals(df: DataFrame, domain: Domain, epsilon: float, delta: float, workload: Sequence[Clique], seed: int = 0) -> list[Measurement]:
    """All marginals of a workload under one Gaussian budget."""
    from marginalia.plans.privacy import gaussian_mech

    sigma = gaussian_mech(epsilon, delta) * np.sqrt(len(workload)) * np.sqrt(2)
    cache, rng = MarginalCache(df, domain, workload), np.random.default_rng(seed)
    return [Measurement(tuple(c), (x := cache[c]) + rng.normal(0, sigma, len(x)), float(sigma)) for c in workload]
