"""Mechanisms (M01-M11): which marginals to measure, under a privacy budget, and the synthetic rows made of them.

Exact answers are private: they stay in a ``MarginalCache`` on the driver (one job answers a
whole workload), and only noisy ones reach an engine. With a ``TableInference`` as engine they stay in a
``MarginalStore``, and measurements and models are tables too (``TableAnswers``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.marginals import MarginalCache
from marginalia.operators.noise import exponential_mechanism
from marginalia.operators.particles import ParticleInference
from marginalia.operators.pgm import FactoredInference, GraphicalModel, Measurement
from marginalia.operators.pgm_tables import TableInference
from marginalia.operators.table_answers import TableAnswers
from marginalia.plans.graph import DisjointSets, JunctionTree
from marginalia.plans.privacy import Budget, gaussian_mech
from marginalia.plans.schema import Clique, Domain, workload_scores

ROOT_2_PI = math.sqrt(2 / math.pi)  # the mean absolute value of a standard normal number


class Mechanism(Protocol):
    """Coded rows and a workload in, synthetic rows out."""

    def run(self, df: DataFrame, domain: Domain, engine, workload: Sequence[Clique], records: int | None = None) -> DataFrame: ...


def _estimate(spark: SparkSession, engine, measured: Sequence[Measurement], total: float | None):
    return engine.estimate(spark, measured, total) if isinstance(engine, ParticleInference) else engine.estimate(measured, total)


class ArrayAnswers:
    """What a mechanism asks of the data and of its model, in arrays on the driver."""

    def __init__(self, df: DataFrame, domain: Domain, cliques: Sequence[Clique], engine, rng: np.random.Generator) -> None:
        self.spark, self.domain, self.engine, self.rng = df.sparkSession, domain, engine, rng
        self.cache = MarginalCache(df, domain, cliques)
        self.measured: list[Measurement] = []
        self.model: GraphicalModel | None = None

    def total(self) -> float:
        return self.cache.total()

    def measure(self, cliques: Sequence[Clique], sigma: float) -> None:
        for c in cliques:
            x = self.cache[c]
            self.measured.append(Measurement(tuple(c), x + self.rng.normal(0, sigma, len(x)), sigma))

    def fit(self, total: float | None):
        self.model = _estimate(self.spark, self.engine, self.measured, total)
        return self.model

    def fit_singles(self, total: float | None, iters: int) -> GraphicalModel:
        self.model = FactoredInference(self.domain, iters=iters).estimate(self.measured, total)
        return self.model

    def gaps(self, cliques: Sequence[Clique]) -> dict[Clique, float]:
        """The L1 distance of each clique's exact answer from the model's."""
        return {c: float(np.abs(self.cache[c] - self.model.project(c).ravel()).sum()) for c in cliques}

    def moved(self, before: GraphicalModel, clique: Clique) -> float:
        return float(np.abs(self.model.project(clique).ravel() - before.project(clique).ravel()).sum())


def _answers(df: DataFrame, domain: Domain, cliques: Sequence[Clique], engine, budget: Budget, rng: np.random.Generator) -> ArrayAnswers | TableAnswers:
    """The engine tells where answers are kept."""
    if isinstance(engine, TableInference):
        return TableAnswers(df, domain, cliques, engine, budget.seed)
    return ArrayAnswers(df, domain, cliques, engine, rng)


def _total(budget: Budget, held: ArrayAnswers | TableAnswers) -> float | None:
    """The number of rows is public only where neighbours have equally many."""
    return held.total() if budget.bounded else None


def model_megabytes(domain: Domain, cliques: Iterable[Sequence[str]]) -> float:
    """Size of the junction tree over ``cliques``, 8 bytes a cell."""
    return JunctionTree(domain, cliques).size() * 8 / 2**20


def filter_candidates(candidates: dict[Clique, float], model: GraphicalModel, size_limit: float) -> dict[Clique, float]:
    """Candidates that the model already covers, or that keep it within ``size_limit`` megabytes."""
    covered = lambda c: any(set(c) <= set(m) for m in model.cliques)
    return {c: s for c, s in candidates.items() if covered(c) or model_megabytes(model.domain, [*model.cliques, c]) <= size_limit}


@dataclass
class KWay:
    """Every marginal of the workload with equal noise."""

    budget: Budget

    def run(self, df: DataFrame, domain: Domain, engine, workload: Sequence[Clique], records: int | None = None) -> DataFrame:
        sigma = gaussian_mech(self.budget.epsilon, self.budget.delta) * math.sqrt(len(workload)) * self.budget.marginal_sensitivity
        held = _answers(df, domain, workload, engine, self.budget, np.random.default_rng(self.budget.seed))
        held.measure(workload, sigma)
        self.model = held.fit(_total(self.budget, held))
        return self.model.synthetic(df.sparkSession, records)


@dataclass
class MST:
    """All single attributes, then pairs along a tree that was chosen privately."""

    budget: Budget
    selection_iters: int = 3000

    def run(self, df: DataFrame, domain: Domain, engine, workload: Sequence[Clique] = (), records: int | None = None) -> DataFrame:
        spark, rng = df.sparkSession, np.random.default_rng(self.budget.seed)
        sigma = math.sqrt(3 / (2 * self.budget.rho)) * self.budget.marginal_sensitivity
        singles, pairs = [(a,) for a in domain], list(combinations(domain.attrs, 2))
        held = _answers(df, domain, singles + pairs, engine, self.budget, rng)
        total = _total(self.budget, held)
        held.measure(singles, sigma * math.sqrt(len(singles)))
        held.fit_singles(total, *(() if isinstance(held, TableAnswers) else (self.selection_iters,)))
        self.tree = self.select(held.gaps(pairs), domain, rng)
        if self.tree:
            held.measure(self.tree, sigma * math.sqrt(len(self.tree)))
        self.model = held.fit(total)
        return self.model.synthetic(spark, records)

    def select(self, weight: dict[Clique, float], domain: Domain, rng: np.random.Generator, given: Sequence[Clique] = ()) -> list[Clique]:
        """A spanning tree, one edge at a time, by the exponential mechanism on ``weight``, how far the model is off."""
        sets, chosen = DisjointSets(), [tuple(e) for e in given]
        for a, b in chosen:
            sets.union(a, b)
        parts = len({sets.find(a) for a in domain})
        epsilon = math.sqrt(8 * (self.budget.rho / 3) / max(1, parts - 1))
        for _ in range(parts - 1):
            open_ = {p: w for p, w in weight.items() if not sets.connected(*p)}
            pick = exponential_mechanism(rng, open_, epsilon, self.budget.sensitivity)
            sets.union(*pick)
            chosen.append(pick)
        return chosen


@dataclass
class MWEM:
    """Rounds of picking the worst-approximated marginal and measuring it."""

    budget: Budget
    rounds: int = 100
    max_model_mb: float = 25.0

    def run(self, df: DataFrame, domain: Domain, engine: FactoredInference, workload: Sequence[Clique], records: int | None = None, alpha: float = 0.9) -> DataFrame:
        spark, rng = df.sparkSession, np.random.default_rng(self.budget.seed)
        workload = [tuple(w) for w in workload]
        held = _answers(df, domain, workload, engine, self.budget, rng)
        rounds = min(self.rounds, len(workload))
        total, left, taken = _total(self.budget, held), list(workload), []
        held.fit(total)
        if rounds:
            rho = self.budget.rho / rounds
            sigma, epsilon = math.sqrt(0.5 / (alpha * rho)) * self.budget.marginal_sensitivity, math.sqrt(8 * (1 - alpha) * rho)
        for i in range(1, rounds + 1):
            fits = [c for c in left if model_megabytes(domain, [*taken, c]) <= self.max_model_mb * i / rounds]
            if not fits:
                break  # nothing that fits is left; the rest of the budget stays unspent
            pick = exponential_mechanism(rng, self.scores(held.gaps(fits), domain), epsilon, self.budget.sensitivity)
            left.remove(pick)
            taken.append(pick)
            held.measure([pick], sigma)
            held.fit(total)
        self.model, self.measured = held.model, held.measured
        return self.model.synthetic(spark, records)

    @staticmethod
    def scores(gaps: dict[Clique, float], domain: Domain) -> dict[Clique, float]:
        """L1 error less the number of cells."""
        return {c: gap - domain.size(c) for c, gap in gaps.items()}


@dataclass
class AIM:
    """Adaptive rounds; noise halves where a round moved the model less than noise alone would."""

    budget: Budget
    rounds: int | None = None
    max_model_mb: float = 80.0
    structural_zeros: dict = field(default_factory=dict)

    def run(self, df: DataFrame, domain: Domain, engine: FactoredInference, workload: Sequence[Clique], records: int | None = None) -> DataFrame:
        spark, rng = df.sparkSession, np.random.default_rng(self.budget.seed)
        candidates = workload_scores(workload)
        singles = [(a,) for a in domain]
        held = _answers(df, domain, [*candidates, *singles], engine, self.budget, rng)
        rho, scale = self.budget.rho, self.budget.marginal_sensitivity
        rounds = self.rounds or 16 * len(domain)
        if rounds < 0.9 * len(domain):
            raise ValueError("single attributes alone take 0.9 rounds each: ask for more rounds")
        if self.structural_zeros:
            if isinstance(held, TableAnswers):
                raise ValueError("the engine on tables has no structural zeros")
            engine.structural_zeros = {**engine.structural_zeros, **self.structural_zeros}
        sigma, epsilon = math.sqrt(rounds / (1.8 * rho)), math.sqrt(0.8 * rho / rounds)  # sigma: per unit of sensitivity
        total, used, done = _total(self.budget, held), len(singles) * 0.5 / sigma**2, False
        held.measure(singles, sigma * scale)
        model = held.fit(total)
        self.spent = used
        while not done:
            if rho - used < 2 * (0.5 / sigma**2 + epsilon**2 / 8):
                rest = rho - used
                if rest <= 0:
                    break
                sigma, epsilon, done = math.sqrt(1 / (1.8 * rest)), math.sqrt(0.8 * rest), True
            fits = filter_candidates(candidates, model, self.max_model_mb * min(1.0, used / rho))
            if not fits:
                break
            pick = self.worst(held.gaps(list(fits)), domain, fits, epsilon, sigma * scale, rng)
            held.measure([pick], sigma * scale)
            used += 0.5 / sigma**2 + epsilon**2 / 8
            before, model = model, held.fit(total)
            if held.moved(before, pick) <= sigma * scale * ROOT_2_PI * domain.size(pick):
                sigma, epsilon = sigma / 2, epsilon * 2
        if used > rho * (1 + 1e-9):
            raise AssertionError("the rounds took more than the budget")
        self.model, self.measured, self.spent = model, held.measured, used
        return model.synthetic(spark, records)

    def worst(self, gaps: dict[Clique, float], domain: Domain, candidates: dict[Clique, float], epsilon: float, sigma: float, rng: np.random.Generator) -> Clique:
        """Weight times (L1 error less what noise alone would make)."""
        scores = {c: w * (gaps[c] - ROOT_2_PI * sigma * domain.size(c)) for c, w in candidates.items()}
        return exponential_mechanism(rng, scores, epsilon, max(candidates.values()) * self.budget.sensitivity)


# --- the scores as plans -----------------------------------------------------------------------------------------------


def pair_gaps(df: DataFrame, domain: Domain) -> DataFrame:
    """M06 in one job: for each pair of attributes (clique_id, gap), the L1 distance of the joint counts from the product of
    the single ones over N."""
    from marginalia.operators.marginals import marginals_kernel

    pairs, n = list(combinations(domain.attrs, 2)), len(domain)
    found = marginals_kernel(df, domain, [(a,) for a in domain] + pairs)
    singles = found.filter(F.col("clique_id") < n)
    joint = found.filter(F.col("clique_id") >= n).withColumn("clique_id", F.col("clique_id") - n)
    meta = df.sparkSession.createDataFrame([(i, domain.attrs.index(a), domain.attrs.index(b), domain[b]) for i, (a, b) in enumerate(pairs)], "clique_id int, _a int, _b int, _n long")
    left = singles.select(F.col("clique_id").alias("_a"), F.col("cell").alias("_i"), F.col("value").alias("_x"))
    right = singles.select(F.col("clique_id").alias("_b"), F.col("cell").alias("_j"), F.col("value").alias("_y"), F.sum("value").over(Window.partitionBy("clique_id")).alias("_total"))
    every = F.broadcast(meta).join(left, "_a").join(right, "_b").withColumn("cell", F.col("_i") * F.col("_n") + F.col("_j"))
    gap = F.abs(F.coalesce("value", F.lit(0.0)) - F.col("_x") * F.col("_y") / F.col("_total"))
    return every.join(joint, ["clique_id", "cell"], "left").groupBy("clique_id").agg(F.sum(gap).alias("gap"))
