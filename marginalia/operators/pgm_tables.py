"""A graphical model whose tables stay tables (E04, E05, E07): propagation and mirror descent for cliques of up to
``marginals.MOST_CELLS`` cells.

Potentials are factors. Messages of one level of the junction tree are made in one job and written as
one table (edge, cell, value); each is kept and serves both directions, so a clique is joined with its
separators' messages only and nothing is computed twice. Cells are bounded by disk, not by the driver,
which holds the tree and a scalar or two for each step.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.scalar import cell_of, code_in
from marginalia.operators.factor import Factor
from marginalia.operators.pgm import HALVINGS
from marginalia.plans.graph import JunctionTree
from marginalia.plans.schema import Clique, Domain, containing
from marginalia.storage import materialise

Potentials = dict[Clique, Factor]
FLOOR = 1e-9  # of the total, in cells that a warm start finds empty


def packed(factors: Mapping[int, Factor], name: str) -> DataFrame:
    """Several factors as one written table (part, cell, value)."""
    parts = [f.rows.select(F.lit(i).alias("part"), cell_of(f.domain.attrs, f.domain.strides()).cast("long").alias("cell"), "value") for i, f in factors.items()]
    return materialise(reduce(DataFrame.union, parts), name)


def unpacked(rows: DataFrame, part: int, domain: Domain) -> Factor:
    own = rows.filter(F.col("part") == part)
    return Factor(domain, own.select(*(code_in(F.col("cell"), s, n).alias(a) for a, s, n in zip(domain.attrs, domain.strides(), domain.shape, strict=True)), "value"))


def nearest_histograms(noisy: DataFrame, total: float) -> DataFrame:
    """(part, cell, value): for each part of (part, cell, y) the nearest counts, in squares, that are not negative and sum to
    ``total``. For one marginal this is where mirror descent ends, at once. A window covers a part's cells."""
    falling = Window.partitionBy("part").orderBy(F.desc("y"), "cell")
    ranked = noisy.withColumn("_k", F.row_number().over(falling)).withColumn("_over", (F.sum("y").over(falling.rowsBetween(Window.unboundedPreceding, 0)) - total) / F.col("_k"))
    kept = F.when(F.col("y") > F.col("_over"), F.struct("_k", "_over"))
    return ranked.withColumn("_cut", F.max(kept).over(Window.partitionBy("part"))["_over"]).select("part", "cell", F.greatest(F.col("y") - F.col("_cut"), F.lit(0.0)).alias("value"))


def plus(factor: Factor, messages: Sequence[Factor]) -> Factor:
    """A clique's potential with messages over its separators; the schema stays."""
    return reduce(lambda a, b: a + b, messages, factor).transpose(factor.domain.attrs)


def propagate(potentials: Potentials, tree: JunctionTree, total: float = 1.0) -> tuple[DataFrame, float]:
    """All clique marginals (part, cell, value), from a written table, in the order of ``tree.cliques``; and the log normaliser.

    Up from the leaves, then down from the first clique. A message is the clique's potential with all
    messages that come from the other side, so none is ever taken out.
    """
    domain, cliques = tree.domain, tree.cliques
    edges = tree.message_order[len(tree.edges) :]  # parent to child, from the root on
    depth, children, parent_of = {cliques[0]: 0}, {c: [] for c in cliques}, {}
    for parent, child in edges:
        depth[child] = depth[parent] + 1
        children[parent].append(child)
        parent_of[child] = parent
    number = {c: i for i, c in enumerate(cliques)}
    separator = {child: tree.separators[parent, child] for parent, child in edges}
    up: Potentials = {}
    down: Potentials = {}

    def written(level: list[Clique], message, into: Potentials, name: str) -> None:
        rows = packed({number[c]: message(c) for c in level}, name)
        into.update((c, unpacked(rows, number[c], domain.project(separator[c]))) for c in level)

    for d in range(max(depth.values()), 0, -1):
        level = [c for c in depth if depth[c] == d]
        written(level, lambda c: plus(potentials[c], [up[k] for k in children[c]]).project(separator[c], "logsumexp"), up, "model-up")
    for d in range(1, max(depth.values()) + 1):
        level = [c for c in depth if depth[c] == d]

        def from_parent(c: Clique) -> Factor:
            p = parent_of[c]
            beside = [up[k] for k in children[p] if k != c] + ([down[p]] if p in down else [])
            return plus(potentials[p], beside).project(separator[c], "logsumexp")

        written(level, from_parent, down, "model-down")
    whole = {c: plus(potentials[c], [up[k] for k in children[c]] + ([down[c]] if c in down else [])) for c in cliques}
    logs = packed({number[c]: f for c, f in whole.items()}, "model-marginals")
    log_z = unpacked(logs, 0, domain.project(cliques[0])).logsumexp().scalar()
    return logs.withColumn("value", F.exp(F.col("value") + (math.log(total) - log_z))), log_z


@dataclass
class TableInference:
    """E01-E05 on tables: mirror descent to noisy marginals (clique, rows of (cell, y), sigma).

    A step is halved until the loss falls enough, however large the total (where none serves the descent ends); ``lr`` None takes steps of 2 / total². Each step's
    potentials are written, so no plan grows, and its loss is one aggregate. ``warm`` begins with the measured cliques' own
    nearest histograms instead of a uniform model; where measurements agree that is the end already, so few steps are left.
    """

    domain: Domain
    iters: int = 100
    lr: float | None = 1.0
    tol: float = 1e-12
    order: Sequence[str] | None = None
    warm: bool = False
    losses: list[float] = field(default_factory=list)

    def estimate(self, spark: SparkSession, measured: Sequence[tuple[Sequence[str], DataFrame, float]], total: float) -> tuple[JunctionTree, DataFrame]:
        """The junction tree, and the fitted clique marginals (part, cell, value); those of a uniform model where nothing is measured."""
        tree = JunctionTree(self.domain, [c for c, _, _ in measured], self.order)
        answers = [self._answer(tree, c, rows, sigma) for c, rows, sigma in measured]
        start = {i: Factor.zeros(spark, self.domain.project(c)) for i, c in enumerate(tree.cliques)}
        if self.warm:
            start |= self._measured_potentials(tree, measured, total)
        theta = packed(start, "model-theta")
        mu, _ = propagate(self._potentials(tree, theta), tree, total)
        if not answers:
            return tree, mu
        grad, value = self._loss(tree, answers, mu)
        rate, self.losses = 2.0 / total**2 if self.lr is None else self.lr, [value]
        for _ in range(self.iters):
            if value <= self.tol:
                break
            step, fell = rate, self.lr is None
            for _ in range(HALVINGS):
                move = theta.join(grad.withColumnRenamed("value", "g"), ["part", "cell"], "left")
                trial = materialise(move.select("part", "cell", (F.col("value") - step * F.coalesce("g", F.lit(0.0))).alias("value")), "model-theta")
                nu, _ = propagate(self._potentials(tree, trial), tree, total)
                new_grad, new = self._loss(tree, answers, nu)
                if fell:
                    break
                gain = self._gain(grad, mu, nu)
                fell = value - new >= max(0.0, 0.5 * step * gain)
                if fell or gain <= self.tol * max(1.0, abs(value)):
                    break
                step /= 2
            if not fell:
                break
            settled = abs(value - new) <= self.tol * max(1.0, abs(value))
            theta, mu, grad, value = trial, nu, new_grad, new
            self.losses.append(value)
            rate = rate if self.lr is None else min(2 * step, 1e12)
            if settled:
                break
        return tree, mu

    def _measured_potentials(self, tree: JunctionTree, measured: Sequence[tuple[Sequence[str], DataFrame, float]], total: float) -> dict[int, Factor]:
        """For each clique that was measured as it is, the log of its nearest histogram, less that of the separator with the
        clique before it. Empty cells count ``FLOOR`` of the total, so that later steps can still raise them."""
        last = {frozenset(c): (tuple(c), rows) for c, rows, _ in measured}
        out, seen = {}, []
        for c in tree.preorder:
            before = next((p for p in tree.neighbors[c] if p in seen), None)
            seen.append(c)
            if frozenset(c) not in last:
                continue
            given, rows = last[frozenset(c)]
            found = nearest_histograms(rows.select(F.lit(0).alias("part"), "cell", "y"), total)
            own = unpacked(found, 0, self.domain.project(given)).transpose(c).map(lambda v: F.greatest(v, F.lit(FLOOR * total)))
            made = own.map(F.log)
            if before is not None:
                made = made - own.project(tree.separators[c, before]).map(F.log)
            out[tree.cliques.index(c)] = made.transpose(c)
        return out

    def _answer(self, tree: JunctionTree, clique: Sequence[str], rows: DataFrame, sigma: float) -> tuple[int, Domain, DataFrame, float]:
        home = containing(tree.cliques, tuple(clique), self.domain)  # J12
        return tree.cliques.index(home), self.domain.project(clique), rows.select("cell", "y"), float(sigma)

    def _potentials(self, tree: JunctionTree, theta: DataFrame) -> Potentials:
        return {c: unpacked(theta, i, self.domain.project(c)) for i, c in enumerate(tree.cliques)}

    def _loss(self, tree: JunctionTree, answers: list, mu: DataFrame) -> tuple[DataFrame, float]:
        """The gradient (part, cell, value), written, and half the squared errors in units of noise."""
        parts = []
        for part, own, rows, sigma in answers:
            whole = self.domain.project(tree.cliques[part])
            model = unpacked(mu, part, whole)
            seen = model.project(own.attrs)
            cell = cell_of(own.attrs, own.strides()).cast("long").alias("cell")
            miss = seen.rows.select(*own.attrs, cell, "value").join(rows, "cell").select(*own.attrs, ((F.col("value") - F.col("y")) / sigma).alias("miss"))
            at = cell_of(whole.attrs, whole.strides()).cast("long").alias("cell")
            squares = F.col("miss") * F.col("miss") / (2 * (whole.size() // own.size()))  # a cell of the answer is met once for each cell of the clique below it
            parts.append(model.rows.join(miss, list(own.attrs)).select(F.lit(part).alias("part"), at, (F.col("miss") / sigma).alias("value"), squares.alias("loss")))
        rows = reduce(DataFrame.union, parts).groupBy("part", "cell").agg(F.sum("value").alias("value"), F.sum("loss").alias("loss"))
        rows = materialise(rows, "model-gradient")
        return rows.drop("loss"), float(rows.agg(F.sum("loss")).first()[0] or 0.0)

    @staticmethod
    def _gain(grad: DataFrame, mu: DataFrame, nu: DataFrame) -> float:
        """How much the gradient promises for the move from ``mu`` to ``nu``."""
        moved = mu.withColumnRenamed("value", "a").join(nu.withColumnRenamed("value", "b"), ["part", "cell"])
        both = grad.join(moved, ["part", "cell"]).agg(F.sum(F.col("value") * (F.col("a") - F.col("b"))))
        return float(both.first()[0] or 0.0)
