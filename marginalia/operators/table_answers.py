"""The mechanisms' state for workloads and models of any size (M02, M03, M05, M07, J16, E11): exact answers in a
``MarginalStore``, noisy ones and the fitted model as written tables.

The driver holds names of cliques, the junction tree and one score for each candidate. Exact answers are private: what
leaves the store is noised cells, and scores that only the exponential mechanism may see.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.scalar import cell_of
from marginalia.operators.factor import Factor, eliminate
from marginalia.operators.marginal_store import MarginalStore
from marginalia.operators.marginals import MOST_CELLS, dense
from marginalia.operators.noise import with_gaussian_noise
from marginalia.operators.pgm import draw_column, total_from_rows
from marginalia.operators.pgm_tables import TableInference, nearest_histograms, packed, unpacked
from marginalia.plans.graph import JunctionTree, elimination_order
from marginalia.plans.schema import Clique, Domain, containing
from marginalia.storage import materialise


@dataclass
class TableModel:
    """A calibrated junction tree; ``rows`` (part, cell, value) are the marginals of ``tree.cliques`` and sum to ``total`` each."""

    domain: Domain
    tree: JunctionTree
    rows: DataFrame
    total: float

    @property
    def cliques(self) -> list[Clique]:
        return self.tree.cliques

    def factor(self, clique: Clique) -> Factor:
        return unpacked(self.rows, self.cliques.index(clique), self.domain.project(clique))

    def marginal(self, attrs: Sequence[str]) -> Factor:
        """Out of a clique that holds ``attrs``, else along the least subtree that does: each clique of it given
        its separator, other attributes summed out as soon as nothing needs them."""
        attrs = tuple(attrs)
        if self.domain.size(attrs) > MOST_CELLS:
            raise ValueError("the marginal has too many cells")
        if home := containing(self.cliques, attrs, self.domain):
            return self.factor(home).project(attrs)
        left = {c: set(n) for c, n in self.tree.neighbors.items()}
        while spare := next((c for c, n in left.items() if len(n) == 1 and set(c) & set(attrs) <= set(next(iter(n)))), None):
            left[left.pop(spare).pop()].discard(spare)  # a leaf that tells nothing about attrs
        first, *rest = [c for c in self.tree.preorder if c in left]
        factors, seen = [self.factor(first)], {first}
        for c in rest:
            parent = next(p for p in left[c] if p in seen)
            own = self.factor(c)
            factors.append(own / own.project(self.tree.separators[c, parent]))
            seen.add(c)
        gone = {a for f in factors for a in f.domain} - set(attrs)
        order = [a for a in elimination_order(self.domain, [f.domain.attrs for f in factors] + [attrs], self.domain.invert(attrs)) if a in gone]
        return eliminate(factors, order).transpose(attrs)

    def answers(self, cliques: Sequence[Clique]) -> DataFrame:
        """(clique_id, cell, model) of several marginals, from a written table; ids by place."""
        if sum(map(self.domain.size, cliques)) > MOST_CELLS:
            raise ValueError("the marginals have too many cells")
        made = packed({i: self.marginal(c) for i, c in enumerate(cliques)}, "model-answers")
        return made.select(F.col("part").alias("clique_id"), "cell", F.col("value").alias("model"))

    def synthetic(self, spark: SparkSession, rows: int | None = None, method: str = "round", seed: int = 0) -> DataFrame:
        """As the arrays' model draws them, a column at a time; the conditional shares are joined as tables."""
        n = int(round(self.total)) if rows is None else int(rows)
        out, used = spark.range(n).withColumnRenamed("id", "_row"), []
        for attr in reversed(self.tree.order):
            near = {a for c in self.cliques if attr in c for a in c}
            parents = tuple(a for a in used if a in near)
            strides = self.domain.project(parents).strides()
            table = self.marginal((*parents, attr)).rows
            given = sum((F.col(a).cast("long") * s for a, s in zip(parents, strides, strict=True)), F.lit(0).cast("long"))
            # shares are cumulated within each parents' cell; an array holds one attribute's codes
            within = Window.partitionBy("_given")
            cells = table.select(given.alias("_given"), F.col(attr).alias("code"), F.greatest("value", F.lit(0.0)).alias("value")).withColumn("mass", F.sum("value").over(within))
            upto = F.when(F.col("mass") > 0, F.sum("value").over(within.orderBy("code")) / F.col("mass")).otherwise((F.col("code") + 1) / self.domain[attr])
            pairs = cells.select("_given", F.struct("code", upto.alias("upto")).alias("pair")).groupBy("_given").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
            shares = pairs.select("_given", F.transform("pairs", lambda p: p["upto"]).alias("_upto"))
            out = draw_column(out, attr, self.domain[attr], given, shares, method, seed, n)
            used.append(attr)
        return out.select(*self.domain.attrs)


class TableAnswers:
    """What a mechanism asks of the data and of its model. A measurement's noise is keyed by its own number, so no two share
    noise, and it is written once, so a lost executor does not draw again."""

    def __init__(self, df: DataFrame, domain: Domain, cliques: Sequence[Clique], engine: TableInference, seed: int) -> None:
        self.spark, self.domain, self.engine, self.seed = df.sparkSession, domain, engine, seed
        every = list(dict.fromkeys(map(tuple, cliques)))
        self.store = MarginalStore.of(df, domain, [c for c in every if not any(set(c) < set(o) for o in every)])
        self.measured: list[tuple[Clique, DataFrame, float]] = []
        self.model: TableModel | None = None

    def total(self) -> float:
        return self.store.total

    def measure(self, cliques: Sequence[Clique], sigma: float) -> None:
        """Every cell of ``cliques`` with noise of ``sigma``."""
        first = len(self.measured)
        exact = dense(self.store.answers(cliques), self.domain, cliques).withColumn("clique_id", F.col("clique_id") + first)
        noisy = materialise(with_gaussian_noise(exact, sigma, self.seed).select("clique_id", "cell", "y"), "measured")
        self.measured += [(tuple(c), noisy.filter(F.col("clique_id") == first + i).select("cell", "y"), float(sigma)) for i, c in enumerate(cliques)]

    def _total(self, total: float | None) -> float:
        """A public number of rows, else what the measurements imply."""
        if total is not None:
            return float(total)
        if not self.measured:
            return 1.0
        rows = reduce(DataFrame.union, (r.select(F.lit(i).alias("clique_id"), "cell", "y", F.lit(s).alias("sigma")) for i, (_, r, s) in enumerate(self.measured)))
        return float(total_from_rows(rows).first()[0])

    def fit(self, total: float | None) -> TableModel:
        n = self._total(total)
        tree, rows = self.engine.estimate(self.spark, self.measured, n)
        self.model = TableModel(self.domain, tree, rows, n)
        return self.model

    def fit_singles(self, total: float | None) -> TableModel:
        """The model of the measured single attributes, each of them measured once."""
        n = self._total(total)
        tree = JunctionTree(self.domain, [c for c, _, _ in self.measured])
        noisy = reduce(DataFrame.union, (r.select(F.lit(tree.cliques.index(c)).alias("part"), "cell", "y") for c, r, _ in self.measured))
        self.model = TableModel(self.domain, tree, materialise(nearest_histograms(noisy, n), "model-singles"), n)
        return self.model

    def gaps(self, cliques: Sequence[Clique]) -> dict[Clique, float]:
        """The L1 distance of each clique's exact answer from the model's. Only stored cells are joined: where no rows are, the
        distance is the model's mass there, its total less its mass at stored cells."""
        exact = self.store.answers(cliques).join(self.model.answers(cliques), ["clique_id", "cell"], "left")
        off = F.sum(F.abs(F.col("value") - F.coalesce("model", F.lit(0.0))) - F.coalesce("model", F.lit(0.0)))
        found = {r["clique_id"]: r["off"] for r in exact.groupBy("clique_id").agg(off.alias("off")).collect()}  # a row a candidate
        return {c: self.model.total + found.get(i, 0.0) for i, c in enumerate(cliques)}

    def moved(self, before: TableModel, clique: Clique) -> float:
        """The L1 distance between two models' marginals."""
        at = cell_of(clique, self.domain.project(clique).strides()).cast("long").alias("cell")
        old, new = (m.marginal(clique).rows.select(at, F.col("value").alias(n)) for m, n in ((before, "old"), (self.model, "new")))
        return float(old.join(new, "cell", "full").agg(F.sum(F.abs(F.coalesce("old", F.lit(0.0)) - F.coalesce("new", F.lit(0.0))))).first()[0] or 0.0)
