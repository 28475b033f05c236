"""Histograms over discrete schemas (G01-G07, G15, G18-G20): one scan answers a whole workload."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.scalar import cell_of, code_in
from marginalia.plans.schema import Clique, Domain

#: Grids of more cells are refused: a dense answer would outgrow what it describes.
MOST_CELLS = 200_000_000
#: Cells all cliques together may have for the array kernel; a task then holds 8 bytes for each.
KERNEL_CELLS = 8_000_000
CELL_RUN = 1 << 16
#: Cells of the attributes that a workload uses, nulls as a code each, up to which equal rows are joined first.
JOINT_CELLS = 1 << 16


def bucketed(value: Column, n: int) -> Column:
    """Histogram codes: values floor, n itself falls into the last cell, others outside 0 .. n are null."""
    return F.when((value >= 0) & (value <= n), F.least(F.floor(value), F.lit(n - 1))).cast("int")


def grid(spark: SparkSession, domain: Domain) -> DataFrame:
    """every cell of a schema, as its codes and its row-major number ``cell``."""
    if domain.size() > MOST_CELLS:
        raise ValueError(f"{domain.size()} cells are too many for a dense grid")
    cells = spark.range(domain.size()).withColumnRenamed("id", "cell")
    return cells.select(*(code_in(F.col("cell"), s, n).alias(a) for a, s, n in zip(domain.attrs, domain.strides(), domain.shape, strict=True)), "cell")


def marginal(df: DataFrame, domain: Domain, attrs: Sequence[str], weight: str | None = None, dense: bool = True) -> DataFrame:
    """(attrs, value): the weighted count of each cell; ``dense``: cells without rows too, as 0."""
    part = domain.project(attrs)
    rows = df.select(*(bucketed(F.col(a), n).alias(a) for a, n in part.config.items()), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")).dropna(subset=list(part.attrs))
    found = rows.groupBy(*part.attrs).agg(F.sum("_w").alias("value"))
    if not dense:
        return found
    return grid(df.sparkSession, part).drop("cell").join(found, list(part.attrs), "left").select(*part.attrs, F.coalesce("value", F.lit(0.0)).alias("value"))


def marginals_exploded(df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], weight: str | None = None) -> DataFrame:
    """Sparse (clique_id, cell, value) of all cliques in one scan and one aggregation.

    Each row becomes one (clique, cell) pair per clique; partial sums collapse them before the shuffle.
    """
    pairs = []
    for i, c in enumerate(cliques):
        part = domain.project(c)
        pairs.append(F.struct(F.lit(i).alias("clique_id"), cell_of(part.attrs, part.strides()).alias("cell")))
    rows = df.select(*(bucketed(F.col(a), n).alias(a) for a, n in domain.config.items()), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    long = rows.select(F.explode(F.array(*pairs)).alias("p"), "_w").filter("p.cell is not null")
    return long.groupBy("p.clique_id", "p.cell").agg(F.sum("_w").alias("value"))


def marginals_kernel(df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], weight: str | None = None) -> DataFrame:
    """G02, fast path: each task adds its rows into dense arrays with ``bincount`` and emits its non-empty cells once.

    Unweighted rows of few possible kinds (``JOINT_CELLS``) are counted by kind instead, and never leave the JVM.
    """
    import numpy as np
    import pyarrow as pa

    from marginalia.shipping import ship

    parts = [domain.project(c) for c in cliques]
    total = sum(p.size() for p in parts)
    if total > KERNEL_CELLS:
        return marginals_exploded(df, domain, cliques, weight)
    used = [a for a in domain if any(a in p for p in parts)]
    if weight is None and math.prod(domain[a] + 1 for a in used) <= JOINT_CELLS:
        kinds = compress(df.select(*(bucketed(F.col(a), domain[a]).alias(a) for a in used)), used)
        return marginals_exploded(kinds, domain.project(used), cliques, "weight")
    ship(df.sparkSession)
    plan = [[(a, s) for a, s in zip(p.attrs, p.strides(), strict=True)] for p in parts]
    sizes = [p.size() for p in parts]
    rows = df.select(*(F.coalesce(bucketed(F.col(a), domain[a]), F.lit(-1)).alias(a) for a in used), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))

    def run(batches):
        sums = [np.zeros(n) for n in sizes]
        for b in batches:
            codes = {a: b.column(a).to_numpy() for a in used}
            w = b.column("_w").to_numpy()
            for total, terms, n in zip(sums, plan, sizes, strict=True):
                cell = sum(codes[a].astype(np.int64) * s for a, s in terms)
                ok = np.logical_and.reduce([codes[a] >= 0 for a, _ in terms])
                total += np.bincount(cell[ok], w[ok], n) if not ok.all() else np.bincount(cell, w, n)
        for i, total in enumerate(sums):
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(total[at])], names=["clique_id", "cell", "value"])

    partial = rows.mapInArrow(run, "clique_id int, cell long, value double")
    return partial.groupBy("clique_id", "cell").agg(F.sum("value").alias("value"))


def cells_of(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """(clique_id, n, cell) of all cells of all cliques. Cells are laid out in runs, so that a large clique spreads over tasks."""
    if sum(sizes) > MOST_CELLS:
        raise ValueError(f"{sum(sizes)} cells are too many for a dense answer")
    runs = [(i, n, a, min(a + CELL_RUN, n) - 1) for i, n in enumerate(sizes) for a in range(0, n, CELL_RUN)]
    rows = spark.createDataFrame(runs, "clique_id int, n long, a long, b long")
    return rows.select("clique_id", "n", F.explode(F.sequence("a", "b")).alias("cell"))


def dense(sparse: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]]) -> DataFrame:
    """All cells of all cliques: (clique_id, cell, value), absent ones 0. Noise must only be added after this."""
    every = cells_of(sparse.sparkSession, [domain.size(c) for c in cliques]).select("clique_id", "cell")
    return every.join(sparse, ["clique_id", "cell"], "left").select("clique_id", "cell", F.coalesce("value", F.lit(0.0)).alias("value"))


def grouping_sets(df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]]) -> DataFrame:
    """Sparse counts as SQL grouping sets: attributes outside a set are null, ``gid`` names the set."""
    rows = df.select(*(bucketed(F.col(a), n).alias(a) for a, n in domain.config.items())).dropna()
    return rows.groupingSets([[F.col(a) for a in c] for c in cliques], *map(F.col, domain.attrs)).agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n")).select("gid", *domain.attrs, "n")


def cube(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Counts of every non-empty subset of ``attrs``."""
    return df.cube(*attrs).agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n")).filter(F.col("gid") < 2 ** len(attrs) - 1).select("gid", *attrs, "n")


def compress(df: DataFrame, attrs: Sequence[str], weight: str | None = None) -> DataFrame:
    """Equal rows as one, with their summed weight."""
    return df.groupBy(*attrs).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("weight"))


def distinct_codes(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Number of distinct values of each attribute."""
    return df.agg(*(F.count_distinct(a).alias(a) for a in attrs))


def rescaled_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights that sum to less than 1.5 are probabilities: they are multiplied by the number of rows."""
    total = df.agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    factor = F.when(F.col("_sum") < 1.5, F.col("_rows")).otherwise(1)
    return df.crossJoin(F.broadcast(total)).withColumn(weight, F.col(weight) * factor).drop("_sum", "_rows")


class MarginalCache:
    """Exact answers of a workload, computed in one job and held on the driver (they are private; only noise leaves).

    Their total size is checked; a clique inside a measured one is answered by summing it.
    """

    def __init__(self, df: DataFrame, domain: Domain, cliques: Iterable[Sequence[str]], weight: str | None = None, most_cells: int = KERNEL_CELLS) -> None:
        import numpy as np

        self.domain, self.cliques = domain, [tuple(c) for c in dict.fromkeys(map(tuple, cliques))]
        sizes = [domain.size(c) for c in self.cliques]
        if sum(sizes) > most_cells:
            raise ValueError(f"{sum(sizes)} cells exceed the bound of {most_cells}")
        self.answers = {c: np.zeros(n) for c, n in zip(self.cliques, sizes, strict=True)}
        got = marginals_kernel(df, domain, self.cliques, weight).toPandas()
        for i, part in got.groupby("clique_id"):
            self.answers[self.cliques[i]][part["cell"].to_numpy()] = part["value"].to_numpy()

    def __getitem__(self, clique: Sequence[str]):
        import numpy as np

        clique = tuple(clique)
        if clique in self.answers:
            return self.answers[clique]
        for c in self.cliques:
            if set(clique) <= set(c):
                table = self.answers[c].reshape(self.domain.project(c).shape)
                left = [a for a in c if a in clique]
                table = table.sum(axis=tuple(i for i, a in enumerate(c) if a not in clique))
                return np.transpose(table, [left.index(a) for a in clique]).ravel()
        raise KeyError(clique)

    def total(self) -> float:
        return float(self.answers[self.cliques[0]].sum())


def clique_names(cliques: Sequence[Clique]) -> list[str]:
    return ["|".join(c) for c in cliques]
