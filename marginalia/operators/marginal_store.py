"""Answers of a workload left as a table (M05, M07, M08, N02): scores by joins, a private choice by noised maximum."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.scalar import code_in, gumbel
from marginalia.operators.marginals import KERNEL_CELLS, marginals_exploded, marginals_kernel
from marginalia.plans.schema import Clique, Domain
from marginalia.storage import shared_dir

ROOT_2_PI = math.sqrt(2 / math.pi)


@dataclass
class MarginalStore:
    """Exact non-empty cells (clique_id, cell, value) of ``cliques`` as a Parquet table partitioned by clique.

    They are private: only noised choices and answers may leave. Cells without rows are not stored, so a clique costs what the
    data fill of it, whatever its size; the driver holds names of cliques and one score for each.
    """

    spark: SparkSession
    domain: Domain
    cliques: list[Clique]
    path: str
    total: float

    @classmethod
    def of(cls, df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], weight: str | None = None, path: str | None = None) -> MarginalStore:
        """One scan. Arrays in tasks serve while all cells fit them (``KERNEL_CELLS``), sparse counting beyond."""
        cliques = [tuple(c) for c in dict.fromkeys(map(tuple, cliques))]
        count = marginals_kernel if sum(map(domain.size, cliques)) <= KERNEL_CELLS else marginals_exploded
        path = path or f"{shared_dir(df.sparkSession)}/marginals-{uuid.uuid4().hex}"
        # a clique's cells lie together, so a task writes to few folders; a clique of many cells may spread over several
        found = count(df, domain, cliques, weight).repartitionByRange("clique_id", "cell")
        found.write.partitionBy("clique_id").option("compression", "zstd").parquet(path)
        out = cls(df.sparkSession, domain, cliques, path, 0.0)
        total = out.rows().filter(F.col("clique_id") == 0).agg(F.sum("value")).first()[0]
        out.total = float(total or 0.0)
        return out

    def rows(self) -> DataFrame:
        return self.spark.read.schema("cell long, value double, clique_id int").parquet(self.path).select("clique_id", "cell", "value")

    def home(self, clique: Sequence[str]) -> int:
        """The stored clique of the fewest cells that holds ``clique``."""
        fits = [(self.domain.size(c), i) for i, c in enumerate(self.cliques) if set(clique) <= set(c)]
        if not fits:
            raise KeyError(tuple(clique))
        return min(fits)[1]

    def answers(self, wanted: Sequence[Sequence[str]]) -> DataFrame:
        """Non-empty cells (clique_id, cell, value) of other cliques, ids by place in ``wanted``, each summed out of its home.

        Only homes are read (their folders are the partitions), each once for all cliques taken from it.
        """
        by_home: dict[int, list[int]] = {}
        for k, c in enumerate(wanted):
            by_home.setdefault(self.home(c), []).append(k)
        parts = []
        for i, ks in by_home.items():
            codes, pairs = self._codes(i), []
            for k in ks:
                part = self.domain.project(tuple(wanted[k]))
                cell = sum((codes[a].cast("long") * s for a, s in zip(part.attrs, part.strides(), strict=True)), F.lit(0).cast("long"))
                pairs.append(F.struct(F.lit(k).alias("clique_id"), cell.alias("cell")))
            parts.append(self.rows().filter(F.col("clique_id") == i).select(F.explode(F.array(*pairs)).alias("p"), "value"))
        return reduce(DataFrame.union, parts).groupBy("p.clique_id", "p.cell").agg(F.sum("value").alias("value"))

    def _codes(self, i: int) -> dict:
        part = self.domain.project(self.cliques[i])
        return {a: code_in(F.col("cell"), s, n) for a, s, n in zip(part.attrs, part.strides(), part.shape, strict=True)}

    def independent(self) -> DataFrame:
        """The stored cells with ``model``, what they would be if attributes were independent: the state that the adaptive
        mechanisms begin with. Each attribute's own counts are summed out of the store and met by equi-joins, a place at a time."""
        singles = self.answers([(a,) for a in self.domain]).select(F.col("clique_id").alias("_attr"), F.col("cell").alias("_code"), F.col("value").alias("_count"))
        at = {a: k for k, a in enumerate(self.domain.attrs)}
        meta = self._meta([(i, [at[a] for a in p.attrs], list(p.strides()), list(p.shape)) for i, p in enumerate(map(self.domain.project, self.cliques))], "clique_id int, _at array<int>, _stride array<long>, _size array<long>")
        out = self.rows().join(F.broadcast(meta), "clique_id").withColumn("model", F.lit(self.total))
        for place in range(max(map(len, self.cliques))):
            code = F.pmod(F.floor(F.col("cell") / F.get("_stride", F.lit(place))), F.get("_size", F.lit(place)))
            keyed = out.withColumn("_own", F.get("_at", F.lit(place))).withColumn("_c", code)
            joined = keyed.join(singles, (F.col("_own") == F.col("_attr")) & (F.col("_c") == F.col("_code")), "left")
            share = F.when(F.col("_own").isNull(), 1.0).otherwise(F.coalesce("_count", F.lit(0.0)) / self.total)
            out = joined.withColumn("model", F.col("model") * share).drop("_own", "_c", "_attr", "_code", "_count")
        return out.select("clique_id", "cell", "value", "model")

    def _meta(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)  # a row a clique

    def gaps(self, cells: DataFrame) -> DataFrame:
        """(clique_id, gap): the L1 distance of each stored clique from a model that is known at the stored cells, ``cells`` with
        ``model``, and whose cells sum to the store's total. Where no rows are the distance is the model's own mass there, its
        total less its mass at stored cells, so empty cells need not be visited."""
        gap = F.sum(F.abs(F.col("value") - F.col("model")) - F.col("model")) + self.total
        every = self._meta([(i,) for i in range(len(self.cliques))], "clique_id int")
        return every.join(cells.groupBy("clique_id").agg(gap.alias("gap")), "clique_id", "left").select("clique_id", F.coalesce("gap", F.lit(self.total)).alias("gap"))

    def scores(self, cells: DataFrame, sigma: float, weights: Sequence[float] | None = None) -> DataFrame:
        """(clique_id, score): weight times (L1 distance less what noise of ``sigma`` alone would make)."""
        weights = weights or [1.0] * len(self.cliques)
        meta = self._meta([(i, float(w), float(self.domain.size(c))) for i, (c, w) in enumerate(zip(self.cliques, weights, strict=True))], "clique_id int, _w double, _n double")
        return self.gaps(cells).join(F.broadcast(meta), "clique_id").select("clique_id", (F.col("_w") * (F.col("gap") - F.lit(ROOT_2_PI * sigma) * F.col("_n"))).alias("score"))


def private_choice(scores: DataFrame, epsilon: float, sensitivity: float, seed: int) -> DataFrame:
    """N02 as one aggregate: the clique_id of the largest noised score, which is a draw of the exponential mechanism.

    Noise is keyed by (seed, clique_id), so a lost task redraws the same; each round needs a seed of its own, and a release an
    unpredictable one.
    """
    noised = F.col("score") * F.lit(0.5 * epsilon / sensitivity) + gumbel(seed, F.col("clique_id"))
    return scores.agg(F.max_by("clique_id", noised).alias("clique_id"))
