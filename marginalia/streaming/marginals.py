"""Marginals of a stream: counts by window and cell add up, so they are maintained incrementally.

Each released window is a table of its own; noise belongs on its dense cells, with a budget for each release.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scalar import cell_of, normal
from marginalia.operators.marginals import bucketed, dense
from marginalia.plans.schema import Domain


def windowed_marginals(stream: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], time: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, clique_id, cell, value) of coded rows; a row later than ``lateness`` is not counted. Works on tables too."""
    pairs = []
    for i, c in enumerate(cliques):
        part = domain.project(c)
        pairs.append(F.struct(F.lit(i).alias("clique_id"), cell_of(part.attrs, part.strides()).alias("cell")))
    rows = stream.withWatermark(time, lateness).select(F.window(time, window).alias("w"), *(bucketed(F.col(a), n).alias(a) for a, n in domain.config.items()))
    long = rows.select("w", F.explode(F.array(*pairs)).alias("p")).filter("p.cell is not null")
    return long.groupBy("w", "p.clique_id", "p.cell").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.col("w.start").alias("start"), "clique_id", "cell", "value")


def release(window_counts: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], sigma: float, seed: int) -> DataFrame:
    """A closed window's (clique_id, cell, value) with noise on every cell, empty ones too: (clique_id, cell, y)."""
    full = dense(window_counts.select("clique_id", "cell", "value"), domain, cliques)
    return full.select("clique_id", "cell", (F.col("value") + normal(sigma, seed, F.col("clique_id"), F.col("cell"))).alias("y"))
