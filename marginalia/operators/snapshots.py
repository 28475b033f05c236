"""What a plot of a particle run would show, as tables (X12): points over epochs and inverse distribution curves by direction."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.transport import projected
from marginalia.storage import numbered, shared_dir


@dataclass
class Snapshots:
    """Points of several epochs in one Parquet table, partitioned by epoch; only appended to.

    An epoch is to be added once: its rows appear when the job that writes them ends.
    """

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession) -> Snapshots:
        return cls(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")

    def add(self, points: DataFrame, epoch: int) -> None:
        """``points``: (pid, x_<attr>); other columns (moments) are left out."""
        coords = [c for c in points.columns if c.startswith("x_")]
        points.select("pid", *coords, F.lit(int(epoch)).alias("epoch")).write.mode("append").partitionBy("epoch").parquet(self.path)

    def rows(self, epochs: Sequence[int] | None = None) -> DataFrame:
        """All snapshots, or those of some epochs, of which alone the files are read then."""
        out = self.spark.read.parquet(self.path)
        return out if epochs is None else out.filter(F.col("epoch").isin([int(e) for e in epochs]))


def inverse_curves(points: DataFrame, coords: Sequence[str], thetas: Sequence[Sequence[float]], shares: Sequence[float], by: str = "epoch") -> DataFrame:
    """(by, proj, share, z): in each group and direction the point of rank floor(share * (n - 1)), counted from the least.

    Exact: points are ranked by ranges over all tasks, and the ranks wanted are met by an equi-join, so no curve is ever
    gathered, whatever its size. Groups without points have no curve; null coordinates are left out.
    """
    lines = projected(points, coords, thetas, keep=[by]).select(by, "proj", "z").filter("z is not null")
    ranked = numbered(lines, [F.col(by), F.col("proj"), F.col("z")], group=(by, "proj"), name="curves")
    sizes = ranked.groupBy(by, "proj").agg(F.count(F.lit(1)).alias("_n"))
    at = sizes.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("pos", F.floor(F.col("share") * (F.col("_n") - 1)))
    return at.join(ranked, [by, "proj", "pos"]).select(by, "proj", "share", "z")
