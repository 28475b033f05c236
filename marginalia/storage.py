"""Tables in shared storage: intermediate results that survive a lost executor, and places in an order over all tasks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_ROWS = 100_000  # of a written table of narrow rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder serves only where that is unset and all tasks run in the driver's process, as in tests.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; executors need a shared folder")
        at = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="marginalia-"))
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of an executor, unlike a cache. ``rows``: about how many rows to expect at
    most. Partitions are then joined to files of up to ``FILE_ROWS`` rows, though never to fewer than keep all cores
    busy, so a small table behind a shuffle into many partitions does not cost a file for each.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PART_ROWS = 1 << 33  # a task numbers its rows from a multiple of this


def numbered(df: DataFrame, order: list[Column], group: tuple[str, ...] = (), name: str = "numbered") -> DataFrame:
    """``df`` and pos (long): each row's place in its ``group``, from 0, in the order of ``order``.

    ``order`` begins with the columns of ``group``. Rows are dealt to tasks by ranges of the order and sorted there; where a
    range begins in its group follows from counts by task, so no group is ever in one task, however large. Rows equal
    in all of ``order`` are told apart by where they were read. The table is written once, since places must not change.
    """
    read = F.monotonically_increasing_id().alias("_read")
    ranged = df.select("*", read).repartitionByRange(*order, "_read").sortWithinPartitions(*order, "_read").drop("_read")
    rows = materialise(ranged.withColumn("_place", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.floor(F.col("_place") / PART_ROWS)).withColumn("_row", F.col("_place") % PART_ROWS).drop("_place")
    keys = [*group, "_part"]
    ranges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")  # a row for each task that has rows of the group
    ranges = ranges.select(*(F.col(c).alias(f"_of{i}") for i, c in enumerate(keys)), (before - F.col("_first")).alias("_shift"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(keys)))
    return rows.join(ranges, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias("pos"))
