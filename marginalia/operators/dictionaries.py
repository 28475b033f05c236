"""Dictionaries of any size (D01, D06, S16, S17): stored tables of (value, code) that new rows extend without renumbering."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from marginalia.storage import numbered, shared_dir


@dataclass
class StoredDictionary:
    """Codes of a column's values in a Parquet table at ``path``; the driver never holds a value.

    Each extension appends the values not yet coded, in their order, after the greatest code: files are sorted by value, so a
    lookup of a range reads little, and a code never changes. Spark's commit makes an extension's files visible when its job ends;
    one that breaks off leaves at most some of its values coded, and the next takes the rest with further codes.
    One writer at a time. Null is no value: its code is null, as that of a value not in the dictionary.
    """

    spark: SparkSession
    path: str
    type: DataType

    @classmethod
    def create(cls, spark: SparkSession, type: DataType, path: str | None = None) -> StoredDictionary:
        """An empty one, by default below the shared folder; an existing path must be free."""
        out = cls(spark, path or f"{shared_dir(spark)}/dictionary-{uuid.uuid4().hex}", type)
        spark.createDataFrame([], out.schema).write.mode("errorifexists").parquet(out.path)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredDictionary:
        return cls(spark, path, spark.read.parquet(path).schema["value"].dataType)

    @property
    def schema(self) -> StructType:
        return StructType([StructField("value", self.type), StructField("code", LongType())])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def size(self) -> int:
        """The number of codes: one more than the greatest."""
        top = self.rows().agg(F.max("code")).first()[0]
        return 0 if top is None else top + 1

    def extend(self, values: DataFrame, column: str) -> int:
        """Code what ``column`` holds besides; the number of new values. Copies are dropped in the tasks before any exchange."""
        known, before = self.rows().select("value"), self.size()
        new = values.select(F.col(column).cast(self.type).alias("value")).filter("value is not null").distinct().join(known, "value", "left_anti")
        placed = numbered(new, [F.col("value")], name="new-values")
        placed.select("value", (F.col("pos") + before).alias("code")).sortWithinPartitions("value").write.mode("append").parquet(self.path)
        return self.size() - before

    def forward(self, df: DataFrame, column: str, into: str | None = None) -> DataFrame:
        """``df`` with the code of ``column`` in ``into`` (by default in its place).

        One dictionary row meets each key, so adaptive execution may split a value that very many rows hold.
        """
        return self._joined(df, column, into or column, F.col("value"), F.col("code"))

    def backward(self, df: DataFrame, column: str, into: str | None = None) -> DataFrame:
        """The values of codes; null for a code that was not given."""
        return self._joined(df, column, into or column, F.col("code"), F.col("value"))

    def _joined(self, df: DataFrame, column: str, into: str, key: Column, result: Column) -> DataFrame:
        table = self.rows().select(key.alias("_key"), result.alias("_result"))
        out = df.join(table, F.col(column) == F.col("_key"), "left")
        kept = [F.col("_result").alias(c) if c == into else F.col(c) for c in df.columns]
        return out.select(*kept, *([] if into in df.columns else [F.col("_result").alias(into)]))
