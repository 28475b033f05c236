"""Reading and writing coded tables, schemas, models' results and splits."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from marginalia.functions.scalar import uniform
from marginalia.operators.discretize import Coder, clean
from marginalia.plans.schema import Clique, Domain


@dataclass(frozen=True)
class Dataset:
    """A1: coded rows restricted to a schema, with a weight column (1 by default)."""

    df: DataFrame
    domain: Domain

    @classmethod
    def of(cls, df: DataFrame, domain: Domain, weight: str | None = None) -> Dataset:
        """Checks and projects. Columns beyond the schema go; a missing one is an error."""
        missing = [a for a in domain if a not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are missing")
        w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")
        return cls(df.select(*(F.col(a).alias(a, metadata={"size": n}) for a, n in domain.config.items()), w), domain)

    @classmethod
    def load(cls, spark: SparkSession, path: str, domain_path: str) -> Dataset:
        """CSV (with header) or Parquet, and a JSON object of attribute sizes, whose order is the schema's."""
        domain = read_domain(spark, domain_path)
        if path.rstrip("/").endswith(".parquet"):
            return cls.of(spark.read.parquet(path), domain)
        names = spark.read.text(path).first()[0].split(",")
        schema = StructType([StructField(c.strip('"'), IntegerType() if c.strip('"') in domain else DoubleType()) for c in names])
        return cls.of(spark.read.csv(path, header=True, schema=schema), domain)

    @classmethod
    def synthetic(cls, spark: SparkSession, domain: Domain, n: int, seed: int = 0) -> Dataset:
        """Uniform rows, the same for the same seed whatever the partitioning."""
        rows = spark.range(n).select(*(F.floor(uniform(seed, F.lit(a), F.col("id")) * k).cast("int").alias(a) for a, k in domain.config.items()))
        return cls.of(rows, domain)

    def project(self, attrs: Sequence[str]) -> Dataset:
        """Keeps the weights."""
        return Dataset(self.df.select(*attrs, "weight"), self.domain.project(attrs))

    def drop(self, attrs: Iterable[str]) -> Dataset:
        """P02."""
        return self.project(self.domain.invert(attrs))

    @property
    def records(self) -> int:
        """Number of rows, whatever their weight."""
        return self.df.count()

    def datavector(self, attrs: Clique | None = None) -> DataFrame:
        """G01."""
        from marginalia.operators.marginals import marginal

        return marginal(self.df, self.domain, attrs or self.domain.attrs, "weight")


def read_domain(spark: SparkSession, path: str) -> Domain:
    """The JSON may lie in any store that Spark reads."""
    return Domain.fromdict(json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_domain(spark: SparkSession, domain: Domain, path: str) -> None:
    write_text(spark, json.dumps(domain.config), path)


def write_synthetic(df: DataFrame, path: str, form: str = "csv") -> None:
    """S04."""
    (df.write.mode("overwrite").csv(path, header=True) if form == "csv" else df.write.mode("overwrite").parquet(path))


def append_result(spark: SparkSession, row: Mapping[str, object], path: str) -> None:
    """One row of parameters and metrics, appended."""
    names = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
    spark.createDataFrame([tuple(v if isinstance(v, float | bool | int | None) else str(v) for v in row.values())], names).write.mode("append").parquet(path)


def save_processed(spark: SparkSession, coded: DataFrame, original: DataFrame, coder: Coder, path: str) -> None:
    """Coded rows, original rows, sizes and codings, below ``path``."""
    coded.write.mode("overwrite").parquet(f"{path}/coded")
    original.write.mode("overwrite").parquet(f"{path}/original")
    write_domain(spark, coder.domain, f"{path}/domain")
    write_text(spark, json.dumps(coder.to_json()), f"{path}/coding")


def load_coder(spark: SparkSession, path: str) -> Coder:
    """S17."""
    return Coder.from_json(json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/coding", wholetext=True).collect())))


def split_column(keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> Column:
    """True for test rows. It depends on the row's keys alone, so every frame that has them splits alike."""
    return uniform(seed, *map(F.col, keys)) < test_share


def split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    test = split_column(keys, test_share, seed)
    return df.filter(~test), df.filter(test)


def fetch_and_prepare(spark: SparkSession, path: str, k: int, key: str, drop_first: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Coder]:
    """S09, S10 but for the download: read, clean, code with k bins, and split both forms alike.

    Returns coded train and test, original train and test, and the coder. Coding is fitted on all rows, as the split
    is only used for evaluation.
    """
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    raw = clean(raw, drop_first)
    test = split_column([key])
    marked = raw.withColumn("_test", test)
    coder = Coder.fit(raw.drop(key), k)
    out = [coder.forward(marked.filter(F.col("_test") == t)) for t in (False, True)]
    return out[0], out[1], marked.filter(~F.col("_test")).drop("_test"), marked.filter("_test").drop("_test"), coder


def eligible(catalogue: DataFrame, most_features: int = 25, least_rows: int = 30_000) -> DataFrame:
    """Entries (name, features, rows) of a catalogue that are neither too wide nor too short."""
    return catalogue.filter((F.col("features") <= most_features) & (F.col("rows") >= least_rows))
