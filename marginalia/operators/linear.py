"""Linear queries on contingency vectors (L01-L28), as coordinate rows (row, cell, coef).

A ``Query`` is lazy: composition builds plans (unions with offsets, joins), and a product
with a vector is a join on the cell and a group-by. Identity and all-ones queries, scalars
and Kronecker products are kept symbolic, so that they cost no join or one per attribute.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that ``dense`` brings to the driver.
DENSE_ENTRIES = 25_000_000
SENT_ENTRIES = 1_000_000  # of a matrix that is broadcast


class Query(ABC):
    """A matrix of ``shape`` (rows, cells)."""

    shape: tuple[int, int]
    ndim = 2

    @abstractmethod
    def coo(self, spark: SparkSession) -> DataFrame:
        """Its non-zero entries (row, cell, coef), each place once."""

    # --- products -----------------------------------------------------------------------------------------------------

    def apply(self, vector: DataFrame) -> DataFrame:
        """(row, value) from (cell, value). Rows without an entry are absent (0)."""
        joined = self.coo(vector.sparkSession).join(vector, "cell")
        return joined.groupBy("row").agg(F.sum(F.col("coef") * F.col("value")).alias("value"))

    @property
    def T(self) -> Query:
        """L16."""
        return Transposed(self)

    def gram(self) -> Query:
        """Its transpose times itself."""
        return Product(self.T, self)

    def __matmul__(self, other: Query) -> Query:
        return Product(self, other)

    # --- sums and norms -------------------------------------------------------------------------------------------------

    def l1_sensitivity(self, spark: SparkSession) -> float:
        """The largest column sum of absolute entries."""
        return float(self.coo(spark).groupBy("cell").agg(F.sum(F.abs("coef")).alias("s")).agg(F.max("s")).first()[0] or 0.0)

    sensitivity = l1_sensitivity

    def l2_sensitivity(self, spark: SparkSession) -> float:
        """L19."""
        top = self.coo(spark).groupBy("cell").agg(F.sum(F.col("coef") * F.col("coef")).alias("s")).agg(F.max("s")).first()[0]
        return math.sqrt(top or 0.0)

    def sums(self, spark: SparkSession, axis: int | None = None) -> DataFrame:
        """Over columns (axis 0: a row per cell), rows (axis 1), or everything."""
        by = {None: [], 0: ["cell"], 1: ["row"]}[axis]
        return self.coo(spark).groupBy(*by).agg(F.sum("coef").alias("value"))

    def diag(self, spark: SparkSession) -> DataFrame:
        """L22."""
        return self.coo(spark).filter(F.col("row") == F.col("cell")).select("row", F.col("coef").alias("value"))

    def trace(self, spark: SparkSession) -> float:
        return float(self.diag(spark).agg(F.sum("value")).first()[0] or 0.0)

    # --- small matrices on the driver ---------------------------------------------------------------------------------

    def dense(self, spark: SparkSession | None = None) -> np.ndarray:
        """L26."""
        if self.shape[0] * self.shape[1] > DENSE_ENTRIES:
            raise ValueError("the matrix is too large for the driver")
        spark = spark or SparkSession.getActiveSession()
        out = np.zeros(self.shape)
        got = self.coo(spark).toPandas()
        np.add.at(out, (got["row"].to_numpy(int), got["cell"].to_numpy(int)), got["coef"].to_numpy(float))
        return out

    def inv(self, spark: SparkSession) -> Query:
        """L21."""
        return Matrix(np.linalg.inv(self.dense(spark)))

    def pinv(self, spark: SparkSession) -> Query:
        return Matrix(np.linalg.pinv(self.dense(spark)))

    # --- building -------------------------------------------------------------------------------------------------------

    def row(self, i: int) -> Query:
        """One row as a 1 x n query."""
        return Picked(self, i)

    __getitem__ = row

    def __abs__(self) -> Query:
        """L27."""
        return Mapped(self, "abs")

    def squared(self) -> Query:
        return Mapped(self, "square")

    def __mul__(self, other):
        """By a number, or by another query."""
        if isinstance(other, Query):
            return Product(self, other)
        if isinstance(other, int | float | np.number):
            return Weighted(self, float(other))
        return NotImplemented

    def __rmul__(self, other):
        return Weighted(self, float(other)) if isinstance(other, int | float | np.number) else NotImplemented

    def __add__(self, other: Query) -> Query:
        """L24."""
        return Sum((self, other)) if isinstance(other, Query) else NotImplemented

    def __sub__(self, other: Query) -> Query:
        return Sum((self, Weighted(other, -1.0))) if isinstance(other, Query) else NotImplemented


class Matrix(Query):
    """Entries given as an array."""

    def __init__(self, values: Sequence[Sequence[float]] | np.ndarray) -> None:
        self.values = np.atleast_2d(np.asarray(values, float))
        self.shape = self.values.shape

    def coo(self, spark: SparkSession) -> DataFrame:
        i, j = np.nonzero(self.values)
        return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), self.values[i, j].tolist(), strict=True)), "row long, cell long, coef double")

    def __eq__(self, other: object) -> bool:
        """L28."""
        return isinstance(other, Matrix) and np.array_equal(self.values, other.values)

    def __hash__(self) -> int:
        return hash((self.shape, self.values.tobytes()))


@dataclass(frozen=True)
class Entries(Query):
    """Entries given as a DataFrame (row, cell, coef)."""

    shape: tuple[int, int]
    rows: DataFrame

    def coo(self, spark: SparkSession) -> DataFrame:
        return self.rows


@dataclass(frozen=True)
class Identity(Query):
    """Answers are the vector itself, without a join."""

    n: int

    @property
    def shape(self) -> tuple[int, int]:
        return (self.n, self.n)

    def coo(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select(F.col("id").alias("row"), F.col("id").alias("cell"), F.lit(1.0).alias("coef"))

    def apply(self, vector: DataFrame) -> DataFrame:
        return vector.select(F.col("cell").alias("row"), "value")

    def inv(self, spark: SparkSession) -> Query:
        return self

    pinv = inv

    @property
    def T(self) -> Query:
        return self


@dataclass(frozen=True)
class Ones(Query):
    """Every row is the total."""

    m: int
    n: int

    @property
    def shape(self) -> tuple[int, int]:
        return (self.m, self.n)

    def coo(self, spark: SparkSession) -> DataFrame:
        cells = spark.range(self.m * self.n)
        return cells.select(F.floor(F.col("id") / self.n).cast("long").alias("row"), (F.col("id") % self.n).alias("cell"), F.lit(1.0).alias("coef"))

    def apply(self, vector: DataFrame) -> DataFrame:
        total = vector.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
        return vector.sparkSession.range(self.m).withColumnRenamed("id", "row").crossJoin(F.broadcast(total))

    def gram(self) -> Query:
        return Weighted(Ones(self.n, self.n), float(self.m))

    def pinv(self, spark: SparkSession) -> Query:
        return Weighted(Ones(self.n, self.m), 1.0 / (self.m * self.n))

    @property
    def T(self) -> Query:
        return Ones(self.n, self.m)


class Weighted(Query):
    """A scalar multiple; nested weights become one. Its sensitivity takes the weight's absolute value."""

    def __init__(self, base: Query, weight: float) -> None:
        if isinstance(base, Weighted):
            base, weight = base.base, base.weight * weight
        self.base, self.weight, self.shape = base, weight, base.shape

    def coo(self, spark: SparkSession) -> DataFrame:
        return self.base.coo(spark).withColumn("coef", F.col("coef") * self.weight)

    def apply(self, vector: DataFrame) -> DataFrame:
        return self.base.apply(vector).withColumn("value", F.col("value") * self.weight)

    def l1_sensitivity(self, spark: SparkSession) -> float:
        return abs(self.weight) * self.base.l1_sensitivity(spark)

    def l2_sensitivity(self, spark: SparkSession) -> float:
        return abs(self.weight) * self.base.l2_sensitivity(spark)

    def gram(self) -> Query:
        return Weighted(self.base.gram(), self.weight**2)

    def inv(self, spark: SparkSession) -> Query:
        return Weighted(self.base.inv(spark), 1 / self.weight)

    def pinv(self, spark: SparkSession) -> Query:
        return Weighted(self.base.pinv(spark), 1 / self.weight)

    @property
    def T(self) -> Query:
        return Weighted(self.base.T, self.weight)

    sensitivity = l1_sensitivity


class Transposed(Query):
    """L16."""

    def __init__(self, base: Query) -> None:
        self.base, self.shape = base, base.shape[::-1]

    def coo(self, spark: SparkSession) -> DataFrame:
        return self.base.coo(spark).select(F.col("cell").alias("row"), F.col("row").alias("cell"), "coef")

    @property
    def T(self) -> Query:
        return self.base


class Picked(Query):
    def __init__(self, base: Query, i: int) -> None:
        self.base, self.i, self.shape = base, range(base.shape[0])[i], (1, base.shape[1])

    def coo(self, spark: SparkSession) -> DataFrame:
        return self.base.coo(spark).filter(F.col("row") == self.i).withColumn("row", F.lit(0).cast("long"))


class Mapped(Query):
    def __init__(self, base: Query, how: str) -> None:
        self.base, self.how, self.shape = base, how, base.shape

    def coo(self, spark: SparkSession) -> DataFrame:
        c = F.col("coef")
        return self.base.coo(spark).withColumn("coef", F.abs(c) if self.how == "abs" else c * c)


class Sum(Query):
    """L05."""

    def __init__(self, parts: Sequence[Query]) -> None:
        self.parts, self.shape = tuple(parts), parts[0].shape
        if any(p.shape != self.shape for p in parts):
            raise ValueError("the shapes differ")

    def coo(self, spark: SparkSession) -> DataFrame:
        return reduce(DataFrame.unionByName, (p.coo(spark) for p in self.parts)).groupBy("row", "cell").agg(F.sum("coef").alias("coef"))

    @property
    def T(self) -> Query:
        return Sum([p.T for p in self.parts])


class Blocks(Query):
    """Queries placed with row and cell offsets."""

    def __init__(self, parts: Sequence[Query], down: bool, across: bool) -> None:
        self.parts = tuple(parts)
        rows, cells = [p.shape[0] for p in parts], [p.shape[1] for p in parts]
        if not across and len(set(cells)) > 1 or not down and len(set(rows)) > 1:
            raise ValueError("the shapes differ")
        self.shape = (sum(rows) if down else rows[0], sum(cells) if across else cells[0])
        self.at = [(sum(rows[:i]) if down else 0, sum(cells[:i]) if across else 0) for i in range(len(parts))]
        self.down, self.across = down, across

    def coo(self, spark: SparkSession) -> DataFrame:
        moved = [p.coo(spark).select((F.col("row") + i).alias("row"), (F.col("cell") + j).alias("cell"), "coef") for p, (i, j) in zip(self.parts, self.at, strict=True)]
        return reduce(DataFrame.unionByName, moved)

    def gram(self) -> Query:
        if self.down and not self.across:
            return reduce(Query.__add__, (p.gram() for p in self.parts))
        if self.down and self.across:
            return Blocks([p.gram() for p in self.parts], True, True)
        return super().gram()

    @property
    def T(self) -> Query:
        return Blocks([p.T for p in self.parts], self.across, self.down)


def block_diag(parts: Sequence[Query]) -> Query:
    return Blocks(parts, True, True)


def vstack(parts: Sequence[Query]) -> Query:
    return Blocks(parts, True, False)


def hstack(parts: Sequence[Query]) -> Query:
    return Blocks(parts, False, True)


class Kronecker(Query):
    """One matrix per attribute. Applied attribute by attribute, each a join with that attribute's small matrix."""

    def __init__(self, parts: Sequence[Query]) -> None:
        self.parts = tuple(parts)
        self.shape = (math.prod(p.shape[0] for p in parts), math.prod(p.shape[1] for p in parts))

    def coo(self, spark: SparkSession) -> DataFrame:
        out = self.parts[0].coo(spark)
        for p in self.parts[1:]:
            b = p.coo(spark).toDF("_row", "_cell", "_coef")
            out = out.crossJoin(F.broadcast(b) if math.prod(p.shape) <= SENT_ENTRIES else b).select((F.col("row") * p.shape[0] + F.col("_row")).alias("row"), (F.col("cell") * p.shape[1] + F.col("_cell")).alias("cell"), (F.col("coef") * F.col("_coef")).alias("coef"))
        return out

    def apply(self, vector: DataFrame) -> DataFrame:
        spark = vector.sparkSession
        left, out = [p.shape[1] for p in self.parts], vector.select(F.col("cell").cast("long").alias("cell"), "value")
        for k, p in enumerate(self.parts):
            after = math.prod(left[k + 1 :])
            if not isinstance(p, Identity):
                digit = F.floor(F.col("cell") / after) % left[k]
                before = F.floor(F.col("cell") / (after * left[k]))
                split = out.select(before.alias("_a"), digit.cast("long").alias("_k"), (F.col("cell") % after).alias("_b"), "value")
                joined = split.join(p.coo(spark).withColumnRenamed("cell", "_k"), "_k")
                left[k] = p.shape[0]
                cell = ((F.col("_a") * left[k] + F.col("row")) * after + F.col("_b")).cast("long").alias("cell")
                out = joined.groupBy(cell).agg(F.sum(F.col("coef") * F.col("value")).alias("value"))
        return out.select(F.col("cell").alias("row"), "value")

    def l1_sensitivity(self, spark: SparkSession) -> float:
        return math.prod(p.l1_sensitivity(spark) for p in self.parts)

    def l2_sensitivity(self, spark: SparkSession) -> float:
        return math.prod(p.l2_sensitivity(spark) for p in self.parts)

    def trace(self, spark: SparkSession) -> float:
        return math.prod(p.trace(spark) for p in self.parts)

    def gram(self) -> Query:
        return Kronecker([p.gram() for p in self.parts])

    def inv(self, spark: SparkSession) -> Query:
        return Kronecker([p.inv(spark) for p in self.parts])

    def pinv(self, spark: SparkSession) -> Query:
        return Kronecker([p.pinv(spark) for p in self.parts])

    @property
    def T(self) -> Query:
        return Kronecker([p.T for p in self.parts])

    sensitivity = l1_sensitivity


@dataclass(frozen=True)
class Haar(Query):
    """The Haar wavelet of n = 2^k cells: the total, then differences of halves, from coarse to fine."""

    n: int

    def __post_init__(self) -> None:
        if self.n < 1 or self.n & (self.n - 1):
            raise ValueError("n must be a power of two")

    @property
    def shape(self) -> tuple[int, int]:
        return (self.n, self.n)

    def coo(self, spark: SparkSession) -> DataFrame:
        k = self.n.bit_length() - 1
        cells = spark.range(self.n).withColumnRenamed("id", "cell")
        levels = [F.struct(F.lit(0).cast("long").alias("row"), F.lit(1.0).alias("coef"))]
        for j in range(k):  # 2^j blocks at level j; a block's first half counts plus, its second minus
            width = self.n >> j
            levels.append(F.struct((F.lit(1 << j) + F.floor(F.col("cell") / width)).cast("long").alias("row"), F.when(F.col("cell") % width < width // 2, 1.0).otherwise(-1.0).alias("coef")))
        return cells.select("cell", F.explode(F.array(*levels)).alias("e")).select("e.row", "cell", "e.coef")

    def l1_sensitivity(self, spark: SparkSession | None = None) -> float:
        return float(self.n.bit_length())

    sensitivity = l1_sensitivity


class Product(Query):
    """Composition: two joins with aggregations, never the product matrix unless it is asked for."""

    def __init__(self, a: Query, b: Query) -> None:
        if a.shape[1] != b.shape[0]:
            raise ValueError("the shapes do not fit")
        self.a, self.b, self.shape = a, b, (a.shape[0], b.shape[1])

    def coo(self, spark: SparkSession) -> DataFrame:
        right = self.b.coo(spark).select(F.col("row").alias("_k"), "cell", F.col("coef").alias("_coef"))
        left = self.a.coo(spark).select("row", F.col("cell").alias("_k"), "coef")
        return left.join(right, "_k").groupBy("row", "cell").agg(F.sum(F.col("coef") * F.col("_coef")).alias("coef"))

    def apply(self, vector: DataFrame) -> DataFrame:
        return self.a.apply(self.b.apply(vector).withColumnRenamed("row", "cell"))

    @property
    def T(self) -> Query:
        return Product(self.b.T, self.a.T)


def prefix(n: int) -> Matrix:
    """All prefix sums of n cells."""
    return Matrix(np.tril(np.ones((n, n))))
