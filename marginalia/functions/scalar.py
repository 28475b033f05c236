"""Column functions (F01-F19, D04, D11-D13, N06, W07, X01). All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def equal_width(value: Column, low: float, high: float, k: int) -> Column:
    """Right-closed bins over [low, high], codes 0 .. k-1; values outside fall into the end bins, null stays null.

    A constant column (low = high) is widened on both sides, so that with two bins its value is code 0.
    """
    if low == high:
        half = abs(low) * 0.001 or 0.001
        low, high = low - half, high + half
    value = value.cast("double")
    code = F.ceil((value - F.lit(float(low))) / F.lit(float(high - low)) * F.lit(k)) - 1
    return F.when(value.isNotNull() & ~F.isnan(value), F.least(F.greatest(code, F.lit(0)), F.lit(k - 1))).cast("int")


def whole(value: Column) -> Column:
    """A double rounded to a whole one, halves away from zero. ``F.round`` does so by a decimal for each row, which is dear."""
    near = F.rint(value)
    return near + F.when((value > 0) & (value - near == 0.5), 1.0).when((value < 0) & (value - near == -0.5), -1.0).otherwise(0.0)


def center(code: Column, k: int | Column) -> Column:
    """The centre of bin ``code`` of k in [0, 1]."""
    return (2 * code.cast("double") + 1) / (2 * k.cast("double") if isinstance(k, Column) else F.lit(float(2 * k)))


def nearest_code(x: Column, k: int) -> Column:
    """The code whose centre is nearest, the lower on ties."""
    return F.least(F.greatest(F.ceil(x * k) - 1, F.lit(0)), F.lit(k - 1)).cast("int")


def clamp_unit(x: Column) -> Column:
    """D13."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def cell_of(attrs: Sequence[str], strides: Sequence[int], prefix: str = "") -> Column:
    """The row-major number of a row's cell."""
    return sum((F.col(prefix + a).cast("long") * F.lit(int(s)) for a, s in zip(attrs, strides, strict=True)), F.lit(0).cast("long"))


def code_in(cell: Column, stride: int, size: int) -> Column:
    """The code of one attribute in a cell number."""
    return F.pmod(F.floor(cell / F.lit(stride)), F.lit(size)).cast("int")


def floor_log(value: Column, floor: float = 1e-100) -> Column:
    """F02."""
    return F.log(value + F.lit(floor))


def safe_subtract(a: Column, b: Column) -> Column:
    """A minus b, where b = -inf takes nothing."""
    return F.when(b == F.lit(NEG_INF), a).otherwise(a - b)


def safe_divide(a: Column, b: Column) -> Column:
    """0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def nan_to_num(value: Column) -> Column:
    """NaN to 0, infinities to the greatest doubles."""
    most = F.lit(1.7976931348623157e308)
    return F.least(F.greatest(F.nanvl(value, F.lit(0.0)), -most), most)


def log_add(a: Column, b: Column) -> Column:
    """log(e^a + e^b); -inf where both are."""
    top = F.greatest(a, b)
    return F.when(top == F.lit(NEG_INF), top).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def log_sum(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Log of summed exponentials for each key, shifted by the group's maximum; -inf where all are -inf."""
    top = values.groupBy(*keys).agg(F.max(value).alias("_top"))
    shifted = (values.join(top, list(keys)) if keys else values.crossJoin(F.broadcast(top))).withColumn("_e", F.when(F.col("_top") == NEG_INF, 0.0).otherwise(F.exp(F.col(value) - F.col("_top"))))
    total = shifted.groupBy(*keys).agg(F.max("_top").alias("_top"), F.sum("_e").alias("_e"))
    return total.select(*keys, F.when(F.col("_top") == NEG_INF, F.lit(NEG_INF)).otherwise(F.col("_top") + F.log("_e")).alias("value"))


def softmax(score: Column, scale: float = 1.0, base: Column | None = None, by: Sequence[str] = ()) -> Column:
    """Probabilities in proportion to base * exp(scale * score) within each group ``by``."""
    w = Window.partitionBy(*by)
    z = F.lit(scale) * score + (F.log(base) if base is not None else F.lit(0.0))
    e = F.exp(z - F.max(z).over(w))
    return e / F.sum(e).over(w)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) for each key, whatever the partitioning: from a 64-bit hash of seed and keys."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (h.cast("double") + 0.5) / F.lit(float(2**53))


def laplace(scale: Column | float, seed: int, *keys: Column) -> Column:
    """By the inverse distribution function of a keyed uniform number."""
    u = uniform(seed, *keys) - 0.5
    return -(scale if isinstance(scale, Column) else F.lit(float(scale))) * F.signum(u) * F.log1p(-2 * F.abs(u))


def normal(sigma: Column | float, seed: int, *keys: Column) -> Column:
    """By the polar form of two keyed uniform numbers."""
    u, v = uniform(seed, F.lit("radius"), *keys), uniform(seed, F.lit("angle"), *keys)
    return (sigma if isinstance(sigma, Column) else F.lit(float(sigma))) * F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def gumbel(seed: int, *keys: Column) -> Column:
    """Standard Gumbel noise: the largest score + noise is a draw by softmax."""
    return -F.log(-F.log(uniform(seed, *keys)))


def threshold_query(coords: Sequence[Column], theta: Sequence[float], tau: float, sigma: float) -> Column:
    """A smooth indicator of theta . x >= tau; its mean is the query's answer."""
    dot = sum((F.lit(float(t)) * x for t, x in zip(theta, coords, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-F.lit(float(sigma)) * (dot - F.lit(float(tau)))))


def norm(values: Column) -> Column:
    """The L2 norm of an array."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))


def minkowski(a: Column, b: Column, p: float = 5) -> Column:
    """The p-norm of the difference of two arrays; p may be infinite."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if p == float("inf"):
        return F.array_max(gaps)
    return F.pow(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(float(p)))), F.lit(1.0 / p))


def clean_names(df: DataFrame) -> DataFrame:
    """F16: column names without dots."""
    return df.toDF(*(c.replace(".", "") for c in df.columns))


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """nested struct fields as columns of their own, names joined by ``sep``."""
    from pyspark.sql.types import StructType

    def leaves(schema: StructType, path: tuple[str, ...] = ()) -> Iterable[tuple[str, ...]]:
        for f in schema:
            yield from leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, StructType) else [(*path, f.name)]

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema)))
