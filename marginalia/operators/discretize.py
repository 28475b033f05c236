"""Coding of raw columns and back (D01-D19): plans of projections and joins with small code tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType

from marginalia.functions.scalar import center, clamp_unit, equal_width, nearest_code
from marginalia.operators.marginals import grid
from marginalia.plans.schema import Domain

#: A dictionary of more values is refused: coding is for low cardinalities.
MOST_VALUES = 1_000_000
SENT_VALUES = 100_000  # a longer one is joined without a broadcast


@dataclass
class Coding:
    """How one column is coded. ``kind``: bool, width (bins between ``low`` and ``high``) or dictionary (``values``)."""

    attr: str
    kind: str
    size: int
    low: float = 0.0
    high: float = 0.0
    values: list = field(default_factory=list)

    def edges(self) -> list[float]:
        """Bin edges; the first is lowered by a thousandth of the range, so that the least value lies inside."""
        low, high = self.low, self.high
        if low == high:
            half = abs(low) * 0.001 or 0.001
            return [low - half + i * 2 * half / self.size for i in range(self.size + 1)]
        out = [low + i * (high - low) / self.size for i in range(self.size + 1)]
        return [out[0] - 0.001 * (high - low), *out[1:]]

    def centers(self) -> list[float]:
        """D05."""
        e = self.edges()
        return [(a + b) / 2 for a, b in zip(e, e[1:], strict=False)]

    def originals(self) -> list:
        return [False, True] if self.kind == "bool" else self.values if self.kind == "dictionary" else self.centers()


@dataclass
class Coder:
    """Fitted codings of a table's columns; ``forward`` and ``backward`` are lazy projections and joins."""

    codings: dict[str, Coding]

    @classmethod
    def fit(cls, df: DataFrame, k: int, order: str | None = None, bounds: dict[str, tuple[float, float]] | None = None, shared_cap: bool = False) -> Coder:
        """One pass for ranges, one for each dictionary column.

        ``order``: dictionaries in order of first appearance along this column, else sorted. ``bounds``: public ranges,
        which leak nothing about the rows. ``shared_cap``: an integer column with fewer than k values lowers k for the
        columns after it too (off by default: each column has its own).
        """
        bounds = bounds or {}
        numeric = [f for f in df.schema if f.name != order and isinstance(f.dataType, NumericType)]
        ask = [f(F.col(c.name)).cast("double").alias(f"{n}{i}") for i, c in enumerate(numeric) if c.name not in bounds for n, f in (("lo", F.min), ("hi", F.max))]
        got = df.agg(*ask).first().asDict() if ask else {}
        out: dict[str, Coding] = {}
        cap = k
        for f in df.schema:
            if f.name == order:
                continue
            if isinstance(f.dataType, BooleanType):
                out[f.name] = Coding(f.name, "bool", 2)
            elif isinstance(f.dataType, NumericType):
                i = numeric.index(f)
                low, high = bounds.get(f.name) or (got[f"lo{i}"], got[f"hi{i}"])
                if low is None:
                    raise ValueError(f"{f.name} has no values")
                size = cap if shared_cap else k
                if isinstance(f.dataType, IntegralType):  # D03
                    size = max(1, min(size, int(high - low) + (0 if shared_cap else 1)))
                    cap = size if shared_cap else cap
                out[f.name] = Coding(f.name, "width", size, float(low), float(high))
            else:
                values = dictionary(df, f.name, order)
                out[f.name] = Coding(f.name, "dictionary", len(values), values=values)
        return cls(out)

    @property
    def domain(self) -> Domain:
        return Domain.fromdict({a: c.size for a, c in self.codings.items()})

    def forward(self, df: DataFrame) -> DataFrame:
        """Codes of each column. Nulls and unknown values are null codes."""
        out = df
        for c in self.codings.values():
            if c.kind == "bool":
                out = out.withColumn(c.attr, F.col(c.attr).cast("int"))
            elif c.kind == "width":
                out = out.withColumn(c.attr, equal_width(F.col(c.attr), c.low, c.high, c.size))
            else:
                codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(c.values)], f"_v {_type(df, c.attr)}, _code int")
                out = out.join(F.broadcast(codes) if len(c.values) <= SENT_VALUES else codes, F.col(c.attr) == F.col("_v"), "left").withColumn(c.attr, F.col("_code")).drop("_v", "_code")
        return out.select(*self.codings)

    def backward(self, df: DataFrame) -> DataFrame:
        """Bin centres or original values; null where a code is out of range."""
        out = df.select(*self.codings)
        for c in self.codings.values():
            values = F.array(*(F.lit(v) for v in c.originals()))
            code = F.col(c.attr)
            out = out.withColumn(c.attr, F.when((code >= 0) & (code < c.size), F.get(values, code.cast("int"))))
        return out

    def to_json(self) -> dict:
        """Plain values for ``json``."""
        return {a: {"kind": c.kind, "size": c.size, "low": c.low, "high": c.high, "values": c.values} for a, c in self.codings.items()}

    @classmethod
    def from_json(cls, config: dict) -> Coder:
        """S17."""
        return cls({a: Coding(a, **c) for a, c in config.items()})

    def bins(self, spark: SparkSession) -> DataFrame:
        """The dimension table (attr, code, lo, hi, center, original) of all columns."""
        rows = []
        for c in self.codings.values():
            edges = c.edges() if c.kind == "width" else None
            for i, v in enumerate(c.originals()):
                rows.append((c.attr, i, edges[i] if edges else None, edges[i + 1] if edges else None, v if edges else None, None if edges else str(v)))
        return spark.createDataFrame(rows, "attr string, code int, lo double, hi double, center double, original string")


def _type(df: DataFrame, attr: str) -> str:
    return df.schema[attr].dataType.simpleString()


def dictionary(df: DataFrame, attr: str, order: str | None = None) -> list:
    """Distinct values, sorted or by first appearance; refuses more than ``MOST_VALUES``."""
    found = df.filter(F.col(attr).isNotNull()).groupBy(attr).agg((F.min(order) if order else F.lit(0)).alias("_first"))
    values = [r[0] for r in found.orderBy("_first", attr).limit(MOST_VALUES + 1).collect()]
    if len(values) > MOST_VALUES:
        raise ValueError(f"{attr} has more than {MOST_VALUES} values")
    return values


def rank_codes(df: DataFrame, attr: str, slices: int = 64) -> DataFrame:
    """D06 without the driver: (value, code) by rank of the distinct values.

    Bounds between slices come from a bounded sample by hash; only slices are sorted, and codes begin after those before.
    """
    found = df.select(F.col(attr).alias("value")).filter("value is not null").distinct()
    sample = sorted(r[0] for r in found.orderBy(F.xxhash64("value"), "value").limit(16 * slices).collect())
    bounds = sample[16::16]
    at = F.lit(0)
    for b in bounds:
        at = at + (F.col("value") >= F.lit(b)).cast("int")
    cut = found.select("value", at.alias("_slice"))
    sizes = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"))  # a row per slice
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("value")) - 1
    return cut.join(F.broadcast(before), "_slice").select("value", (F.col("_before") + rank).cast("int").alias("code"))


def clean(df: DataFrame, drop_first: bool = False) -> DataFrame:
    """Rows with nulls go, dots leave the names, and on request the first column goes."""
    df = df.toDF(*(c.replace(".", "") for c in df.columns)).dropna()
    return df.drop(df.columns[0]) if drop_first else df


# --- supports: rare codes merged into one ---------------------------------------------------------------------------


def supported(y: Sequence[float], sigma: float) -> list[int]:
    """Codes whose noisy count is three deviations or more."""
    return [i for i, v in enumerate(y) if v >= 3 * sigma]


def compress_measurement(y: Sequence[float], sigma: float) -> tuple[list[float], list[float], list[int]]:
    """Counts over supported codes and one for the rest, the factor of each query row, and the support.

    The last row's factor is 1 / sqrt(number merged), so that its noise has the same deviation as the others'.
    """
    keep = supported(y, sigma)
    rest = [v for i, v in enumerate(y) if i not in set(keep)]
    if not rest:
        return list(y), [1.0] * len(y), keep
    factor = len(rest) ** -0.5
    return [*(y[i] for i in keep), sum(rest) * factor], [*([1.0] * len(keep)), factor], keep


def merge_unsupported(df: DataFrame, supports: dict[str, list[int]]) -> DataFrame:
    """Supported codes count up from 0; all others become the code after them."""
    for a, keep in supports.items():
        codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(keep)], "_v int, _code int")
        df = df.join(F.broadcast(codes), F.col(a) == F.col("_v"), "left").withColumn(a, F.coalesce("_code", F.lit(len(keep)))).drop("_v", "_code")
    return df


def split_unsupported(df: DataFrame, supports: dict[str, list[int]], domain: Domain, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Codes back to the original ones; the merged code becomes one of those it stands for, drawn by the row's key."""
    from marginalia.functions.scalar import uniform

    for a, keep in supports.items():
        rest = [v for v in range(domain[a]) if v not in set(keep)] or [None]
        old = F.array(*map(F.lit, keep)) if keep else F.array(F.lit(-1))
        draw = F.floor(uniform(seed, F.lit(a), *map(F.col, key)) * len(rest)).cast("int")
        df = df.withColumn(a, F.when(F.col(a) < len(keep), F.get(old, F.col(a))).otherwise(F.get(F.array(*map(F.lit, rest)), draw)))
    return df


# --- embeddings into the unit cube -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Embedding:
    """Each attribute is one coordinate; code i of k lies at (2i+1)/2k. ``supports``: codes in use, if not all."""

    domain: Domain
    supports: dict[str, list[int]] = field(default_factory=dict)

    def support(self, attr: str) -> list[int]:
        return self.supports.get(attr) or list(range(self.domain[attr]))

    def dims(self, cliques: Sequence[Sequence[str]]) -> list[tuple[int, ...]]:
        """Coordinates of each clique."""
        return [self.domain.axes(c) for c in cliques]

    def embed(self, df: DataFrame, attrs: Sequence[str] | None = None, prefix: str = "x_", keep: Sequence[str] = ()) -> DataFrame:
        """D11."""
        return df.select(*keep, *(center(F.col(a), self.domain[a]).alias(prefix + a) for a in attrs or self.domain.attrs))

    def discretize(self, df: DataFrame, attrs: Sequence[str] | None = None, prefix: str = "x_", keep: Sequence[str] = ()) -> DataFrame:
        """The place, within the support, of the nearest centre."""
        return df.select(*keep, *(self._nearest(F.col(prefix + a), a).alias(a) for a in attrs or self.domain.attrs))

    def _nearest(self, x: Column, attr: str) -> Column:
        k, support = self.domain[attr], self.support(attr)
        if len(support) == k:
            return nearest_code(x, k)
        # midpoints between neighbouring supported centres decide; a point on one goes to the lower
        cuts = [(a + b + 1) / (2 * k) for a, b in zip(support, support[1:], strict=False)]
        return sum(((x > F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int")

    def project_manifold(self, df: DataFrame, prefix: str = "x_") -> DataFrame:
        """D13."""
        return df.withColumns({c: clamp_unit(F.col(c)) for c in df.columns if c.startswith(prefix)})

    def centers(self, spark: SparkSession, attrs: Sequence[str]) -> DataFrame:
        """cells of a clique over supported codes, with their coordinates."""
        part = Domain(tuple(attrs), tuple(len(self.support(a)) for a in attrs))
        cells = grid(spark, part)
        coords = []
        for a in attrs:
            codes = F.array(*map(F.lit, self.support(a)))
            coords.append(center(F.get(codes, F.col(a)), self.domain[a]).alias("x_" + a))
        return cells.select("cell", *coords)

    def without_merged(self, spark: SparkSession, attrs: Sequence[str]) -> DataFrame | None:
        """Cells of a compressed grid and whether none of their codes is the merged one; None if nothing is merged."""
        sizes = tuple(len(self.supports[a]) + 1 if a in self.supports else self.domain[a] for a in attrs)
        if all(a not in self.supports for a in attrs):
            return None
        keep = [F.col(a) < len(self.supports[a]) for a in attrs if a in self.supports]
        cells = grid(spark, Domain(tuple(attrs), sizes))
        out = keep[0]
        for k in keep[1:]:
            out = out & k
        return cells.select(*attrs, "cell", out.alias("kept"))
