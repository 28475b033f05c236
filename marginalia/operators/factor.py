"""Factor algebra as relational algebra.

A factor is a function of discrete attributes, held as rows (codes, value). A product is a
natural join, summing out is a group-by. Plans grow lazily; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.scalar import NEG_INF, cell_of, floor_log, log_add, log_sum, safe_divide, safe_subtract, uniform
from marginalia.operators.marginals import cells_of, grid
from marginalia.plans.schema import Clique, Domain


#: Grids of more cells are not broadcast.
SENT_CELLS = 1_000_000


@dataclass(frozen=True)
class Factor:
    """``rows``: one row for each cell of ``domain`` (attributes and ``value``)."""

    domain: Domain
    rows: DataFrame

    # --- making -----------------------------------------------------------------------------------------------------

    @classmethod
    def of(cls, spark: SparkSession, domain: Domain, value: Column) -> Factor:
        """``value`` (an expression over the codes and ``cell``) in each cell."""
        return cls(domain, grid(spark, domain).select(*domain.attrs, value.cast("double").alias("value")))

    @classmethod
    def zeros(cls, spark: SparkSession, domain: Domain) -> Factor:
        return cls.of(spark, domain, F.lit(0.0))

    @classmethod
    def ones(cls, spark: SparkSession, domain: Domain) -> Factor:
        return cls.of(spark, domain, F.lit(1.0))

    @classmethod
    def uniform(cls, spark: SparkSession, domain: Domain) -> Factor:
        return cls.of(spark, domain, F.lit(1.0 / domain.size()))

    @classmethod
    def random(cls, spark: SparkSession, domain: Domain, seed: int = 0) -> Factor:
        return cls.of(spark, domain, uniform(seed, F.col("cell")))

    @classmethod
    def active(cls, spark: SparkSession, domain: Domain, zeros: Iterable[Sequence[int]]) -> Factor:
        """0 everywhere, but -inf in the listed cells, which cannot occur."""
        listed = spark.createDataFrame([tuple(map(int, z)) for z in zeros], ", ".join(f"`{a}` int" for a in domain)).distinct().withColumn("_hit", F.lit(True))
        cells = grid(spark, domain).drop("cell").join(F.broadcast(listed), list(domain.attrs), "left")
        return cls(domain, cells.select(*domain.attrs, F.when(F.col("_hit"), F.lit(NEG_INF)).otherwise(0.0).alias("value")))

    @classmethod
    def from_values(cls, spark: SparkSession, domain: Domain, values: Sequence[float]) -> Factor:
        """values in row-major order; there must be one for each cell."""
        if len(values) != domain.size():
            raise ValueError(f"{len(values)} values for {domain.size()} cells")
        given = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "cell long, value double")
        return cls(domain, grid(spark, domain).join(given, "cell").select(*domain.attrs, "value"))

    # --- cell by cell -----------------------------------------------------------------------------------------------

    def map(self, f: Callable[[Column], Column]) -> Factor:
        return Factor(self.domain, self.rows.withColumn("value", f(F.col("value"))))

    def exp(self) -> Factor:
        return self.map(F.exp)

    def log(self, floor: float = 1e-100) -> Factor:
        return self.map(lambda v: floor_log(v, floor))

    def copy(self) -> Factor:
        """plans never change, so the factor itself."""
        return self

    def vector(self) -> list[float]:
        """values in row-major order, on the driver; for small factors."""
        at = self.rows.select(cell_of(self.domain.attrs, self.domain.strides()).alias("cell"), "value")
        return [r["value"] for r in at.orderBy("cell").collect()]

    # --- schema -----------------------------------------------------------------------------------------------------

    def expand(self, domain: Domain) -> Factor:
        """The same values over a larger schema."""
        if not domain.contains(self.domain):
            raise ValueError("the schema must contain the factor's")
        more = domain.project(domain.invert(self.domain.attrs))
        cells = grid(self.rows.sparkSession, more).drop("cell")
        rows = self.rows.crossJoin(F.broadcast(cells) if more.size() <= SENT_CELLS else cells) if len(more) else self.rows
        return Factor(domain, rows.select(*domain.attrs, "value"))

    def transpose(self, attrs: Sequence[str]) -> Factor:
        """J09."""
        if set(attrs) != set(self.domain.attrs):
            raise ValueError("all attributes must be listed")
        return Factor(self.domain.project(attrs), self.rows.select(*attrs, "value"))

    def condition(self, evidence: Mapping[str, int | slice]) -> Factor:
        """Attributes fixed to a value leave the schema; those bound to a slice stay, shifted to begin at 0."""
        rows, sizes = self.rows, dict(self.domain.config)
        for a, v in evidence.items():
            if isinstance(v, slice):
                low, high, _ = v.indices(self.domain[a])
                rows = rows.filter((F.col(a) >= low) & (F.col(a) < high)).withColumn(a, F.col(a) - low)
                sizes[a] = high - low
            else:
                rows = rows.filter(F.col(a) == v).drop(a)
                del sizes[a]
        return Factor(Domain.fromdict(sizes), rows)

    # --- summing out --------------------------------------------------------------------------------------------------

    def _keep(self, attrs: Iterable[str] | None) -> Clique:
        return () if attrs is None else self.domain.invert(attrs)

    def sum(self, attrs: Iterable[str] | None = None) -> Factor:
        """Over ``attrs`` (None: all; the empty tuple: the factor itself)."""
        keep = self._keep(attrs)
        return Factor(self.domain.project(keep), self.rows.groupBy(*keep).agg(F.sum("value").alias("value")))

    def logsumexp(self, attrs: Iterable[str] | None = None) -> Factor:
        """G10."""
        keep = self._keep(attrs)
        return Factor(self.domain.project(keep), log_sum(self.rows, keep))

    def max(self, attrs: Iterable[str] | None = None) -> Factor:
        """G11."""
        keep = self._keep(attrs)
        return Factor(self.domain.project(keep), self.rows.groupBy(*keep).agg(F.max("value").alias("value")))

    def project(self, attrs: Sequence[str], agg: str = "sum") -> Factor:
        """Onto ``attrs``, in that order."""
        if agg not in ("sum", "logsumexp"):
            raise ValueError("agg is 'sum' or 'logsumexp'")
        gone = self.domain.invert(attrs)
        return (self.sum(gone) if agg == "sum" else self.logsumexp(gone)).transpose(tuple(attrs))

    def scalar(self) -> float:
        """The value of a factor without attributes."""
        return float(self.rows.select("value").first()[0])

    # --- two factors --------------------------------------------------------------------------------------------------

    def _join(self, other: Factor, f: Callable[[Column, Column], Column], how: str = "inner") -> Factor:
        domain = self.domain.merge(other.domain)
        shared = [a for a in self.domain if a in other.domain]
        right = other.rows.withColumnRenamed("value", "_right")
        rows = self.rows.join(right, shared, how) if shared else self.rows.crossJoin(right)
        return Factor(domain, rows.select(*domain.attrs, f(F.col("value"), F.col("_right")).alias("value")))

    def _within(self, other: Factor, f: Callable[[Column, Column], Column]) -> Factor:
        """As ``_join``, but the other schema must lie inside this one."""
        if not self.domain.contains(other.domain):
            raise ValueError("the right schema must lie inside the left")
        return self._join(other, f, "left" if len(other.domain) else "inner")

    def __mul__(self, other: Factor | float) -> Factor:
        """The natural join, values multiplied; a cross join where no attribute is shared."""
        return self._join(other, lambda a, b: a * b) if isinstance(other, Factor) else self.map(lambda v: v * other)

    def __add__(self, other: Factor | float) -> Factor:
        """J02."""
        return self._join(other, lambda a, b: a + b) if isinstance(other, Factor) else self.map(lambda v: v + other)

    __rmul__, __radd__ = __mul__, __add__

    def __imul__(self, other: Factor | float) -> Factor:
        """J04."""
        return self._within(other, lambda a, b: a * b) if isinstance(other, Factor) else self * other

    def __iadd__(self, other: Factor | float) -> Factor:
        """J03."""
        return self._within(other, lambda a, b: a + b) if isinstance(other, Factor) else self + other

    def __sub__(self, other: Factor | float) -> Factor:
        """-inf on the right takes nothing."""
        return self._join(other, safe_subtract) if isinstance(other, Factor) else self.map(lambda v: v - other)

    def __truediv__(self, other: Factor | float) -> Factor:
        """0 where the divisor is not positive."""
        return self._within(other, safe_divide) if isinstance(other, Factor) else self.map(lambda v: v / other)

    def logaddexp(self, other: Factor) -> Factor:
        """J07."""
        return self._join(other, log_add)


def eliminate(factors: Sequence[Factor], order: Iterable[str], log: bool = False) -> Factor:
    """Join the factors that have an attribute, sum it out, and go on; then join what is left.

    Catalyst does not push a sum through a join, so the plan is built in elimination order here.
    """
    left = list(factors)
    combine = (lambda a, b: a + b) if log else (lambda a, b: a * b)
    for attr in order:
        own = [f for f in left if attr in f.domain]
        if not own:
            continue
        left = [f for f in left if attr not in f.domain]
        made = own[0]
        for f in own[1:]:
            made = combine(made, f)
        left.append(made.logsumexp([attr]) if log else made.sum([attr]))
    made = left[0]
    for f in left[1:]:
        made = combine(made, f)
    return made


def kron_answer(factors: Sequence[Factor], queries: Sequence[tuple[str, Sequence[Sequence[float]]]], order: Sequence[str]) -> Factor:
    """The answers of per-attribute query matrices on a product of factors. Each attribute a becomes ``a_answer``."""
    spark = factors[0].rows.sparkSession
    answers = []
    for attr, matrix in queries:
        rows = [(i, j, float(v)) for i, line in enumerate(matrix) for j, v in enumerate(line)]
        answers.append(Factor(Domain((attr + "_answer", attr), (len(matrix), len(matrix[0]))), spark.createDataFrame(rows, f"{attr}_answer int, {attr} int, value double")))
    return eliminate([*factors, *answers], order)


@dataclass(frozen=True)
class CliqueVector:
    """Factors of several cliques as one table (clique_id, cell, value), with vector arithmetic."""

    domain: Domain
    cliques: tuple[Clique, ...]
    rows: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, domain: Domain, cliques: Sequence[Sequence[str]], value: Callable[[Column, Column, Column], Column]) -> CliqueVector:
        """``value(clique_id, cell, number of cells)`` in each cell."""
        cells = cells_of(spark, [domain.size(c) for c in cliques])
        return cls(domain, tuple(map(tuple, cliques)), cells.select("clique_id", "cell", value(F.col("clique_id"), F.col("cell"), F.col("n")).cast("double").alias("value")))

    @classmethod
    def zeros(cls, spark: SparkSession, domain: Domain, cliques: Sequence[Sequence[str]]) -> CliqueVector:
        return cls.of(spark, domain, cliques, lambda i, c, n: F.lit(0.0))

    @classmethod
    def ones(cls, spark: SparkSession, domain: Domain, cliques: Sequence[Sequence[str]]) -> CliqueVector:
        return cls.of(spark, domain, cliques, lambda i, c, n: F.lit(1.0))

    @classmethod
    def uniform(cls, spark: SparkSession, domain: Domain, cliques: Sequence[Sequence[str]]) -> CliqueVector:
        return cls.of(spark, domain, cliques, lambda i, c, n: 1.0 / n)

    @classmethod
    def random(cls, spark: SparkSession, domain: Domain, cliques: Sequence[Sequence[str]], seed: int = 0) -> CliqueVector:
        return cls.of(spark, domain, cliques, lambda i, c, n: uniform(seed, i, c))

    @classmethod
    def from_data(cls, df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], weight: str | None = None) -> CliqueVector:
        """All marginals in one scan."""
        from marginalia.operators.marginals import dense, marginals_exploded

        return cls(domain, tuple(map(tuple, cliques)), dense(marginals_exploded(df, domain, cliques, weight), domain, cliques))

    def map(self, f: Callable[[Column], Column]) -> CliqueVector:
        return CliqueVector(self.domain, self.cliques, self.rows.withColumn("value", f(F.col("value"))))

    def exp(self) -> CliqueVector:
        return self.map(F.exp)

    def log(self) -> CliqueVector:
        return self.map(floor_log)

    def factor(self, clique: Sequence[str]) -> Factor:
        from marginalia.functions.scalar import code_in

        part = self.domain.project(clique)
        own = self.rows.filter(F.col("clique_id") == self.cliques.index(tuple(clique)))
        return Factor(part, own.select(*(code_in(F.col("cell"), s, n).alias(a) for a, s, n in zip(part.attrs, part.strides(), part.shape, strict=True)), "value"))

    def _aligned(self, other: CliqueVector) -> DataFrame:
        ids = [(other.cliques.index(c), i) for i, c in enumerate(self.cliques) if c in other.cliques]
        mapping = self.rows.sparkSession.createDataFrame(ids, "_id int, clique_id int") if ids else self.rows.sparkSession.createDataFrame([], "_id int, clique_id int")
        right = other.rows.withColumnRenamed("clique_id", "_id").join(F.broadcast(mapping), "_id").select("clique_id", "cell", F.col("value").alias("_right"))
        return right

    def combine(self, other: CliqueVector) -> CliqueVector:
        """Add the other's factors where the clique is the same; the rest stays."""
        rows = self.rows.join(self._aligned(other), ["clique_id", "cell"], "left")
        return CliqueVector(self.domain, self.cliques, rows.select("clique_id", "cell", (F.col("value") + F.coalesce("_right", F.lit(0.0))).alias("value")))

    def _binary(self, other: CliqueVector | float, f: Callable[[Column, Column], Column]) -> CliqueVector:
        if not isinstance(other, CliqueVector):
            return self.map(lambda v: f(v, F.lit(float(other))))
        if set(self.cliques) != set(other.cliques):
            raise ValueError("the cliques differ")
        rows = self.rows.join(self._aligned(other), ["clique_id", "cell"])
        return CliqueVector(self.domain, self.cliques, rows.select("clique_id", "cell", f(F.col("value"), F.col("_right")).alias("value")))

    def __add__(self, other: CliqueVector | float) -> CliqueVector:
        """J11."""
        return self._binary(other, lambda a, b: a + b)

    def __sub__(self, other: CliqueVector | float) -> CliqueVector:
        return self._binary(other, safe_subtract)

    def __mul__(self, scale: float) -> CliqueVector:
        return self.map(lambda v: v * scale)

    __radd__, __rmul__ = __add__, __mul__

    def dot(self, other: CliqueVector) -> DataFrame:
        """One row ``dot``."""
        return self.rows.join(self._aligned(other), ["clique_id", "cell"]).agg(F.sum(F.col("value") * F.col("_right")).alias("dot"))

    def size(self) -> int:
        """Cells of all cliques, from the schema alone."""
        return sum(map(self.domain.size, self.cliques))


def containing_cliques(spark: SparkSession, domain: Domain, models: Sequence[Sequence[str]], measured: Sequence[Sequence[str]]) -> DataFrame:
    """For each measured clique the smallest model clique that holds it, as (measured_id, model_id)."""
    from marginalia.operators.containment import smallest_holders

    a = spark.createDataFrame([(i, list(c)) for i, c in enumerate(measured)], "id int, attrs array<string>")
    b = spark.createDataFrame([(i, list(c), domain.size(c)) for i, c in enumerate(models)], "id int, attrs array<string>, cells long")
    return smallest_holders(a, b).filter("model_id is not null").withColumnRenamed("id", "measured_id")


def primal_feasibility(vector: CliqueVector) -> DataFrame:
    """For each pair of cliques that share attributes, the L1 gap of their shared marginals (r, s, gap)."""
    from functools import reduce

    rows = []
    for r, a in enumerate(vector.cliques):
        for s, b in enumerate(vector.cliques[:r]):
            shared = vector.domain.canonical(set(a) & set(b))
            if shared:
                both = vector.factor(a).project(shared)._join(vector.factor(b).project(shared), lambda x, y: F.abs(x - y))
                rows.append(both.rows.agg(F.lit(r).alias("r"), F.lit(s).alias("s"), F.sum("value").alias("gap")))
    if not rows:
        return vector.rows.sparkSession.createDataFrame([], "r int, s int, gap double")
    return reduce(DataFrame.unionByName, rows)
