"""Distances between a real and a synthetic table over a workload (V01-V08): one job for each family of metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scalar import center
from marginalia.operators.marginals import marginals_kernel
from marginalia.operators.transport import directions, w1_signed
from marginalia.plans.schema import Clique, Domain


def normalised(answers: DataFrame) -> DataFrame:
    """(clique_id, cell, value) scaled to sum 1 for each clique; null where a clique has no weight."""
    total = answers.groupBy("clique_id").agg(F.sum("value").alias("_t"))
    return answers.join(F.broadcast(total), "clique_id").select("clique_id", "cell", F.when(F.col("_t") > 0, F.col("value") / F.col("_t")).alias("value"))


def marginal_gaps(real: DataFrame, synth: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], weights: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(clique_id, l1, l2) between normalised marginals; cells absent on either side are 0."""
    a = normalised(marginals_kernel(real, domain, cliques, weights[0])).withColumnRenamed("value", "_a")
    b = normalised(marginals_kernel(synth, domain, cliques, weights[1])).withColumnRenamed("value", "_b")
    gap = a.join(b, ["clique_id", "cell"], "full").withColumn("_gap", F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return gap.groupBy("clique_id").agg(F.sum(F.abs("_gap")).alias("l1"), F.sqrt(F.sum(F.col("_gap") * F.col("_gap"))).alias("l2"))


def wasserstein(real: DataFrame, synth: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], n_directions: int = 100, seed: int = 0, weights: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(clique_id, w1): sliced distance in the unit cube. Rows are merged to cells of each clique before any sort."""
    spark = real.sparkSession
    sides = [normalised(marginals_kernel(df, domain, cliques, w)).withColumn("w", F.lit(sign) * F.col("value")) for df, sign, w in ((real, 1, weights[0]), (synth, -1, weights[1]))]
    both = sides[0].unionByName(sides[1]).groupBy("clique_id", "cell").agg(F.sum("w").alias("w")).filter("w <> 0")
    lines = []  # a direction of a clique: how each attribute's code is read off the cell, and its share of z
    for i, c in enumerate(cliques):
        part = domain.project(c)
        for j, theta in enumerate(directions(len(c), n_directions if len(c) > 1 else 1, seed + i).tolist()):
            lines.append((i, j, [(int(s), int(n), float(t)) for s, n, t in zip(part.strides(), part.shape, theta, strict=True)]))
    lines = spark.createDataFrame(lines, "clique_id int, proj int, terms array<struct<stride: long, size: int, theta: double>>")
    term = lambda s, t: s + t["theta"] * center(F.floor(F.col("cell") / t["stride"]) % t["size"], t["size"])
    long = both.join(F.broadcast(lines), "clique_id").select("clique_id", "proj", F.aggregate("terms", F.lit(0.0), term).alias("z"), "w")
    each = w1_signed(long, ("clique_id", "proj")).groupBy("clique_id").agg(F.avg("w1").alias("w1"))
    every = spark.createDataFrame([(i,) for i in range(len(cliques))], "clique_id int")
    return every.join(each, "clique_id", "left").select("clique_id", F.coalesce("w1", F.lit(0.0)).alias("w1"))  # equal tables leave no rows


#: Cells of all cliques together that a write may count on its way; each is one running sum in every task.
OBSERVED_CELLS = 2_000


def write_measured(df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], truth: DataFrame, path: str) -> DataFrame:
    """V07, V08 beside the work: writes coded rows and measures them in the same scan.

    The counts of all cells ride on the write as observed sums in the writing stage itself, where each task counts once however
    often it was tried, so the rows are computed once. ``truth``: (clique_id, cell,
    value), the answers to compare with. Returns (clique_id, records, l1, l2, variation) between normalised marginals, the
    distances null where either side is empty. Only for cliques of few cells (``OBSERVED_CELLS`` together): larger ones belong
    in ``marginal_gaps`` over the written table. Rows with a code that is null or outside the schema are written, not counted.
    """
    from pyspark.sql import Observation

    from marginalia.functions.scalar import cell_of
    from marginalia.operators.marginals import bucketed

    parts = [domain.project(tuple(c)) for c in cliques]
    if sum(p.size() for p in parts) > OBSERVED_CELLS:
        raise ValueError(f"{sum(p.size() for p in parts)} cells are too many to count beside a write")
    seen, sums = Observation(), []
    coded = df.select("*", *(bucketed(F.col(a), n).alias("_code_" + a) for a, n in domain.config.items()))
    coded = coded.select(*df.columns, *(cell_of(p.attrs, p.strides(), "_code_").alias(f"_cell_{i}") for i, p in enumerate(parts)))
    for i, p in enumerate(parts):
        sums += [F.count_if(F.col(f"_cell_{i}") == k).alias(f"c{i}_{k}") for k in range(p.size())]
    coded.observe(seen, F.count(F.lit(1)).alias("records"), *sums).select(*df.columns).write.parquet(path)
    got, spark = seen.get, df.sparkSession
    cells = [(i, k, float(got[f"c{i}_{k}"] or 0)) for i, p in enumerate(parts) for k in range(p.size())]
    written = normalised(spark.createDataFrame(cells, "clique_id int, cell long, value double")).withColumnRenamed("value", "_a")
    gap = written.join(normalised(truth).withColumnRenamed("value", "_b"), ["clique_id", "cell"], "left")
    gap = gap.withColumn("_gap", F.col("_a") - F.coalesce("_b", F.lit(0.0)))
    l1, known = F.sum(F.abs("_gap")), F.sum("_b") > 0
    out = gap.groupBy("clique_id").agg(F.when(known, l1).alias("l1"), F.when(known, F.sqrt(F.sum(F.col("_gap") * F.col("_gap")))).alias("l2"))
    return out.select("clique_id", F.lit(int(got["records"])).cast("long").alias("records"), "l1", "l2", (F.col("l1") / 2).alias("variation"))


@dataclass
class Evaluator:
    """Metrics of a synthetic table against the real one, which it reads by design (they are not private)."""

    real: DataFrame
    synth: DataFrame
    domain: Domain
    workload: Sequence[Clique]
    undo: Callable[[DataFrame], DataFrame] | None = None  # X05
    n_directions: int = 100

    def update_synth(self, synth: DataFrame) -> None:
        """V02."""
        self.synth = synth

    def set_compression(self, undo: Callable[[DataFrame], DataFrame]) -> None:
        self.undo = undo

    def _synth(self) -> DataFrame:
        return self.synth.transform(self.undo) if self.undo else self.synth

    def evaluate(self) -> tuple[dict[str, float], list[float]]:
        """Averages and maxima over the workload, and the distance of each clique."""
        gaps = marginal_gaps(self.real, self._synth(), self.domain, self.workload).agg(*(f(m).alias(f"{m}_{n}") for m in ("l1", "l2") for n, f in (("avg", F.avg), ("max", F.max)))).first().asDict()
        w = [r["w1"] for r in wasserstein(self.real, self._synth(), self.domain, self.workload, self.n_directions).orderBy("clique_id").collect()]
        return gaps | {"w_avg": sum(w) / len(w), "w_sum": sum(w), "w_max": max(w)}, w


def _summed(values, clique: Sequence[str], attrs: Sequence[str]):
    """The marginal of ``attrs`` of an array over ``clique``."""
    import numpy as np

    x = np.asarray(values).sum(axis=tuple(i for i, a in enumerate(clique) if a not in attrs))
    keep = [a for a in clique if a in attrs]
    return np.transpose(x, [keep.index(a) for a in attrs])


@dataclass
class Logger:
    """Records metrics of marginals every ``frequency`` calls; pass ``logger`` as an engine's callback.

    A true answer is compared with the first clique that contains its attributes. With ``engine`` also the fit to what
    was measured: the sums of misses in units of noise, and half of their squares. ``feasibility`` is the mean L1 gap
    of the marginals of cliques on the attributes that two of them share.
    """

    truth: dict
    frequency: int = 50
    engine: object | None = None
    rows: list[dict] = field(default_factory=list)
    calls: int = 0
    started: float = field(default_factory=time.time)

    def __call__(self, marginals: dict) -> None:
        if self.calls % self.frequency == 0:
            self.run(marginals)
        self.calls += 1

    def run(self, marginals: dict) -> None:
        import numpy as np

        home = {q: next((c for c in marginals if set(q) <= set(c)), None) for q in self.truth}
        truth = {q: np.ravel(self.truth[q]) for q, c in home.items() if c is not None}
        gaps = {q: np.abs(t - _summed(marginals[home[q]], home[q], q).ravel()) for q, t in truth.items()}
        row = {
            "call": self.calls,
            "time": time.time() - self.started,
            "l1": float(sum(g.sum() for g in gaps.values())),
            "l2": float(sum((g**2).sum() for g in gaps.values())) ** 0.5,
            "variation": float(np.mean([0.5 * gaps[q].sum() / (t.sum() or 1.0) for q, t in truth.items()])) if truth else 0.0,
            "feasibility": self.feasibility(marginals),
        }
        if self.engine is not None:
            miss = self.misses(marginals)
            row |= {"l1_loss": float(np.abs(miss).sum()), "l2_loss": 0.5 * float(miss @ miss)}
        self.rows.append(row)

    def misses(self, marginals: dict):
        """How far the marginals are from each measured answer, in units of its noise."""
        import numpy as np

        measured = self.engine.measured if hasattr(self.engine, "measured") else [m for own in self.engine.groups.values() for m in own]
        out = [np.empty(0)]
        for m in measured:
            home = next(c for c in marginals if set(m.clique) <= set(c))
            x = _summed(marginals[home], home, m.clique).ravel()
            out.append(((x if m.q is None else m.q @ x) - m.y) * m.weight)
        return np.concatenate(out)

    @staticmethod
    def feasibility(marginals: dict) -> float:
        import numpy as np

        cliques, gaps = list(marginals), []
        for i, a in enumerate(cliques):
            for b in cliques[i + 1 :]:
                if shared := [x for x in a if x in b]:
                    gaps.append(float(np.abs(_summed(marginals[a], a, shared) - _summed(marginals[b], b, shared)).sum()))
        return float(np.mean(gaps)) if gaps else 0.0
