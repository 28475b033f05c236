"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Shallow trees (a few leaves on one feature's bins) are
boosted feature by feature in a fixed cycle, each adding a small step to that feature's
lookup table; then the pairs of features with the largest gain get two-way tables, boosted
the same way by four-leaf trees. A score is the sigmoid of the sum of table cells: one
bin lookup and addition per feature, over a whole batch at once.

The model is fitted on at most ``max_rows`` labelled rows, those of the smallest hash of
their id, so the driver holds a bounded table. Features come from the text alone.

Defined cases: a null text counts as empty; an empty text has all features 0 and gets the
model's score for that; rows without a label are not learned from; a fit without rows, or
with labels of one kind only, scores all texts by the smoothed share of label 1; texts of any
length are measured whole; rows that repeat are scored alike, and each is learned from; rows of
the sample with equal hashes stand in order of id; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import mapped, texts, with_columns

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "symbols", "digits", "punctuation", "beyond_ascii", "blanks",
    "distinct", "top_word", "adjacent_equal", "repeated_pairs", "repeated_lines", "line_length", "exclaim",
)
_ASCII = np.arange(256)
_CLASSES = np.stack(
    [
        (_ASCII >= 65) & (_ASCII <= 90),
        np.isin(_ASCII, [ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]),
        (_ASCII >= 48) & (_ASCII <= 57),
        np.isin(_ASCII, [ord(c) for c in ".,;:?'\"-()"]),
        _ASCII >= 128,
        (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13)),
        _ASCII == ord("!"),
    ]
).astype(np.float64)


def features(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    upper, symbols, digits, punctuation, beyond, blanks, exclaim = (_CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n).tolist()
    words = text.split()
    k = len(words)
    if not k:
        return [np.log1p(n), 0.0, 0.0, upper, symbols, digits, punctuation, beyond, blanks, 0.0, 0.0, 0.0, 0.0, 0.0, np.log1p(n), exclaim]
    count = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    equal = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(k), (n - blanks * n) / k, upper, symbols, digits, punctuation, beyond, blanks,
        len(count) / k, max(count.values()) / k, equal / k, 1 - pairs / max(1, k - 1), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), exclaim,
    ]


def matrix(batch_texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in batch_texts], np.float64).reshape(len(batch_texts), len(FEATURES))


@dataclass
class Gam:
    """Lookup tables: ``tables[j]`` over the bins of feature j, ``pairs[(i, j)]`` over coarse bins of two."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j])]
        for (i, j), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges between distinct values, at quantiles."""
    u = np.unique(v)
    if len(u) < 2:
        return np.empty(0)
    at = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    at = at[at < u[-1]]
    if not len(at):
        at = u[:1]
    return (at + u[np.searchsorted(u, at) + 1]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """A regression tree over ordered bins with gradient and curvature sums; its value in each bin."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gt, ht = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            if (k := int(np.argmax(gain))) is not None and gain[k] > best[0]:
                best = (gain[k], (a, b), int(m[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _square(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best four-leaf tree with one cut in each direction: its gain, and its value in each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    ra, rb = cg[:-1, -1:] - a, ch[:-1, -1:] - b
    da, db = cg[-1:, :-1] - a, ch[-1:, :-1] - b
    ea, eb = tg - a - ra - da, th - b - rb - db
    gain = a**2 / (b + l2) + ra**2 / (rb + l2) + da**2 / (db + l2) + ea**2 / (eb + l2)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for s, x, y in (((slice(None, i + 1), slice(None, j + 1)), a, b), ((slice(None, i + 1), slice(j + 1, None)), ra, rb), ((slice(i + 1, None), slice(None, j + 1)), da, db), ((slice(i + 1, None), slice(j + 1, None)), ea, eb)):
        out[s] = x[i, j] / (y[i, j] + l2)
    return float(gain[i, j] - tg**2 / (th + l2)), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, bins: int = 64, rate: float = 0.15, leaves: int = 3, l2: float = 2.0) -> Gam:
    """Boost one-way tables in a fixed cycle, then two-way tables of the best pairs."""
    y = np.asarray(y, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(base=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    d, n = x.shape[1], len(y)
    model.edges, model.coarse = [_cuts(x[:, j], bins) for j in range(d)], [_cuts(x[:, j], 12) for j in range(d)]
    fine = [np.searchsorted(model.edges[j], x[:, j]) for j in range(d)]
    rough = [np.searchsorted(model.coarse[j], x[:, j]) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f, least = np.full(n, model.base), max(1.0, 0.0005 * n)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            if len(model.edges[j]):
                g, h = gradients()
                k = len(model.tables[j])
                step = rate * _tree(np.bincount(fine[j], g, k), np.bincount(fine[j], h, k), leaves, l2, min(least, h.sum() / 20))
                model.tables[j] += step
                f += step[fine[j]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(rough[i] * shape[1] + rough[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    usable = [j for j in range(d) if len(model.coarse[j])]
    gains = sorted(((_square(grid(i, j, g), grid(i, j, h), l2)[0], i, j) for a, i in enumerate(usable) for j in usable[a + 1 :]), reverse=True)
    for _, i, j in gains[:n_pairs]:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = gradients()
            step = rate * _square(grid(i, j, g), grid(i, j, h), l2)[1]
            table += step
            f += step[rough[i], rough[j]]
    return model


def id_text(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as the empty text."""
    return F.crc32(id_text(column).cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, learn=None) -> DataFrame:
    """At most ``max_rows`` rows (doc_id, text, y), the same for the same tables: labels with the smallest hash of
    their id first. Only that bounded set of labels is broadcast."""
    some = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    some = some.filter(~held_out() if learn is None else learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    docs = docs.select("doc_id", "text")
    return docs.join(F.broadcast(some), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> Gam:
    """Learn ``labels.quality`` from at most ``max_rows`` rows whose id is not held out."""
    sample = labelled_sample(docs, labels, "quality", max_rows)

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(texts(batch))
        return with_columns(batch, {"x": pa.array(list(x), pa.list_(pa.float64()))}, drop=("text",))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = mapped(sample, spec, f"doc_id {id_type}, y int, x array<double>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).select("y", "x").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(rows.num_rows, len(FEATURES))
    return fit(x, rows["y"].to_numpy(), **options)


def score_quality(df: DataFrame, model: Gam, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and ``score`` (0 to 1, higher: label 1 is likelier). No shuffle."""
    df = df.select(*keep, "text")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        return with_columns(batch, {"score": pa.array(sent.value.scores(matrix(texts(batch))))}, drop=("text",))

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return mapped(df, spec, f"{given}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches ``threshold``) of each row of ``docs``."""
    scored = score_quality(docs, fit_quality(docs, labels, max_rows), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
