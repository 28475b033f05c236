"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A sentence's probability is the sigmoid of summed token weights; a document is toxic with
the noisy-or of its sentences, 1 - prod(1 - p). Weights are trained from document labels
through the noisy-or (gradient steps on the driver, from a bounded sample of labelled rows);
the sentence scores then tell where in a document the offence lies. Tokens are whole words
and their first four and five characters, so that inflected forms share weight.

The sample: at most ``max_rows`` labelled rows of each label, those of the smallest hash of
their id, up to ``max_chars`` characters together; rows weigh as much as their label does
among all labels. Weights are learned for the tokens that tell the labels apart best, as many
as the sample has toxic documents (20 at least); more would fit noise.

Defined cases: a null text counts as empty; a text without words has no sentence and score 0;
rows without a label are not learned from; without rows of both labels every score is the
smoothed share of label 1 (0 where there is no sentence); sentences end at . ! ? or a line end;
texts of any length are scored whole; rows that repeat are scored alike, and each is learned
from; rows of the sample with equal hashes stand in order of id, then of their text's hash; an
empty table gives an empty result; columns to be kept may have any names but those added.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import mapped, texts, trim, with_columns
from marginalia.llm.quality_gam import held_out, labelled_sample

#: A-Z to a-z; . ! ? and line ends to byte 1; other ASCII but letters, digits and ' to blanks. Lengths stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 1 if b in b".!?\n" else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(first byte, end, words) of each sentence that has a word."""
    out, at = [], 0
    for part in text.translate(FOLD).split(b"\x01"):
        words = part.split()
        if words:
            out.append((at, at + len(part), words))
        at += len(part) + 1
    return out


def tokens(word: bytes) -> list[bytes]:
    """The word, and its first four and five characters (of longer words)."""
    out = [word]
    if len(word) > 4:
        chars = word.decode(errors="replace")
        out += [f"{chars[:k]}\x02".encode() for k in (4, 5) if len(chars) > k]
    return out


@dataclass
class MilModel:
    bias: float = 0.0
    weights: dict[bytes, float] = field(default_factory=dict)
    constant: float | None = None  # the score where nothing could be learned

    def word_weight(self, word: bytes) -> float:
        get = self.weights.get
        return sum(get(t, 0.0) for t in tokens(word))

    def score(self, text: bytes, cache: dict[bytes, float]) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (first byte, end, score) of each sentence."""
        found = sentences(text)
        if self.constant is not None:
            return (self.constant if found else 0.0), [(a, b, self.constant) for a, b, _ in found]
        clean, out = 0.0, []
        for a, b, words in found:
            z = self.bias
            for w in words:
                if (v := cache.get(w)) is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    v = cache[w] = self.word_weight(w)
                z += v
            z = min(z, 35.0)
            e = np.exp(z) if z > -700 else 0.0
            clean -= np.log1p(e)
            out.append((a, b, float(e / (1 + e))))
        return float(-np.expm1(clean)), out


def train(bags: list[list[list[bytes]]], y: np.ndarray, weight: np.ndarray, least: int = 3, tokens_per_document: float = 1.0, steps: int = 300, rate: float = 0.1, l2: float = 0.05) -> MilModel:
    """Adam on the mean weighted log loss of the noisy-or. ``bags``: the token lists of each document's sentences."""
    share = float((weight * y).sum() + 1) / float(weight.sum() + 2)
    if not len(y) or y.min() == y.max():
        return MilModel(constant=share)
    in_docs: list[dict[bytes, int]] = [{}, {}]
    for bag, label in zip(bags, y.tolist(), strict=True):
        for t in {t for s in bag for t in s}:
            in_docs[int(label)][t] = in_docs[int(label)].get(t, 0) + 1
    neg, pos = in_docs
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    # the tokens whose shares of documents lie most deviations apart, as many as toxic documents; more would fit noise
    found = []
    for t in pos.keys() | neg.keys():
        a, b = pos.get(t, 0), neg.get(t, 0)
        if a + b >= least:
            both = (a + b) / (n1 + n0)
            found.append((-abs(a / n1 - b / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12), t))
    names = [t for _, t in sorted(found)[: max(20, int(n1 * tokens_per_document))]]
    index = {t: i for i, t in enumerate(sorted(names))}
    sent, tok, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            here = [index[t] for t in s if t in index]
            sent += [len(doc_of)] * len(here)
            tok += here
            doc_of.append(d)
    sent, tok, doc_of = np.array(sent, np.int64), np.array(tok, np.int64), np.array(doc_of, np.int64)
    w, bias = np.zeros(len(index)), -3.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    scale = weight / weight.sum()
    for t in range(1, steps + 1):
        z = np.clip(bias + np.bincount(sent, w[tok], len(doc_of)), -35, 35)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc_of, np.log1p(np.exp(z)), len(y))  # -log of the share of no offence
        toxic = np.maximum(-np.expm1(-clean), 1e-12)
        # d loss / d clean: 1 for label 0, -exp(-clean) / toxic for label 1
        slope = scale * np.where(y == 1, -np.exp(-clean) / toxic, 1.0)
        dz = slope[doc_of] * p
        grad = np.append(np.bincount(tok, dz[sent], len(w)) + l2 * w / len(y), dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    keep = np.abs(w) > 1e-3
    return MilModel(float(bias), {t: float(w[i]) for t, i in index.items() if keep[i]})


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 2_500, max_chars: int = 100_000_000, **options) -> MilModel:
    """Learn ``labels.toxic`` from at most ``max_rows`` rows, and ``max_chars`` characters, of each label whose id is not held out."""
    shares = {r["y"]: r["n"] for r in labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bags, y, weight = [], [], []
    known: dict[bytes, list[bytes]] = {}  # each token is held once

    def bag(text: str) -> list[list[bytes]]:
        return [[t for w in words for t in (known.get(w) or known.setdefault(w, tokens(w)))] for _, _, words in sentences(text.encode())]

    for label in (0, 1):
        sample = labelled_sample(docs, labels, "toxic", max_rows, ~held_out() & (F.col("y") == label))
        rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows).select("text")
        own, held = [], 0
        for r in rows.toLocalIterator():
            held += len(r["text"] or "")
            if held > max_chars and own:
                break
            if b := bag(r["text"] or ""):
                own.append(b)
        bags += own
        y += [label] * len(own)
        weight += [shares.get(label, 0) / max(1, len(own))] * len(own)
    model = train(bags, np.array(y, np.float64), np.array(weight, np.float64), **options)
    del bags, known
    trim()
    return model


def score_toxicity(df: DataFrame, model: MilModel, keep: list[str], at_least: float = 0.5) -> DataFrame:
    """Columns ``keep`` of ``df``, ``score``, and ``offending``: the byte spans of sentences that score ``at_least``. No shuffle."""
    df = df.select(*keep, "text")
    sent = df.sparkSession.sparkContext.broadcast(model)
    cache: dict[bytes, float] = {}

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.score(t, cache) for t in texts(batch)]
        where = [[{"a": a, "b": b, "score": p} for a, b, p in s if p >= at_least] for _, s in found]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())]))
        return with_columns(batch, {"score": pa.array([s for s, _ in found], pa.float64()), "offending": pa.array(where, kind)}, drop=("text",))

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return mapped(df, spec, f"{given}, score double, offending array<struct<a: long, b: long, score: double>>")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 2_500) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score reaches ``threshold``) and the number of offending sentences."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, max_rows), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def reject_toxic(docs: DataFrame, model: MilModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``. Their texts travel once."""
    rest = [c for c in docs.columns if c != "text"]
    filler = "_" * (1 + max(map(len, rest), default=0))  # a struct must not be empty; longer than any other name
    row = docs.select(F.struct(F.lit(0).alias(filler), *rest).alias("_row"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[bytes, float] = {}

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([sent.value.score(t, cache)[0] < threshold for t in texts(batch)], pa.bool_()))

    kept = mapped(row, spec, f"_row {row.schema['_row'].dataType.simpleString()}, text string")
    return kept.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))
