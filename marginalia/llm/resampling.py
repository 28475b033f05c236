"""Importance resampling towards a target text, with hashed word and word-pair features.

A document's features are its words and its pairs of consecutive words; each falls into one of
``BUCKETS`` buckets. Buckets are counted over all documents and over the target; the gain of
a bucket is the logarithm of the ratio of its smoothed shares, and a document's weight the mean
gain of its features. Documents are drawn without replacement by weight plus Gumbel noise
from a digest of their id (the greatest sums are a draw in proportion to exponential weights).

Scoring explodes nothing: higher-order functions make a document's array of buckets, which is
written once, and fold it over a literal array of gains. For the counts the arrays are
exploded inside their task and added up there, so only totals, at most ``BUCKETS`` of a task,
are shuffled; the driver gets ``BUCKETS`` gains. Ranks are places in ranges of
(score, id) over all tasks, so neither a source nor equal scores gather in one.

Defined cases: a null or empty text has no features, weight 0, and too few words to be drawn; a
null id has noise of the empty string and comes last among equal scores; rows of equal id and
score are ordered by their number of features, and are alike otherwise; an empty target makes gains
from the documents alone; texts of any length count whole; an empty table draws nothing;
other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, numbered

BUCKETS = 10_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and nothing else."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def bucket_of(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def buckets_of(words: str) -> Column:
    """The buckets of all words and all pairs of consecutive words."""
    w = F.col(words)
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: bucket_of(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(w, bucket_of), pairs)


def featurise(df: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns, n_words and buckets of each row's text."""
    words = df.select(*kept, words_of(F.col("text")).alias("_words"))
    return words.select(*kept, F.size("_words").cast("long").alias("n_words"), buckets_of("_words").alias("buckets"))


def counted(features: DataFrame) -> DataFrame:
    """How often each bucket occurs; added up in each task first."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """1000 times the log ratio of each bucket's smoothed share of ``target`` and of ``source`` (bucket, n), floored."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    found = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = found.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t")).first()
    share = (F.col("t") + 1) * (totals["all_s"] + BUCKETS) / ((F.col("s") + 1) * (totals["all_t"] + BUCKETS))
    every = F.broadcast(found.withColumnRenamed("bucket", "_bucket"))  # BUCKETS rows at most
    every = found.sparkSession.range(BUCKETS).join(every, F.col("id") == F.col("_bucket"), "left").fillna(0.0, ["s", "t"])
    return [r["gain"] for r in every.select("id", F.floor(1000 * F.log(share)).alias("gain")).sort("id").collect()]


def literal_array(values: list[int]) -> Column:
    """One array of all values, folded to a constant when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def noise_of(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(features: DataFrame, by_bucket: list[int], seed: int = SEED) -> DataFrame:
    """``features`` (doc_id, buckets and more) with n_features, weight and score instead of buckets.

    The weight is the floored mean of the gains, in whole numbers.
    """
    gain = literal_array(by_bucket)
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda so_far, b: so_far + F.element_at(gain, b + 1))
    kept = [c for c in features.columns if c != "buckets"]
    summed = features.select(*kept, F.size("buckets").cast("long").alias("n_features"), total.alias("_total"))
    mean = F.expr("if(n_features > 0, (_total - pmod(_total, n_features)) div n_features, 0L)")
    out = summed.select(*kept, "n_features", mean.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise_of(F.col("doc_id"), seed))


def fit(features: DataFrame, target: DataFrame) -> list[int]:
    """The gains of all buckets; of the target (text), too, only counts leave a task."""
    return gains(counted(features), counted(featurise(target)))


def ranked(rows: DataFrame, percent: int, least_words: int) -> tuple[DataFrame, int]:
    """The rows (doc_id, n_words, n_features, weight, score) that may be drawn, with pos by falling score; and how many are."""
    may = rows.filter(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    return numbered(may, order, (), "resample-ranks"), percent * may.count() // 100


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs`` (doc_id, text); rank is null where a row is not drawn."""
    features = materialise(featurise(docs, "doc_id"), "resample-buckets")
    rows = materialise(scored(features, fit(features, target), seed), "resample-scores")
    first, n = ranked(rows, percent, least_words)
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = first.select(*columns, F.when(F.col("pos") < n, F.col("pos") + 1).alias("rank"))
    return placed.union(rows.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long")))


def drawn_rows(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, all columns. Texts are not moved: a row's score follows from itself, so the last place is a filter.

    Rows of equal id and score are drawn together.
    """
    features = materialise(featurise(docs, "doc_id"), "resample-buckets")
    by_bucket = fit(features, target)
    first, n = ranked(materialise(scored(features, by_bucket, seed), "resample-scores"), percent, least_words)
    last = first.filter(F.col("pos") == n - 1).first()
    if last is None:
        return docs.limit(0)
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    again = scored(featurise(docs.select("doc_id", "text", row), "doc_id", "_row"), by_bucket, seed).filter(F.col("n_words") >= least_words)
    tie = F.lit(True) if last["doc_id"] is None else F.col("doc_id") <= last["doc_id"]
    again = again.filter((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & F.coalesce(tie, F.lit(False))))
    return again.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
