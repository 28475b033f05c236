"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws a key, -ln(u) / weight, where u comes from a digest of its id and text
and weight from its quality; the smaller, the earlier. A source's target is met by complete
epochs of all its documents, then by the documents whose keys come first, up to the document
at which the sum of sizes comes nearest to what is left.

A source may hold a third of all rows, so it is never sorted in one task: keys are cut into
slices (about as many as a slice has rows); sums by slice give the slice in which the budget
ends, and only the rows of that slice are sorted. Targets are computed over one row per source.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its
own, last in order; rows with equal id and text have equal keys and are taken together; a
source of size 0 has target 0; texts of any length count whole; an empty table gives an
empty mix; other columns may have any names. Results depend on the rows
alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialise

WEIGHTS = (5, 2, 1)
MOST = 3  # times that a document may be taken
SENT_SOURCES = 10_000  # more are joined without a broadcast
SLICE_ROWS = 2_000  # or the square root of a source's rows, so that slices and rows of a slice grow alike
LEAST_WEIGHT = 0.5  # documents' quality weights are held between this and its fourfold


def size_of(text: str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(weight: Column, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The exponential key: 52 bits of a digest make a uniform number within (0, 1)."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / F.greatest(F.least(weight, F.lit(4 * LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))


def slice_of(key: Column, slices: Column) -> Column:
    """A non-decreasing function of the key, under which no slice expects over four times its share of rows."""
    return F.least(F.floor((1 - F.exp(-LEAST_WEIGHT * key)) * slices), slices - 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size, rows; a row per source) with target.

    Sharing all excess again by weight until no target is above ``most`` sizes is water filling: in order of
    size per weight, a source is full if its limit is below its share of what the sources before it left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(filling), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filling), F.lit(0))
    weighed = weighed.withColumn("left", left).withColumn("weight", weight)
    full = most * F.col("source_size") * F.col("weight") <= F.col("w") * F.col("left")
    # the first source that is not full sets the level for all that are not
    level = F.min(F.when(~full, F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("left").alias("left"), F.col("weight").alias("by")))).over(everything)
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise((F.col("w") * level["left"]).cast("double") / level["by"])
    return weighed.select("source", "source_size", "rows", target.alias("target"))


def few_sources(sized: DataFrame) -> bool:
    """Whether a table with a row per source is small enough to be broadcast: its size is checked, not assumed."""
    names = sized.groupBy("source").agg(F.lit(1).alias("one")).limit(SENT_SOURCES + 1)
    found = names.agg(F.count("one").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    return found["n"] <= SENT_SOURCES and found["bytes"] <= 100 * SENT_SOURCES


def same_source(left: str, right: str, few: bool) -> Column:
    """Equal sources, null to null. Their hashes as a further key keep a large source's partition divisible, where sides are exchanged."""
    same = F.col(left).eqNullSafe(F.col(right))
    return same if few else same & (F.xxhash64(left) == F.xxhash64(right))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slice_rows: int = SLICE_ROWS, few: bool = False) -> DataFrame:
    """A row per source of ``sized`` (source, size, key): its target, epochs, and where the last, partial epoch ends."""
    send = F.broadcast if few else lambda df: df
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets(sizes, weights, most).withColumn("epochs", F.least(whole, F.lit(most)))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = goal.withColumn("slices", F.ceil(F.col("rows") / F.greatest(F.lit(float(slice_rows)), F.sqrt("rows"))).cast("long"))
    goal = goal.withColumnRenamed("source", "of")
    here = same_source("source", "of", few)
    cut = sized.join(send(goal.select("of", "slices")), here).select("source", "size", "key", slice_of(F.col("key"), F.col("slices")).alias("slice"))
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    upto = F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice"))
    ends = sums.withColumn("upto", upto).join(send(goal.select("of", "rest")), here).filter("rest > 0 and upto >= rest and upto - in_slice < rest")
    ends = ends.select(F.col("source").alias("end_of"), F.col("slice").alias("end"), (F.col("upto") - F.col("in_slice")).alias("earlier"), "rest")
    inside = cut.join(send(ends), same_source("source", "end_of", few) & (F.col("slice") == F.col("end")))
    groups = inside.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("earlier").alias("earlier"), F.first("rest").alias("rest"))
    through = F.col("earlier") + F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    near = groups.withColumn("through", through).filter(2 * F.col("through") - F.col("size") <= 2 * F.col("rest"))
    near = near.groupBy("source").agg(F.max("key").alias("cut"))
    last = ends.join(near, F.col("source").eqNullSafe(F.col("end_of")), "left").select("end_of", F.col("end").alias("slice"), F.coalesce("cut", F.lit(-1.0)).alias("cut"))
    done = goal.join(last, F.col("end_of").eqNullSafe(F.col("of")), "left")
    return done.select(F.col("of").alias("source"), "source_size", "rows", "target", "epochs", "slices", F.coalesce("slice", F.lit(-1)).alias("slice"), F.coalesce("cut", F.lit(-1.0)).alias("cut"))


def times(key: Column) -> Column:
    """How often a document of this key is taken, by the columns of its source's plan."""
    at = slice_of(key, F.col("slices"))
    return F.col("epochs") + F.when((at < F.col("slice")) | ((at == F.col("slice")) & (key <= F.col("cut"))), 1).otherwise(0)


def weighed(docs: DataFrame, labels: DataFrame | None, columns: list) -> DataFrame:
    """``columns`` of ``docs`` and weight: 2 for labels.quality 1, 0.5 for 0, else 1."""
    if labels is None:
        return docs.select(*columns, F.lit(1.0).alias("weight"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_of")).agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return docs.select(*columns).join(known, F.col("_id") == F.col("label_of"), "left").withColumn("weight", weight).drop("label_of", "quality")


def mix(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row of ``docs`` (doc_id, text, source)."""
    drawn = weighed(docs, labels, [F.col("doc_id").alias("_id"), "source", size_of().alias("size"), key_of(F.lit(1.0)).alias("_key")])
    # dividing by the weight of 1 first and by the true one now gives the same key
    sized = materialise(drawn.select(F.col("_id").alias("doc_id"), "source", "size", (F.col("_key") / F.col("weight")).alias("key")), "mix-sizes")
    few = few_sources(sized)
    goal = plan(sized, weights, most, slice_rows, few).withColumnRenamed("source", "of")
    return sized.join(F.broadcast(goal) if few else goal, same_source("source", "of", few)).select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("key"))).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as it is taken (documents of size 0: in each full epoch)."""
    row = [F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id")]
    key = (F.col("_key") / F.col("weight")).alias("key")
    narrow = weighed(docs, labels, [F.col("doc_id").alias("_id"), "source", size_of().alias("size"), key_of(F.lit(1.0)).alias("_key")])
    sized = materialise(narrow.select("source", "size", key), "mix-sizes")
    few = few_sources(sized)
    goal = materialise(plan(sized, weights, most, slice_rows, few), "mix-plan", 0).withColumnRenamed("source", "of")
    rows = weighed(docs, labels, [*row, F.col("source"), key_of(F.lit(1.0)).alias("_key")]).select("_row", "source", key)
    rows = rows.join(F.broadcast(goal) if few else goal, same_source("source", "of", few)).select("_row", times(F.col("key")).cast("int").alias("n"))
    rows = rows.filter("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
