"""Which set holds which, over tables of sets (J12, J13, T02): an inverted index on each set's rarest member, no pairs of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.storage import materialise, numbered


def _set(attrs: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.col(attrs) if isinstance(attrs, str) else attrs))


def _signature(attrs: Column) -> Column:
    """64 bits, one set for each member: a set within another has no bit that the other lacks."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)).cast("int"))
    return F.aggregate(attrs, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))


def smallest_holders(measured: DataFrame, models: DataFrame) -> DataFrame:
    """For each row of ``measured`` (id, attrs) the row of ``models`` (id, attrs, cells) that holds all its members and has the
    fewest cells, ties to the smaller id: (id, model_id), null where none does.

    A set can only lie within sets that hold its rarest member, so it meets those alone: an equi-join on that member, with a
    signature and then the members themselves compared. Members are numbered from the rarest, counted among different models:
    all others of a set have greater numbers, so a model's row for a member brings only its greater ones, as ints. Equal sets
    are looked up once. An empty set is held by the smallest model; a null one, or one with a null member, by none. Repeated
    members and rows change nothing.
    """
    sets = measured.select("id", _set("attrs").alias("attrs"))
    held = models.filter("attrs is not null").select(_set("attrs").alias("of"), F.struct("cells", "id").alias("best")).groupBy("of").agg(F.min("best").alias("best"))
    held = materialise(held.withColumn("_set", F.monotonically_increasing_id()), "holders")
    members = held.select("_set", "best.cells", "best.id", F.explode("of").alias("attr"))
    rarity = numbered(members.filter("attr is not null").groupBy("attr").agg(F.count(F.lit(1)).alias("n")), [F.col("n"), F.col("attr")], name="rarity")
    rarity = rarity.select("attr", F.col("pos").cast("int").alias("no"))
    ordered = members.join(rarity, "attr").groupBy("_set", "cells", "id").agg(F.array_sort(F.collect_list("no")).alias("nos"))
    index = ordered.select("cells", "id", "nos", F.posexplode("nos").alias("_at", "no")).select("no", "cells", "id", F.slice("nos", F.col("_at") + 2, F.size("nos")).alias("of"))
    index = index.withColumn("of_bits", _signature(F.col("of")))
    wanted = sets.select("attrs").distinct()
    found_members = wanted.select("attrs", F.explode("attrs").alias("attr")).join(rarity, "attr")
    nos = found_members.groupBy("attrs").agg(F.array_sort(F.collect_list("no")).alias("nos")).filter(F.size("nos") == F.size("attrs"))  # else a member is in no model
    probes = nos.select("attrs", F.col("nos")[0].alias("no"), F.slice("nos", F.lit(2), F.size("nos")).alias("rest"))
    probes = probes.withColumn("bits", _signature(F.col("rest")))
    inside = (F.col("bits").bitwiseAND(F.bitwise_not("of_bits")) == 0) & (F.size(F.array_except("rest", "of")) == 0)
    found = probes.join(index, "no").filter(inside).groupBy("attrs").agg(F.min(F.struct("cells", "id")).alias("best"))
    least = held.agg(F.min("best").alias("best")).select(F.array().cast(held.schema["of"].dataType).alias("attrs"), "best")  # for empty sets
    return sets.join(found.unionByName(least), "attrs", "left").select("id", F.col("best.id").alias("model_id"))
