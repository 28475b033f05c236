"""A Merkle manifest of a dataset, proofs for every row, and their verification, by parent preimages.

Each row is a leaf: the digest of its columns, each written with its length. The leaves of a
source are numbered in order of doc_id; every ``FAN`` consecutive nodes make a parent, until
one is left, the source's subroot. Subroots, in order of their source, make the root likewise.

A parent's row keeps its preimage: the digests of its children, joined. That is all a proof
needs. A node with its place among the children finds its siblings by cutting its own 64
characters out of the preimage, and the parent that a changed node would have by putting the
new digest there. So nothing is stored per leaf. Paths are joined from the root down, a row
per parent; leaves join the path of their first parent at the end, and a leaf's path of
preimages never crosses an exchange.

A source may hold any part of all rows: places come from ranges of (source, doc_id) over all
tasks (``common.numbered``), and all other exchanges are by parents, which have ``FAN`` children
at most. The driver learns the number of rows and of levels only.

Defined cases: a null column is ``-``; an empty text is ``0:``; a null source is a source, first in
order; null ids come first in theirs; rows with equal ids stand in order of their digests, and
equal rows in any order, each with a place and a proof of its own; a row without id is never tampered
with; texts of any length count whole; an empty table has no leaf and no root; other columns play no part, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, numbered

FAN = 16
DIGEST = 64  # characters
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A column's part of a leaf: its UTF-8 length and itself."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(**instead: Column) -> Column:
    """The digest of a row; ``instead`` replaces columns."""
    return F.sha2(F.concat(*(field(instead.get(c, F.col(c))) for c in COLUMNS)), 256)


@dataclass(frozen=True)
class Manifest:
    """Written tables: ``leaves`` (tree, size, pos, hash and what came with the leaf), the levels above (tree, size, pos,
    preimage, hash), and ``tops`` (tree, source, subroot, root, up: the path from subroot to root)."""

    leaves: DataFrame
    levels: tuple[DataFrame, ...]
    tops: DataFrame


def grow(leaves: DataFrame, name: str) -> tuple[DataFrame, ...]:
    """The levels above ``leaves`` (tree, size, pos, hash); a tree is on the levels up to that of its only node."""
    most, rows = leaves.agg(F.max("size"), F.count(F.lit(1))).first()
    levels, nodes, width = [], leaves, 1
    while width < (most or 0):
        child = F.struct("pos", "hash")
        runs = nodes.filter(F.col("size") > width).groupBy("tree", "size", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.array_sort(F.collect_list(child)).alias("run"))
        parents = runs.select("tree", "size", "pos", F.concat_ws("", F.col("run.hash")).alias("preimage"))
        rows //= 2  # a parent of the first level has two children, or its tree has other parents
        nodes = materialise(parents.withColumn("hash", F.sha2("preimage", 256)), f"{name}-{len(levels) + 1}", rows)
        levels.append(nodes)
        width *= FAN
    return tuple(levels)


def apexes(leaves: DataFrame, levels: tuple[DataFrame, ...]) -> DataFrame:
    """The one node (tree, hash) in which each tree ends."""
    return reduce(DataFrame.union, (nodes.filter(F.col("size") <= FAN**k).select("tree", "hash") for k, nodes in enumerate((leaves, *levels))))


def climb(leaves: DataFrame, levels: tuple[DataFrame, ...], tops: DataFrame) -> DataFrame:
    """``leaves`` and the columns of ``tops``, whose up, the path above a tree, is led down to the leaf.

    A path is an array of steps (preimage of the parent, place in it), from the leaf upwards.
    """
    above = None
    carried = [c for c in tops.columns if c not in ("tree", "up")]
    tables = (leaves, *levels)
    for k in reversed(range(len(tables))):
        nodes = tables[k]
        end = nodes.filter(F.col("size") <= FAN**k).join(tops, "tree").select(*nodes.columns, "up", *carried)
        if above is not None:
            step = F.struct(F.col("_preimage").alias("preimage"), (F.col("pos") % FAN).cast("int").alias("slot"))
            inner = nodes.filter(F.col("size") > FAN**k).join(above, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("pos") / FAN) == F.col("_pos")))
            end = end.union(inner.select(*nodes.columns, F.concat(F.array(step), F.col("up")).alias("up"), *carried))
        above = end if k == 0 else end.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("preimage").alias("_preimage"), "up", *carried)
    return above


def build(docs: DataFrame, **kept: Column) -> Manifest:
    """The manifest of ``docs`` (``COLUMNS``). ``kept``: further columns of a leaf, evaluated over ``docs``."""
    rows = docs.select("doc_id", "source", leaf_of().alias("hash"), *(c.alias(n) for n, c in kept.items()))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("hash")]
    placed = numbered(rows, order, ("source",), "merkle-leaves")
    sources = placed.groupBy("source").agg((F.max("pos") + 1).alias("size"))
    sources = materialise(numbered(sources, [F.col("source").asc_nulls_first()], (), "merkle-sources").withColumnRenamed("pos", "tree"), "merkle-trees", 0)
    of = sources.withColumnRenamed("source", "_source")
    # a row per source on one side; if that is too large to be sent, this exchange is the join's own, so a large source's part can be split
    leaves = placed.join(of, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "size", "pos", "hash", "doc_id", *kept)
    leaves = materialise(leaves, "merkle-placed")
    levels = grow(leaves, "merkle-level")
    subroots = apexes(leaves, levels).withColumnRenamed("hash", "subroot")
    n = sources.count()
    upper = materialise(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("tree").alias("pos"), F.col("subroot").alias("hash")), "merkle-subroots", n)
    upper_levels = grow(upper, "merkle-upper")
    step = "array<struct<preimage: string, slot: int>>"
    root = apexes(upper, upper_levels).select("tree", F.col("hash").alias("root"), F.array().cast(step).alias("up"))
    tops = climb(upper, upper_levels, root).select(F.col("pos").alias("_pos"), F.col("hash").alias("subroot"), "root", "up")
    tops = tops.join(sources, F.col("_pos") == F.col("tree")).select("tree", "source", "subroot", "root", "up")
    return Manifest(leaves, levels, materialise(tops, "merkle-tops", n))


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its path, source, subroot and root."""
    return climb(manifest.leaves, manifest.levels, manifest.tops)


def own(slot: Column) -> Column:
    """Where a child's digest begins in its parent's preimage, counted from 1."""
    return (slot * DIGEST + 1).cast("int")


def siblings(up: Column) -> Column:
    """The siblings' digests, from the leaf's level to the root's, each level from left to right."""
    return F.concat_ws("", F.transform(up, lambda s: F.overlay(s["preimage"], F.lit(""), own(s["slot"]), F.lit(DIGEST))))


def fold(digest: Column, up: Column) -> Column:
    """The root that follows from a leaf's digest and the preimages above it."""
    return F.aggregate(up, digest, lambda below, s: F.sha2(F.overlay(s["preimage"], below, own(s["slot"]), F.lit(DIGEST)), 256))


def tampered() -> Column:
    """The rows of the trial of tampering: of five ids one, by its checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def audit(docs: DataFrame) -> DataFrame:
    """Build the manifest, tamper with some texts (A-Z lower-cased), fold every leaf to a root and compare."""
    changed = F.when(tampered(), leaf_of(text=F.translate("text", CAPITALS, SMALL)))
    found = proofs(build(docs, changed=changed))
    now = F.coalesce("changed", "hash")
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("up")), 256).alias("proof_sha256"), fold(now, F.col("up")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
