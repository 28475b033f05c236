"""Near-duplicate documents by circulant MinHash, with every link confirmed on full shingle sets.

Two permutations make all coordinates of a signature: the first scatters a document's
shingles, the second, circularly shifted by 0, 1, 2, ..., gives a minimum per shift. Bands
of coordinates make buckets; two sets of similarity 0.8 miss all 32 buckets with odds below
one in ten million. Links found there are confirmed exactly, then joined to components.

Documents with equal sets are one node from the start, so copies cost nothing further. A
bucket never emits its pairs. Its members form a unit around a hub, the member that shares
most buckets: each is compared with the hub, and only those that do not link to it
(stragglers) with the other members, inside a task, which emits just the links that join
components. A large unit is dealt to several tasks by salt; then its members whose component
still differs from the hub's meet all members in bounded blocks. So every pair of a bucket
is compared unless it is in one component already, which cannot change the result.

Defined cases: a null or blank text has the empty set, links with nothing and is its own
component; an empty table gives an empty result; texts of any length count whole; other
columns may have any names; a text of fewer words than a shingle has its whole word sequence as one shingle;
rows with equal ids count as documents of their own; a null id is never the smallest unless
a component has no other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER_BYTES, hot_join, mapped, materialise, mix64, ship, text_or_empty, texts, trim, with_columns

BANDS, ROWS = 32, 4
SHIFTS = BANDS * ROWS
SECTION = 1 << 15  # shingles whose coordinates are computed at once
UNIT_ROWS = 1000  # members of a unit in one task
BLOCK = 256  # stragglers compared at once
_ODD = np.random.default_rng(977).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(978).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def word_cache() -> dict[bytes, int]:
    return {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    cache = word_cache()
    if len(cache) > 200_000:
        cache.clear()
    try:
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, k: int) -> np.ndarray:
    """The set of ``k``-word shingles as sorted 64-bit hashes. Words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - k + 1)
    total = np.full(n, np.uint64(min(len(h), k)))
    for j in range(min(k, len(h))):
        total += h[j : j + n] * _ODD[j]
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The ``SHIFTS`` minima of each set (not empty), as uint32: permutation, circular shift, permutation, minimum."""
    out = np.full((len(sets), SHIFTS), 0xFFFFFFFF, np.uint32)
    flat = np.concatenate(sets)
    ends = np.cumsum([len(s) for s in sets])
    first = (mix64(flat ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(flat), SECTION):
        part = first[a : a + SECTION]
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, a + len(part) - 1, side="right")
        starts = np.maximum(np.append(0, ends[i:j]) - a, 0)
        starts[0] = 0
        for shift in range(SHIFTS):
            y = part + np.uint32(shift)  # modulo 2**32: the shift is circular
            y *= np.uint32(0x9E3779B1)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x85EBCA77)
            y ^= y >> np.uint32(13)
            y *= np.uint32(0xC2B2AE3D)
            out[i : j + 1, shift] = np.minimum(out[i : j + 1, shift], np.minimum.reduceat(y, starts))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    return mix64((rows * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th, n, h1 and h2 (digest of the set), bands (empty for the empty set)."""

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in texts(batch)]
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [[] for _ in sets]
        if full:
            for i, row in zip(full, band_keys(signatures([sets[i] for i in full])).view(np.int64), strict=True):
                bands[i] = row
        digest = np.array([(xxhash.xxh3_64_intdigest(s.tobytes()), xxhash.xxh3_64_intdigest(s.tobytes(), seed=7)) for s in sets], dtype=np.uint64).view(np.int64)
        new = {"n": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array(digest[:, 0]), "h2": pa.array(digest[:, 1]), "bands": pa.array(bands, pa.list_(pa.int64()))}
        return with_columns(batch, new, drop=("text",))

    return mapped(docs, spec, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, h1 long, h2 long, bands array<long>")


class Joined:
    """Union-find of the nodes of one task, so that it emits only links that join something."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


class Postings:
    """Sets of a block, indexed by shingle, to be intersected with one set at a time."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]) -> None:
        self.nodes, self.sizes = nodes, np.array([len(s) for s in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.keys, first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.of = first, of[order]

    def linked(self, s: np.ndarray, percent: int) -> list[int]:
        """Nodes whose set links with ``s``."""
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        n = self.counts[at]
        places = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.of[places], minlength=len(self.nodes))
        hit = np.flatnonzero(100 * both >= percent * (self.sizes + len(s) - both))
        return [self.nodes[i] for i in hit.tolist()]


def pairs_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def hub_links(units: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within ``units`` (hub, node), of members dealt to one task. ``held``: (node, text)."""
    ship(units.sparkSession)
    many = units.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / UNIT_ROWS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    members = hot_join(units, many, ["hub"]).select("hub", salt.alias("salt"), "node").join(held, "node").select("hub", "salt", "node", "text")
    hubs = many.join(held.withColumnRenamed("node", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), "text")
    both = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node").asc_nulls_first())

    def run(batches):
        hub, head, linked_nodes, others, links = None, None, [], [], []

        def finish() -> None:
            """Compare stragglers with every member; all that link to the hub are one component."""
            joined = Joined()
            for x, _ in linked_nodes:
                joined.join(hub, x)
            for a in range(0, len(others), BLOCK):
                block = others[a : a + BLOCK]
                index = Postings([x for x, _ in block], [s for _, s in block])
                for y, s in [*linked_nodes, *others[a:]]:
                    links.extend((x, y) for x in index.linked(s, percent) if x != y and joined.join(x, y))

        for batch in batches:
            for h, node, text in zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), texts(batch), strict=True):
                if node is None:
                    if others:
                        finish()
                    hub, head, linked_nodes, others = h, shingles(text, k), [], []
                    continue
                s = shingles(text, k)
                if linked(head, s, percent):
                    links.append((hub, node))
                    linked_nodes.append((node, s))
                else:
                    others.append((node, s))
            if len(links) > 1000:
                yield pairs_batch(links)
                links.clear()
        if others:
            finish()
        yield pairs_batch(links)
        trim()

    return both.mapInArrow(run, "a long, b long")


def straggler_links(units: DataFrame, large: DataFrame, belongs: DataFrame, held: DataFrame, k: int, percent: int, nodes: int) -> DataFrame:
    """Links of large units that ``hub_links`` could not see, as their members were dealt to several tasks.

    ``large``: hub and rows of those units. Members of another component than the hub's, in blocks of ``BLOCK``, meet
    all members of the unit, ``UNIT_ROWS`` at a time.
    """
    own = belongs.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    rows = hot_join(units, large.join(own, "hub", "left"), ["hub"]).join(belongs, "node", "left")
    apart = F.coalesce("component", "node") != F.coalesce("hub_component", "hub")
    rows = rows.select("hub", "node", F.coalesce("component", "node").alias("component"), apart.alias("apart"), F.ceil(F.col("rows") / UNIT_ROWS).cast("int").alias("salts"))
    rows = materialise(rows, "large-units", nodes)
    blocks = rows.filter("apart").groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = hot_join(rows, blocks, ["hub"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.filter("apart").select("hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), every("salts").alias("salt"), F.lit(0).alias("role"), "node", "component")
    asked = dealt.select("hub", every("blocks").alias("block"), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "node", "component")
    both = asking.unionByName(asked).join(held, "node").repartition("hub", "block", "salt").sortWithinPartitions("hub", "block", "salt", "role", "node")

    def run(batches):
        group, index, held_nodes, held_sets, joined, links, of = None, None, [], [], Joined(), [], {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("hub", "block", "salt", "role", "node", "component")]
            for hub, block, salt, role, node, component, text in zip(*cols, texts(batch), strict=True):
                if (hub, block, salt) != group:
                    group, index, held_nodes, held_sets, of = (hub, block, salt), None, [], [], {}
                s = shingles(text, k)
                of[node] = component
                if role == 0:
                    held_nodes.append(node)
                    held_sets.append(s)
                    continue
                if not held_nodes:
                    continue  # no straggler fell into this block
                if index is None:
                    index = Postings(held_nodes, held_sets)
                links.extend((x, node) for x in index.linked(s, percent) if of[x] != component and joined.join(of[x], component))
            if links:
                yield pairs_batch(links)
                links = []

    return both.mapInArrow(run, "a long, b long")


def stars(edges: DataFrame) -> bool:
    """Whether each node has at most one edge upwards, and none that has one is at the upper end of another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, nodes: int) -> DataFrame:
    """Edges (u, v) from each node that has a link (a, b) to the smallest node it reaches, but from that itself.
    ``nodes``: about how many there are.

    Large-star and small-star steps; minima are aggregates, so no node's neighbours are gathered in one place.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    edges = materialise(edges.distinct(), "links", nodes)
    rows = edges.count()  # steps make no more
    while rows and not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = hot_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hot_join(large, least, ["u"])
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "links", rows)
    return edges


def membership(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges``, stars."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_components(df: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, component, component_id and kept of each row of ``df`` (doc_id, text).

    ``component`` is a node, null for the empty set: other than ``component_id``, it tells components apart that null
    or repeated ids have in common.
    """
    docs = df.select("doc_id", text_or_empty(df).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = materialise(sketch(docs, shingle), "sketches")
    n = rows.count()
    full = rows.filter("n > 0")
    nodes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "sets", n)

    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialise(hot_join(banded, buckets, ["band"]), "buckets", 8 * n)  # members of buckets of two or more
    degree = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    hubs = shared.join(degree, "node").groupBy("band").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    units = materialise(hot_join(shared, hubs, ["band"]).filter("node <> hub").select("hub", "node").distinct(), "units", n)

    wanted = shared.select("node").distinct().join(nodes.select("node", "at.*"), "node").withColumnsRenamed({"doc_id": "k1", "th": "k2"})
    here = F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("k2"))
    held = materialise(wanted.join(docs, here).select("node", "text").dropDuplicates(["node"]), "set-texts")

    edges = components(materialise(hub_links(units, held, shingle, percent), "links", n), n)
    large = units.groupBy("hub").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > UNIT_ROWS)
    if not large.isEmpty():
        more = materialise(straggler_links(units, large, membership(edges), held, shingle, percent, n), "links", n)
        if not more.isEmpty():
            edges = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more), n)

    # singles are left out here: a component that holds many nodes is a hot key of the join, which can be split
    linked_ = membership(edges).join(nodes.select("node", "first_id"), "node")
    least = linked_.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = nodes.select("node", "h1", "h2", "first_id").join(hot_join(linked_.select("node", "component"), least, ["component"]), "node", "left")
    named = named.select("h1", "h2", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("least_id"))
    joined = rows.select("doc_id", "th", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    id_ = F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "th", F.col("n").alias("n_shingles"), "component", id_.alias("component_id"), F.col("doc_id").eqNullSafe(id_).alias("kept"))


def near_duplicates(df: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, th, n_shingles, component_id and kept of each row of ``df`` (doc_id, text)."""
    return with_components(df, shingle, percent).drop("component")


def keep_one(df: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """All columns of ``df``, one row of each component: that of the smallest id. Rows without words all stay."""
    kept = with_components(df, shingle, percent).filter("kept")
    # rows of one id in one component count once; rows without words are each their own component
    single = kept.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("at")).select("at.*", F.lit(True).alias("once"))
    ids = single.unionByName(kept.filter("n_shingles = 0").select("doc_id", "th", F.lit(False).alias("once")).distinct())

    def key(doc_id: str) -> list:  # plain columns, so that the rows' exchange serves the join and what follows
        return [F.coalesce(F.col(doc_id), F.lit("0").cast(df.schema["doc_id"].dataType)).alias("_id"), F.col(doc_id).isNull().alias("_no_id")]

    rows = df.select(F.struct(*df.columns).alias("_row"), *key("doc_id"), F.xxhash64(text_or_empty(df)).alias("_th"))
    rows = rows.join(ids.select(*key("doc_id"), F.col("th").alias("_th"), "once"), ["_id", "_no_id", "_th"])
    copy = F.when(F.col("once"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return rows.withColumn("_copy", copy).dropDuplicates(["_id", "_no_id", "_th", "_copy"]).select(*(F.col("_row").getField(c).alias(c) for c in df.columns))
