import hashlib
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.llm import merkle as M

SMALL = str.maketrans(M.CAPITALS, M.SMALL)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proof_tree(nodes):
    """Root, and for each node its siblings and the runs that it is in: (run, place)."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(at):
            steps[k].append((runs[p // 16], p % 16))
        at, nodes = [p // 16 for p in at], [digest(*r) for r in runs]
    return nodes[0], steps


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: proof_tree([leaf(r) for r in of[s]]) for s in sources}
    root, upper = proof_tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for r, low in zip(of[s], trees[s][1], strict=True):
            steps = low + upper[k]
            siblings = [d for run, p in steps for d in run[:p] + run[p + 1 :]]
            text = r[4].translate(SMALL) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
            folded = leaf((*r[:4], text))
            for run, p in steps:
                folded = digest(*run[:p], folded, *run[p + 1 :])
            out.append((r[0], leaf(r), trees[s][0], root, digest(*siblings), folded, folded == root))
    return sorted(out, key=str)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("sizes", [[1], [16, 1], [17], [256, 257, 2], [1] * 40, [600, 15, 33]])
def test_against_brute_force(spark, sizes):
    rows = [(1000 * s + i, f"s{s}é" if s else None, "en", i, f"Text {s} {i} É" if i % 3 else f"plain {i}") for s, n in enumerate(sizes) for i in range(n)]
    got = M.audit(frame_of(spark, rows[::-1]).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_rows(spark, odd_rows, prose):
    rows = [(d, None if d == 4 else "", None, None, t) for d, t in odd_rows] + [(-7, "ß", "EN", -1, "A"), (10, "ß", "EN", 2**40, "ÀB|1:c"), (11, "ß", "", 0, prose(3, 60000).upper())]
    got = M.audit(frame_of(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_tampering_shows_where_text_changes(spark):
    rows = [(i, "s", "en", 1, "Changed" if i % 2 else "the same") for i in range(200)]
    got = {r.doc_id: r.verified for r in M.audit(frame_of(spark, rows)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200)}


def test_any_change_of_a_step_changes_the_root(spark):
    rows = [(i, "s", "en", 1, str(i)) for i in range(40)]
    found = M.proofs(M.build(frame_of(spark, rows)))
    worse = F.transform("up", lambda s: F.struct(F.regexp_replace(s["preimage"], "^.", "x").alias("preimage"), s["slot"].alias("slot")))
    got = found.select("root", M.fold(F.col("hash"), F.col("up")).alias("right"), M.fold(F.col("hash"), worse).alias("wrong"), F.size("up").alias("n"), F.max(F.length(F.element_at("up", 1)["preimage"])).over(Window.partitionBy()).alias("most")).collect()
    assert all(r.right == r.root and r.n == 2 and r.most == 16 * 64 for r in got) and any(r.wrong != r.root for r in got)


def test_empty_table_and_clashing_names(spark):
    none = frame_of(spark, []).withColumn("leaf", F.lit(1))
    assert M.audit(none).collect() == []
    rows = [(i, "s", "en", 1, str(i)) for i in range(20)]
    odd = frame_of(spark, rows)
    for c in ("pos", "_place", "_read", "tree", "size", "hash", "up", "root", "changed", "preimage"):
        odd = odd.withColumn(c, F.lit("q"))
    assert sorted(map(tuple, M.audit(odd).collect()), key=str) == brute(rows)


def test_places_within_groups(spark):
    from marginalia.llm.common import numbered

    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("v"))
    got = numbered(df, [F.col("g"), F.col("v")], ("g",)).collect()
    for g in range(3):
        assert [(r.v, r.pos) for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == [(v, i) for i, v in enumerate(sorted(-x for x in range(5000) if x % 3 == g))]
