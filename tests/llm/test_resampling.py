import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import resampling as R

LOWER = str.maketrans(R.CAPITALS, R.SMALL)


def features(text):
    w = re.findall(R.WORD, (text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(docs, target, least=20, percent=25):
    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for f in found for b in f[2]), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)]
    rows = []
    for d, n, bs in found:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((i for i, r in enumerate(rows) if r[4] >= least), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    rank = {i: k + 1 for k, i in enumerate(may[: percent * len(may) // 100])}
    return sorted(((*r[:4], rank.get(i)) for i, r in enumerate(rows)), key=str)


def tables(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")


def test_against_brute_force(spark, prose, odd_rows):
    docs = [(i, prose(i % 90, 5 + i % 60).title()) for i in range(400)] + odd_rows + [(900, "É é ß Ω 漢字 a-b_c`d{e}f " * 30)]
    target = [prose(i, 40) for i in range(0, 90, 9)] + [None, "", "one"]
    assert sorted(map(tuple, R.draw(*tables(spark, docs, target)).collect()), key=str) == brute(docs, target)


@pytest.mark.parametrize("docs,target", [([], ["a b"]), ([(1, "a b c")], []), ([(1, None), (2, "")], [None]), ([(None, "w " * 30)] * 8 + [(3, "v " * 30)] * 8, ["v"])])
def test_small_tables(spark, docs, target):
    assert sorted(map(tuple, R.draw(*tables(spark, docs, target)).collect()), key=str) == brute(docs, target)


def test_the_draw_leans_to_the_target_and_rows_come_whole(spark, prose):
    docs = [(i, " ".join(["near" if i % 4 == 0 else "far"] * 15) + " " + prose(i, 40)) for i in range(400)]
    docs, target = tables(spark, docs, ["near near near near"] * 200)
    for c in ("weight", "score", "n_words", "buckets", "_row", "rank", "pos"):
        docs = docs.withColumn(c, F.lit(c))
    got = {r.doc_id for r in R.draw(docs, target).collect() if r["rank"] is not None}
    rows = R.drawn_rows(docs, target)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == got and len(got) == 100
    assert sum(i % 4 == 0 for i in got) > 60


def test_scoring_neither_explodes_nor_shuffles(spark, prose):
    docs, _ = tables(spark, [(1, prose(1, 50))], [])
    plan = R.scored(R.featurise(docs, "doc_id"), list(range(10000)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1  # the fixture's own
    assert "split(" not in plan  # the gains are one constant
