import hashlib
import random
import re

import pytest

from marginalia.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items, window=10):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_against_windows(spark, frame, prose, odd_rows, block):
    items = [(i, prose(500 + i, random.Random(i).choice([1, 3, 9, 10, 11, 40]))) for i in range(12)] + [(3, prose(503, 11)), (90, None), (91, "!!"), (92, prose(511, 40))]
    rows = list(odd_rows)
    for i in range(30):
        part = (items[i % 12][1] or "").split()
        cut = " ".join(part[: max(1, len(part) - i % 3)])
        rows.append((100 + i, prose(i, 20) + " " + cut.upper() + ", " + prose(900 + i, 15)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(frame(rows).withColumnRenamed("lang", "hits"), bench, block_words=block).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *brute(t, items)) for i, t in rows)


def test_many_blocks_run_one_worker_at_a_time(spark, frame, prose):
    items = [(i, prose(700 + i, 40)) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.item_blocks(bench, 10, 150)[1] >= 20
    rows = [(i, prose(i, 20) + " " + items[i % 60][1] + " " + items[(7 * i) % 60][1] + " " + prose(900 + i, 15)) for i in range(80)] + [(i, prose(3000 + i, 50)) for i in range(80, 120)]
    found = D.find_contamination(frame(rows), bench, block_words=150)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == sorted((i, *brute(t, items)) for i, t in rows)
    cut = D.decontaminate(frame(rows), bench, block_words=150).orderBy("doc_id").collect()
    whole = D.decontaminate(frame(rows), bench).orderBy("doc_id").collect()
    assert cut == whole and len(cut) < len(rows)


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(3)
    seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    a = D.SuffixAutomaton()
    for s in seqs:
        a.add(s)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}

    def accepts(t):
        state = 0
        for x in t:
            if x not in a.next[state]:
                return False
            state = a.next[state][x]
        return True

    for n in range(1, 6):
        for k in range(3**n):
            t = tuple(k // 3**i % 3 for i in range(n))
            assert accepts(t) == (t in subs)


def test_empty_benchmark_and_empty_documents(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in D.find_contamination(frame([(1, "a b")]), none).collect()] == [False]
    assert D.find_contamination(frame([]), none).count() == 0


def test_cutting(spark, frame, prose):
    passage, clean = prose(1, 30), prose(2, 80)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = frame([(1, clean + "\n" + passage + "\nand so on"), (2, clean), (3, passage), (4, None)]).withColumnRenamed("lang", "hits")
    got = {r["doc_id"]: r for r in D.decontaminate(df, bench).collect()}
    assert set(got) == {1, 2, 4} and got[2]["text"] == clean and got[4]["text"] is None
    assert got[1]["text"].startswith(clean) and got[1]["text"].endswith("and so on") and passage[:-1] not in got[1]["text"]
    assert got[1].asDict().keys() == set(df.columns)
