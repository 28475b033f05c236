import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from marginalia.llm import toxicity_mil
from marginalia.llm.queries import vocabulary
from marginalia.llm.repair_tokens import tokenizer
from test_circulant_minhash import brute as near
from test_decontaminate import LOWER, WORD
from test_mixing import brute as mixed


def cut(text, items, window=10, most=0.5):
    """Words inside windows go, with what lies between words of one run; a document of too many goes."""
    t = text.translate(LOWER)
    at = [m.span() for m in WORD.finditer(t)]
    w = [t[a:b] for a, b in at]
    hit = set()
    for v in items:
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
    if len(hit) > most * max(1, len(w)):
        return None
    out, pos = [], 0
    for i in range(len(w)):
        if i in hit and i - 1 not in hit:
            out.append(text[pos : at[i][0]])
        if i in hit:
            pos = at[i][1]
    return "".join([*out, text[pos:]])


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    bad = ["vile", "rotten", "nasty"]
    bench = [prose(7000 + i, 25) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        text = prose(i, 40 + i % 30)
        if i % 6 == 0:
            text += f" You {bad[i % 3]} {bad[(i + 1) % 3]} thing. " + prose(3000 + i, 10)
        if i % 11 == 0:
            text += " " + bench[i % 5]
        if i % 13 == 0:
            text = bench[i % 5]
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, i % 2, int(i % 6 == 0)))
    for i in range(30):  # near copies
        text = docs[i + 60][1] + " more"
        docs.append((1000 + i, text, "en", "s0", len(text)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, labels, bench


def test_stages_against_brute_force(spark, folder):
    at, docs, labels, bench = folder
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    model = toxicity_mil.fit_toxicity(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    left = [d for d in docs if model.score(d[1].encode(), {})[0] < 0.7]
    gone = {d[0] for d in docs} - {d[0] for d in left}
    truth = {i for i, _, t in labels if t} - {i for i in range(0, 240, 13)}
    assert len(gone & truth) >= 0.9 * len(truth) and len(gone - {i for i, _, t in labels if t} - set(range(1000, 1030))) <= 5
    keep = {c for d, n, c, kept in near([(d[0], d[1]) for d in left], 5) if kept}
    left = [d for d in left if d[0] in keep]
    items = [[w for w in WORD.findall(b.translate(LOWER))] for b in bench]
    left = [(d[0], t, d[3]) for d in left if (t := cut(d[1], items)) is not None]
    quality = {i: q for i, q, _ in labels}
    rows = mixed(left, quality)
    want = Counter()
    for (i, n, _, _, taken), (_, text, _) in zip(rows, left, strict=True):
        ids = [*tokenizer(vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += taken // n if n else 0
    got = P.run(spark, at).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == +want
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_columns_stay(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.dtypes == docs.dtypes


DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_` string, hits long, node long, band string"


@pytest.mark.parametrize("some", [True, False])
def test_odd_tables(spark, odd_rows, prose, tmp_path, some):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names; and no rows at all."""
    at = f"file://{tmp_path}"
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None if k % 5 else 7, "x", 1, None, "b") for k, (i, t) in enumerate([*odd_rows, *odd_rows[-3:], (9, prose(31, 60)), (10, prose(31, 60))])]
    spark.createDataFrame(rows if some else [], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(None, None, None), (6, 1, 0), (9, None, 1), (9, 0, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, prose(31, 60))] if some else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = P.materialise(stage(spark, docs, at), "odd")
        assert docs.columns == [c.split()[0].strip("`") for c in DOCS.split(", ")]
    got = P.STAGES[-1][1](spark, docs, at).collect()
    if not some:
        assert got == []
        return
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert (6, prose(1, 30000)) in left and not {9, 10} & {i for i, _ in left}  # the latter are all benchmark
    assert set(left) <= {(i, t) for i, t, *_ in rows} and Counter(r["doc_id"] for r in got) == Counter(i for i, _ in left)


def test_pattern_of_the_contract():
    assert re.findall(WORD, "a1-B ü.") == ["a1", "ü"]
