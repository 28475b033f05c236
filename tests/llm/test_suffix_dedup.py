import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import suffix_dedup as S


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_sort(seed):
    rng = random.Random(seed)
    s = bytes(rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 150)))
    assert S.two_stage_suffix_array(np.frombuffer(s, np.uint8), 160).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_sort_of_some_suffixes(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 120)
    s = bytes(rng.randint(1, rng.choice([1, 2, 3])) for _ in range(n))
    (a, b), (c, d) = (sorted(rng.sample(range(n + 1), 2)) for _ in range(2))
    got = S.two_stage_suffix_array(np.frombuffer(s, np.uint8), 160, (np.array([a, c]), np.array([b, d]))).tolist()
    assert {*range(a, b), *range(c, d)} <= set(got) and got == [i for i in sorted(range(n), key=lambda i: s[i:]) if i in set(got)]


def brute(texts, length):
    """Count every string of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                hit[i : i + length] = b"\x01" * length
        rest = bytes(b for b, h in zip(d, hit, strict=True) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((len(d), sum(hit), runs, hashlib.sha256(rest).hexdigest()))
    return out


def planted(prose):
    shared = [prose(100 + i, 40) for i in range(4)]
    rows = []
    for i in range(40):
        text = prose(i, 60)
        if i % 3 == 0:
            text += " " + shared[i % 4] + " " + prose(1000 + i, 30)
        if i % 7 == 0:
            text = text[:200] + shared[(i + 1) % 4][5:230] + text[200:]
        rows.append((i, text))
    rows += [(50, rows[3][1]), (50, rows[3][1]), (51, "ab" * 400), (52, "z" * 300), (53, "z" * 199), (54, prose(77, 20) * 3), (55, "é" * 150 + prose(78, 20)), (56, None), (57, "")]
    return rows


@pytest.mark.parametrize("hot", [16384, 2])
def test_against_counting(frame, prose, hot):
    rows = planted(prose)
    got = S.remove_repeats(frame(rows), 200, hot).collect()
    want = sorted((str(i), *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 200), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_short_length_and_small_sections(frame, prose, monkeypatch):
    monkeypatch.setattr(S, "LONGEST", 7)
    rows = planted(prose)
    got = S.remove_repeats(frame(rows), 48).collect()
    want = sorted((str(i), *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 48), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_more_contexts_of_an_anchor_than_offsets(frame, prose):
    """A passage within half of all rows: its anchors' groups are never gathered."""
    common = "zq" + prose(5000, 6)[:38]
    rows = [(i, prose(2000 + i, 12) + common * (i % 2) + prose(3000 + i // 4 * 4, 12)) for i in range(120)]
    got = S.remove_repeats(frame(rows), 48, 1).collect()
    want = sorted((str(i), *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 48), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_no_task_gets_a_wide_group(frame, prose, monkeypatch):
    """5,000 documents share a passage and go on differently, some alike: no group that is judged has over ``hot`` contexts."""
    common, hot = prose(5000, 60)[:300], 200
    rows = [(i, f"{i * 7919 % 10007} " + common + f" {i // 5 if i % 5 < 2 else i * 31 % 9973} " + prose(i // 5 if i % 5 < 2 else 9000 + i, 45)) for i in range(5000)]
    seen = []
    real = S.judged
    monkeypatch.setattr(S, "judged", lambda contexts, length: seen.append(contexts) or real(contexts, length))
    got = S.remove_repeats(frame(rows), 200, hot).collect()
    assert sorted(map(tuple, got)) == sorted((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 200), strict=True))
    assert len(seen) == 2
    for contexts in seen:
        assert max((r["count"] for r in contexts.groupBy("ah").count().collect()), default=0) <= hot
    assert seen[1].count() > 0


def test_string_hashes():
    s = np.random.default_rng(1).integers(0, 250, 600).astype(np.uint8)
    s[300:520] = s[20:240]
    h = S.string_hashes(s, 401, 200)
    assert (h[20:41] == h[300:321]).all() and len(set(h.tolist())) == 401 - 21


def test_odd_rows(frame, odd_rows):
    got = S.remove_repeats(frame(odd_rows).withColumnRenamed("lang", "th"), kept=True).collect()
    want = sorted((str(i), *w) for (i, _), w in zip(odd_rows, brute([t for _, t in odd_rows], 200), strict=True))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert S.remove_repeats(frame([])).count() == 0
