import base64
import random
import re
from collections import Counter

import pytest

from marginalia.llm import fertility as Fe
from marginalia.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_base_counts(frame, prose, odd_rows):
    rows = [*odd_rows] + [(20, prose(3, 40) + " " + prose(3, 12)), (21, "a#b\n\na#b\n \na#b"), (22, "één twee drie " * 9), (23, prose(5, 200))]
    got = Fe.measure(frame(rows).withColumnRenamed("lang", "kept"), ["doc_id"], MODEL).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted((str(i), *brute(t)) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert Fe.measure(frame([]), ["doc_id"], MODEL).count() == 0


def test_words_alone_give_the_tokens_of_the_text(prose):
    model = Fe.vocabulary(MODEL)[0]
    text = prose(8, 60) + " naïve 東京 x1!"
    assert [i for w in text.split() for i in model.encode(w)] == model.encode(text)


def test_bands(prose):
    assert Fe.verdict("latin", 100, 2.5, 0.0, 6.0)
    assert not Fe.verdict("latin", 100, 0.5, 0.0, 6.0) and not Fe.verdict("latin", 600, 2.5, 0.0, 5.5)
    assert not Fe.verdict("latin", 100, 2.5, 0.9, 6.0)
    assert not Fe.verdict("latin", 100, 2.5, 0.0, 0.5)
    assert Fe.verdict("latin", 14, 2.0, 0.3, 3.0) and not Fe.verdict("latin", 30, 2.0, 0.3, 4.5)
    assert not Fe.verdict("latin", 14, 1.0, 0.0, 3.0) and not Fe.verdict("latin", 14, 2.0, 0.0, 2.0) and not Fe.verdict("latin", 5, 0.1, 1.0, 0.0)
    assert Fe.script_of("привет world мир дом") == "cyrillic" and Fe.script_of("123") == "other" and Fe.script_of("東京 ab") in ("cjk", "latin")


@pytest.mark.parametrize("text", ["𓀀𓂀𓃀 " * 40, "aaaa " * 3 + "x"])
def test_junk_goes(frame, text):
    assert not Fe.measure(frame([(1, text)]), ["doc_id"], MODEL).first()["kept"]


RNG = random.Random(7)
JUNK = {
    "base64": " ".join(base64.b64encode(RNG.randbytes(60)).decode() for _ in range(40)),
    "symbols": " ".join("".join(RNG.choice("#$%&*<>|+=~^") for _ in range(6)) for _ in range(60)),
    "private use": " ".join("".join(chr(0xE000 + RNG.randrange(6000)) for _ in range(5)) for _ in range(60)),
}
CLEAN = {
    "latin": "The boy wrote a long letter to his friend in the old town before he went to the sea with his family and their two dogs, and nobody knew when they would be back.",
    "latin_marked": "Cậu bé viết một bức thư dài cho người bạn ở thành phố cổ trước khi đi biển cùng gia đình",
    "cyrillic": "Мальчик написал длинное письмо своему другу в старом городе перед тем как уехать к морю с семьёй",
    "arabic": "كتب الولد رسالة طويلة إلى صديقه في المدينة القديمة قبل أن يسافر إلى البحر مع أسرته الكبيرة",
    "hebrew": "הילד כתב מכתב ארוך לחבר שלו בעיר העתיקה לפני שנסע אל הים עם המשפחה הגדולה שלו",
    "devanagari": "लड़के ने पुराने शहर में अपने मित्र को एक लंबा पत्र लिखा और फिर अपने परिवार के साथ समुद्र गया",
    "thai": "เด็กชาย เขียน จดหมาย ยาว ถึง เพื่อน ใน เมือง เก่า ก่อน เดินทาง ไป ทะเล กับ ครอบครัว ใหญ่",
    "hangul": "소년은 오래된 도시에 사는 친구에게 긴 편지를 쓰고 나서 가족과 함께 바다로 여행을 떠났다",
}


def test_junk_of_any_figure_goes_and_prose_stays(frame):
    rows = [(i, t) for i, t in enumerate([*JUNK.values(), *CLEAN.values()])]
    got = sorted(Fe.measure(frame(rows), ["doc_id"], MODEL).collect(), key=lambda r: r["doc_id"])
    assert all(r["n_tokens"] >= 30 and not r["base_failed"] for r in got)
    assert [r["kept"] for r in got] == [False] * len(JUNK) + [True] * len(CLEAN)
    assert [r["script"] for r in got[len(JUNK) :]] == list(CLEAN)


SHORT = {
    "Dinner with old friends from school was great fun tonight 🎉": True,
    "A b c d e f g h i j k l": False,
    "x- y- x- y- y- x- x- x- y- y- y- x-": False,
    "# $ % & * < > | + =": False,
    "\ue001\ue002 \ue003\ue004 \ue005 \ue006 \ue007 \ue008 \ue009 \ue00a \ue00b \ue00c": False,
    "мы все были рады видеть его дома в этот день": True,
}


def test_short_texts_are_judged_too(frame):
    got = {r["doc_id"]: r for r in Fe.measure(frame(list(enumerate(SHORT))), ["doc_id"], MODEL).collect()}
    assert {t: got[i]["kept"] for i, t in enumerate(SHORT)} == SHORT
    assert not any(r["base_failed"] for r in got.values())


def test_windows_that_may_repeat():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        assert Fe.windows_repeat(words) or len(set(grams)) == len(grams)
    assert not Fe.windows_repeat([str(i).encode() for i in range(5000)])
