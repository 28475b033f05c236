import hashlib
import math
import random
import re
import time

import pytest

from marginalia.llm import secrets as S


def brute(text):
    """The base kinds as the contract words them: all matches first, then those that fail are dropped."""
    text = text or ""
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x for _, _, x in sorted(out))


TEXTS = [
    None, "", "PassWord = 'abc123' and token:tok=token=abcdef", "token=token:abcdefg", "aws AKIA" + "Z9" * 8 + " or AKIAAKIA" + "A" * 12,
    "é" * 3 + " api_key: \"0123456789abcdef0123456789abcdef\"", "f" * 24 + " " + "f" * 23, "toKen=abcdefgh ſecret=abcdefgh", "passwd=abc.de=",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    base, spans, _, _ = S.scan(text or "")
    assert S.listed(base) == brute(text)
    assert set(base) <= set(spans)


def span_costs(value, i, j):
    """What the span can be, told by looking at it alone (and at what stands beside it, for long runs)."""
    part, low = value[i:j], value[i:j].lower()
    out = [sum(map(S.brute_cost, part))]
    for form, extra in ((low, 0.0), (low.translate(S.LEET), 0.5)):
        if len(part) >= 3 and form in S.COMMON_WORDS and not (extra and form == low):
            cased = 0.0 if part.islower() else S.STEP if part.istitle() or part.isupper() else 1.0
            out.append(math.log10(S.COMMON_WORDS.index(form) + 2) + extra + cased)
    if re.fullmatch(r"(?:19|20)\d\d", part, re.ASCII):
        out.append(math.log10(150))
    ymd = r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    dmy = r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"
    if re.fullmatch(f"{ymd}|{dmy}", part, re.ASCII):
        out.append(math.log10(365 * 150 * 4))
    for p in range(1, S.UNIT + 1):
        k, over = divmod(len(part), p)
        whole = (i == 0 or value[i - 1] != value[i - 1 + p : i + p]) and not value[j:].startswith(part[:p])
        if not over and k >= 2 and len(part) >= 3 and part == part[:p] * k and (len(part) <= S.SPAN or whole):
            out.append(sum(map(S.brute_cost, part[:p])) + math.log10(k))
    beside = lambda a, b: any(a + b in row or b + a in row for row in S.WALKS)
    whole = not (i and beside(*value[i - 1 : i + 1].lower())) and not (j < len(value) and beside(*value[j - 1 : j + 1].lower()))
    if len(part) >= 3 and all(map(beside, low, low[1:])) and (len(part) <= S.SPAN or whole):
        ups = [b > a for a, b in zip(low, low[1:])]
        out.append(math.log10(len(S.WALKS) * 10 * len(part)) + 0.6 * sum(a != b for a, b in zip(ups, ups[1:])))
    return min(out)


def cheapest(value):
    """Over all segmentations into any spans."""
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + span_costs(value, i, j) + (S.STEP if i else 0) for i in range(j)))
    return best[-1]


@pytest.mark.parametrize(
    "value",
    ["password1", "qwerty2019-04-01", "aaaaaaab", "Xk9$vLq2", "dr4g0n!!", "12345678", "x", "10112019-12-31", "kqzvwxjhtrmpbgdlfc", "31122019x2019", "abababaxyxyxy", "a" * 60, "qwertyuiop" * 4, "poiuytrewq1987", "abcabcabcdefed" * 3, "Pa55WORD", "0" * 30 + "1" * 26],
)
def test_guess_cost_is_the_cheapest_segmentation(value):
    assert S.guess_cost(value) == pytest.approx(cheapest(value))


def test_guess_cost_of_random_values():
    rng = random.Random(4)
    for _ in range(60):
        value = "".join(rng.choice(["pass", "19", "20", "12", "31", "a", "b", "qwe", "-", "Z", "ab", "1"]) for _ in range(rng.randint(1, 12)))
        assert S.guess_cost(value) == pytest.approx(cheapest(value)), value


def test_long_texts_take_linear_time():
    began = time.process_time()
    assert len(S.scan("password=abcdef " * 100_000)[0]) == 100_000
    assert len(S.scan("pwd=" + "x9!" * 30_000)[1]) <= 1
    assert time.process_time() - began < 30


@pytest.mark.parametrize("value", ["kqzvwxjhtrmpbgdlfc", "80931746205917"])
def test_one_class_of_characters_is_judged_by_its_cost(value):
    assert S.scan(f"pwd={value}")[1] == [(4, "context", 4 + len(value))]


def test_costs_order_as_expected():
    assert S.guess_cost("password123") < S.guess_cost("qwertyuiop1987") < S.guess_cost("vT7#kQ9zLm2!")
    assert S.guess_cost("") == 0.0


def test_context_adds_hard_values_only():
    _, spans, _, _ = S.scan("the password is hT9$kfQ2zLp!, honest; another secret is something else; pwd: password1")
    assert [k for _, k, _ in spans] == ["context"]


def test_query_rows(frame, odd_rows):
    df = frame([*odd_rows, (10, TEXTS[2])]).withColumnRenamed("lang", "spans")
    rows = S.find_secrets(df, ["doc_id"]).collect()
    assert len(rows) == len(odd_rows) + 1
    got = next(r for r in rows if r["doc_id"] == 10)
    assert got["base_sha256"] == hashlib.sha256(brute(TEXTS[2]).encode()).hexdigest() and got["n_assign"] == 2
    assert S.find_secrets(frame([]), ["doc_id"]).count() == 0


PREFIXED = [
    ("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI/K7MDENG"), ('"secret_access_key": "', "wJalrXUtnFEMI/K7MDENG"), ("DB_PWD=", "Tr0ub4dor&3zQ"), ("db_password: ", "$3cR#t!9zQx"),
    ("ssh_passphrase: ", "kq9!zvjx#wpb"), ("client_secret -> ", "x9!kQ#2mZp"), ("DB_PASSWORD='", "p@55!x#Zq9"), ("private_deploy_key: ", "x9!kQ#2mZp"),
]


@pytest.mark.parametrize("name,value", PREFIXED)
def test_context_under_longer_names(name, value):
    text = f"export {name}{value}' and so on"
    assert [(text[i:j], k) for i, k, j in S.scan(text)[1]] == [(value, "context")]


@pytest.mark.parametrize("value", ["kqzvjxwpbmrtfghd", "83920571649372", "$%&!#*?~^|+{"])
def test_one_class_of_characters_is_judged_by_its_cost(value):
    assert [k for _, k, _ in S.scan(f"pwd={value}")[1]] == ["context"]
    assert S.scan(f"the secret was {value}")[1] == []


def test_cheap_values_of_one_class_stay_out():
    assert S.scan("pwd=qwertyuiop pwd=12345678 passphrase: princess")[1] == []
