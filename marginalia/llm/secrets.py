"""Secret scans by password guess cost.

Three pattern kinds (``assign``, ``access``, ``hex``) are always reported. Beside
them, values that stand in a credential context are judged by how many guesses an
attacker needs: a dynamic program finds the cheapest segmentation of the value into
common words, dates, repeats, keyboard walks and brute-force spans. A value that no
pattern kind covers and whose cheapest segmentation costs ``min_log10`` or more is
added as kind ``context``; an ``assign`` value below it is counted as weak. After a mere
``is``, ``was`` or ``bearer``, which prose has too, a value must also mix letters, digits
and other characters (two of the three).

Defined cases: a null text counts as empty; an empty text has no spans and the digest
of the empty string; an empty table gives an empty result; every row gives one row, whatever
repeats, and spans that begin together stand in the order of the kinds; texts of any length
are scanned whole, in time linear in the text and in each value; columns to be kept may have
any names but those of the result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import mapped, texts, with_columns

KINDS = ("assign", "access", "hex", "context")
ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
#: Any text with an ``assign`` match has this; it is far cheaper to look for.
ASSIGN_HINT = re.compile("[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}")
#: The word may end a longer name (``DB_PASSWORD``, ``client_secret``), and ``key`` may have words before it.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|authorization|(?:api|access|private|secret)(?:[_\-][a-z0-9]+){0,3}[_\- ]?key)\b"
    r"[\"']?[ \t]*(?:(?P<sign>[:=]>?|->)|\bis\b|\bwas\b|(?<=bearer))[ \t]*[\"']?(?P<value>[^\s\"'<>,;]{6,})",
    re.IGNORECASE | re.ASCII,
)
#: A context has one of these in any case; found on lower-case text.
CONTEXT_HINT = re.compile("pass|pwd|secret|token|credential|bearer|authorization|key")

# Words that guessers try first, most common first.
COMMON_WORDS = (
    "password pass admin root user login welcome secret master hello dragon monkey letmein qwerty test guest default changeme "
    "access server system database oracle token love sun moon star summer winter spring autumn shadow football baseball soccer "
    "hockey batman superman princess angel michael jordan charlie thomas robert daniel andrew martin george computer internet "
    "example sample demo temp private public key api company office money freedom whatever trust killer ninja pepper ginger cookie "
    "chocolate banana orange apple purple yellow silver golden flower butterfly tiger lion eagle wolf bear horse the and you that "
    "this with have from they will your what when make like time just know take year good some could them than then look only come "
    "over think also back after work first well even want because these give most"
).split()
#: Rows of the usual keyboard, and digits and letters in order.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "1qaz2wsx3edc4rfv5tgb6yhn7ujm", "abcdefghijklmnopqrstuvwxyz")
#: A date at a place: year first, day first, or a year alone; each tried at every character.
DATES = tuple(
    re.compile(d, re.ASCII)
    for d in (
        r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
)
UNIT = 8  # characters of a repeated unit, at most
SPAN = 24  # characters of a repeat or walk; the whole of a longer one counts besides
LEET = str.maketrans("@4310$5!7", "aaeiossit")
STEP = math.log10(2)  # for each further segment: where it is cut

_rank = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_longest = max(map(len, COMMON_WORDS))
_next: dict[str, set[str]] = {}
for _row in WALKS:
    for _a, _b in zip(_row, _row[1:], strict=False):
        _next.setdefault(_a, set()).add(_b)
        _next.setdefault(_b, set()).add(_a)


def brute_cost(ch: str) -> float:
    """log10 of the guesses for one character of its class."""
    return 1.0 if ch.isdigit() else math.log10(26) if ch.isascii() and ch.isalpha() else math.log10(33) if ch.isascii() else math.log10(1000)


def segments(value: str):
    """Every span that is no brute force, as (start, end, kind, log10 of its guesses), in order of starts.

    Words and dates stand at any character, repeats and walks too, with any end up to ``SPAN`` characters on; the whole
    of a longer run counts besides. So their number is linear in the length.
    """
    low, n = "".join(c.lower()[0] for c in value), len(value)  # as many characters as the value
    plain = low.translate(LEET)
    same = []  # for each length of a unit: how many characters from i on equal those a unit later
    for p in range(1, min(UNIT, n // 2) + 1):
        count = [0] * (n + 1)
        for i in range(n - p - 1, -1, -1):
            if value[i] == value[i + p]:
                count[i] = count[i + 1] + 1
        same.append((p, count))
    run = 0  # where the walk that i is part of began
    for i in range(n):
        for j in range(i + 3, min(n, i + _longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.5)):
                if (r := _rank.get(form[i:j])) and (not extra or form[i:j] != low[i:j]):
                    cased = 0.0 if value[i:j].islower() else STEP if value[i:j].istitle() or value[i:j].isupper() else 1.0
                    yield i, j, "word", math.log10(r + 1) + extra + cased
        if value[i].isdigit():
            for pattern in DATES:
                if m := pattern.match(value, i):
                    yield i, m.end(), "date", math.log10(150 if m.end() - i == 4 else 365 * 150 * 4)
        for p, count in same:
            if count[i] < p or count[i] + p < 3:
                continue
            copies = 1 + count[i] // p
            unit = sum(map(brute_cost, value[i : i + p]))
            for k in range(3 if p == 1 else 2, min(copies, SPAN // p) + 1):
                yield i, i + k * p, "repeat", unit + math.log10(k)
            if copies * p > SPAN and not (i and count[i - 1]):
                yield i, i + copies * p, "repeat", unit + math.log10(copies)
        if i and low[i] not in _next.get(low[i - 1], ()):
            run = i
        j, turns, back = i + 1, 0, 0
        while j < n and (j - i < SPAN or run == i) and low[j] in _next.get(low[j - 1], ()):
            step = ord(low[j]) - ord(low[j - 1])
            turns += bool(back) and (step > 0) != (back > 0)
            back, j = step, j + 1
            if 3 <= j - i <= SPAN:
                yield i, j, "walk", math.log10(len(WALKS) * 10 * (j - i)) + 0.6 * turns
        if j - i > SPAN:
            yield i, j, "walk", math.log10(len(WALKS) * 10 * (j - i)) + 0.6 * turns


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for the empty value."""
    n, found = len(value), segments(value)
    best, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)  # brute: the last span is brute force
    best[0] = 0.0
    ahead = next(found, None)
    for i in range(n):
        best[i] = here = min(best[i], brute[i])
        start = here + (STEP if i else 0.0)
        brute[i + 1] = brute_cost(value[i]) + min(brute[i], start)
        while ahead and ahead[0] == i:
            if start + ahead[3] < best[ahead[1]]:
                best[ahead[1]] = start + ahead[3]
            ahead = next(found, None)
    return min(best[n], brute[n]) if n else 0.0


@lru_cache(maxsize=20_000)
def known_cost(value: str) -> float:
    return guess_cost(value)


def cost_of(value: str) -> float:
    """``guess_cost``, remembered for values of usual length."""
    return known_cost(value) if len(value) <= 200 else guess_cost(value)


def scan(text: str, min_log10: float = 9.0) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], int, float]:
    """Pattern spans, all spans (each (start, kind, end), in order), weak ``assign`` values, and the dearest value's cost."""
    base, weak, most = [], 0, 0.0
    if ASSIGN_HINT.search(text):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                base.append((m.start(), "assign", m.end()))
                cost = cost_of(m[2])
                weak, most = weak + (cost < min_log10), max(most, cost)
    if "AKIA" in text:
        base += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    spans = list(base)
    starts, ends = [], []  # of what base spans cover, as runs
    for i, _, j in base:
        if ends and i <= ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            starts.append(i)
            ends.append(j)
    if CONTEXT_HINT.search(text.lower()):
        for m in CONTEXT.finditer(text):
            i, value = m.start("value"), m["value"].rstrip(".)]}:!?")
            j = i + len(value)
            if len(value) < 6 or ((k := bisect_left(starts, j)) and ends[k - 1] > i):
                continue
            mixed = sum((any(c.isalpha() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
            if (m["sign"] or mixed >= 2) and (cost := cost_of(value)) >= min_log10:
                spans.append((i, "context", j))
                most = max(most, cost)
        spans.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return base, spans, weak, most


def listed(spans: list[tuple[int, str, int]]) -> str:
    """``kind:start:end`` joined by commas; code points, the end is exclusive."""
    return ",".join(f"{kind}:{i}:{j}" for i, kind, j in spans)


def find_secrets(df: DataFrame, keep: list[str], min_log10: float = 9.0) -> DataFrame:
    """Columns ``keep`` of ``df``, and for each text what was found: counts by kind, ``base`` and ``spans`` as
    text lists, and ``max_log10``, the log10 guesses of its dearest credential value. No shuffle."""

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(t.decode(), min_log10) for t in texts(batch)]
        count = lambda k, at=1: pa.array([sum(s[1] == k for s in f[at]) for f in found], pa.int64())
        base = [listed(f[0]) for f in found]
        return with_columns(
            batch,
            {"n_" + k: count(k) for k in KINDS}
            | {
                "n_weak": pa.array([f[2] for f in found], pa.int64()),
                "max_log10": pa.array([f[3] for f in found], pa.float64()),
                "base": pa.array(base, pa.string()),
                "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([listed(f[1]) for f in found], pa.string()),
            },
            drop=("text",),
        )

    df = df.select(*keep, "text")
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return mapped(df, spec, f"{given}, n_assign long, n_access long, n_hex long, n_context long, n_weak long, max_log10 double, base string, base_sha256 string, spans string")
