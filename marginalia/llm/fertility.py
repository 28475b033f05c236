"""Quality rules from tokeniser fertility.

A public vocabulary (a sentencepiece model with byte fallback) cuts each word of a text.
Three figures judge the text: characters per token, the share of byte-fallback tokens, and
the entropy of its tokens in bits. Each script has bands of accepted values, wider for short
texts; a text outside a band of its main script is rejected. Plain counts
(words, symbols, repeated lines and 5-word windows) are computed beside them and reject by
fixed limits. One vocabulary is used: the other public ones are byte-level or drop unknown
characters, so they have no byte fallback to measure.

Words are tokenised on their own (pieces of this vocabulary never cross blanks), so each
distinct word is cut once per batch, whatever its frequency; the counts cover whole texts.

Defined cases: a null or blank text has no words and fails the base rule (fewer than 10);
repeated rows are judged alike; a text without tokens has figures 0; texts of any length are
measured whole, and short ones by the first step of each band; a tie between scripts goes to the
one listed first; columns to be kept may have any names but those of the result; an empty table
gives an empty result. No shuffle.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import mapped, texts, with_columns

#: Per script, by steps (tokens from which on, limit): least characters per token; most characters per token; most
#: byte-fallback share; least entropy in bits. A text has the limits of the last step that it reaches, and those of the
#: first step if it reaches none. Running prose reaches its vocabulary's entropy within some hundred tokens. The Latin
#: limits lie below the good texts of the learning split of sf0.1: of their passages of 10 and 14 words, in 15 to 19
#: tokens, the least have 1.82 characters per token and 3.25 bits (10 to 14 tokens: 1.92 and 3.09; 20 to 29: 1.61 and
#: 3.62). A short text may hold a character or two of several bytes, so its share may be larger. The other scripts' limits
#: are set around sample sentences, a tenth lower for short texts. No text of mere symbols passes.
BANDS = {
    "latin": (((10, 1.2), (30, 1.28), (120, 1.5), (250, 1.6)), 8.0, ((10, 0.45), (30, 0.20)), ((10, 2.2), (15, 2.5), (20, 2.8), (30, 3.0), (120, 5.0), (250, 5.6), (500, 5.8))),
    "latin_marked": (((10, 0.81), (30, 0.9)), 8.0, ((10, 0.45), (30, 0.20)), ((10, 2.2), (120, 5.0), (250, 5.6), (500, 5.8))),
    "cyrillic": (((10, 0.9), (30, 1.0)), 8.0, ((10, 0.45), (30, 0.25)), ((10, 2.2), (120, 4.5), (500, 5.2))),
    "greek": (((10, 0.63), (30, 0.70)), 6.0, ((10, 0.75), (30, 0.60)), ((10, 2.2), (120, 4.0))),
    "cjk": (((10, 0.27), (30, 0.30)), 4.0, ((10, 0.95), (30, 0.90)), ((10, 2.2), (120, 4.0))),
    "hangul": (((10, 0.27), (30, 0.30)), 4.0, ((10, 0.95), (30, 0.90)), ((10, 2.2), (120, 4.0))),
    "arabic": (((10, 0.5), (30, 0.55)), 4.0, ((10, 0.60), (30, 0.40)), ((10, 2.2), (120, 3.0))),
    "hebrew": (((10, 0.5), (30, 0.55)), 4.0, ((10, 0.60), (30, 0.40)), ((10, 2.2), (120, 3.0))),
    "devanagari": (((10, 0.45), (30, 0.50)), 4.0, ((10, 0.60), (30, 0.40)), ((10, 2.2), (120, 3.0))),
    "thai": (((10, 0.45), (30, 0.50)), 4.0, ((10, 0.60), (30, 0.40)), ((10, 2.2), (120, 3.0))),
    "letters": (((10, 0.22), (30, 0.25)), 8.0, ((10, 0.95), (30, 0.92)), ((10, 2.0),)),
    "other": (((10, 0.36), (30, 0.40)), 1.1, ((10, 0.30), (30, 0.10)), ((10, 2.0),)),
    "symbols": (((10, np.inf),), 0.0, ((10, 0.0),), ((10, 0.0),)),
}
#: First and last code point of the ranges that name a script.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "cyrillic": ((0x400, 0x52F),),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x2FA1F)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "arabic": ((0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F)),
    "hebrew": ((0x5D0, 0x5EA),),
    "devanagari": ((0x900, 0x963), (0x970, 0x97F)),
    "thai": ((0xE01, 0xE4D),),
}
SYMBOLS = b"#*$%&|<>"
CACHED = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@lru_cache(maxsize=2)
def known_words(path: str) -> dict[bytes, bytes]:
    """Token ids (uint16) of words met before; a Python worker keeps them for its later tasks."""
    return {}


def script_of(text: str) -> str:
    """The script with most letters of a text.

    ``latin_marked`` where a tenth of the Latin letters or more have marks (as in Vietnamese), ``letters`` for scripts
    without a band of their own; without any letter ``other``, or ``symbols`` where digits are less than half.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    far = points[points >= 0x370]  # most texts have few
    count = {k: sum(int(((x >= a) & (x <= b)).sum()) for a, b in r for x in (points if a < 0x370 else far,)) for k, r in RANGES.items()}
    best = max(count, key=count.get)
    if count[best]:
        plain = sum(int(((points >= a) & (points <= b)).sum()) for a, b in RANGES["latin"][:2]) if best == "latin" and not text.isascii() else count[best]
        return "latin_marked" if 10 * (count[best] - plain) >= count[best] else best
    if any(map(str.isalpha, text)):
        return "letters"
    return "other" if 2 * sum(map(str.isdigit, text)) >= len("".join(text.split())) else "symbols"


def id_type(model_path: str) -> type:
    """The smallest type that holds the vocabulary's ids."""
    return np.uint16 if len(vocabulary(model_path)[1]) <= 1 << 16 else np.uint32


def windows_repeat(words: list[bytes]) -> bool:
    """Whether two 5-word windows of a text may be equal, by a hash of each; equal windows have equal hashes."""
    if len(words) < 6:
        return False
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(h) - 4
    mixed = h[:n].copy()
    for k in range(1, 5):
        mixed *= MIX
        mixed ^= mixed >> np.uint64(29)
        mixed += h[k : k + n]
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = sum(map(len, words))
    if not data.isascii():
        word_chars -= int((np.frombuffer(data, np.uint8) & 0xC0 == 0x80).sum())
    symbols = sum(map(data.count, (bytes([c]) for c in SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeat = 0
    if windows_repeat(words):
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        count = Counter(windows)
        hit = np.zeros(len(words) + 1, np.int64)
        for i, w in enumerate(windows):
            if count[w] > 1:
                hit[i] += 1
                hit[i + 5] -= 1
        repeat = int((np.cumsum(hit)[:-1] > 0).sum())
    return word_chars, symbols, len(lines) - len(set(lines)), repeat


def limit(steps: tuple[tuple[int, float], ...], n_tokens: int) -> float:
    """Of the last step that so many tokens reach, else of the first."""
    return next((x for n, x in reversed(steps) if n <= n_tokens), steps[0][1])


def verdict(script: str, n_tokens: int, chars_per_token: float, byte_share: float, entropy: float, bands=BANDS) -> bool:
    """Whether the figures lie in the bands of the script."""
    lows, high, shares, floors = bands[script]
    return limit(lows, n_tokens) <= chars_per_token <= high and byte_share <= limit(shares, n_tokens) and entropy >= limit(floors, n_tokens)


def measure(df: DataFrame, keep: list[str], model_path: str, bands: dict = BANDS) -> DataFrame:
    """Columns ``keep`` of ``df`` with the base counts, the three figures, script, base_failed and kept."""
    df = df.select(*keep, "text")

    def cut(words: set[bytes]) -> None:
        cache = known_words(model_path)
        if len(cache) > CACHED:
            cache.clear()
        new = [w for w in words if w not in cache]
        for w, ids in zip(new, vocabulary(model_path)[0].encode([w.decode() for w in new], num_threads=1), strict=True):
            cache[w] = np.array(ids, id_type(model_path)).tobytes()

    def spec(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in texts(batch):
            words, cache = data.split(), known_words(model_path)
            for a in range(0, len(words), CACHED):  # so that the cache stays bounded in the longest text too
                cut(set(words[a : a + CACHED]))
            tokens = np.frombuffer(b"".join([cache.get(w) or whole(w) for w in words]), id_type(model_path))
            n, n_tokens = len(words), len(tokens)
            chars, symbols, dup, repeat = base_counts(data, words)
            is_byte = vocabulary(model_path)[1]
            count = np.unique(tokens, return_counts=True)[1] if n_tokens < 4096 else np.bincount(tokens)
            share = count[count > 0] / max(1, n_tokens)
            entropy = float(-(share * np.log2(share)).sum()) + 0.0
            fallback, per_token = (float(is_byte[tokens].mean()), chars / n_tokens) if n_tokens else (0.0, 0.0)
            script = script_of(data.decode()) if n_tokens else "other"
            failed = n < 10 or 100 * repeat > 20 * n
            good = not failed and bool(verdict(script, n_tokens, per_token, fallback, entropy, bands))
            rows.append((n, chars, symbols, dup, repeat, failed, good, n_tokens, per_token, fallback, entropy, script))
        kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), *[pa.float64()] * 3, pa.string())
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script")
        return with_columns(batch, {k: pa.array(c, t) for k, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)}, drop=("text",))

    def whole(word: bytes) -> bytes:
        return np.array(vocabulary(model_path)[0].encode(word.decode()), id_type(model_path)).tobytes()

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return mapped(df, spec, f"{given}, {counts}, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string")
