import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import repair_tokens as R
from marginalia.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)  # as the library has it, not by way of the operator


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = ["", "a  b\n\n c\t d", "\n x", "  ", "it's I'll 　x \xa0y", "<|endoftext|> z", "é́ 12a3 !!x  \r\n q", " 's", "a \n b", "x\ny 's\n", "\n\n", "a ", "q 日本 'll ve", "\na", "\x01 b \x01c", "a\n", "\n", "one two\nthree four\nfive", "a\u2019b \u201cc\u201d", "a\u2003b", "x\ufeffy", "\x85z", "p\u1680q", "tab\there"]


def test_words_make_the_ids_of_the_text(prose):
    many = [*ODD, prose(3, 500), prose(4, 200).replace(". ", ".\n"), prose(3, 40) + " ünï çôdé 東京"]
    encoder = R.Encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode([t.encode() for t in many])] == [ids_of(t) for t in many]


def test_pool_is_bounded(prose, monkeypatch):
    monkeypatch.setattr(R, "POOL", 50)
    encoder = R.Encoder(PATH)
    for seed in range(5):
        many = [prose(seed, 100)]
        assert encoder.encode([t.encode() for t in many])[0].tolist() == ids_of(many[0])


def test_a_word_is_learned_once_whatever_punctuation_ends_it():
    text = "a word word, word. word!! word... wörd wörd; wörd?"
    encoder = R.Encoder(PATH)
    assert encoder.encode([text.encode()])[0].tolist() == ids_of(text)
    assert [w for w in encoder.words.to_pylist() if "rd" in w] == ["word", "wörd"]


def test_punctuation_at_a_words_end_makes_the_ids_of_the_text():
    last = ["a", "Z", "9", "é", "×", "÷", "ā", "ʰ", "́", "…", "’", "'", "'s", "日", "¿", "²", "ѐ", "\U0001f600", "_", ""]
    marks = [",", "'", "',", "!!", "…,", ",…", "-x-", "'s,", "|>", "." * 64, "." * 65, "\"]\\", ",é,"]
    many = [f"{lead}{c}{m}{after}" for lead in ("", "x ", "x\n", "b") for c in last for m in marks for after in ("", " y", "\nz")]
    encoder = R.Encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode([t.encode() for t in many])] == [ids_of(t) for t in many]


@pytest.mark.parametrize("seed", range(6))
def test_block_round_trip(seed):
    rng = np.random.default_rng(seed)
    kinds = [5, 50, 50000][seed % 3]
    docs = [np.append(rng.integers(0, kinds, rng.integers(0, 400)), 0).astype("<u4") for _ in range(60)]
    docs[0] = np.full(1000, 7, "<u4")
    docs[1] = np.tile(np.array([1, 2, 3], "<u4"), 500)
    data = R.pack(docs, 50257)
    block = R.Block(data)
    assert all((block.document(k) == d).all() for k, d in enumerate(docs))
    assert [block.token(1, i) for i in (0, 1, 7, 1499)] == docs[1][[0, 1, 7, 1499]].tolist()
    assert [block.token(2, i) for i in range(len(docs[2]))] == docs[2].tolist()
    assert (block.lengths == [len(block.expand(np.array([50257 + i]))) for i in range(len(block.rules))]).all()
    if kinds == 5:
        assert len(block.symbols) < 0.6 * sum(map(len, docs))
    with pytest.raises(ValueError):
        R.Block(data[:-5] + b"x" + data[-4:])


def frequency(x, ends):
    """Occurrences of each pair within documents; in a run of one symbol every second counts."""
    count, i_of = {}, {}
    for i in range(len(x) - 1):
        pair = (int(x[i]), int(x[i + 1]))
        if not ends[i] and i_of.get(pair, -2) != i - 1:
            count[pair], i_of[pair] = count.get(pair, 0) + 1, i
    return count


@pytest.mark.parametrize("least_sorted", [1, 1 << 16])
@pytest.mark.parametrize("kinds", [2, 30, 3000])
def test_no_frequent_pair_is_left(kinds, least_sorted, monkeypatch):
    monkeypatch.setattr(R, "SORTED", least_sorted, raising=False)
    monkeypatch.setattr(R, "HASH_BITS", 6 if least_sorted == 1 else 18, raising=False)
    rng = np.random.default_rng(kinds)
    passage = rng.integers(0, 50000, 300)
    docs = [np.concatenate([rng.integers(0, kinds, rng.integers(1, 200)), passage, np.full(rng.integers(1, 60), 7)]) for _ in range(80)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    x, left_ends, rules = R.compress(ids, ends, 50257)
    assert max(frequency(x, left_ends).values()) < R.LEAST and left_ends.sum() == len(docs)
    block = R.Block(R.pack([d.astype(np.uint32) for d in docs], 50257))
    assert all((block.document(k) == d).all() for k, d in enumerate(docs))
    assert max(block.lengths) >= len(passage) // 2


def test_a_run_shrinks_to_its_logarithm():
    block = R.Block(R.pack([np.full(100_000, 7, np.uint32)], 50257))
    assert len(block.symbols) < 64 and (block.document(0) == 7).all() and block.token(0, 99_999) == 7


def test_written_and_read_back(frame, prose, odd_rows, tmp_path):
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(ODD)), *((500 - i, prose(i, 90)) for i in range(60))]
    out = f"file://{tmp_path}/tokens"
    table = R.write_tokens(frame(rows).withColumnRenamed("lang", "block"), PATH, out, block_tokens=700)
    assert table.count() > 5
    got = sorted(R.read_tokens(table).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None) and ids[:2] == [None, None]
    want = sorted((str(i), len(x := [*ids_of(t), 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_empty_table(frame):
    assert R.read_tokens(R.write_tokens(frame([]), PATH)).count() == 0


def test_special_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    many = ["a <|endoftext|> b", "x<|endoftext|>y\nz", "<|endoftext|>", "plain words"]
    want = [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in many]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in R.Encoder(PATH).encode([t.encode() for t in many])] == want
