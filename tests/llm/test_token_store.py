import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from heirflow.llm import token_store as store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
def test_bounds_select(n):
    random = np.random.default_rng(n)
    for ends in (np.cumsum(random.integers(0, 900, n)), np.zeros(n, np.int64), np.full(n, 10**9)):
        bounds = store.Bounds(*store.encode_bounds(ends, int(ends[-1])), n)
        assert bounds.all().tolist() == ends.tolist()
        assert [bounds.select(k) for k in range(n)] == ends.tolist()
        with pytest.raises(IndexError):
            bounds.select(n)


def test_words_encode_like_whole_texts(rows, tokenizer, monkeypatch):
    monkeypatch.setattr(store, "MAX_WORDS", 300)
    encoder = store.WordEncoder(PATH)
    texts = [r[1] or "" for r in rows] + ["a \u0085 b", "a\x1c \x1cb", " 's", "x\n y", "a b ", "\n  c", "é   é"]
    for at in range(0, len(texts), 16):
        some = texts[at : at + 16]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in some]
        assert encoder.encode(some) == want


def test_round_trip(docs, rows, tokenizer, spark, tmp_path):
    found = store.token_report(docs, str(tmp_path / "t"), PATH).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for r in ordered:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), store.crc_of(ids)))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def test_small_segments_and_empty(docs, no_docs, spark, tmp_path):
    whole, cut, none = (str(tmp_path / x) for x in ("a", "b", "c"))
    store.write_tokens(docs, whole, PATH)
    store.write_tokens(docs, cut, PATH, segment_ids=100)
    assert spark.read.parquet(cut).count() > spark.read.parquet(whole).count()
    key = lambda p: sorted((r.start, bytes(r.ids)) for r in store.read_tokens(spark, p).collect())
    assert key(whole) == key(cut)
    assert store.token_report(no_docs, none, PATH).count() == 0


def test_clashing_columns(clashing, tmp_path):
    assert store.token_report(clashing, str(tmp_path / "t"), PATH).count() == clashing.count()


def test_known_words_make_no_python_objects(tokenizer):
    encoder = store.WordEncoder(PATH)
    text = " ".join(f"w{i % 5000}" for i in range(100_000))
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, encoder.kind).tobytes()
    assert encoder.encode([text]) == [want]
    tracemalloc.start()
    try:
        assert encoder.encode([text]) == [want]
        # the text and its ids are objects, and so are arrays of numbers; a list of words takes over 60 bytes a word
        assert tracemalloc.get_traced_memory()[1] < 45 * 100_000
    finally:
        tracemalloc.stop()


def test_tables_of_words_stay_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(store, "MAX_WORD_BYTES", 2000)
    encoder = store.WordEncoder(PATH)
    for at in range(0, 3000, 100):
        texts = [f"the word{i} of{i % 7}, and" for i in range(at, at + 100)] + ["", " ", "the"]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
        assert encoder.encode(pa.array(texts, pa.large_string())) == want
        assert len(encoder.words) == len(encoder.ids) <= 210


def test_texts_that_end_in_two_blanks(tmp_path):
    letters = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    own = Tokenizer(models.BPE({**letters, store.BLANK * 2: len(letters)}, [(store.BLANK, store.BLANK)]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "t.json"))
    encoder = store.WordEncoder(str(tmp_path / "t.json"))
    texts = ["a  ", "  ", "a  b", "a   b", "  a", "a \n ", "a\n", "\u00a0 "]
    want = [np.array(own.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
    assert encoder.encode(texts) == want


def test_rounds_cover_all_texts(monkeypatch):
    monkeypatch.setattr(store, "ROUND_BYTES", 10)
    texts = ["a" * n for n in (3, 3, 3, 30, 0, 2, 9)]
    found = list(store.rounds(pa.array(["cut", *texts]).slice(1)))
    assert [at for at, _ in found] == [0, *np.cumsum([n for _, n in found])[:-1]]
    assert sum(n for _, n in found) == len(texts) and len(found) > 2
    assert list(store.rounds(pa.array([], pa.string()))) == []
