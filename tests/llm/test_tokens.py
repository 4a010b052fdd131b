import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import frame, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, tokenfile, vocab

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")

HARD = [
    "a<|endoftext|>b <|endoftext|>", "Don't  It'S x\xa0y é ΑΣ Σ\tq\x1c1", "　 x", "", None, "   ", "́a ̈b \n̈ c",
    "a\x0bb\x0cc\x85d e", 'J̌ T̈ É, É,! É…,a "quo,ted" foo\'s, !\'s x!\'s ,\'t a.b.c 1,2 a1 2b %a% ſ K İ ÷, a÷, ×! naïve|x ß, ŉ',
    "<|EndOfText|> <|endoftext|>", "한국 한글 한", "a" * 5000 + "!" * 300, "😀😀 a😀, ,😀", "ÀÉÎ.ÕÜ,ñ! ÿ: ð;",
]


@functools.cache
def tokenizer():
    return vocab.load(PATH)


def library(text):
    found = tokenizer()
    ids = found.encode(text or "", add_special_tokens=False).ids
    return ids, found.decode(ids, skip_special_tokens=False)


def test_encoder_equals_library():
    for text, ids in zip(HARD, vocab.Encoder.of(PATH).encode(pa.array(HARD)), strict=True):
        assert ids.tolist() == library(text)[0], text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzABZ éÉ'’.,!…%|<>\n\t12́÷ßſ")), max_size=40))
def test_encoder_equals_library_on_random_texts(text):
    assert vocab.Encoder.of(PATH).encode(pa.array([text]))[0].tolist() == library(text)[0]


def test_full_table_starts_anew(monkeypatch):
    texts = pa.array([" ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}q" for i in range(26)) + f" z{j}" for j in range(26)])
    want = [library(x)[0] for x in texts.to_pylist()]
    monkeypatch.setattr(vocab, "TABLE_BITS", 6)
    monkeypatch.setattr(vocab, "SLICE", 100)
    small = vocab.Encoder(PATH)
    assert [x.tolist() for x in small.encode(texts)] == want
    long = pa.array([" ".join(x for x in texts.to_pylist())])
    assert small.encode(long)[0].tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("bits", [4, 18])
def test_word_counts_merge(spark, bits):
    from collections import Counter

    docs = spark.createDataFrame([("a b a C",), ("c d e f g h i j k l m n",), ("a",), (None,)], "text string").coalesce(1)
    found = {r["word"].decode(): r["n"] for r in bpe.count_words(docs, "text", bits=bits).collect()}
    assert found == Counter("abaccdefghijklmna")


@pytest.mark.parametrize("hot", [bpe.HOT_WORDS, 20, 0])
def test_bpe(spark, hot):
    rows = messy() + [(5000 + k, t, None, None, None) for k, t in enumerate(HARD)]
    found = bpe.bpe(frame(spark, rows), PATH, hot_words=hot).collect()
    got = sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in found)
    want = sorted((str(r[0]), *(lambda x: (tuple(x[0]), x[1]))(library(r[1]))) for r in rows)
    assert got == want


def thue_morse(n):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("hot", [bpe.HOT_WORDS, 0])
def test_unlike_words_keep_their_ids(spark, hot):
    rows = [(k, t, None, None, None) for k, t in enumerate([*thue_morse(1024), *thue_morse(64), " ".join(thue_morse(1024))])]
    found = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.bpe(frame(spark, rows, 1), PATH, hot_words=hot).collect()}
    assert found == {r[0]: library(r[1]) for r in rows}
    for text, ids in zip(rows, vocab.Encoder(PATH).encode(pa.array([r[1] for r in rows])), strict=True):
        assert ids.tolist() == library(text[1])[0]


def test_a_frequent_long_word_is_salted(spark, monkeypatch):
    monkeypatch.setattr(bpe._hot, "__defaults__", (8,))
    rows = [(k, "x" * 70 + f" w{k} J\u030c" + " y" * (k % 3), None, None, None) for k in range(60)] + [(100 + k, "J\u030c whole", None, None, None) for k in range(30)]
    found = sorted((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.bpe(frame(spark, rows), PATH).collect())
    assert found == sorted((r[0], *(lambda x: (tuple(x[0]), x[1]))(library(r[1]))) for r in rows)


def test_bpe_empty(spark):
    assert bpe.bpe(frame(spark, []), PATH).count() == 0


def test_decode_joins_pieces(spark):
    ids = library("Hello, wörld <|endoftext|>")[0]
    rows = spark.createDataFrame([(1, ids), (2, []), (3, [])], "k int, ids array<int>")
    found = {r["k"]: r["decoded"] for r in bpe.decode(rows, PATH, "k").collect()}
    assert found == {1: library("Hello, wörld <|endoftext|>")[1], 2: "", 3: ""}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 20), st.integers(0, (1 << 64) - 1)), max_size=600), max_size=4))
def test_codec_round_trip(docs):
    ids = [np.array(d, dtype=np.uint64) for d in docs]
    keys, tokens, values = tokenfile.unpack_segment(tokenfile.pack_segment([*range(len(docs))], ids))
    assert keys == [*range(len(docs))] and tokens.tolist() == [len(d) for d in docs]
    assert values.tolist() == [x for d in docs for x in d]


def test_codec_uses_runs_and_escapes():
    zeros = tokenfile.pack_segment([1], [np.zeros(256 * 40, np.uint64)])
    assert len(zeros) < 1500
    big = np.array([(1 << 60) - 1, (1 << 64) - 1, 5], dtype=np.uint64)
    assert tokenfile.unpack_segment(tokenfile.pack_segment([None], [big]))[2].tolist() == big.tolist()
    with pytest.raises(ValueError):
        tokenfile.unpack_segment(b"nothing")


def test_token_files(spark, tmp_path):
    rows = messy()
    docs = frame(spark, rows)
    tokenfile.write_token_files(docs, str(tmp_path / "t"), PATH, segment_tokens=500)
    found = tokenfile.read_token_files(spark, str(tmp_path / "t")).collect()
    assert len(found) == len(rows)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: (r["start"], r["n_tokens"]))]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    want = sorted((str(r[0]), tuple(library(r[1])[0]) + (2,)) for r in rows)
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in found) == want


def test_hot_ids_have_several_parts(spark, tmp_path):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k} of many", None, None, None) for k in range(600)]
    tokenfile.write_token_files(frame(spark, rows), str(tmp_path / "t"), PATH, segment_tokens=100)
    sizes = {r["part"]: r["n"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("part").agg({"tokens": "sum"}).toDF("part", "n").collect()}
    assert max(sizes.values()) <= 0.5 * sum(sizes.values()) and len(sizes) >= 3
    found = tokenfile.read_token_files(spark, str(tmp_path / "t")).collect()
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert sorted(tuple(r["ids"]) for r in found) == sorted(tuple(library(r[1])[0]) + (2,) for r in rows)


def test_token_files_of_nothing(spark):
    assert tokenfile.token_files(frame(spark, []), PATH).count() == 0
