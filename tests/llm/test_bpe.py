"""Byte-level BPE against the tiktoken library, and round trips."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ravelin.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as file:
        return bpe.Vocabulary(file.read(), P.PATTERN)


def texts():
    draw = random.Random(3)
    odd = ["", " ", "a\x1cb\x85c\xa0 d", "aaaa" * 300, "日本語。テキスト" * 9, "👍🏽" * 80, "x" * 900 + " the", "'s 'LL"]
    letters = ["ab c\n\té日😀's1,.", "abcde"]
    return odd + [
        "".join(draw.choice(letters[i % 2]) for _ in range(draw.randint(1, 700))) for i in range(120)
    ]


def test_same_ids_as_the_library(vocabulary):
    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={}
    )
    for text, got in zip(texts(), vocabulary.encode_series(texts()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)


def test_long_texts_go_block_by_block(vocabulary, monkeypatch):
    whole = vocabulary.encode_series(["the cat sat, 12 times. " * 40])
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    assert vocabulary.encode_series(["the cat sat, 12 times. " * 40]) == whole


def test_round_trip_keeps_columns_and_nulls(spark):
    codec = bpe.Codec(spark, RANKS, P.PATTERN)
    rows = [(1, "one two", 5), (None, None, None), (1, "one two", 5), (3, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = codec.round_trip(df, "text", "packed", "back").orderBy("doc_id").collect()
    assert sorted((r["back"] or b"").decode() for r in out) == ["", "", "one two", "one two"]
    assert {r["ids"] for r in out} == {5, None, 7}
    assert codec.round_trip(df.limit(0), "text").count() == 0
    unpacked = codec.round_trip(df, "text").select(bpe.id_array("ids").alias("a")).collect()
    assert sorted(len(r["a"]) for r in unpacked) == [0, 0, 2, 2]
    one = df.where("doc_id = 3 OR doc_id IS NULL").select(codec.decode(codec.encode(df["text"])).alias("b"))
    assert [bytes(r["b"]) for r in one.collect()] == [b"", b""]


def test_text_column_may_have_an_output_name(spark):
    codec = bpe.Codec(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    df = spark.createDataFrame([(1, "ab cd", 2)], "k int, ids string, x int")
    out = codec.round_trip(df, "ids").first()
    assert (out["k"], out["x"], bytes(out["decoded"])) == (1, 2, b"ab cd")
