"""Token files against the tokenizers library, text by text."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from ravelin.llm import token_files
from ravelin.llm.shared import shared_folder

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize(("separate", "special"), [(True, False), (False, False), (True, True)])
def test_files_hold_what_the_library_makes(spark, separate, special, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 300)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 40)
    texts = ["The cat's 12 hats", None, "", "  \t\n", "É́ ΣΑΣ ß", "日本 \u3000 x", "<|endoftext|> a", "A" * 500, "x\x1cy",
             "ab<|startoftext|>.cd <|ENDOFTEXT|>! <|endoftext|>", " a\x0bb\x0c", "word. " * 30_000, "Ab, ab! AB?"]
    rows = [(i * 5 % 47 - 4, t) for i, t in enumerate(texts * 3)] + [(None, "none"), (2, "dup"), (2, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS start")
    folder = shared_folder(spark, "tokens")
    parts = token_files.write_documents(df, "doc_id", "text", PATH, 2, folder, separate, special)
    out = token_files.read_documents(spark, folder, "long").collect()
    model = Tokenizer.from_file(PATH)
    if special:
        model.encode_special_tokens = True
    assert special or 49407 in model.encode("<|endoftext|> a").ids
    want = sorted(
        (str(k), [*model.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows
    )
    got = sorted((str(r["key"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in out)
    assert got == want
    place = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == place
        place += len(r["ids"]) // 4
    keys = [r["key"] for r in sorted(out, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert parts.agg({"ids": "sum"}).first()[0] == place


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = shared_folder(spark, "tokens")
    token_files.write_documents(df, "doc_id", "text", PATH, 2, folder)
    assert token_files.read_documents(spark, folder, "long").count() == 0


def test_memory_of_words_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    with open(PATH, encoding="utf-8") as file:
        coder = token_files.Encoder(file.read(), "<u2", True)
    model = Tokenizer.from_file(PATH)
    for turn in range(12):
        texts = [f"common {turn}x word{'abcdefghijkl'[turn]}{'abcdefghijkl'[k]}, ok." for k in range(12)] + ["", "common"]
        ids, sizes = coder.encode(pa.array(texts))
        want = [model.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
        assert len(coder.memory.young) < 130 and len(coder.memory.old) < 130
        assert b"common" in coder.memory.young
