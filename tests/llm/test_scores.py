"""Toxicity and quality: held-out accuracy, and rows that are hard to score."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import named, quality, toxicity

SMALL = "/root/testdata/sf0.01"
BAD = ["blorg", "snarf", "grumph", "zonk"]


def corpus(n=600):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        own, toxic, junk = draw.choices(words, k=draw.randint(20, 90)), i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                own.insert(draw.randrange(len(own)), draw.choice(BAD))
        text = " ".join(w.upper() + "!!" if junk else w for w in own)
        rows.append((i, text, "x"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None, "x"), (n + 1, "", "x"), (None, "a b c", "x"), (0, rows[0][1], "x")]
    labels += [(None, 1, 1), (5, None, None), (0, 0, 1), (n + 7, 1, 1)]
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, "doc_id", "text", marks, "doc_id", "toxic", F.col("_key") % 5 != 0)
    out = toxicity.scored(docs, "text", model, "p").collect()
    assert len(out) == len(rows) and all(0 <= r["p"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 5 == 0]
    right = [(r["p"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]
    assert np.mean(right) > 0.95
    blank = [r["p"] for r in out if r["doc_id"] in (600, 601)]
    assert blank[0] == blank[1] < 0.5
    assert toxicity.scored(docs.limit(0), "text", model).count() == 0
    none = toxicity.learned(docs, "doc_id", "text", marks.limit(0), "doc_id", "toxic")
    assert {r["q"] for r in toxicity.scored(docs, "text", none, "q").collect()} == {0.5}


def test_long_labelled_texts_are_sampled_in_whole_runs():
    coded = np.arange(100_000, dtype="<u8").tobytes()
    some = np.frombuffer(toxicity.sampled(coded), "<u8").reshape(-1, toxicity.RUN)
    assert some.size <= toxicity.SAMPLE_WORDS and some[0, 0] == 0 and some[-1, -1] == 99_999
    assert (np.diff(some, axis=1) == 1).all() and (some[:, 0] % toxicity.RUN == 0).all()
    assert toxicity.sampled(coded[:800]) == coded[:800]


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.scored(docs, "doc_id", "text", marks, "doc_id", "quality", F.col("_key") % 5 != 0).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 5 == 0]
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in held]) > 0.95
    none = quality.scored(docs, "doc_id", "text", marks.limit(0), "doc_id", "quality").collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.scored(docs.limit(0), "doc_id", "text", marks, "doc_id", "quality").count() == 0


def test_isotonic_levels_do_not_fall():
    draw = np.random.default_rng(1)
    counts = draw.integers(1, 9, 50).astype(float)
    ones = np.minimum(counts, draw.integers(0, 9, 50))
    levels = quality.pooled(counts, ones)
    assert (np.diff(levels) >= 0).all() and len(levels) == 50
    assert abs((levels * counts).sum() - ones.sum()) < 1e-9
    assert quality.pooled(np.ones(3), np.array([0.0, 1.0, 1.0])).tolist() == [0.0, 1.0, 1.0]


def test_statistics_of_long_texts_in_blocks(monkeypatch):
    text = "Aa bb  cc!!\n" * 500
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "BLOCK", 37)
    assert quality.statistics(text) == pytest.approx(whole)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name, label, parts", [("op8_toxicity", "toxic", 5), ("op9_quality", "quality", 4)])
def test_queries_are_right_on_held_out_labels(spark, name, label, parts):
    out = named.QUERIES[name](spark, SMALL)
    joined = out.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out")
    right = joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right > 0.9


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_pipeline_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, texts = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        texts = corpus_pipeline.written(stage(spark, texts, SMALL), "stage")
        assert texts.schema.names == docs.schema.names
        sizes.append(texts.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0.7 * sizes[0]
    coded = corpus_pipeline.STAGES[-1][1](spark, texts, SMALL)
    assert coded.count() == sizes[-1] and coded.where("NOT round_trip").count() == 0
