"""Corpus pipeline: from raw documents to token ids, every stage over all rows kept before it.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and hands the table on.  All but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import bpe, simhash, substring, templates, toxicity
from ravelin.llm.shared import written

#: Documents with at least this probability of being toxic go.
TOXIC = 0.5
WORDS_OF_SHINGLE, DIFFERING_BITS, REPEATED_WORDS = 4, 4, 20


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not call toxic, learned from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learned(docs, "doc_id", "text", labels, "doc_id", "toxic")
    free = "_".join(["score", *docs.columns])  # longer than any column of the input
    scored = toxicity.scored(docs, "text", model, free)
    return scored.where(F.col(free) < TOXIC).select(*docs.columns)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash group."""
    return simhash.keep_first(docs, "doc_id", "text", WORDS_OF_SHINGLE, DIFFERING_BITS)


def drop_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier in the corpus.

    Texts that lose words are their other words joined by one space, n_chars follows; others
    stay as they are, white space included.
    """
    return substring.without_repeats(docs, "doc_id", "text", REPEATED_WORDS, size="n_chars")


def drop_benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, also none with other numbers or names."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return templates.without_contaminated(docs, "doc_id", "text", items, "item_id", "text")


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed ids of every text, and whether they decode to it."""
    codec = bpe.Codec(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    coded = codec.round_trip(docs.select("doc_id", "text"), "text")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]

#: Training, hashing and byte-pair merging have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
