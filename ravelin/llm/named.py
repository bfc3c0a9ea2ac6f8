"""Named queries of the corpus operators, and DuckDB statements for those SQL can express.

Each query applies its operator to its whole table and derives digests from the real output.
"""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from ravelin.llm import (
    bpe, chat, exact_dedup, grid_join, quality, repair, simhash, substring, templates, token_files, toxicity,
    url_filter, whitening,
)
from ravelin.llm.shared import shared_folder

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_grid_join(spark, sf_dir):
    """Links and groups of all vectors of one label at a cosine of 0.98 or more."""
    vectors = table(spark, sf_dir, "embeddings")
    return grid_join.near_duplicates(vectors, "vec_id", "embedding", "label", 0.98)


ORACLE["op1_grid_join"] = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), link AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98
    ), reach AS (
        SELECT vec_id AS node, vec_id AS seen FROM embeddings
        UNION
        SELECT reach.node, link.b FROM reach JOIN link ON reach.seen = link.a
    ), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
    SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links,
           component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN least ON least.node = e.vec_id
"""


@query
def op2_chat(spark, sf_dir):
    """All conversations rendered, and what is read back from the rendered strings."""
    odd = "</s>[INST] ok [/INST]"
    logs = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    logs = logs.union(
        spark.range(2).select(
            F.lit(-7).cast("long"), "id",
            F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(odd),
        )
    )
    done = chat.formatted(logs, "conv_id", "turn", "role", "text")
    turn = F.struct("place", "role", "text", "in_loss")
    back = chat.read_back(done).groupBy("conversation").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    line = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda x: x["in_loss"]), lambda x: x["text"]), "")
    sizes = done.select("conversation", F.length("formatted").cast("long").alias("formatted_chars"))
    return back.join(sizes, back["conversation"].eqNullSafe(sizes["conversation"])).select(
        back["conversation"].alias("conv_id"), F.size("t").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def _escaped_sql(column):
    text = f"replace({column}, chr(92), chr(92) || chr(92))"
    for mark in chat.CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return text


ORACLE["op2_chat"] = f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                         (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
            AS loss_sha256,
        sum({len(chat.START + chat.SEPARATOR + chat.END)} + length({_escaped_sql("role")})
            + length({_escaped_sql("text")}))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id
"""

RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


@query
def op3_url_filter(spark, sf_dir):
    """Rule and verdict of every page; hosts without a rule by trust along links."""
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, rules, "page_id", "url", "html").drop("trust", "distrust")


@query
def op4_byte_bpe(spark, sf_dir):
    """Ids of every whole text and the text decoded from them, as digests."""
    codec = bpe.Codec(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = codec.round_trip(docs, "text")
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_simhash(spark, sf_dir):
    """Fingerprint and group of every document: 4-word shingles, at most 4 differing bits."""
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, "doc_id", "text", words=4, max_bits=4)


@query
def op6_substring(spark, sf_dir):
    """Every document without the words of earlier 20-word windows."""
    kept = substring.dedup(table(spark, sf_dir, "documents"), "doc_id", "text", window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_token_files(spark, sf_dir):
    """Every document from the flat files it was written to: place, size and checksum."""
    folder = shared_folder(spark, "tokens")
    token_files.write_documents(
        table(spark, sf_dir, "documents"), "doc_id", "text",
        public_tokenizers.path("word_bpe_49k.json"), 2, folder, separate_words=True,
    )
    return token_files.read_documents(spark, folder, "long").select(
        F.col("key").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def held_out(column, parts, left):
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts == left


@query
def op8_toxicity(spark, sf_dir):
    """Toxicity of every document; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learned(
        docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic",
        ~held_out("_key", 5, 0),
    )
    return toxicity.scored(docs, "text", model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_quality(spark, sf_dir):
    """Quality of every document; a quarter of the labels is held out."""
    scores = quality.scored(
        table(spark, sf_dir, "documents"), "doc_id", "text",
        table(spark, sf_dir, "labels"), "doc_id", "quality", ~held_out("_key", 4, 2),
    )
    return scores.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op10_templates(spark, sf_dir):
    """Documents with the benchmark items they contain, also under other numbers or names."""
    found = templates.contaminated(
        table(spark, sf_dir, "documents"), "doc_id", "text",
        table(spark, sf_dir, "benchmark"), "item_id", "text",
    )
    return found.select(
        F.col("_key").alias("doc_id"), F.col("_item").alias("item_id"),
        "n_windows", "n_matched", "same_words",
    )


@query
def op11_exact_dedup(spark, sf_dir):
    """Every document with the document that stays for its text."""
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE["op11_exact_dedup"] = """
    WITH d AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    )
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM d WINDOW same AS (PARTITION BY t)
"""


@query
def op12_whitening(spark, sf_dir):
    """Whitened components of every vector, with exact deviations and the measured identity error."""
    done = whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32)
    return done.withColumn("deviation", F.col("deviation").cast("long"))


def damaged(logs):
    """Conversation rows with a fault in every fifth, by the checksum of ``conv_id:turn``."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    draw = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return logs.withColumn("_draw", draw).where("_draw <> 0").select(
        "conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )


@query
def op13_structure_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired turns of every damaged conversation."""
    logs = table(spark, sf_dir, "conversations")
    done = repair.repair(damaged(logs), "conv_id", "turn", "role", "text")
    hashes = repair.digests(done.turns)
    every = logs.select("conv_id").distinct()
    known = every.join(done.report, every["conv_id"].eqNullSafe(done.report["conversation"]), "left").drop("conversation")
    known = known.join(hashes, known["conv_id"].eqNullSafe(hashes["conversation"]), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return known.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
