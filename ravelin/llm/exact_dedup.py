"""Exact duplicates with a heavy-hitter split.

Every text becomes a digest, and the digests are written once.  A Misra-Gries summary per
partition, summed over partitions, names the few digests that may be frequent; their exact sizes
and winners come from one aggregate with a map-side step over the written digests.  These verified
winners are broadcast, so rows of a frequent digest are settled where they lie and never meet in
one task.  All other digests are rare by proof and take an ordinary shuffle.

With k counters over n rows a partition of m rows understates a count by at most m / (k + 1), the
sum over partitions by at most n / (k + 1).  So a digest of 2n / (k + 1) rows or more has a sum of
at least n / (k + 1), and since all sums together are at most n, no more than k + 1 digests have.
The broadcast holds at most that many rows of some 60 bytes, whatever the corpus.
"""

import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.shared import written

#: Counters of a summary: groups of more than n / 2048 rows are settled without a shuffle.
COUNTERS = 4096


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class Summary:
    """Misra-Gries counters of weighted items: at most ``size`` of them after each batch."""

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, items, weights) -> None:
        counts = self.counts
        for item, weight in zip(items, weights, strict=True):
            counts[item] = counts.get(item, 0) + weight
        if len(counts) > self.size:
            # Taking the (size + 1)-th largest count from all leaves at most ``size`` counters.
            cut = sorted(counts.values(), reverse=True)[self.size]
            self.counts = {item: count - cut for item, count in counts.items() if count > cut}


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(d): every value of ``d`` on at least 2n / (counters + 1) of the n rows, and perhaps others,
    at most counters + 1 in all.  Values on one row only may be among them in a small table."""

    def summarise(batches):
        summary = Summary(counters)
        for batch in batches:
            for entry in pc.value_counts(batch.column(0)).to_pylist():
                summary.add([entry["values"]], [entry["counts"]])
        if summary.counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(summary.counts.keys(), pa.binary()), pa.array(summary.counts.values(), pa.int64())],
                ["d", "c"],
            )

    sums = digests.select("d").mapInArrow(summarise, "d binary, c long").groupBy("d").agg(F.sum("c").alias("c"))
    return sums.where(F.col("c") >= digests.count() / (counters + 1)).select("d")


def settled(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digests`` (id, d, ...), a table that can be read again, with ``keep`` (the largest id of the
    equal digests) and ``n`` (their rows)."""
    candidates = F.broadcast(frequent(digests, counters))
    winners = (
        digests.join(candidates, "d").groupBy("d")
        .agg(F.max("id").alias("keep"), F.count("*").alias("n"))
        .where("n > 1")
    )
    winners = F.broadcast(written(winners, "winners"))
    common = digests.join(winners, "d")
    same = Window.partitionBy("d")
    rare = digests.join(winners, "d", "left_anti").withColumns(
        {"keep": F.max("id").over(same), "n": F.count("*").over(same)}
    )
    return common.unionByName(rare)


def duplicates(docs: DataFrame, key: str, text: str, counters: int = COUNTERS) -> DataFrame:
    """(key, keep_id, group_size, kept, digest), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, so null and
    empty texts are one group.  The row with the largest key stays; a null key is smaller than any
    other and stays only where no other key has the text.  Rows that repeat key and text count in
    ``group_size`` one by one and are kept or not together (``keep_last`` keeps one of them).
    Other columns are not read.  Texts may be of any length; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), digest(F.col(text)).alias("d"))
    return settled(written(rows, "digests"), counters).select(
        F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("d").alias("digest"),
    )


def keep_last(docs: DataFrame, key: str, text: str, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns as they are.

    Rows that repeat the winning key and text are one group of a limited window: each task passes
    on one of them (the least by its other columns' hash).
    """
    free = [f"_{i}_" for i in range(len(docs.columns))]
    held = docs.toDF(*free)
    at, body = (held[free[docs.columns.index(c)]] for c in (key, text))
    marked = held.select(*free, digest(body).alias("d"))
    stay = settled(written(held.select(at.alias("id"), digest(body).alias("d")), "digests"), counters)
    stay = written(stay.where("id <=> keep").select("id", "d").distinct(), "kept")
    met = marked.join(stay, [marked["d"] == stay["d"], at.eqNullSafe(stay["id"])], "left_semi")
    order = Window.partitionBy("d").orderBy(F.xxhash64(*free))
    return met.withColumn("r", F.row_number().over(order)).where("r = 1").select(*free).toDF(*docs.columns)
