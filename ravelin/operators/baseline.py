"""Fingerprints and the baseline gate."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.sources.files import relative


def fingerprint(root: str) -> Column:
    """16 hex digits that do not depend on the line of the finding."""
    file = F.coalesce("file", F.lit(""))
    parts = [
        F.coalesce("rule_id", F.lit("")),
        relative(file, root),
        F.coalesce("cwe", F.lit("")),
        F.coalesce("title", "message", F.lit("")),
        T.collapse_whitespace(F.coalesce("evidence", F.lit(""))),
    ]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def with_fingerprint(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(root))


def from_json(df: DataFrame, column: str) -> DataFrame:
    """Fingerprints in JSON texts {version, fingerprints[]}; bad JSON has none."""
    parsed = F.from_json(F.col(column), "fingerprints array<string>")
    return (
        df.select(F.explode(parsed["fingerprints"]).alias("fingerprint"))
        .where(F.col("fingerprint").isNotNull())
        .distinct()
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    """A baseline written by ``save`` or as one JSON file; none if absent."""
    try:
        texts = spark.read.text(path, wholetext=True)
        texts.schema  # the path is checked here
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "fingerprint string")
    lines = texts.select(F.explode(T.splitlines(F.col("value"))).alias("value"))
    rows = lines.select(
        F.from_json("value", "fingerprint string")["fingerprint"].alias("fingerprint")
    ).where(F.col("fingerprint").isNotNull())
    return from_json(texts, "value").union(rows).distinct()


def fingerprints(df: DataFrame, root: str) -> DataFrame:
    """Sorted distinct fingerprints of a finding set."""
    return (
        df.select(fingerprint(root).alias("fingerprint")).distinct().orderBy("fingerprint")
    )


def save(df: DataFrame, root: str, path: str) -> int:
    """Write the baseline as JSON rows, range-sorted over many files; returns its size."""
    fingerprints(df, root).write.mode("overwrite").json(path)
    return df.sparkSession.read.schema("fingerprint string").json(path).count()


def add(prints: DataFrame, path: str) -> int:
    """Add fingerprints to a baseline written by ``save``; returns how many are new."""
    spark = prints.sparkSession
    fresh = prints.select("fingerprint").distinct().join(load(spark, path), "fingerprint", "left_anti")
    count = fresh.count()
    fresh.write.mode("append").json(path)
    return count


def gate(df: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """Findings whose fingerprint is not in the baseline."""
    return with_fingerprint(df, root).join(known.distinct(), ["fingerprint"], "left_anti")


def suppressed(df: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """One row: how many findings the baseline hides."""
    return with_fingerprint(df, root).join(known.distinct(), ["fingerprint"], "left_semi").agg(F.count("*").alias("suppressed"))


def flagged(df: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """All findings with ``is_known``, so that the gate and its count come from
    one pass over the scan."""
    marked = known.distinct().withColumn("is_known", F.lit(True))
    return with_fingerprint(df, root).join(marked, ["fingerprint"], "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
