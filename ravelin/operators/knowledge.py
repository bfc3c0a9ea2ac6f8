"""Findings joined with weakness notes, and the explanation text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin import catalog
from ravelin.operators import algebra

EXPLAIN_LIMIT = 20  # fixed value: findings explained per scan


def with_notes(df: DataFrame) -> DataFrame:
    """Left join with the fixed note table; the class is compared upper-cased."""
    notes = F.broadcast(catalog.cwe_notes(df.sparkSession))
    return df.join(notes, F.upper("cwe") == F.col("kb_cwe"), "left")


def explain(df: DataFrame) -> DataFrame:
    """Add ``explanation``: heading, location, what, why, how to fix."""
    noted = with_notes(df)
    title = F.coalesce("title", "rule_id", F.lit("Finding"))
    cwe = F.coalesce("cwe", F.lit(""))
    heading = F.rtrim(
        F.concat(
            F.lit("* "), title, F.lit("  ["), F.coalesce("severity", F.lit("")),
            F.lit("]  "), cwe,
        )
    )
    file = F.coalesce("file", F.lit(""))
    where = F.when(
        (file != "") & (F.coalesce("line", F.lit(0)) != 0),
        F.concat_ws(":", file, F.col("line").cast("string")),
    ).otherwise(file)
    message = F.coalesce(
        F.nullif("message", F.lit("")), F.nullif("description", F.lit(""))
    )
    known = F.concat_ws(
        "\n",
        F.concat(F.lit("\n  weakness  "), F.col("name"), F.lit(".")),
        F.concat(F.lit("  effect    "), F.col("why")),
        F.concat(F.lit("  remedy    "), F.col("fix")),
        F.concat(F.lit("  see also  "), F.col("ref")),
    )
    unknown = F.concat_ws(
        "\n",
        F.concat(F.lit("\n  "), message),
        F.lit("  (No note for this weakness class.)"),
    )
    text = F.concat_ws(
        "\n",
        heading,
        F.when(where != "", F.concat(F.lit("  at        "), where)),
        F.when(F.col("name").isNotNull(), known).otherwise(unknown),
    )
    return noted.withColumn("explanation", text).drop("kb_cwe", "name", "why", "fix", "ref")


def fix_advice(df: DataFrame) -> DataFrame:
    """Add ``advice``: the fix of the note, or the standard sentence."""
    noted = with_notes(df)
    advice = F.concat(
        F.lit("Recommended fix ("), F.coalesce("cwe", F.lit("")), F.lit("): "),
        F.coalesce("fix", F.lit("Apply the standard remediation for this class.")),
    )
    return noted.withColumn("advice", advice).drop("kb_cwe", "name", "why", "fix", "ref")


def explain_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Explanations of the findings of a scan in order, the first ``limit`` if given."""
    return explain(algebra.limit_in_order(df, limit))
