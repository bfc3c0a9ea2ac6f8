"""Detection quality on labelled snippets, and rule coverage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin import catalog

MIN_RECALL = 0.90  # fixed value: pass mark, together with no false positive


def score_cases(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Per labelled file: was the declared class found, was anything found.

    ``cases`` has path, case_id, side ('vulnerable' or 'secure'), cwe, modelled.
    Findings are reduced per file before the join.
    """
    per_file = findings.groupBy(F.col("file").alias("path")).agg(
        F.collect_set("cwe").alias("cwes"), F.min("rule_id").alias("first_rule")
    )
    return cases.join(per_file, "path", "left").withColumns(
        {
            "hit": F.coalesce(F.array_contains("cwes", F.col("cwe")), F.lit(False)),
            "flagged": F.col("cwes").isNotNull(),
        }
    )


def scorecard(scored: DataFrame) -> DataFrame:
    """Recall, false-positive rate, precision for the modelled set and overall."""
    vulnerable, secure = F.col("side") == "vulnerable", F.col("side") == "secure"
    per_scope = scored.withColumn("scope", F.explode(scopes()))
    counted = per_scope.groupBy("scope").agg(
        F.count_if(vulnerable).alias("cases"),
        F.count_if(vulnerable & F.col("hit")).alias("tp"),
        F.count_if(secure & F.col("flagged")).alias("fp"),
        F.count_if(secure).alias("secure_cases"),
    )
    recall = F.coalesce(F.try_divide("tp", "cases"), F.lit(0.0))
    return counted.withColumns(
        {
            "recall": recall,
            "fpr": F.coalesce(F.try_divide("fp", "secure_cases"), F.lit(0.0)),
            "precision": F.coalesce(
                F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)
            ),
            "passed": (F.col("fp") == 0) & (recall >= MIN_RECALL),
        }
    )


def missed_cases(scored: DataFrame) -> DataFrame:
    """Vulnerable cases whose declared class was not found."""
    return (
        scored.where((F.col("side") == "vulnerable") & ~F.col("hit"))
        .select("case_id", "cwe", "modelled")
        .distinct()
    )


def false_positives(scored: DataFrame) -> DataFrame:
    """Secure cases with a finding, and its rule."""
    return (
        scored.where((F.col("side") == "secure") & F.col("flagged"))
        .select("case_id", F.col("first_rule").alias("rule_id"))
        .distinct()
    )


def scopes() -> Column:
    return F.when(
        F.col("modelled"), F.array(F.lit("modelled"), F.lit("overall"))
    ).otherwise(F.array(F.lit("overall")))


def rule_summary(rules: DataFrame) -> DataFrame:
    """Rules and distinct classes per language."""
    return (
        rules.where(F.col("language").isNotNull())
        .groupBy("language")
        .agg(
            F.count("*").alias("rules"),
            F.countDistinct("cwe").alias("classes"),
            F.array_join(F.array_sort(F.collect_set("cwe")), ",").alias("cwes"),
        )
    )


def silent_rules(findings: DataFrame) -> DataFrame:
    """Source rules that never fired."""
    rules = catalog.rules(findings.sparkSession).where(F.col("language").isNotNull())
    fired = findings.select("rule_id").distinct()
    return rules.select("rule_id").join(fired, "rule_id", "left_anti")
