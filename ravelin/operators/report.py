"""JSON and SARIF reports."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin import schema
from ravelin.operators import algebra
from ravelin.sources.tables import written

# SARIF level and score per severity.
SARIF_LEVEL = {
    "CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "none",
}
SECURITY_SEVERITY = {
    "CRITICAL": "9.3", "HIGH": "7.5", "MEDIUM": "5.0", "LOW": "3.1", "INFO": "0.0",
}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0"
SARIF_VERSION = "2.1.0"
TOOL_NAME = "ravelin"
SARIF_LIMIT = 200


def lookup(key: Column, table: dict, default: str) -> Column:
    return F.coalesce(F.try_element_at(schema.literal_map(table), key), F.lit(default))


def header(df: DataFrame, target: str) -> DataFrame:
    """One row: target, risk and counts of a report."""
    return algebra.risk(df).select(
        F.lit(target).alias("target"), "risk_level", "risk_score", "total", "exit_code",
        *[s.lower() for s in schema.SEVERITIES],
    )


def write_json(df: DataFrame, target: str, path: str) -> None:
    """The report as a folder: ``header`` and, in many files, ``findings``."""
    header(df, target).write.mode("overwrite").json(f"{path}/header")
    df.write.mode("overwrite").json(f"{path}/findings")


def sarif_results(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings in order with the index of their rule, the first ``limit`` if given.

    Rules are numbered from one row each; findings join their number.  Without a limit nothing is
    sorted here: ``_order`` holds the order.
    """
    upper = F.upper(F.coalesce("severity", F.lit("INFO")))
    chosen = df if limit is None else algebra.limit_in_order(df, limit)
    top = chosen.withColumns(
        {
            "rule_id": F.coalesce("rule_id", F.lit("UNKNOWN")),
            "level": lookup(upper, SARIF_LEVEL, "none"),
            "security_severity": lookup(upper, SECURITY_SEVERITY, "0.0"),
            "start_line": F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)),
            "_order": algebra.order_of(df),
        }
    )
    first = top.groupBy("rule_id").agg(F.min("_order").alias("_first"))
    return top.join(algebra.numbered(first, F.col("_first"), "rule_index"), "rule_id").withColumn(
        "rule_index", F.col("rule_index").cast("int")
    )


def _rule() -> Column:
    cwe = F.coalesce("cwe", F.lit(""))
    return F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_id").alias("name"),
        F.struct(F.coalesce("title", "message", "rule_id").alias("text")).alias("shortDescription"),
        F.struct(F.col("level")).alias("defaultConfiguration"),
        F.struct(
            F.when(
                cwe != "",
                F.array(F.lit("security"), F.concat(F.lit("external/cwe/"), F.lower(cwe))),
            ).otherwise(F.array(F.lit("security"))).alias("tags"),
            F.col("security_severity").alias("security-severity"),
            cwe.alias("cwe"),
        ).alias("properties"),
    )


def _result() -> Column:
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("rule_index").alias("ruleIndex"),
        F.col("level"),
        F.struct(F.coalesce("message", "title", F.lit("Finding")).alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.coalesce("file", F.lit("unknown")).alias("uri")).alias("artifactLocation"),
                    F.struct(F.col("start_line").alias("startLine")).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(
            F.coalesce("severity", F.lit("INFO")).alias("severity"),
            F.coalesce("source", F.lit("")).alias("source"),
        ).alias("properties"),
    )


def sarif_parts(df: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """The SARIF document in parts, each a frame (place, value) of text lines in order of ``place``.

    Joined in the order of the names and places the lines are one JSON document.  Findings are
    numbered by two-level prefix sums; each is one line and nothing is gathered.
    """
    spark = df.sparkSession
    rows = written(algebra.numbered(sarif_results(df, limit), F.col("_order"), "place"), "sarif")
    firsts = rows.groupBy("rule_index").agg(F.min_by(_rule(), "place").alias("rule"))

    def fixed(text):
        return spark.range(1).select(F.col("id").alias("place"), F.lit(text).alias("value"))

    def listed(rows, place, body):
        comma = F.when(place == 0, "").otherwise(",")
        return rows.select(place.cast("long").alias("place"), F.concat(comma, F.to_json(body)).alias("value"))

    quoted = [json.dumps(v) for v in (SARIF_SCHEMA, SARIF_VERSION, TOOL_NAME)]
    head = '{{"$schema":{},"version":{},"runs":[{{"tool":{{"driver":{{"name":{},"rules":['.format(*quoted)
    return {
        "0-head": fixed(head),
        "1-rules": listed(firsts, F.col("rule_index"), F.col("rule")),
        "2-between": fixed(']}},"results":['),
        "3-results": listed(rows, F.col("place"), _result()),
        "4-tail": fixed("]}]}"),
    }


def write_sarif(df: DataFrame, path: str, limit: int | None = None) -> None:
    """The SARIF document as text files below ``path``, range-sorted: all files joined in the order of
    their names are the document."""
    for name, rows in sarif_parts(df, limit).items():
        ordered = rows if name[0] in "024" else rows.repartitionByRange("place").sortWithinPartitions("place")
        ordered.select("value").write.mode("overwrite").text(f"{path}/{name}")


def sarif(df: DataFrame, limit: int) -> DataFrame:
    """One row with the SARIF document of the first ``limit`` findings as JSON text.

    A document in one value must be small, so the limit is asked for; ``write_sarif`` has none.
    """
    lines = None
    for k, rows in enumerate(sarif_parts(df, limit).values()):
        part = rows.select(F.struct(F.lit(k).alias("part"), "place", "value").alias("line"))
        lines = part if lines is None else lines.unionByName(part)
    ordered = F.array_sort(F.collect_list("line"))
    return lines.agg(F.array_join(ordered["value"], "\n").alias("sarif"))


def tool_summary(df: DataFrame, target: str, floor: str = "LOW") -> DataFrame:
    """Header for a tool call: risk and levels over all findings, ``total`` over
    those of at least the given severity."""
    minimum = schema.SEVERITY_ORDINAL.get(floor.upper(), 1)
    marked = df.withColumn("_listed", schema.severity_ordinal(F.col("severity")) >= minimum)
    return algebra.risk(
        marked, extra=[F.count_if("_listed").alias("listed")]
    ).select(
        F.lit(target).alias("target"), "risk_level", "risk_score",
        F.col("listed").alias("total"), *[s.lower() for s in schema.SEVERITIES],
    )


def tool_findings(df: DataFrame, floor: str = "LOW", limit: int | None = None) -> DataFrame:
    """Findings of at least the given severity in order, seven columns."""
    return algebra.narrow(algebra.limit_in_order(algebra.at_least(df, floor), limit))
