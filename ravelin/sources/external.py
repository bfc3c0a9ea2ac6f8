"""Result files of other tools to findings: Semgrep, Slither, cargo-audit, OSV.

Every reader takes a frame with one JSON text per row, so the same code reads a
folder of result files (``read_json_texts``) and a table column.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import schema
from ravelin.functions import text as T
from ravelin.operators.algebra import dedup_by_rule
from ravelin.operators.report import lookup

# Severity maps and score bounds.
SEMGREP_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
SLITHER_IMPACT = {
    "High": "HIGH", "Medium": "MEDIUM", "Low": "LOW", "Informational": "INFO",
    "Optimization": "INFO",
}
SEMGREP = (
    "results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,"
    "extra:struct<message:string,severity:string,lines:string,metadata:struct<"
    "cwe:string,`cwe2022-top25`:string,owasp:string,`owasp-top-ten`:string,"
    "fix:string,references:array<string>,category:string>>>>"
)
SLITHER = (
    "results struct<detectors:array<struct<check:string,impact:string,confidence:string,"
    "description:string,elements:array<struct<source_mapping:struct<"
    "filename_relative:string,filename_short:string,filename_absolute:string,"
    "lines:array<int>>>>>>>"
)
CARGO_AUDIT = (
    "vulnerabilities struct<list:array<struct<advisory:struct<id:string,cvss:string,"
    "title:string,description:string,aliases:array<string>>,"
    "package:struct<name:string,version:string>>>>"
)
OSV = (
    "id string, aliases array<string>, summary string, details string, "
    "severity array<struct<type:string,score:string>>, "
    "database_specific struct<severity:string>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>, "
    "references array<struct<url:string>>"
)


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")
    )


def parse_object(text: Column, fields: str) -> Column:
    """A JSON object; anything else becomes an object without fields.

    Broken JSON parses to null by itself; only lists need to be kept out.
    """
    return F.from_json(F.when(text.rlike(r"^\s*\{"), text), fields)


def is_json_object(text: Column) -> Column:
    parsed = F.try_parse_json(text)
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def cvss_bucket(score: Column, default: str) -> Column:
    value = score.try_cast("double")
    return (
        F.when(value.isNull(), default)
        .when(value >= 9.0, "CRITICAL")
        .when(value >= 7.0, "HIGH")
        .when(value >= 4.0, "MEDIUM")
        .otherwise("LOW")
    )


def result_place() -> Column:
    """Order of a result: its file, then its place there, which fits 31 bits."""
    return F.shiftleft(F.col("_o").cast("bigint"), 31) + F.col("pos")


def semgrep_findings(df: DataFrame, column: str, order: str, default_path: str = "") -> DataFrame:
    """Semgrep results, first per rule, file and line."""
    rows = df.select(
        F.col(order).cast("bigint").alias("_o"),
        F.posexplode(parse_object(F.col(column), SEMGREP)["results"]).alias("pos", "r"),
    )
    meta, extra = F.col("r.extra.metadata"), F.col("r.extra")
    tags = F.coalesce(meta["cwe"], meta["cwe2022-top25"], F.lit(""))
    number = F.regexp_extract(tags, r"(?i)CWE-(\d+)", 1)
    owasp = F.coalesce(F.nullif(meta["owasp"], F.lit("")), meta["owasp-top-ten"])
    first_owasp = F.coalesce(F.get_json_object(owasp, "$[0]"), owasp)
    rule = F.coalesce("r.check_id", F.lit("SEMGREP"))
    message = F.coalesce(extra["message"], F.col("r.check_id"), F.lit("Semgrep finding"))
    refs = F.coalesce(meta["references"], F.array().cast("array<string>"))
    found = rows.select(
        F.lit("sast").alias("engine"),
        F.lit(0).alias("engine_rank"),
        F.lit(1).alias("pack_rank"),
        result_place().alias("seq"),
        F.lit("semgrep").alias("source"),
        rule.alias("rule_id"),
        lookup(F.coalesce(extra["severity"], F.lit("WARNING")), SEMGREP_SEVERITY, "MEDIUM").alias("severity"),
        message.alias("title"),
        message.alias("message"),
        message.alias("description"),
        F.when(number != "", F.concat(F.lit("CWE-"), number)).otherwise("").alias("cwe"),
        F.coalesce(meta["category"], F.lit("security")).alias("category"),
        F.coalesce("r.path", F.lit(default_path)).alias("file"),
        F.coalesce("r.start.line", F.lit(1)).alias("line"),
        F.coalesce("r.start.col", F.lit(1)).alias("col"),
        T.strip(F.coalesce(extra["lines"], F.lit(""))).alias("evidence"),
        F.coalesce(meta["fix"], F.try_element_at(refs, F.lit(1)), F.lit("")).alias("recommendation"),
        F.lit(75.0).alias("confidence"),
        refs.alias("refs"),
        F.create_map(
            F.lit("owasp"), F.coalesce(first_owasp, F.lit("")),
            F.lit("type"), F.element_at(F.split(rule, r"\."), -1),
        ).alias("extra"),
    )
    return dedup_by_rule(schema.conform(found))


def slither_findings(df: DataFrame, column: str, order: str, root: str = "") -> DataFrame:
    """Slither detectors; the first element that names a file gives the place."""
    rows = df.select(
        F.col(order).cast("bigint").alias("_o"),
        F.posexplode(parse_object(F.col(column), SLITHER)["results"]["detectors"]).alias("pos", "d"),
    )

    def file_of(e: Column) -> Column:
        m = e["source_mapping"]
        return F.coalesce(
            *[F.nullif(m[f"filename_{k}"], F.lit("")) for k in ("relative", "short", "absolute")]
        )

    place = F.try_element_at(
        F.filter(F.col("d.elements"), lambda e: file_of(e).isNotNull()), F.lit(1)
    )
    description = F.nullif("d.description", F.lit(""))
    heading = F.coalesce(description, F.nullif("d.check", F.lit("")), F.lit("Slither finding"))
    return schema.conform(
        rows.select(
            F.lit("web3").alias("engine"),
            F.lit(4).alias("engine_rank"),
            F.lit(3).alias("pack_rank"),
            result_place().alias("seq"),
            F.lit("web3:slither").alias("source"),
            F.concat(F.lit("slither:"), F.coalesce("d.check", F.lit("detector"))).alias("rule_id"),
            lookup(F.coalesce("d.impact", F.lit("")), SLITHER_IMPACT, "INFO").alias("severity"),
            F.substring_index(T.strip(heading), "\n", 1).alias("title"),
            T.strip(F.coalesce(description, F.lit(""))).alias("message"),
            F.coalesce(file_of(place), F.lit(root)).alias("file"),
            F.coalesce(F.try_element_at(place["source_mapping"]["lines"], F.lit(1)), F.lit(0)).alias("line"),
            F.col("d.confidence").try_cast("double").alias("confidence"),
            F.create_map(F.lit("confidence"), F.coalesce("d.confidence", F.lit(""))).alias("extra"),
        )
    )


def cargo_audit_findings(df: DataFrame, column: str, order: str, lockfile: str = "Cargo.lock") -> DataFrame:
    """cargo-audit vulnerabilities; one without a score counts as HIGH."""
    rows = df.select(
        F.col(order).cast("bigint").alias("_o"),
        F.posexplode(parse_object(F.col(column), CARGO_AUDIT)["vulnerabilities"]["list"]).alias("pos", "v"),
    )
    adv, pkg = F.col("v.advisory"), F.col("v.package")
    aliases = F.array_join(F.coalesce(adv["aliases"], F.array().cast("array<string>")), ", ")
    return schema.conform(
        rows.select(
            F.lit("sca").alias("engine"),
            F.lit(1).alias("engine_rank"),
            F.lit(1).alias("pack_rank"),
            result_place().alias("seq"),
            F.lit("sca:cargo-audit").alias("source"),
            F.coalesce(adv["id"], F.lit("RUSTSEC")).alias("rule_id"),
            cvss_bucket(adv["cvss"], "HIGH").alias("severity"),
            T.strip(
                F.concat(
                    F.coalesce(pkg["name"], F.lit("crate")), F.lit(" "),
                    F.coalesce(pkg["version"], F.lit("")), F.lit(": "),
                    F.coalesce(adv["title"], F.lit("advisory")),
                )
            ).alias("title"),
            F.coalesce(adv["description"], F.lit("")).alias("message"),
            F.lit(lockfile).alias("file"),
            F.lit(0).alias("line"),
            F.coalesce(F.nullif(aliases, F.lit("")), adv["id"], F.lit("")).alias("cve"),
            pkg["name"].alias("package"),
            pkg["version"].alias("installed_version"),
            adv["aliases"].alias("aliases"),
        )
    )


def osv_severity(severity: Column, database: Column, skip_version: bool = False) -> Column:
    """Severity of an advisory.

    The first number in the first CVSS entry decides.  In a vector text that
    number is the CVSS version, so 'CVSS:3.1/...' reads as LOW; with
    ``skip_version`` vectors are passed over instead.
    """
    numbers = F.transform(
        F.filter(
            severity,
            lambda s: F.upper(F.coalesce(s["type"], F.lit(""))).contains("CVSS")
            & (~s["score"].startswith("CVSS:") if skip_version else F.lit(True)),
        ),
        lambda s: F.regexp_extract(s["score"], r"(\d+\.?\d*)", 1).try_cast("double"),
    )
    first = F.try_element_at(F.filter(numbers, lambda n: n.isNotNull()), F.lit(1))
    named = F.upper(database)
    return F.when(first.isNotNull(), cvss_bucket(first, "LOW")).otherwise(
        F.when(named.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), named).otherwise("MEDIUM")
    )


def osv_advisories(df: DataFrame, column: str, skip_version: bool = False) -> DataFrame:
    """An OSV dump as advisory rows, ready for ``osv_findings``."""
    o = F.col("o")
    aliases = F.coalesce(o["aliases"], F.array().cast("array<string>"))
    vuln_id = F.coalesce(o["id"], F.lit("OSV-UNKNOWN"))
    cve = F.try_element_at(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(1))
    return df.select(parse_object(F.col(column), OSV).alias("o")).select(
        vuln_id.alias("id"),
        F.coalesce(cve, vuln_id).alias("cve"),
        aliases.alias("aliases"),
        F.coalesce(o["summary"], o["details"], F.lit("")).alias("summary"),
        osv_severity(o["severity"], o["database_specific"]["severity"], skip_version).alias("severity"),
        F.transform(
            F.coalesce(o["references"], F.array().cast("array<struct<url:string>>")),
            lambda r: F.coalesce(r["url"], F.lit("")),
        ).alias("refs"),
        o["affected"].alias("affected"),
    )
