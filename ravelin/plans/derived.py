"""Inputs that Spark derives from the driver tables: findings, result files of
other tools as JSON, dependencies, authorizations."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import schema
from ravelin.operators import baseline, governance
from ravelin.sources.tables import read_table, scratch  # noqa: F401

ECOSYSTEMS = ["npm", "PyPI", "Go", "crates.io"]


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def event_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a finding."""
    e, u = F.col("event_id"), F.col("user_id")
    rank = (e % 5).cast("int")
    pack = (e % 3).cast("int")
    return schema.conform(
        read_table(spark, d, "events").select(
            pick(schema.ENGINES, rank).alias("engine"),
            rank.alias("engine_rank"),
            pack.alias("pack_rank"),
            e.alias("seq"),
            F.lit("events").alias("source"),
            F.concat(pick(["SC-TON-", "SC-SOL-", "EV-"], pack), "event_type").alias("rule_id"),
            F.when(F.col("value") < 20, "LOW").when(F.col("value") < 60, "MEDIUM")
            .when(F.col("value") < 120, "HIGH").when(F.col("value") < 200, "CRITICAL")
            .otherwise("INFO").alias("severity"),
            F.concat(F.lit("Saw "), "event_type").alias("title"),
            F.concat(F.lit("Saw "), "event_type").alias("message"),
            F.when(u % 11 > 0, F.concat(F.lit("cwe-"), pick(["89", "78", "79", "327", "22", "1"], u % 6))).alias("cwe"),
            F.when(pack == 2, pick(["SOLANA", "COSMWASM"], u % 2)).alias("chain"),
            F.concat(F.lit("src/u"), u.cast("string"), F.lit(".py")).alias("file"),
            (e % 50).cast("int").alias("line"),
            F.concat(F.lit("  "), F.col("props"), F.lit(" \t x  ")).alias("evidence"),
        )
    )


def raw_findings(spark: SparkSession, d: str) -> DataFrame:
    """Events as records with missing, empty and odd fields."""
    e = F.col("event_id")
    return read_table(spark, d, "events").select(
        "event_id",
        F.when(e % 3 == 0, F.lit("")).when(e % 3 == 1, "high").alias("severity"),
        F.when(e % 4 == 0, "bogus").alias("sev"),
        F.when(e % 2 == 0, "Low").alias("level"),
        F.when(e % 5 == 0, F.col("event_type")).when(e % 5 == 1, F.lit("")).alias("title"),
        F.when(e % 7 == 0, F.col("props")).alias("message"),
        F.when(e % 11 > 0, F.concat(F.lit("R"), F.col("user_id").cast("string"))).alias("rule_id"),
        F.when(e % 6 == 0, "tool").alias("source"),
    )


def semgrep_json(spark, d) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    meta = F.struct(
        F.array(F.concat(F.lit("cwe-"), (u % 90 + 10).cast("string"), F.lit(": text"))).alias("cwe"),
        F.array(F.concat(F.lit("https://r.example/"), u.cast("string")), F.lit("b"), F.lit("c"), F.lit("d")).alias("references"),
    )
    result = F.struct(
        F.concat(F.lit("rules."), "event_type").alias("check_id"),
        F.concat(F.lit("src/u"), u.cast("string"), F.lit(".py")).alias("path"),
        F.struct((e % 50 + 1).alias("line"), (u % 80 + 1).alias("col")).alias("start"),
        F.struct(
            F.concat(F.lit("found "), "event_type").alias("message"),
            pick(["ERROR", "WARNING", "INFO", "OTHER"], e % 4).alias("severity"),
            F.concat(F.lit("   call("), "props", F.lit(") ")).alias("lines"),
            meta.alias("metadata"),
        ).alias("extra"),
    )
    return _json(spark, d, F.struct(F.array(result).alias("results")))


def slither_json(spark, d) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    name = F.concat(F.lit("c"), u.cast("string"), F.lit(".sol"))
    none = F.lit(None).cast("string")
    elements = F.array(
        F.struct(F.struct(none.alias("filename_relative"), none.alias("filename_short"), F.array(F.lit(1)).alias("lines")).alias("source_mapping")),
        F.struct(F.struct(F.when(e % 2 == 0, name).alias("filename_relative"), name.alias("filename_short"), F.array((e % 90 + 1).cast("int"), F.lit(7)).alias("lines")).alias("source_mapping")),
    )
    detector = F.struct(
        F.when(e % 9 > 0, F.col("event_type")).alias("check"),
        pick(["High", "Medium", "Low", "Informational", "Odd"], e % 5).alias("impact"),
        F.lit("Medium").alias("confidence"),
        F.when(e % 4 > 0, F.concat(F.lit(" "), F.col("event_type"), F.lit(" here\nmore"))).alias("description"),
        F.when(e % 8 > 0, elements).alias("elements"),
    )
    return _json(spark, d, F.struct(F.struct(F.array(detector).alias("detectors")).alias("results")))


def cargo_json(spark, d) -> DataFrame:
    e = F.col("event_id")
    advisory = F.struct(
        F.concat(F.lit("RUSTSEC-"), e.cast("string")).alias("id"),
        F.when(e % 5 > 0, F.round((e % 101) / 10, 1).cast("string")).alias("cvss"),
        F.when(e % 6 > 0, F.concat(F.lit("bad "), "event_type")).alias("title"),
        F.when(e % 3 == 0, F.array(F.concat(F.lit("CVE-"), e.cast("string")), F.lit("X-1"))).alias("aliases"),
    )
    package = F.struct(
        F.concat(F.lit("crate"), F.col("user_id").cast("string")).alias("name"),
        F.concat((e % 4).cast("string"), F.lit(".1")).alias("version"),
    )
    listed = F.array(F.struct(advisory.alias("advisory"), package.alias("package")))
    return _json(spark, d, F.struct(F.struct(listed.alias("list")).alias("vulnerabilities")))


def _json(spark, d, body: Column) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", F.to_json(body).alias("json"))


def osv_json(spark, d) -> DataFrame:
    """One advisory per part, as OSV records."""
    k = F.col("p_partkey")
    s = k.cast("string")
    event = "struct<introduced:string,fixed:string>"
    introduced = F.concat((k % 5).cast("string"), F.lit("."), (k % 3).cast("string"))
    fixed = F.concat((k % 5 + 2).cast("string"), F.lit(".0."), (k % 2).cast("string"))
    events = F.array_compact(
        F.array(
            F.struct(introduced.alias("introduced"), F.lit(None).cast("string").alias("fixed")).cast(event),
            F.when(k % 7 > 0, F.struct(F.lit(None).cast("string").alias("introduced"), fixed.alias("fixed")).cast(event)),
        )
    )
    score = F.when(k % 5 == 0, F.lit("CVSS:3.1/AV:N/AC:L")).otherwise(F.round((k % 101) / 10, 1).cast("string"))
    severity = F.when(k % 4 > 0, F.array(F.struct(F.lit("CVSS_V3").alias("type"), score.alias("score"))))
    record = F.struct(
        F.concat(F.lit("GHSA-"), s).alias("id"),
        F.when(k % 3 == 0, F.array(F.lit("PYSEC-1"), F.concat(F.lit("CVE-"), s))).alias("aliases"),
        F.when(k % 2 == 0, F.col("p_name")).alias("summary"),
        F.concat(F.lit("about "), F.col("p_name")).alias("details"),
        severity.alias("severity"),
        F.struct(pick(["high", "low", "odd"], k % 3).alias("severity")).alias("database_specific"),
        F.array(
            F.struct(
                F.struct(F.concat(F.lit("Pkg-"), s).alias("name"), pick(ECOSYSTEMS, k % 4).alias("ecosystem")).alias("package"),
                F.array(F.struct(events.alias("events"))).alias("ranges"),
            )
        ).alias("affected"),
        F.array(*[F.struct(F.concat(F.lit(f"https://r.example/{i}/"), s).alias("url")) for i in range(4)]).alias("references"),
    )
    return read_table(spark, d, "part").select(F.to_json(record).alias("json"))


def line_version() -> Column:
    return F.concat(
        (F.col("l_quantity").cast("int") % 8).cast("string"), F.lit("."),
        F.col("l_linenumber").cast("string"),
        F.when(F.col("l_linenumber") == 1, F.lit(".0")).otherwise(F.lit("")),
    )


def dependencies(spark, d) -> DataFrame:
    """Every line item as a dependency on its part."""
    k = F.col("l_partkey")
    return read_table(spark, d, "lineitem").select(
        F.concat(F.lit("m"), F.lpad((F.col("l_orderkey") % 100).cast("string"), 2, "0"), F.lit("/requirements.txt")).alias("file"),
        F.concat(F.lit("pkg-"), k.cast("string")).alias("name"),
        line_version().alias("version"),
        pick(ECOSYSTEMS, k % 4).alias("ecosystem"),
        F.col("l_linenumber").alias("pos"),
    )


def known(spark, d) -> DataFrame:
    """Baseline: fingerprints of the findings with an even line."""
    half = event_findings(spark, d).where("line % 2 = 0")
    return baseline.with_fingerprint(half, "src").select("fingerprint")


def baseline_json(spark, d) -> DataFrame:
    """Baseline files: good ones, one without the list, one that is no JSON."""
    e = F.col("event_id")
    good = F.to_json(
        F.struct(F.lit(1).alias("version"), F.array(F.substring(F.sha1("props"), 1, 16), F.substring(F.sha1("event_type"), 1, 16)).alias("fingerprints"))
    )
    return read_table(spark, d, "events").select(
        F.when(e % 3 == 0, F.lit('{"version": 1}')).when(e % 3 == 1, F.lit("[broken")).otherwise(good).alias("json")
    )


SCOPES = [
    "http://*.example.com/en/*", "https://m.*", "http://blog.*",
    "https://spam-farm.example.org/*", "*://*/de/?*", "https://blog.tion",
]


def authorizations(spark, d) -> DataFrame:
    """Every supplier as an authorization; some lack a field or have expired."""
    k = F.col("s_suppkey")
    entry = F.struct(
        F.col("s_name").alias("organization"),
        F.array(pick(SCOPES, k % 6)).alias("scope"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("authorized_by"),
        F.when(k % 10 != 3, F.concat(F.lit("ref-"), k.cast("string"))).alias("permission_ref"),
        F.when(k % 4 == 0, "2020-01-01").when(k % 9 == 0, "bad").when(k % 6 == 3, "2021-01-01").otherwise("2999-12-31").alias("expires"),
    )
    texts = read_table(spark, d, "supplier").select(
        "s_suppkey", F.to_json(F.struct(F.array(entry).alias("authorizations"))).alias("json")
    )
    return governance.load_authorizations(texts, "json", "s_suppkey")


def wildcard_authorizations(spark, d) -> DataFrame:
    """Every supplier with a scope that begins with a wildcard, one from a list, and one by class."""
    k = F.col("s_suppkey")
    name = k.cast("string")
    entry = F.struct(
        F.col("s_name").alias("organization"),
        F.array(
            F.concat(F.lit("*/x"), name), F.concat(F.lit("*h"), name, F.lit(".example*/click/*")),
            F.concat(F.lit("h?"), F.lit("*.example.com/[pv]*/x"), name, F.lit("?")), pick(SCOPES, k % 6),
        ).alias("scope"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("authorized_by"),
        F.concat(F.lit("ref-"), name).alias("permission_ref"),
        F.when(k % 3 == 0, "2020-01-01").otherwise("2999-12-31").alias("expires"),
    )
    texts = read_table(spark, d, "supplier").select(
        "s_suppkey", F.to_json(F.struct(F.array(entry).alias("authorizations"))).alias("json")
    )
    return governance.load_authorizations(texts, "json", "s_suppkey")


def requests(spark, d) -> DataFrame:
    """Every event as a request with an id: a target and an action, some of them forbidden."""
    e, u = F.col("event_id"), F.col("user_id")
    words = F.array(*[F.lit(w) for w in governance.FORBIDDEN])
    return read_table(spark, d, "events").select(
        "event_id",
        F.concat(
            F.lit("h"), (u % 97).cast("string"), F.lit(".example.com/"), "event_type", F.lit("/x"), (e % 400).cast("string")
        ).alias("target"),
        F.when(e % 5 == 0, F.concat(F.lit("  "), F.upper(F.element_at(words, (e % 14 + 1).cast("int")))))
        .otherwise(F.col("event_type")).alias("asked"),
    )


def targets(spark, d) -> DataFrame:
    return read_table(spark, d, "pages").select(F.col("url").alias("target"))


def page_findings(spark, d) -> DataFrame:
    """Three findings per page, to assess."""
    k = F.col("page_id")
    return read_table(spark, d, "pages").select(
        F.col("url").alias("target"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"), "page_id"
    ).select(
        "target",
        F.concat(F.lit("R"), F.col("i").cast("string")).alias("rule_id"),
        pick(["cwe-89", "CWE-78", "CWE-22"], F.col("i")).alias("cwe"),
        F.when(k % 3 > 0, F.concat(F.lit("p"), k.cast("string"))).alias("file"),
        (F.col("i") * (k % 2)).cast("int").alias("line"),
    )
