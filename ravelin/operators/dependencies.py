"""Dependencies against advisories: the fixed table and an OSV dump."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin import catalog, schema
from ravelin.functions import text as T


def static_findings(deps: DataFrame) -> DataFrame:
    """Every listed package that has an advisory, whatever its version."""
    table = catalog.advisories(deps.sparkSession)
    hit = deps.join(F.broadcast(table), "name")
    version = F.when(F.col("version") == "", "(unspecified)").otherwise(F.col("version"))
    text = F.concat(F.col("name"), F.lit(" "), version, F.lit(": "), F.col("summary"))
    evidence = F.when(F.col("version") == "", F.col("name")).otherwise(
        F.concat_ws("==", "name", "version")
    )
    return _sca(hit, F.col("cve"), text, text, evidence, "dependency_scanner", 95.0, 0)


def last_file_wins(deps: DataFrame) -> DataFrame:
    """One row per (name, version, ecosystem), with the last file in path order.

    This is also what keeps the advisory join small: a package listed a billion
    times meets the advisories once per version.
    """
    return deps.groupBy("name", "version", "ecosystem").agg(
        F.max("file").alias("file")
    )


def advisory_ranges(osv: DataFrame) -> DataFrame:
    """One row per advisory, package and affected range."""
    return osv.select(
        "*", F.explode("affected").alias("a")
    ).select(
        "id", "cve", "aliases", "summary", "severity", "refs",
        F.lower("a.package.name").alias("name"),
        F.col("a.package.ecosystem").alias("ecosystem"),
        F.explode("a.ranges").alias("r"),
        fixed_version(F.col("affected"), F.col("a.package.ecosystem")).alias("fixed_in"),
    ).select(
        "*",
        F.explode(
            F.arrays_zip(
                F.filter(F.col("r.events.introduced"), lambda v: v.isNotNull()).alias("introduced"),
                F.filter(F.col("r.events.fixed"), lambda v: v.isNotNull()).alias("fixed"),
            )
        ).alias("span"),
    ).select(
        "id", "cve", "aliases", "summary", "severity", "refs", "name", "ecosystem",
        "fixed_in", "span.introduced", "span.fixed",
    )


def fixed_version(affected: Column, ecosystem: Column) -> Column:
    """First fixed event of the ecosystem, else 'latest'."""
    mine = F.filter(
        affected, lambda a: F.lower(a["package"]["ecosystem"]) == F.lower(ecosystem)
    )
    events = F.flatten(
        F.flatten(F.transform(mine, lambda a: F.transform(a["ranges"], lambda r: r["events"])))
    )
    fixed = F.filter(events["fixed"], lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(fixed, F.lit(1)), F.lit("latest"))


def is_affected(version: Column, key: Column, introduced: Column, fixed: Column) -> Column:
    """An unknown version is affected; else introduced <= version < fixed.

    All but ``version`` are version keys.
    """
    return (version == "") | ((introduced <= key) & (fixed.isNull() | (key < fixed)))


def osv_findings(deps: DataFrame, osv: DataFrame) -> DataFrame:
    """Affected dependencies by ecosystem, name and version range.

    Versions become keys once per distinct dependency and once per range, before
    the join multiplies them.  The ranges of an advisory are numbered first, so what
    is matched and reduced are numbers; the texts join the result.
    """
    texts = ["fixed_in", "cve", "aliases", "summary", "severity", "refs"]
    number = F.row_number().over(Window.partitionBy("ecosystem", "name", "id").orderBy(*texts, "introduced", "fixed"))
    ranges = advisory_ranges(osv).withColumn("range", number)
    spans = ranges.select(
        "ecosystem", "name", "id", "range",
        T.version_key(F.coalesce("introduced", F.lit("0"))).alias("introduced"),
        T.version_key(F.col("fixed")).alias("fixed"),
    )
    keyed = last_file_wins(deps).withColumn("key", T.version_key(F.col("version")))
    affected = keyed.join(spans, ["ecosystem", "name"]).where(
        is_affected(F.col("version"), F.col("key"), F.col("introduced"), F.col("fixed"))
    )
    # Two ranges of one advisory may both hold the version.
    first = affected.groupBy("file", "name", "version", "ecosystem", "id").agg(F.min("range").alias("range"))
    told = ranges.select("ecosystem", "name", "id", "range", *texts)
    once = first.join(told, ["ecosystem", "name", "id", "range"]).select("file", "name", "version", *texts)
    description = F.concat(
        F.col("name"), F.lit(" "), F.col("version"), F.lit(": "), F.col("summary")
    )
    return _sca(
        once, F.col("cve"), F.col("summary"), description,
        F.concat_ws("==", "name", "version"), "osv_scanner", 90.0, 0,
    )


def _sca(df, rule_id, title, description, evidence, source, confidence, pack_rank):
    return schema.conform(
        df.withColumns(
            {
                "engine": F.lit("sca"),
                "engine_rank": F.lit(1),
                "pack_rank": F.lit(pack_rank),
                "rule_id": rule_id,
                "title": title,
                "message": title,
                "description": description,
                "evidence": evidence,
                "recommendation": F.concat(
                    F.lit("Upgrade "), F.col("name"), F.lit(" to >= "), F.col("fixed_in")
                ),
                "cwe": F.lit("CWE-1035"),
                "category": F.lit("Vulnerable Dependency"),
                "source": F.lit(source),
                "package": F.col("name"),
                "installed_version": F.col("version"),
                "line": F.lit(0),
                "confidence": F.lit(confidence),
                "seq": F.col("pos") if "pos" in df.columns else F.lit(0),
            }
        )
    )
