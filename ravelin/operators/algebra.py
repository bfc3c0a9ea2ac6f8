"""Operators on findings: normalise, merge, de-duplicate, cap, count, score."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin import schema
from ravelin.sources.tables import written
from ravelin.operators.contracts import web3_source

# Limits of the reports.
REPORT_LIMIT = 200
TOP_CWE = 5
LEVELS = [("CRITICAL", 60), ("HIGH", 30), ("MEDIUM", 10), ("LOW", 1)]
EXIT_CODE = {"CRITICAL": 3, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "CLEAN": 0}


def truthy(name: str) -> Column:
    """The column, with '' counting as absent."""
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def first_truthy(df: DataFrame, names: list) -> Column:
    present = [truthy(n) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(None).cast("string"))


def normalise(df: DataFrame, source: str) -> DataFrame:
    """Findings of unknown shape to canonical severity, title and source."""
    severity = F.upper(
        F.coalesce(
            first_truthy(df, ["severity", "sev", "level", "severity_level"]), F.lit("INFO")
        )
    )
    named = first_truthy(df, ["title", "message", "desc", "description", "name"])
    fallback = [F.col(c) for c in ("rule_id", "cve") if c in df.columns]
    own_source = [F.col("source")] if "source" in df.columns else []
    return df.withColumns(
        {
            "severity": F.when(severity.isin(schema.SEVERITIES), severity).otherwise("INFO"),
            "title": F.coalesce(named, *fallback, F.lit("Finding")),
            "source": F.coalesce(*own_source, F.lit(source)),
        }
    )


def label_web3(df: DataFrame) -> DataFrame:
    return df.withColumn("source", web3_source(F.col("rule_id")))


def union_all(parts: list) -> DataFrame:
    """Bag union in engine order."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), parts
    )


def primary_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary`` if it has rows, else ``fallback``.

    The primary is computed once and written; whether it has rows is read from that table
    inside the job.
    """
    primary = written(primary, "primary")
    return primary.unionByName(fallback.where(~primary.exists()), allowMissingColumns=True)


def first_wins(df: DataFrame, keys: list) -> DataFrame:
    """The first row per key in finding order.

    Spark turns the filter into a group limit before the shuffle, so a key with a
    third of all rows costs one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(order_of(df))
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def order_of(df: DataFrame) -> Column:
    return schema.order_key() if "engine_rank" in df.columns else F.col("seq")


def weakness_key() -> list:
    """What makes two source findings the same weakness."""
    what = F.coalesce(truthy("cwe"), truthy("title"), F.col("rule_id"))
    return [what, F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit(""))]


def dedup(df: DataFrame) -> DataFrame:
    """First finding per weakness, file and line."""
    return first_wins(df, weakness_key())


def dedup_by_rule(df: DataFrame) -> DataFrame:
    """First finding per rule, file and line."""
    return first_wins(df, [F.col("rule_id"), F.col("file"), F.col("line")])


def dedup_sast(df: DataFrame) -> DataFrame:
    """``dedup`` for source findings, every row of other engines kept, in one shuffle.

    Splitting the frame by engine would run the whole detection twice.  Rows of
    other engines are spread by their content and pass whatever their number.
    """
    source = F.coalesce(F.col("engine") == "sast", F.lit(False))
    content = [f.name for f in schema.FINDING.fields if f.name != "extra"]
    own = F.when(~source, F.xxhash64(*content))
    first = Window.partitionBy(*weakness_key(), own).orderBy(order_of(df))
    ranked = df.withColumn("_n", F.row_number().over(first))
    return ranked.where(~source | (F.col("_n") == 1)).drop("_n")


def top_per_group(df: DataFrame, group: Column, n: int, own: Column | None = None) -> DataFrame:
    """First ``n`` rows per group, or fewer where ``own`` says so.

    Spark turns the row-number filter into a group limit before the shuffle, so
    a task sends at most ``n`` rows per group however large the group is.
    """
    ranked = df.withColumn("_group", group).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_group").orderBy(order_of(df)))
    )
    kept = ranked.where(F.col("_n") <= n)
    return (kept if own is None else kept.where(F.col("_n") <= own)).drop("_n", "_group")


def cap_web3(df: DataFrame, cap: int, mixed: bool = False) -> DataFrame:
    """Caps of the contract report: 2 x cap, cap, and cap per further chain.  In a ``mixed`` frame
    findings of other engines pass, each a group of its own, so that one detection serves all."""
    own = F.col("pack_rank") == 0
    web3 = F.coalesce(F.col("engine") == "web3", F.lit(False)) if mixed else F.lit(True)
    chain = F.concat(F.lit("chain "), F.coalesce("chain", F.lit("solidity")))
    row = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    group = F.when(~web3, row).when(own, "contracts").otherwise(chain)
    ranked = df.where(~web3 | F.col("pack_rank").isNotNull())
    return top_per_group(ranked, group, 2 * cap, F.when(own | ~web3, 2 * cap).otherwise(cap))


def limit_in_order(df: DataFrame, n: int | None = None) -> DataFrame:
    """Findings in order, the first ``n`` where a number is given."""
    ordered = df.orderBy(order_of(df))
    return ordered if n is None else ordered.limit(n)


def by_severity_rank(df: DataFrame) -> DataFrame:
    """Most severe first, otherwise in finding order."""
    return df.orderBy(-schema.severity_ordinal(F.col("severity")), order_of(df))


def at_least(df: DataFrame, floor: str) -> DataFrame:
    """Findings of at least the given severity; an unknown floor means LOW."""
    minimum = schema.SEVERITY_ORDINAL.get(floor.upper(), 1)
    return df.where(
        schema.severity_ordinal(F.coalesce("severity", F.lit("INFO"))) >= minimum
    )


def narrow(df: DataFrame) -> DataFrame:
    return df.select("rule_id", "severity", "title", "cwe", "file", "line", "source")


def severity_columns() -> list:
    level = F.upper(F.coalesce("severity", F.lit("INFO")))
    return [F.count_if(level == s).alias(s.lower()) for s in schema.SEVERITIES]


def count_by_severity(df: DataFrame) -> DataFrame:
    """One row, all five levels, zeros included."""
    return df.agg(*severity_columns())


def score_column() -> Column:
    return F.least(
        F.lit(100),
        F.coalesce(F.sum(schema.risk_weight(F.coalesce("severity", F.lit("INFO")))), F.lit(0)),
    ).cast("int")


def level_of(score: Column) -> Column:
    out = F
    for name, least in LEVELS:
        out = out.when(score >= least, name)
    return out.otherwise("CLEAN")


def risk(df: DataFrame, *group: str, extra: list = ()) -> DataFrame:
    """Score, level, exit code and counts, overall or per group, in one pass."""
    counted = df.groupBy(*group).agg(
        F.count("*").alias("total"), score_column().alias("risk_score"),
        *severity_columns(), *extra,
    )
    level = level_of(F.col("risk_score"))
    return counted.withColumns(
        {
            "risk_level": level,
            "exit_code": F.element_at(schema.literal_map(EXIT_CODE), level),
        }
    )


def count_by_engine(df: DataFrame) -> DataFrame:
    """Counts per engine and severity with subtotals and the grand total."""
    return df.rollup("engine", "severity").agg(F.count("*").alias("findings"))


def engine_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("engine", "severity").agg(
        F.count("*").alias("findings"), F.countDistinct("file").alias("files")
    )


def count_by_chain(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("chain").isNotNull())
        .groupBy("chain")
        .agg(F.count("*").alias("findings"))
    )


def top_weaknesses(df: DataFrame, n: int | None = None) -> DataFrame:
    """Classes by frequency, the first ``n`` where a number is given; ties go to the one seen first."""
    ranked = (
        df.where(truthy("cwe").isNotNull())
        .groupBy("cwe")
        .agg(F.count("*").alias("findings"), F.min(order_of(df)).alias("first"))
        .orderBy(F.desc("findings"), "first")
    )
    return (ranked if n is None else ranked.limit(n)).drop("first")


def summary(df: DataFrame, top_classes: int | None = None) -> DataFrame:
    """One line of text: total, counts per severity, classes by frequency (the first
    ``top_classes`` where a number is given).

    Findings are reduced to a cell per severity and class, cells to a row per severity and per
    class; only the rows that the text shows are gathered, linear in what it shows.
    """
    cells = df.groupBy(
        F.coalesce("severity", F.lit("INFO")).alias("severity"), truthy("cwe").alias("cwe")
    ).agg(F.count("*").alias("n"), F.min(order_of(df)).alias("first"))

    def joined(rows, sort, text):
        entry = F.struct(*sort, text.alias("text"))
        texts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])
        return rows.agg(F.array_join(texts, ", "))

    levels = cells.groupBy("severity").agg(F.sum("n").alias("n"))
    levels = joined(levels, ["severity"], F.concat_ws(" ", "severity", F.col("n").cast("string")))
    ranked = (
        cells.where("cwe IS NOT NULL").groupBy("cwe")
        .agg((-F.sum("n")).alias("down"), F.min("first").alias("first"))
    )
    if top_classes is not None:
        ranked = ranked.orderBy("down", "first").limit(top_classes)
    top = joined(ranked, ["down", "first"], F.concat("cwe", F.lit(" x"), (-F.col("down")).cast("string")))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)))
    row = df.sparkSession.range(1).select(
        total.scalar().alias("total"), levels.scalar().alias("levels"), top.scalar().alias("top")
    )
    text = F.concat(
        F.col("total").cast("string"), F.lit(" findings ("), F.col("levels"), F.lit("). Most common: "),
        F.when(F.col("top") != "", F.col("top")).otherwise("n/a"), F.lit("."),
    )
    return row.select(
        F.when(F.col("total") == 0, "No findings provided.").otherwise(text).alias("summary")
    )


def _not_above(values: str, limit: Column, most: int) -> Column:
    """How many of the sorted array ``values``, of ``most`` entries at most, are not above ``limit``,
    by halving: a few comparisons a row, not one for each entry."""
    steps = [F.lit(2**k) for k in reversed(range(most.bit_length()))]

    def step(n, more):
        fits = F.try_element_at(values, n + more) <= limit
        return F.when(fits, n + more).otherwise(n)

    return F.aggregate(F.array(*steps), F.lit(0), step)


def numbered(df: DataFrame, order, name: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``name``, its place from 0 by ``order``, by two-level prefix sums.

    A row of each of some hash groups is a splitter; rows are counted and numbered between
    splitters, and every stretch starts where those before it end.  No task sees all rows.
    Equal orders get places of their own, in any order.
    """
    row = df.withColumn("_order", order)
    mark = F.xxhash64("_order")
    some = row.groupBy(F.pmod(mark, F.lit(buckets)).alias("g")).agg(F.max_by("_order", mark).alias("_order"))
    splitters = some.agg(F.array_sort(F.collect_list("_order"))).scalar()
    placed = row.withColumn("_splitters", splitters).withColumn(
        "_stretch", _not_above("_splitters", F.col("_order"), buckets)
    ).drop("_splitters")
    sizes = placed.groupBy("_stretch").agg(F.count("*").alias("n"))
    # One row per stretch, at most ``buckets`` + 1.
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_stretch").orderBy("_order"))
    at = (F.col("_start") + F.col("_within") - 1).alias(name)
    met = placed.withColumn("_within", within).join(F.broadcast(starts), "_stretch")
    return met.select(*df.columns, at)
