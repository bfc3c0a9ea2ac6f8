"""Targets against scope patterns, through an index of the patterns' literal text.

A target is in scope of a pattern that matches it as a glob or, without its trailing stars, as a
prefix.  Prefixes are plain equi-joins: a target has one prefix for each length that occurs.  A glob
with wildcards inside is filed under one piece of its literal text: its head, its tail, or a gram
of any piece in it (a short piece is a gram of its own), whichever the fewest targets hold; where
none holds a piece, the glob matches nothing.  A target looks up its own heads, tails and grams, so
it meets only patterns whose rarest piece it holds; those pairs alone are matched, with every
distinct pattern compiled once per task.  Globs without literal text (``?*``) are spread over salts
and meet every target, as they must.  Patterns and targets may both be many and sizes planned from
small files say little, so joins are merged and nothing is broadcast through the driver.
"""

import fnmatch
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest gram, salts of patterns without literal text, compiled patterns a task holds.
GRAM, SALTS, COMPILED = 6, 64, 20_000
CLASS = r"\[!?\]?[^\]]*\]"
WILD = r"[*?\[]"


def pieces(pattern: Column) -> Column:
    """Literal runs of a glob, without its character classes; empty where a wildcard is at an end."""
    open_ = F.regexp_replace(F.regexp_replace(pattern, CLASS, "*"), r"\[", "*")
    return F.split(open_, r"[*?]+", -1)


def filed(globs: DataFrame, targets: DataFrame) -> DataFrame:
    """``globs`` (pattern, grant) with the ``kind`` and ``key`` under which each is looked up: of its
    pieces, what the fewest of the distinct ``targets`` hold."""
    parts = pieces(F.col("pattern"))
    # The head ends at the first bracket, closed or not.
    head, tail = F.regexp_extract("pattern", r"(?s)^[^*?\[]*", 0), F.element_at("parts", -1)

    def grams(piece):
        n = F.least(F.length(piece), F.lit(GRAM))
        return F.transform(F.sequence(F.lit(1), F.length(piece) - n + 1), lambda i: F.substring(piece, i, n))

    def entry(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    found = F.flatten(F.transform(F.filter("parts", lambda p: p != ""), grams))
    entries = F.concat(
        F.array(entry("head", F.col("head")), entry("tail", F.col("tail"))),
        F.transform(F.array_distinct(found), lambda g: entry("gram", g)),
    )
    cut = globs.withColumn("parts", parts).withColumns({"head": head, "tail": tail})
    cut = cut.select("pattern", "grant", F.inline(F.filter(entries, lambda e: e["key"] != "")))
    held = lookups(targets, cut).groupBy("kind", "key").agg(F.count("*").alias("targets"))
    each = cut.join(held.hint("merge"), ["kind", "key"], "left")
    # Anchored pieces come first: a target has one head or tail of a length, but many grams.
    rank = F.struct(F.coalesce("targets", F.lit(0)).alias("targets"), F.col("kind") == "gram", -F.length("key"), "kind", "key")
    best = each.groupBy("pattern", "grant").agg(F.min(rank).alias("e")).where("e.targets > 0")
    known = best.select("pattern", "grant", "e.kind", "e.key")
    # What has no literal text at all.
    bare = globs.where(F.array_join(parts, "") == "").select(
        "pattern", "grant", F.lit("any").alias("kind"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: i.cast("string"))).alias("key"),
    )
    return known.unionByName(bare)


def lookups(targets: DataFrame, index: DataFrame) -> DataFrame:
    """(target, kind, key): everything of a target that an entry of the index could be filed under."""
    t, size = F.col("target"), F.length("target")
    # The kinds of keys there are and their lengths: a short array, as a scalar.
    sizes = index.agg(F.collect_set(F.struct("kind", F.length("key").alias("n")))).scalar()
    some = targets.withColumn("sizes", sizes)

    def entry(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def fitting(kind):
        found = F.filter("sizes", lambda e: (e["kind"] == kind) & (e["n"] <= size))
        return F.transform(found, lambda e: e["n"])

    def grams(n):
        return F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(t, i, n))

    salt = F.pmod(F.xxhash64("target"), F.lit(SALTS)).cast("string")
    found = F.concat(
        F.transform(fitting("head"), lambda n: entry("head", F.substring(t, F.lit(1), n))),
        F.transform(fitting("tail"), lambda n: entry("tail", F.substring(t, size - n + 1, n))),
        F.transform(F.array_distinct(F.flatten(F.transform(fitting("gram"), grams))), lambda g: entry("gram", g)),
        F.when(F.exists("sizes", lambda e: e["kind"] == "any"), F.array(entry("any", salt))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")),
    )
    return some.select("target", F.inline(found))


def glob_matches(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (target, pattern, grant) where the pattern matches the whole target."""

    def match(batches):
        compiled = {}
        for batch in batches:
            keep = []
            for target, pattern in zip(batch.column("target").to_pylist(), batch.column("pattern").to_pylist(), strict=True):
                test = compiled.get(pattern)
                if test is None:
                    if len(compiled) >= COMPILED:
                        compiled.clear()
                    test = compiled[pattern] = re.compile(fnmatch.translate(pattern)).match
                keep.append(test(target) is not None)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(match, pairs.schema)


def matched(targets: DataFrame, patterns: DataFrame) -> DataFrame:
    """(target, grant): for every distinct target in scope of a pattern the least ``grant`` of its
    patterns, nulls last; ``patterns`` (pattern, grant) holds every pattern once."""
    stem = F.rtrim("pattern", F.lit("*"))
    stems = patterns.groupBy(stem.alias("stem")).agg(F.min("grant").alias("grant"))
    # An empty stem covers everything: one row, no key that all targets share.
    whole = stems.where("stem = ''").agg(F.min("grant").alias("grant"), F.count("*").alias("n"))
    stems = stems.where("stem <> ''")
    sizes = stems.agg(F.collect_set(F.length("stem")).alias("n")).scalar()
    each = targets.select("target").distinct()
    prefixes = each.select("target", F.explode(sizes).alias("n")).where("n <= length(target)").select(
        "target", F.expr("substring(target, 1, n)").alias("stem")
    )
    by_stem = prefixes.join(stems.hint("merge"), "stem").select("target", "grant")
    inside = patterns.where(stem.rlike(WILD))
    index = filed(inside, each)
    pairs = lookups(each, index).join(index.hint("merge"), ["kind", "key"]).select("target", "pattern", "grant")
    by_glob = glob_matches(pairs).select("target", "grant")
    always = each.select("target", whole.select("grant").scalar().alias("grant")).where(
        whole.select("n").scalar() > 0
    )
    return by_stem.unionByName(by_glob).unionByName(always).groupBy("target").agg(F.min("grant").alias("grant"))
