"""URL rules by host and path, and verdicts for the rest from trust that flows along links.

Everything is DataFrame functions.  Rules decide first: the longest rule whose host is the url's
host or a parent of it and whose path starts the url's path.  Where none fits, the host's place
in the link graph decides: personalised PageRank from hosts with allowed pages along the links
(trust), the same from hosts with blocked pages against the links (distrust: who links to bad
hosts), and a threshold on the two.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import dropped, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parents(host: Column) -> Column:
    """The host and every suffix of it that starts after a dot."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with _host, _path) plus _rule and _verdict of the longest rule that fits.

    ``rules`` has rule (host, a slash, the rest of a path) and verdict; a rule without a slash
    fits any path, repeated rules count once (by verdict, block before allow).  Rules meet the
    distinct hosts, so pages join once with what their host can match.
    """
    slash = F.instr("rule", "/")
    known = rules.where("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    known = known.select(
        "rule", "verdict",
        F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")).alias("suffix"),
        F.when(slash > 0, F.col("rule").substr(slash, F.length("rule"))).otherwise("").alias("prefix"),
    )
    hosts = urls.select("_host").distinct()
    fits = (
        hosts.select("_host", F.explode(parents(F.col("_host"))).alias("suffix"))
        .distinct().join(known, "suffix")
        .groupBy("_host")
        .agg(F.sort_array(F.collect_list(
            F.struct(F.length("rule").alias("size"), "rule", "verdict", "prefix")
        ), asc=False).alias("_fits"))
    )  # rules are a control table: a host meets those of its parents
    met = urls.join(fits, "_host", "left")
    first = F.try_element_at(
        F.filter("_fits", lambda r: F.startswith(F.col("_path"), r["prefix"])), F.lit(1)
    )
    return met.withColumn("_first", first).withColumns(
        {"_rule": F.col("_first.rule"), "_verdict": F.col("_first.verdict")}
    ).drop("_first", "_fits")


def links(pages: DataFrame) -> DataFrame:
    """Host edges (src, dst, share): share of src's links to other hosts that go to dst."""
    linked = pages.select(
        F.col("_host").alias("src"),
        F.explode(F.regexp_extract_all("_html", F.lit(LINK), F.lit(1))).alias("dst"),
    ).withColumn("dst", F.translate("dst", UPPER, LOWER))
    counted = linked.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("all"))
    return counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagated(
    seeds: DataFrame, edges: DataFrame, keep: float = 0.85, rounds: int = 1000, settled: float = 1e-6
) -> DataFrame:
    """(host, score): personalised PageRank; ``seeds`` (host, mass) may have any total mass.

    A host passes ``keep`` of its score along its edges; what hosts without edges hold, and the
    rest, returns to the seeds.  Ends when scores move by less than ``settled`` in total; an error
    if they still do after ``rounds``.
    """
    whole = seeds.agg(F.sum("mass")).first()[0]
    if not whole:
        return seeds.select("host", F.lit(0.0).alias("score"))
    seeds = written(seeds.select("host", (F.col("mass") / whole).alias("mass")), "seeds")
    score, last = seeds.select("host", F.col("mass").alias("score")), None
    for _ in range(rounds):
        passed = (
            score.join(edges, score.host == edges.src)
            .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * keep).alias("got"))
        )
        moved = passed.agg(F.sum("got")).first()[0] or 0.0
        after = seeds.join(passed, "host", "full").select(
            "host",
            (F.coalesce("got", F.lit(0.0)) + F.coalesce("mass", F.lit(0.0)) * (1 - moved)).alias("score"),
        )
        after = written(after, "score")
        gap = after.join(score.withColumnRenamed("score", "old"), "host", "full").agg(
            F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
        ).first()[0]
        if last is not None:
            dropped(last)
        score = last = after
        if not gap or gap < settled:
            return score
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def judged(
    pages: DataFrame, rules: DataFrame, key: str, url: str, html: str, ratio: float = 1.0
) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    ``verdict`` is the rule's, else ``block`` for a host whose distrust is above ``ratio`` times
    its trust, else ``allow``: a host that no seed reaches is allowed.  Seeds are hosts weighted
    by their pages that rules allow (trust) or block (distrust).  Null urls have no host and
    path; null html has no links; repeated rows are judged alike, and links of each count.
    """
    urls = pages.select(
        F.col(key).alias("_key"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path")
    )
    ruled = written(matched(urls, rules), "ruled")
    by_host = pages.select(host_of(F.col(url)).alias("_host"), F.col(html).alias("_html"))
    edges = written(links(by_host), "edges")
    all_in = edges.groupBy("dst").agg(F.sum("share").alias("all"))
    back = edges.join(all_in, "dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"),
        (F.col("share") / F.col("all")).alias("share"),
    )

    def seeds(verdict):
        return ruled.where((F.col("_verdict") == verdict) & (F.col("_host") != "")).groupBy(
            F.col("_host").alias("host")
        ).agg(F.count("*").alias("mass"))

    trust = propagated(seeds("allow"), edges).withColumnRenamed("score", "trust")
    distrust = propagated(seeds("block"), back).withColumnRenamed("score", "distrust")
    standing = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    bad = F.coalesce(F.col("distrust") > F.col("trust") * ratio, F.lit(False))
    return ruled.join(standing, ruled["_host"] == standing["host"], "left").select(
        F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
