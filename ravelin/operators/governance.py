"""Authorizations, the deny list, decisions with their log, and assessments.

A target is covered by an authorization when a scope pattern matches it as a
glob or, without its trailing stars, as a prefix (``scopes``).  Decisions are
made once per distinct target and joined back to the requests, so every request
has its own row in the log.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin import catalog
from ravelin.functions import text as T
from ravelin.operators import algebra, scopes

# Actions that are refused whatever the authorization.
FORBIDDEN = [
    "dos", "ddos", "flood", "bruteforce", "brute-force", "wipe", "destroy",
    "drop-table", "delete-data", "ransomware", "exfiltrate", "lateral-movement",
    "deploy-payload", "weaponize",
]
AUTHORIZATION = (
    "organization string, scope array<string>, authorized_by string, "
    "permission_ref string, expires string, contact string, issued string"
)
VALIDATE_LIMIT = 10
REQUIRED = ["organization", "scope", "authorized_by", "permission_ref", "expires"]


def is_forbidden(action: Column) -> Column:
    return F.lower(T.strip(action)).isin(FORBIDDEN)


def authorization_fingerprint() -> Column:
    return F.substring(
        F.sha2(
            F.concat_ws("|", "organization", "authorized_by", "permission_ref", "expires"),
            256,
        ),
        1,
        16,
    )


def load_authorizations(df: DataFrame, column: str, order: str) -> DataFrame:
    """Authorizations in JSON texts {authorizations[]}; incomplete entries drop.

    ``auth_seq`` keeps the order of the entries: first match wins.
    """
    entries = F.from_json(
        F.col(column), f"authorizations array<struct<{_ddl(AUTHORIZATION)}>>"
    )["authorizations"]
    return (
        df.select(F.col(order).alias("_o"), F.posexplode(entries).alias("_p", "a"))
        .select("a.*", F.struct("_o", "_p").alias("auth_seq"))
        .na.drop(subset=REQUIRED)
        .withColumns(
            {
                "contact": F.coalesce("contact", F.lit("")),
                "issued": F.coalesce("issued", F.current_date().cast("string")),
            }
        )
    )


def _ddl(fields: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))


def is_valid(on: Column | None = None) -> Column:
    day = F.current_date() if on is None else on
    return F.coalesce(F.try_to_date("expires", "yyyy-MM-dd") >= day, F.lit(False))


def decide(
    targets: DataFrame, authorizations: DataFrame, on: Column | None = None
) -> DataFrame:
    """One row per distinct target: status, detail and the granting authorization.

    Patterns are reduced first: of all authorizations with one pattern only the
    first valid one can ever grant, and for the refusal text it is enough to
    know that there is one.
    """
    patterns = (
        authorizations.withColumn("authorization", authorization_fingerprint())
        .select(
            F.explode(F.array_distinct("scope")).alias("pattern"),
            F.when(
                is_valid(on),
                F.struct("auth_seq", "authorization", "organization"),
            ).alias("grant"),
        )
        .groupBy("pattern")
        .agg(F.min("grant").alias("grant"))
    )
    matched = scopes.matched(targets, patterns).withColumn("covered", F.lit(True))
    any_on_file = authorizations.exists()
    return (
        targets.select("target")
        .distinct()
        .join(matched.hint("merge"), "target", "left")
        .select(
            "target",
            F.when(F.col("grant").isNotNull(), "AUTHORIZED").otherwise("DENIED").alias("status"),
            F.when(F.col("grant").isNotNull(), "scope match")
            .when(F.col("covered"), "authorization expired")
            .when(any_on_file, "out of scope")
            .otherwise("no authorization file")
            .alias("detail"),
            F.col("grant.authorization").alias("authorization"),
            F.col("grant.organization").alias("organization"),
        )
    )


def decide_requests(
    requests: DataFrame, authorizations: DataFrame, action: str | None = None, on: Column | None = None
) -> DataFrame:
    """Every row of ``requests`` (target, ...) with status, detail, authorization, organization.

    Equal requests are decided once and answered one by one.  Where ``action`` names a column,
    requests for a forbidden action are REFUSED whatever the authorization; a null target is
    covered by nothing.
    """
    decided = decide(requests.where("target IS NOT NULL"), authorizations, on)
    decided = decided.withColumnRenamed("target", "_target")
    met = requests.join(decided.hint("merge"), F.col("target") == F.col("_target"), "left").drop("_target")
    refused = F.lit(False) if action is None else F.coalesce(is_forbidden(F.col(action)), F.lit(False))
    answer = {
        "status": F.when(refused, "REFUSED").otherwise(F.coalesce("status", F.lit("DENIED"))),
        "detail": F.when(refused, "forbidden action").otherwise(F.coalesce("detail", F.lit("no target"))),
        "authorization": F.when(~refused, F.col("authorization")),
        "organization": F.when(~refused, F.col("organization")),
    }
    return met.withColumns(answer)


def assess(
    findings: DataFrame, decisions: DataFrame, action: Column | None = None
) -> DataFrame:
    """Non-destructive assessment of findings on authorized targets.

    ``findings`` carries a ``target``.  A forbidden action yields nothing here; its refusal
    is a row of ``decide_requests``.
    """
    notes = F.broadcast(catalog.assessment_notes(findings.sparkSession))
    allowed = decisions.where("status = 'AUTHORIZED'")
    asked = findings if action is None else findings.where(~is_forbidden(action))
    cwe = F.upper(F.coalesce("cwe", F.lit("")))
    return (
        asked.join(allowed, ["target"])
        .join(notes, cwe == F.col("note_cwe"), "left")
        .select(
            "target", "organization", "authorization",
            F.coalesce("rule_id", F.lit("")).alias("rule_id"),
            cwe.alias("cwe"),
            (
                (F.coalesce("file", F.lit("")) != "")
                & (F.coalesce("line", F.lit(0)) != 0)
            ).alias("statically_reachable"),
            F.coalesce("note", F.lit(catalog.DEFAULT_ASSESSMENT_NOTE)).alias(
                "reproduction_note"
            ),
            F.lit(True).alias("non_destructive"),
            F.lit(False).alias("live_exploitation_performed"),
        )
    )


def validate(
    findings: DataFrame, decisions: DataFrame, floor: str = "INFO", limit: int | None = None
) -> DataFrame:
    """Assessments of findings of at least the given severity, the first ``limit`` per target
    where a number is given."""
    chosen = algebra.at_least(findings, floor)
    if limit is not None:
        chosen = algebra.top_per_group(chosen, F.col("target"), limit)
    return assess(chosen, decisions)


def assessment_audit(assessments: DataFrame) -> DataFrame:
    """One log row per assessment."""
    return assessments.select(
        _now().alias("ts"), F.lit("ASSESSED").alias("action"), "target", "authorization",
        "organization", F.concat(F.lit("rule="), "rule_id").alias("detail"),
    )


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def audit_rows(decisions: DataFrame, keep: tuple = ()) -> DataFrame:
    """Decisions as rows of the append-only log, with the ``keep`` columns of their requests."""
    return decisions.select(
        *keep, _now().alias("ts"),
        F.col("status").alias("action"),
        "target", "authorization", "organization", "detail",
    )


def append_audit(decisions: DataFrame, path: str, run: str | None = None, keep: tuple = ()) -> None:
    """Add the decisions to the log at ``path``.

    A ``run`` has a folder of its own, so writing it again replaces it and adds nothing.
    """
    rows = audit_rows(decisions, keep)
    if run is None:
        rows.write.mode("append").json(path)
    else:
        rows.write.mode("overwrite").json(f"{path}/run={run}")
