"""Named queries over the driver tables, one or more per operator.

Each takes (spark, sf_dir).  Packs run over ``seeded_files`` (every document
with a snippet in front), finding operators over ``event_findings`` (every event
as a finding), joins over rows derived from parts, line items and pages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import catalog, schema
from ravelin.functions import entropy as E
from ravelin.functions import tables
from ravelin.functions import text as T
from ravelin.operators import (
    algebra, baseline, contracts, dependencies, evasion, governance, iac,
    knowledge, linerules, pyrules, report, scorecard, secrets,
)
from ravelin.plans import derived as D
from ravelin.plans import scan
from ravelin.plans.seeded import labelled_cases, seeded_files
from ravelin.sources import external, files as S, manifests
from ravelin.sources.tables import read_table, spread, written
from ravelin.streaming import incremental

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def docs(spark, d) -> DataFrame:
    return spread(read_table(spark, d, "documents"))


def as_files(df: DataFrame) -> DataFrame:
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return S.from_table(df, path, F.col("text"))


HIT_COLUMNS = ["file", "line", "rule_id", "severity", "cwe", "evidence"]


def found(spark, d, packs, rules=None, columns=HIT_COLUMNS) -> DataFrame:
    """Hits of whole packs over all files; ``rules`` filters the result, not the files."""
    hits = scan.detect(seeded_files(spark, d), packs)
    if rules:
        hits = hits.where(F.col("rule_id").rlike(rules))
    return hits.select(*columns)


# --- sources -----------------------------------------------------------------

@query
def s01_file_tree(spark, d):
    return S.read_tree(spark, d, glob="*.parquet").select(
        "rel", "ext", "length", S.language(F.col("ext")).isNotNull().alias("is_source")
    )


@query
def s02_text_table(spark, d):
    return as_files(docs(spark, d)).select("path", "ext", "length", F.length("content").alias("chars"))


@query
def s03_tolerant_decode(spark, d):
    raw = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF80")))
    kept, dropped = T.decode(raw), T.decode(raw, "ignore")
    return docs(spark, d).select(
        "doc_id", F.length(kept).alias("replaced"), F.length(dropped).alias("ignored"),
        F.md5(dropped).alias("digest"),
    )


@query
def s04_lines(spark, d):
    return S.explode_lines(as_files(docs(spark, d))).select(
        "path", "line_no", F.length("line").alias("chars"), F.md5("line").alias("digest")
    )


def deps_of(spark, d, names, static=False):
    files = seeded_files(spark, d).where(F.lower(T.basename(F.col("path"))).rlike(names))
    read = manifests.static_dependencies if static else manifests.ecosystem_dependencies
    return read(files).select("file", "name", "version", "pos")


@query
def s05_requirements(spark, d):
    return deps_of(spark, d, "requirements.txt$")


@query
def s05_requirements_static(spark, d):
    return deps_of(spark, d, "requirements.txt$", static=True)


@query
def s06_package_json(spark, d):
    return deps_of(spark, d, "^package.json$")


@query
def s07_go_mod(spark, d):
    return deps_of(spark, d, "^go.mod$")


@query
def s07_go_mod_static(spark, d):
    return deps_of(spark, d, "^go.mod$", static=True)


@query
def s08_cargo(spark, d):
    return deps_of(spark, d, "^cargo.toml$")


@query
def s08_cargo_static(spark, d):
    return deps_of(spark, d, "^cargo.toml$", static=True)


@query
def s09_gemfile(spark, d):
    return deps_of(spark, d, "^gemfile$")


@query
def s10_pipfile(spark, d):
    return deps_of(spark, d, "^pipfile$", static=True)


@query
def s11_manifest_dispatch(spark, d):
    return manifests.ecosystem_dependencies(seeded_files(spark, d)).select(
        "file", "name", "version", "ecosystem"
    )


@query
def s12_semgrep(spark, d):
    return external.semgrep_findings(D.semgrep_json(spark, d), "json", "event_id").select(
        *HIT_COLUMNS, "col", "recommendation", "confidence", "category"
    )


@query
def s13_slither(spark, d):
    return external.slither_findings(D.slither_json(spark, d), "json", "event_id").select(
        "rule_id", "severity", "title", "file", "line", "source"
    )


@query
def s14_cargo_audit(spark, d):
    return external.cargo_audit_findings(D.cargo_json(spark, d), "json", "event_id").select(
        "rule_id", "severity", "title", "cve", "package", "installed_version"
    )


@query
def s15_osv_dump(spark, d):
    return external.osv_advisories(D.osv_json(spark, d), "json").select(
        "id", "cve", "severity", "summary", F.size("refs").alias("refs"),
        F.element_at("refs", 1).alias("first_ref"),
    )


@query
def s16_json_objects(spark, d):
    texts = read_table(spark, d, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("t")
    ).union(docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text"))
    parsed = external.parse_object(F.col("t"), "k int")
    return texts.select("id", external.is_json_object(F.col("t")).alias("is_object"), parsed["k"].alias("k"))


@query
def s17_baseline_load(spark, d):
    return baseline.from_json(D.baseline_json(spark, d), "json")


@query
def s18_authorizations(spark, d):
    return D.authorizations(spark, d).select(
        "organization", "authorized_by", "permission_ref", "expires",
        F.array_join("scope", " ").alias("scope"), F.col("contact"),
    )


@query
def s19_rule_table(spark, d):
    fired = scan.detect(seeded_files(spark, d), ["lines", "contracts"]).groupBy("rule_id").count()
    return catalog.rules(spark).join(fired, "rule_id").select(
        "rule_id", "cwe", "severity", F.col("count").alias("hits")
    )


# --- sinks -------------------------------------------------------------------

@query
def k01_json_report(spark, d):
    return report.header(D.event_findings(spark, d), "events")


@query
def k02_sarif_results(spark, d):
    return report.sarif_results(D.event_findings(spark, d)).select(
        "rule_id", "rule_index", "level", "security_severity", "file", "start_line", "seq"
    )


@query
def k02_sarif_document(spark, d):
    doc = report.sarif(D.event_findings(spark, d), report.SARIF_LIMIT)
    run = F.get_json_object("sarif", "$.runs[0]")
    return doc.select(
        F.get_json_object("sarif", "$.version").alias("version"),
        F.json_array_length(F.get_json_object(run, "$.results")).alias("results"),
        F.json_array_length(F.get_json_object(run, "$.tool.driver.rules")).alias("rules"),
        F.get_json_object(run, "$.results[0].ruleId").alias("first_rule"),
        F.get_json_object(run, "$.tool.driver.rules[0].id").alias("rule_zero"),
    )


@query
def k01_tool_summary(spark, d):
    return report.tool_summary(D.event_findings(spark, d), "events", "high")


@query
def k02_sarif_parts(spark, d):
    """The document of all findings from its files: one row per result, in document order."""
    path = D.scratch(spark, "k02-sarif")
    report.write_sarif(D.event_findings(spark, d), path)
    lines = spark.read.text(f"{path}/3-results")
    kind = (
        "ruleId string, ruleIndex int, level string, message struct<text string>,"
        " locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>"
    )
    row = F.from_json(F.ltrim("value", F.lit(",")), kind)
    place = F.col("row.locations")[0]["physicalLocation"]
    rules = spark.read.text(f"{path}/1-rules").select(
        F.from_json(F.ltrim("value", F.lit(",")), "id string, properties struct<cwe string>").alias("rule")
    )
    found_ = lines.select(row.alias("row")).select(
        F.col("row.ruleId").alias("rule_id"), F.col("row.ruleIndex").alias("rule_index"), F.col("row.level").alias("level"),
        F.col("row.message.text").alias("message"), place["artifactLocation"]["uri"].alias("file"),
        place["region"]["startLine"].alias("start_line"),
    )
    return found_.join(rules.select(F.col("rule.id").alias("rule_id"), F.col("rule.properties.cwe").alias("rule_cwe")), "rule_id")


@query
def k03_baseline_save(spark, d):
    return baseline.fingerprints(D.event_findings(spark, d), "src")


@query
def k03_baseline_saved(spark, d):
    """A baseline written and loaded again, with the count that writing it reports."""
    path = D.scratch(spark, "k03-baseline")
    count = baseline.save(D.event_findings(spark, d), "src", path)
    return baseline.load(spark, path).withColumn("saved", F.lit(count))


@query
def k04_audit_rows(spark, d):
    rows = governance.audit_rows(governance.decide(D.targets(spark, d), D.authorizations(spark, d)))
    return rows.select("action", "target", "organization", "detail", F.col("ts").isNotNull().alias("stamped"))


@query
def k04_audit_requests(spark, d):
    """One log row per request, read back; the run is decided once, logged twice and counts once."""
    path = D.scratch(spark, "k04-log")
    decided = governance.decide_requests(D.requests(spark, d), D.wildcard_authorizations(spark, d), "asked")
    decided = written(decided, "k04-decided")
    for _ in range(2):
        governance.append_audit(decided, path, "first", ("event_id",))
    rows = "event_id long, ts string, action string, target string, authorization string, organization string, detail string"
    log = spark.read.schema(rows).json(path)
    return log.select("event_id", "action", "target", "organization", "detail", F.col("ts").isNotNull().alias("stamped"))


# --- filters -----------------------------------------------------------------

@query
def f01_language(spark, d):
    return seeded_files(spark, d).select("path", S.language(F.col("ext")).alias("language"))


@query
def f02_skip_dirs(spark, d):
    return seeded_files(spark, d).select(
        "path", S.in_folder(F.col("rel"), S.SOURCE_SKIP_DIRS).alias("skipped")
    )


@query
def f03_size_cut(spark, d):
    size = F.octet_length("content").cast("bigint") * 80
    big = seeded_files(spark, d).withColumn("length", size)
    keep = S.is_scannable(F.col("rel"), F.col("ext"), F.col("length"), S.MAX_SOURCE_BYTES)
    return big.where(keep).select("path", "length")


@query
def f04_asset_skip(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in [".png", ".PNG", ".py", ".svg", ".md"]]), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    pages = read_table(spark, d, "pages").withColumn("ext", ext)
    return pages.where(~F.lower("ext").isin(secrets.SKIP_EXTENSIONS)).select("page_id", "ext")


@query
def f05_minified(spark, d):
    return docs(spark, d).select("doc_id", secrets.is_minified(F.col("text")).alias("minified"))


@query
def f06_comments(spark, d):
    lines = S.explode_lines(seeded_files(spark, d))
    return lines.select(
        "path", "line_no",
        T.is_comment(F.col("line")).alias("code"),
        T.is_comment(F.col("line"), T.COMMENT_SECRETS).alias("secrets"),
        T.is_comment(F.col("line"), T.COMMENT_SOLIDITY).alias("solidity"),
    ).where("code OR secrets OR solidity")


@query
def f07_context_gate(spark, d):
    return found(spark, d, ["lines"]).where("rule_id = 'A005'")


@query
def f08_min_severity(spark, d):
    return algebra.at_least(D.event_findings(spark, d), "high").select("seq", "severity")


@query
def f09_rules_by_language(spark, d):
    fired = found(spark, d, ["lines"]).groupBy("rule_id").agg(F.count("*").alias("hits"))
    php = catalog.rules_for_language(catalog.rules(spark), "PHP")
    return php.select("rule_id").join(fired, "rule_id")


@query
def f10_text_presence(spark, d):
    return found(spark, d, ["contracts", "iac"]).where(
        "rule_id IN ('SC-TON-001', 'SC-TON-004', 'SC-SOL-002', 'IAC-TF-001')"
    ).select("file", "rule_id")


@query
def f11_deny_list(spark, d):
    words = F.array(*[F.lit(w) for w in governance.FORBIDDEN])
    action = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), F.upper(F.element_at(words, (F.col("event_id") % 14 + 1).cast("int")))))
        .otherwise(F.col("event_type"))
    )
    asked = read_table(spark, d, "events").select("event_id", action.alias("action"))
    return asked.select(
        "event_id",
        F.when(governance.is_forbidden(F.col("action")), "REFUSED").otherwise("ALLOWED").alias("status"),
    )


@query
def f11_refusals(spark, d):
    """Requests with the part of the deny list in the decision."""
    decided = governance.decide_requests(D.requests(spark, d), D.authorizations(spark, d), "asked")
    return decided.select("event_id", "status", "detail", "organization")


@query
def f12_chain_of(spark, d):
    rust = seeded_files(spark, d).where("ext = '.rs'")
    return rust.select("path", contracts.chain_of(F.col("content")).alias("chain"))


@query
def f13_old_compiler(spark, d):
    sol = seeded_files(spark, d).where("ext = '.sol'")
    return sol.select("path", contracts.is_old_compiler(F.col("content")).alias("old"))


def candidates(spark, d):
    """All assignment candidates of pages, measured."""
    lines = spread(read_table(spark, d, "pages")).select(
        "page_id", F.explode(T.splitlines(T.html_unescape(F.col("html")))).alias("line")
    ).where(secrets.may_hold_secret(F.col("line")))
    return lines.select(
        "page_id",
        F.explode(secrets.measured(secrets.assignment_candidates(F.col("line")), "assignment")).alias("c"),
    ).select("page_id", "c.*")


@query
def f14_likely_secret(spark, d):
    likely = secrets.is_likely_secret(
        F.col("value"), F.col("name"), F.col("entropy"), F.col("encoding"), F.lit(".html")
    )
    return candidates(spark, d).select("page_id", "name", "value", likely.alias("likely"))


@query
def f15_secret_filter(spark, d):
    return candidates(spark, d).select(
        "page_id", "value", secrets.survives_filter(F.col("value"), F.col("confidence")).alias("kept")
    )


# --- projections -------------------------------------------------------------

@query
def p01_normalise(spark, d):
    return algebra.normalise(D.raw_findings(spark, d), "outside").select(
        "event_id", "severity", "title", "source"
    )


@query
def p02_finding(spark, d):
    return found(spark, d, ["lines"], columns=[*HIT_COLUMNS, "title", "message", "source", "engine"])


@query
def p03_web3_source(spark, d):
    return algebra.label_web3(D.event_findings(spark, d)).select("seq", "rule_id", "source")


@query
def p04_mask(spark, d):
    word = F.explode(F.split("text", " "))
    words = docs(spark, d).select("doc_id", word.alias("w")).where("length(w) > 6")
    return words.select("doc_id", E.mask(F.col("w")).alias("masked")).groupBy("doc_id", "masked").agg(F.count("*").alias("n"))


@query
def p05_redaction(spark, d):
    return found(spark, d, ["contracts", "iac"]).where("rule_id IN ('SC-COM-001', 'IAC-TF-008')")


@query
def p06_secret_severity(spark, d):
    return candidates(spark, d).select(
        "page_id", "name", "value",
        E.secret_severity(F.col("entropy"), F.col("name")).alias("severity"),
    )


@query
def p07_severity_maps(spark, d):
    ev = read_table(spark, d, "events").withColumn("score", (F.col("event_id") % 101) / 10)
    word = F.upper("event_type")
    sev = F.element_at(F.array(*[F.lit(s) for s in schema.SEVERITIES]), (F.col("event_id") % 5 + 1).cast("int"))
    return ev.select(
        "event_id",
        external.cvss_bucket(F.when(F.col("event_id") % 7 > 0, F.col("score")), "HIGH").alias("cvss"),
        report.lookup(word, external.SEMGREP_SEVERITY, "MEDIUM").alias("semgrep"),
        report.lookup(sev, report.SARIF_LEVEL, "none").alias("level"),
        report.lookup(sev, report.SECURITY_SEVERITY, "0.0").alias("score"),
    )


@query
def p08_osv_severity(spark, d):
    dump = D.osv_json(spark, d)
    plain = external.osv_advisories(dump, "json").select("id", F.col("severity").alias("reproduced"))
    strict = external.osv_advisories(dump, "json", skip_version=True).select("id", F.col("severity").alias("skipping_vectors"))
    return plain.join(strict, "id")


@query
def p09_fixed_version(spark, d):
    osv = external.osv_advisories(D.osv_json(spark, d), "json")
    return osv.select(
        "id",
        dependencies.fixed_version(F.col("affected"), F.col("affected")[0]["package"]["ecosystem"]).alias("fixed_in"),
        dependencies.fixed_version(F.col("affected"), F.lit("none")).alias("other"),
    )


@query
def p10_fingerprint(spark, d):
    return baseline.with_fingerprint(D.event_findings(spark, d), "src").select("seq", "fingerprint")


@query
def p11_authorization_fingerprint(spark, d):
    return D.authorizations(spark, d).select(
        "organization", governance.authorization_fingerprint().alias("fingerprint")
    )


@query
def p12_explanations(spark, d):
    return knowledge.explain(D.event_findings(spark, d)).select(
        "seq", F.length("explanation").alias("chars"),
        F.split("explanation", "\n")[0].alias("heading"),
        F.split("explanation", "\n")[1].alias("location"),
    )


@query
def p12_fix_advice(spark, d):
    return knowledge.fix_advice(D.event_findings(spark, d)).select("seq", "advice")


@query
def p13_narrow(spark, d):
    return algebra.narrow(D.event_findings(spark, d))


# --- joins -------------------------------------------------------------------

@query
def j01_static_advisories(spark, d):
    return dependencies.static_findings(manifests.static_dependencies(seeded_files(spark, d))).select(
        "file", "package", "installed_version", "cve", "severity", "fixed_in", "evidence"
    )


@query
def j02_osv_advisories(spark, d):
    osv = external.osv_advisories(D.osv_json(spark, d), "json")
    return dependencies.osv_findings(D.dependencies(spark, d), osv).select(
        "file", "package", "installed_version", "cve", "severity", "fixed_in"
    )


@query
def j03_notes(spark, d):
    return knowledge.with_notes(D.event_findings(spark, d)).select("seq", "kb_cwe", "name")


@query
def j04_baseline_gate(spark, d):
    return baseline.gate(D.event_findings(spark, d), D.known(spark, d), "src").select("seq", "fingerprint")


@query
def j05_suppressed(spark, d):
    return baseline.suppressed(D.event_findings(spark, d), D.known(spark, d), "src")


@query
def j04_flagged(spark, d):
    marked = baseline.flagged(D.event_findings(spark, d), D.known(spark, d), "src")
    return marked.groupBy("is_known").agg(F.count("*").alias("findings"))


@query
def j06_authorization(spark, d):
    return governance.decide(D.targets(spark, d), D.authorizations(spark, d))


@query
def j06_wildcard_scopes(spark, d):
    """Scopes that begin with a wildcard, looked up by their rarest literal text."""
    return governance.decide(D.requests(spark, d), D.wildcard_authorizations(spark, d))


@query
def j07_dynamic_variables(spark, d):
    return found(spark, d, ["python"]).where("rule_id = 'P010'")


@query
def j08_query_helpers(spark, d):
    return found(spark, d, ["python"]).where("rule_id = 'P015'")


@query
def j09_rule_meta(spark, d):
    return found(spark, d, ["lines"], columns=["file", "line", "rule_id", "cwe", "severity"])


def scored(spark, d):
    return scorecard.score_cases(
        labelled_cases(spark, d), scan.detect(seeded_files(spark, d), ["python", "lines"])
    )


@query
def j10_scored_cases(spark, d):
    return scored(spark, d).select("path", "case_id", "side", "hit", "flagged")


@query
def j11_assessment(spark, d):
    decisions = governance.decide(D.targets(spark, d), D.authorizations(spark, d))
    return governance.assess(D.page_findings(spark, d), decisions).select(
        "target", "organization", "rule_id", "cwe", "statically_reachable", "reproduction_note"
    )


# --- aggregations ------------------------------------------------------------

@query
def g01_by_severity(spark, d):
    return algebra.count_by_severity(D.event_findings(spark, d))


@query
def g02_risk_per_file(spark, d):
    return algebra.risk(D.event_findings(spark, d), "file").select("file", "total", "risk_score")


@query
def g03_risk_level(spark, d):
    return algebra.risk(D.event_findings(spark, d), "file").select("file", "risk_score", "risk_level", "exit_code")


@query
def g04_engine_rollup(spark, d):
    return algebra.count_by_engine(D.event_findings(spark, d))


@query
def g05_engine_summary(spark, d):
    return algebra.engine_summary(D.event_findings(spark, d))


@query
def g06_per_chain(spark, d):
    return algebra.count_by_chain(D.event_findings(spark, d))


@query
def g07_top_weaknesses(spark, d):
    return algebra.top_weaknesses(D.event_findings(spark, d), algebra.TOP_CWE)


@query
def g07_summary(spark, d):
    return algebra.summary(D.event_findings(spark, d), algebra.TOP_CWE)


@query
def g08_languages(spark, d):
    return S.language_histogram(seeded_files(spark, d))


@query
def g09_scorecard(spark, d):
    card = scorecard.scorecard(scored(spark, d))
    return card.select(
        "scope", "cases", "tp", "fp", F.round("recall", 3).alias("recall"),
        F.round("fpr", 3).alias("fpr"), F.round("precision", 3).alias("precision"), "passed",
    )


@query
def g09_missed_cases(spark, d):
    return scorecard.missed_cases(scored(spark, d))


@query
def g09_false_positives(spark, d):
    return scorecard.false_positives(scored(spark, d))


@query
def g10_rule_summary(spark, d):
    fired = found(spark, d, ["lines"]).select("rule_id").distinct()
    return scorecard.rule_summary(catalog.rules(spark).join(fired, "rule_id", "left_semi"))


@query
def g11_silent_rules(spark, d):
    return scorecard.silent_rules(scan.detect(seeded_files(spark, d), ["lines"]))


@query
def g12_entropy(spark, d):
    words = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    return words.groupBy("doc_id").agg(F.round(F.max(E.shannon(F.col("w"))), 3).alias("top"), F.count("*").alias("n"))


@query
def g13_last_file(spark, d):
    return dependencies.last_file_wins(D.dependencies(spark, d))


# --- windows, limits, sorts --------------------------------------------------

@query
def w01_dedup(spark, d):
    return algebra.dedup(D.event_findings(spark, d)).select("seq", "cwe", "file", "line", "engine")


@query
def w02_dedup_by_rule(spark, d):
    return algebra.dedup_by_rule(D.event_findings(spark, d)).select("seq", "rule_id", "file", "line")


@query
def w03_cap_per_chain(spark, d):
    return algebra.cap_web3(D.event_findings(spark, d), 3).select("seq", "chain", "pack_rank")


@query
def w04_secret_dedup(spark, d):
    line = F.concat_ws(
        " ",
        *[F.format_string('k%s = "%s%s"', F.lit(i), F.substring(F.sha1(F.col("event_type")), 1, 14), F.substring(F.md5(F.concat("props", F.lit(str(i % 2)))), 1, 10)) for i in range(3)],
    )
    rows = read_table(spark, d, "events").select("event_id", line.alias("line"))
    items = secrets.assignment_candidates(F.col("line"))
    return rows.select(
        "event_id",
        F.size(secrets.first_by_prefix(items, 16)).alias("by16"),
        F.size(secrets.first_by_prefix(items, 12)).alias("by12"),
    )


@query
def w05_rule_index(spark, d):
    return report.sarif_results(D.event_findings(spark, d)).groupBy("rule_index", "rule_id").agg(F.count("*").alias("n"))


@query
def w06_first_authorization(spark, d):
    return governance.decide(D.targets(spark, d), D.authorizations(spark, d)).where(
        "status = 'AUTHORIZED'"
    ).select("target", "organization")


@query
def w07_first_per_file(spark, d):
    return found(spark, d, ["iac", "multichain"]).where(
        "rule_id IN ('IAC-TF-002', 'IAC-TF-008', 'SC-SOL-NA-003', 'SC-SOL-NA-004', 'SC-SOL-NA-005', 'SC-CW-004')"
    ).select("file", "line", "rule_id")


@query
def w08_ahead_four(spark, d):
    return found(spark, d, ["contracts"]).where("rule_id = 'SC-SOL-004'")


@query
def w09_ahead_eight(spark, d):
    return found(spark, d, ["contracts"]).where("rule_id = 'SC-SOL-001'")


@query
def w10_save_then_message(spark, d):
    return found(spark, d, ["multichain"]).where("rule_id = 'SC-CW-004'")


@query
def w11_around(spark, d):
    return found(spark, d, ["iac"]).where("rule_id = 'IAC-TF-002'")


@query
def w12_behind(spark, d):
    files = seeded_files(spark, d)
    both = []
    for name, loose in (("whole_line", False), ("substring", True)):
        hits = scan.detect(files, ["contracts"], substring_guards=loose).where("rule_id = 'SC-SOL-005'")
        both.append(hits.select(F.col("file").alias("path"), "line", F.lit(name).alias("guards")))
    return algebra.union_all(both)


@query
def w13_severity_order(spark, d):
    ordered = algebra.by_severity_rank(D.event_findings(spark, d))
    return ordered.select("seq", "severity", "file")


@query
def w14_first_findings(spark, d):
    return algebra.limit_in_order(D.event_findings(spark, d), algebra.REPORT_LIMIT).select("seq", "engine", "file")


@query
def w14_tool_findings(spark, d):
    return report.tool_findings(D.event_findings(spark, d), "medium", algebra.REPORT_LIMIT)


@query
def w14_explain_first(spark, d):
    first = knowledge.explain_first(D.event_findings(spark, d), knowledge.EXPLAIN_LIMIT)
    return first.select("seq", F.split("explanation", "\n")[0].alias("heading"))


@query
def w14_validate_first(spark, d):
    decisions = governance.decide(D.targets(spark, d), D.authorizations(spark, d))
    targets = D.page_findings(spark, d).join(
        decisions.where("status = 'AUTHORIZED'").select("target"), "target", "left_semi"
    )
    place = F.substring("rule_id", 2, 9).cast("int")
    ordered = targets.withColumns({"severity": F.lit("HIGH"), "seq": place})
    rows = governance.assessment_audit(governance.validate(ordered, decisions, limit=2))
    return rows.select("action", "target", "detail", "organization")


@query
def w15_file_cap(spark, d):
    return S.capped_files(seeded_files(spark, d), 40).select("path")


# --- set operations ----------------------------------------------------------

@query
def u01_union(spark, d):
    f = D.event_findings(spark, d)
    parts = [f.where(F.col("engine") == e).select("engine", "seq", *(["chain"] if e == "web3" else [])) for e in schema.ENGINES]
    return algebra.union_all(parts)


@query
def u02_distinct_dependencies(spark, d):
    return D.dependencies(spark, d).select("name", "version", "ecosystem").distinct()


@query
def u03_distinct_fingerprints(spark, d):
    return baseline.with_fingerprint(D.event_findings(spark, d), "src").select("fingerprint").distinct()


@query
def u04_rules_never_fired(spark, d):
    fired = D.event_findings(spark, d).select(F.upper("cwe").alias("cwe")).distinct()
    return catalog.cwe_notes(spark).select(F.col("kb_cwe").alias("cwe")).join(fired, "cwe", "left_anti")


@query
def u05_fallback(spark, d):
    f = D.event_findings(spark, d).select("seq", "severity", "engine")
    empty, full = f.where("severity = 'NONE'"), f.where("severity = 'HIGH'")
    other = f.where("severity = 'LOW'")
    used = algebra.primary_or_fallback(empty, other).withColumn("case", F.lit("empty"))
    kept = algebra.primary_or_fallback(full, other).withColumn("case", F.lit("full"))
    return used.unionByName(kept)


# --- detection packs ---------------------------------------------------------

def _pack_query(name, packs, rules=None, suffix=None):
    def run(spark, d):
        hits = found(spark, d, packs, rules)
        return hits.where(F.col("file").rlike(suffix)) if suffix else hits

    run.__name__ = name
    query(run)


def _only(rule_ids) -> str:
    return "^(" + "|".join(rule_ids) + ")$"


# Every pack sees every file; rule ids (or, for rules of two dialects, the suffix) pick hits.
for _i, _lang in enumerate(linerules.LANGUAGES):
    _pack_query(f"d{_i + 1:02d}_{_lang}", ["lines"], _only(r for r, _ in linerules.RULES[_lang]))
for _name, _packs, _rules, _suffix in [
    ("d10_python", ["python"], None, None),
    ("d16_terraform", ["iac"], "^IAC-TF-", None),
    ("d17_cloudformation", ["iac"], "^IAC-CF-", None),
    ("d18_kubernetes", ["iac"], "^IAC-K8S-", None),
    ("d20_ton", ["contracts"], None, r"\.(fc|func|tolk)$"),
    ("d21_evm", ["contracts"], None, r"\.sol$"),
    ("d22_solidity", ["solidity"], None, None),
    ("d23_solana", ["multichain"], "^SC-SOL-NA-", None),
    ("d24_cosmwasm", ["multichain"], "^SC-CW-", None),
]:
    _pack_query(_name, _packs, _rules, _suffix)

# Rules of a user over the fact rows of the readers.
FACT_RULES = [
    ("P001", "python", "f.kind = 'call' AND (lower(f.dotted) IN ('hashlib.md5', 'hashlib.sha1') OR f.name IN ('md5', 'sha1')"
     " OR lower(f.dotted) = 'hashlib.new' AND lower(get(f.args, 0).text) IN ('md5', 'sha1', 'md4'))", "CWE-327", "MEDIUM", "hash"),
    ("P003", "python", "f.kind = 'attribute' AND f.attr IN ('MODE_ECB', 'ECB')", "CWE-327", "HIGH", "mode"),
    ("P016", "python", "f.kind = 'call' AND f.attr = 'xpath' AND get(f.args, 0).dynamic", "CWE-643", "HIGH", "xpath"),
    ("IAC-CF-001", "yaml", "f.kind = 'ingress' AND f.port = '22' AND f.cidr IN ('0.0.0.0/0', '::/0')", "CWE-284", "HIGH", "ssh"),
    ("IAC-K8S-005", "yaml", "f.kind = 'container' AND f.privileged", "CWE-250", "HIGH", "privileged"),
]


@query
def x01_facts_in_sql(spark, d):
    """Calls of eval and exec from SQL, through the table function of the Python reader."""
    tables.register(spark)
    files = scan.with_facts(seeded_files(spark, d), []).where("language = 'python'")
    return spark.sql(
        "SELECT f.path AS file, p.line, 'P007' AS rule_id FROM {files} f, LATERAL python_facts(f.source_text) p"
        " WHERE p.kind = 'call' AND p.name IN ('eval', 'exec') AND size(p.args) > 0 AND get(p.args, 0).text IS NULL",
        files=files,
    )


@query
def x02_fact_rules(spark, d):
    """Rules of a user over the fact rows of both readers."""
    return scan.detect_facts(seeded_files(spark, d), FACT_RULES).select("file", "line", "rule_id", "severity")


SECRET_COLUMNS = ["severity", "evidence", "encoding", "var_name", "context_type", "confidence"]


@query
def d11_secrets(spark, d):
    found_ = scan.detect(as_files(docs(spark, d)), ["secrets"])
    return found_.select("file", "line", *SECRET_COLUMNS, F.round("entropy", 3).alias("entropy"))


@query
def d11_secrets_seeded(spark, d):
    found_ = scan.detect(seeded_files(spark, d), ["secrets"])
    return found_.select("file", "line", *SECRET_COLUMNS, F.round("entropy", 3).alias("entropy"))


@query
def d11_candidate_profile(spark, d):
    return candidates(spark, d).select(
        "page_id", "name", "value", "encoding", F.round("entropy", 3).alias("entropy"), "confidence"
    )


def evasions(spark, d, hits):
    rows = seeded_files(spark, d).where(S.language(F.col("ext")).isNotNull())
    return rows.select("path", F.explode(hits(F.col("content"))).alias("h")).select(
        F.col("path").alias("file"), "h.line", "h.evidence", F.col("h.encoding").alias("kind")
    )


@query
def d12_base64(spark, d):
    return evasions(spark, d, evasion.base64_hits)


@query
def d13_hex(spark, d):
    return evasions(spark, d, evasion.hex_hits)


@query
def d14_charcode(spark, d):
    return evasions(spark, d, evasion.charcode_hits)


@query
def d15_split_strings(spark, d):
    hits = scan.detect(seeded_files(spark, d), ["evasion"]).where("encoding = 'concat'")
    return hits.select("file", "line", "evidence", F.col("encoding").alias("kind"))


@query
def d19_iac_dispatch(spark, d):
    return seeded_files(spark, d).where("ext IN ('.tf', '.yml', '.yaml')").select(
        "path",
        F.when(F.col("ext") == ".tf", "terraform").otherwise(iac.yaml_kind(F.col("ext"), F.col("content"))).alias("kind"),
    )


@query
def d25_web3(spark, d):
    return scan.web3_findings(seeded_files(spark, d), scan.WEB3_CAP).select("file", "line", "rule_id", "source")


@query
def d26_sca(spark, d):
    files = seeded_files(spark, d)
    cargo = external.cargo_audit_findings(D.cargo_json(spark, d), "json", "event_id")
    nothing = external.osv_advisories(D.osv_json(spark, d).where("false"), "json")
    return scan.sca_findings(files, osv=nothing, cargo_audit=cargo).select(
        "file", "rule_id", "severity", "source", "package", "installed_version"
    )


@query
def d27_full_scan(spark, d):
    return scan.scan(seeded_files(spark, d)).select("engine", *HIT_COLUMNS, "source")


@query
def d27_scan_with_semgrep(spark, d):
    semgrep = external.semgrep_findings(D.semgrep_json(spark, d), "json", "event_id")
    return scan.scan(seeded_files(spark, d), engines=["sast"], semgrep=semgrep).select(
        "source", "file", "line", "rule_id", "cwe"
    )


@query
def d27_scan_errors(spark, d):
    """Every document once more as a file that cannot be read as it stands: broken Python, odd YAML,
    bad bytes, and whatever is over 9,000 bytes."""
    k, raw = F.col("doc_id") % 3, F.encode("text", "utf-8")
    name = F.concat(F.lit("bad/"), F.col("doc_id").cast("string"), D.pick([".py", ".yaml", ".txt"], k))
    hidden = F.encode(F.concat(F.lit("# "), F.regexp_replace("text", T.LINE_END, "\n# ")), "utf-8")
    content = (
        F.when(k == 0, F.concat(F.encode(F.lit("def 1:\n"), "utf-8"), raw))
        .when(k == 1, F.concat(F.encode(F.lit("apiVersion: v1\nkind: Thing\nspec: null\n"), "utf-8"), hidden))
        .otherwise(F.concat(raw, F.unhex(F.lit("FF80"))))
    )
    bad = S.from_bytes(docs(spark, d), name, content)
    return scan.errors(seeded_files(spark, d).unionByName(bad), 9_000)


@query
def flagship_risk_by_language(spark, d):
    files = seeded_files(spark, d)
    findings = algebra.dedup(scan.detect(files, ["lines"]))
    lang = S.language(T.extension(F.col("file")))
    return algebra.risk(findings.withColumn("language", lang), "language")


# --- scalar functions --------------------------------------------------------

@query
def e04_collapse_whitespace(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.collapse_whitespace(F.col("text"))).alias("digest"))


@query
def e06_decoders(spark, d):
    ev = read_table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" "), "props").alias("t"))
    coded = F.concat(F.lit("\\x"), F.array_join(F.regexp_extract_all(F.hex("t"), F.lit("(..)"), F.lit(1)), "\\x"))
    return ev.select(
        "event_id",
        evasion.decode_base64(F.base64(F.encode("t", "utf-8"))).alias("from_base64"),
        evasion.decode_hex(coded).alias("from_hex"),
    )


@query
def e07_encoding_class(spark, d):
    words = docs(spark, d).select(F.explode(F.split("text", r"\s+")).alias("w"))
    pages = read_table(spark, d, "pages").select(F.col("url").alias("w"))
    hashes = read_table(spark, d, "events").select(F.md5("props").alias("w"))
    all_words = words.union(pages).union(hashes).where("w <> ''")
    return all_words.groupBy(E.encoding_class(F.col("w")).alias("encoding")).agg(F.count("*").alias("n"))


@query
def e13_html_escape(spark, d):
    pages = read_table(spark, d, "pages")
    return pages.select(
        "page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped"),
        F.md5(T.html_unescape(F.col("html"))).alias("unescaped"),
    )


@query
def e14_glob(spark, d):
    pages = read_table(spark, d, "pages").select("url")
    globs = ["http://*.example.com/??/*", "*[0-9]", "*.[!h]*#top", "https://m.*"]
    return pages.select(
        "url", *[F.regexp("url", T.glob_regex(F.lit(g))).alias(f"g{i}") for i, g in enumerate(globs)]
    )


@query
def e15_version_keys(spark, d):
    items = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.line_version().alias("version"))
    pre = F.concat("version", F.lit("-rc."), (F.col("l_orderkey") % 12).cast("string"))
    return items.select(
        "l_orderkey", "l_linenumber", "version",
        (T.version_key(F.col("version")) < T.version_key(F.lit("3.2"))).alias("below"),
        (T.version_key(F.col("version")) == T.version_key(F.lit("3.1.0.0"))).alias("same"),
        (T.version_key(pre) < T.version_key(F.concat("version", F.lit("-rc.9")))).alias("earlier"),
        (T.version_key(pre) < T.version_key(F.col("version"))).alias("before_release"),
    )


# --- streaming ---------------------------------------------------------------

def table_stream(spark, d, name) -> DataFrame:
    """The files of a table as a stream, be the table one file or a folder of them: a stream takes
    a single file by a pattern only, here one that matches no other name."""
    return spark.readStream.schema(read_table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query
def t01_stream_new_findings(spark, d):
    out, checkpoint = D.scratch(spark, "t01-out"), D.scratch(spark, "t01-checkpoint")
    arrivals = table_stream(spark, d, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = S.from_table(arrivals, path, F.col("text"))
    half = scan.detect(as_files(docs(spark, d)), ["secrets"]).where("line % 2 = 0")
    known = baseline.with_fingerprint(half, "doc").select("fingerprint")
    fresh = incremental.new_findings(files, known, "doc", ["secrets"])
    incremental.run_once(fresh, out, checkpoint)
    return spark.read.parquet(out).select("file", "evidence", "rule_id")


def arriving(spark, d, folder, out, known, checkpoint):
    """One run over the documents that lie in ``folder`` by now."""
    schema_ = read_table(spark, d, "documents").schema
    arrivals = spark.readStream.schema(schema_).option("recursiveFileLookup", True).parquet(folder)
    fresh = incremental.new_findings(as_files(arrivals), known, "doc", ["secrets"])
    incremental.run_once(fresh, out, checkpoint)
    return spark.read.parquet(out)


@query
def t01_stream_two_runs(spark, d):
    """Half of the documents arrive, are scanned, and arrive again with the others: each finding once."""
    folder, out, checkpoint = (D.scratch(spark, f"t01-{n}") for n in ("in", "twice", "twice-checkpoint"))
    table, known = docs(spark, d), spark.createDataFrame([], "fingerprint string")
    table.where("doc_id % 2 = 0").write.parquet(f"{folder}/first")
    arriving(spark, d, folder, out, known, checkpoint)
    table.write.parquet(f"{folder}/second")
    return arriving(spark, d, folder, out, known, checkpoint).select("file", "evidence", "rule_id")


@query
def t01_stream_remembered(spark, d):
    """As before, but the second run has a new checkpoint and knows the first from the baseline."""
    folder, out, later, base = (D.scratch(spark, f"t01-{n}") for n in ("in", "one", "two", "base"))
    table, known = docs(spark, d), spark.createDataFrame([], "fingerprint string")
    table.where("doc_id % 2 = 0").write.parquet(f"{folder}/first")
    one = arriving(spark, d, folder, out, known, f"{out}-checkpoint")
    incremental.remember(spark, out, base)
    table.write.parquet(f"{folder}/second")
    two = arriving(spark, d, folder, later, baseline.load(spark, base), f"{later}-checkpoint")
    return one.unionByName(two).select("file", "evidence", "rule_id")


@query
def t02_stream_decisions(spark, d):
    out, checkpoint = D.scratch(spark, "t02-out"), D.scratch(spark, "t02-checkpoint")
    targets = table_stream(spark, d, "pages").select("page_id", F.col("url").alias("target"))
    incremental.log_decisions(targets, D.authorizations(spark, d), out, checkpoint, keep=("page_id",))
    rows = "page_id long, ts string, action string, target string, authorization string, organization string, detail string"
    return spark.read.schema(rows).json(out).select("page_id", "action", "target", "organization", "detail")
