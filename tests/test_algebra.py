"""Finding algebra, joins, baseline, reports and governance."""

import datetime as dt
import fnmatch
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ravelin import catalog, schema
from ravelin.functions import text as T
from ravelin.operators import algebra, baseline, governance, knowledge, report, scopes, scorecard


def findings(spark, records):
    """Findings from dicts; missing fields are null."""
    fields = [f.name for f in schema.FINDING.fields]
    data = [tuple(r.get(f) for f in fields) for r in records]
    return spark.createDataFrame(data, schema.FINDING)


def plain(n, **more):
    base = dict(engine="sast", engine_rank=0, pack_rank=0, seq=n, rule_id="R", severity="LOW", file=f"f{n % 3}", line=n)
    return {**base, **more}


@pytest.mark.parametrize(
    "levels, score, level, code",
    [
        ([], 0, "CLEAN", 0), (["INFO"], 0, "CLEAN", 0), (["LOW"], 3, "LOW", 1),
        (["MEDIUM", "LOW"], 11, "MEDIUM", 2), (["HIGH", "HIGH"], 30, "HIGH", 3),
        (["CRITICAL", "CRITICAL"], 50, "HIGH", 3), (["CRITICAL"] * 10, 100, "CRITICAL", 3),
    ],
)
def test_risk(spark, levels, score, level, code):
    df = findings(spark, [plain(i, severity=s) for i, s in enumerate(levels)])
    r = algebra.risk(df).first()
    assert (r.risk_score, r.risk_level, r.exit_code, r.total) == (score, level, code, len(levels))
    counts = algebra.count_by_severity(df).first().asDict()
    assert counts == {s.lower(): levels.count(s) for s in schema.SEVERITIES}


def test_normalise(spark):
    df = spark.createDataFrame(
        [
            (1, None, "high", "", "msg", None, "R1", None),
            (2, "critical", None, "t", None, None, None, "own"),
            (3, "weird", None, None, "", "d", None, None),
            (4, "", None, None, None, None, "R4", None),
            (5, None, None, None, None, None, None, None),
        ],
        "i int, severity string, level string, title string, message string, description string, rule_id string, source string",
    )
    got = rows(algebra.normalise(df, "dflt"), "i", "severity", "title", "source")
    assert got == [
        (1, "HIGH", "msg", "dflt"), (2, "CRITICAL", "t", "own"), (3, "INFO", "d", "dflt"),
        (4, "INFO", "R4", "dflt"), (5, "INFO", "Finding", "dflt"),
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_first_wins_with_a_hot_key(spark, parts):
    records = [
        plain(i, cwe="CWE-1" if i % 3 else None, title=f"t{i % 4}", file="hot" if i % 3 == 1 else f"f{i}", line=i % 2, pack_rank=i % 2)
        for i in range(600)
    ]
    best = {}
    for r in sorted(records, key=lambda r: (r["engine_rank"], r["pack_rank"], r["file"], r["seq"])):
        best.setdefault((r["cwe"] or r["title"], r["file"], r["line"]), r["seq"])
    got = algebra.dedup(findings(spark, records).repartition(parts))
    assert sorted(r.seq for r in got.collect()) == sorted(best.values())


def test_dedup_keeps_other_engines_whole(spark):
    records = [plain(1, cwe="C", file="a", line=1), plain(2, cwe="C", file="a", line=1)]
    records += [plain(3, cwe="C", file="a", line=1, engine="sca", engine_rank=1, package=p) for p in "xy"]
    assert [r.seq for r in algebra.dedup_sast(findings(spark, records)).orderBy("seq").collect()] == [1, 3, 3]


def test_caps(spark):
    records = [plain(i, engine="web3", pack_rank=i % 3, chain=[None, None, ["SOLANA", "COSMWASM"][i % 2]][i % 3]) for i in range(90)]
    got = algebra.cap_web3(findings(spark, records), 3)
    want = []
    for key in [(0, None), (1, None), (2, "SOLANA"), (2, "COSMWASM")]:
        mine = [r for r in records if (r["pack_rank"], r["chain"]) == key]
        mine.sort(key=lambda r: (r["file"], r["seq"]))
        want += [r["seq"] for r in mine[: 6 if key[0] == 0 else 3]]
    assert sorted(r.seq for r in got.collect()) == sorted(want)


def test_group_limit_happens_before_the_shuffle(spark):
    plan = algebra.top_per_group(findings(spark, [plain(1)]), F.col("chain"), 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_summary_and_top(spark):
    records = [plain(i, cwe=c, severity=s) for i, (c, s) in enumerate([("C2", "LOW"), ("C1", "HIGH"), ("C1", "LOW"), ("C3", "LOW"), (None, "LOW")])]
    df = findings(spark, [{**r, "file": "f"} for r in records])
    assert [r.cwe for r in algebra.top_weaknesses(df).collect()] == ["C1", "C2", "C3"]
    assert algebra.summary(df).first()[0] == "5 findings (HIGH 1, LOW 4). Most common: C1 x2, C2 x1, C3 x1."
    assert algebra.summary(df.where("false")).first()[0] == "No findings provided."


def test_min_severity(spark):
    df = findings(spark, [plain(i, severity=s) for i, s in enumerate(["INFO", "low", "HIGH", None])])
    assert algebra.at_least(df, "medium").count() == 1
    assert algebra.at_least(df, "nonsense").count() == 2


def test_fingerprint_ignores_the_line_only(spark):
    one = plain(1, rule_id="R", file="/r/a/x.py", cwe="C", title="T", evidence=" a  b\t", line=1)
    df = findings(spark, [one, {**one, "line": 9}, {**one, "evidence": "a b"}, {**one, "evidence": "a c"}, {**one, "file": "/other/x.py"}])
    got = [r.fingerprint for r in baseline.with_fingerprint(df, "/r").collect()]
    assert got[0] == got[1] == got[2] and len(set(got)) == 3 and all(len(g) == 16 for g in got)


def test_baseline_round_trip(spark, tmp_path):
    df = findings(spark, [plain(i, title=f"t{i}") for i in range(20)])
    path = str(tmp_path / "base")
    baseline.save(df.where("seq < 15"), "/r", path)
    known = baseline.load(spark, path)
    assert known.count() == 15
    assert sorted(r.seq for r in baseline.gate(df, known, "/r").collect()) == [15, 16, 17, 18, 19]
    assert baseline.suppressed(df, known, "/r").first()[0] == 15
    assert baseline.flagged(df, known, "/r").where("is_known").count() == 15
    assert baseline.load(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "one.json").write_text(json.dumps({"version": 1, "fingerprints": ["a", "b", "a"]}, indent=2))
    assert rows(baseline.load(spark, str(tmp_path / "one.json")), "fingerprint") == [("a",), ("b",)]
    (tmp_path / "bad.json").write_text("{nope")
    assert baseline.load(spark, str(tmp_path / "bad.json")).count() == 0


def test_sarif(spark, tmp_path):
    df = findings(spark, [plain(i, rule_id=f"R{i % 7}", cwe="CWE-1", file="f", line=0, message="m") for i in range(300)])
    assert len(json.loads(report.sarif(df, 300).first()[0])["runs"][0]["results"]) == 300
    report.write_sarif(df, str(tmp_path / "sarif"))
    files = sorted(p for p in (tmp_path / "sarif").rglob("part-*"))
    assert json.loads("".join(p.read_text() for p in files)) == json.loads(report.sarif(df, 300).first()[0])
    doc = json.loads(report.sarif(df, report.SARIF_LIMIT).first()[0])
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["results"]) == 200
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert rules == [f"R{i}" for i in range(7)]
    for r in run["results"]:
        assert rules[r["ruleIndex"]] == r["ruleId"]
        assert r["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert run["tool"]["driver"]["rules"][0]["properties"]["tags"] == ["security", "external/cwe/cwe-1"]
    empty = json.loads(report.sarif(df.where("false"), 5).first()[0])
    assert empty["runs"][0]["results"] == []


def test_places_by_two_level_prefix_sums(spark):
    df = spark.range(1000).selectExpr("id", "pmod(id * 37, 250) AS o").repartition(7)
    for buckets in (1, 3, 64):
        got = algebra.numbered(df, F.col("o"), "place", buckets).collect()
        assert sorted(r["place"] for r in got) == list(range(1000))
        assert [r["o"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r["o"] for r in got)
    assert algebra.numbered(df.where("false"), F.col("o"), "place").count() == 0


def test_json_report(spark, tmp_path):
    df = findings(spark, [plain(i, severity="HIGH") for i in range(5)])
    report.write_json(df, "t", str(tmp_path / "r"))
    head = spark.read.json(str(tmp_path / "r" / "header")).first()
    assert (head.total, head.risk_score, head.high) == (5, 75, 5)
    assert spark.read.json(str(tmp_path / "r" / "findings")).count() == 5


def test_explanations(spark):
    df = findings(spark, [plain(3, cwe="cwe-89", title="T", file="f"), plain(4, cwe="CWE-1", title="T", message="M", file=None)])
    got = [r.explanation for r in knowledge.explain(df).orderBy("seq").collect()]
    assert "at        f:3" in got[0] and "bind parameters" in got[0] and "cwe-89" in got[0]
    assert "Location" not in got[1] and "  M" in got[1]
    assert [r.advice for r in knowledge.fix_advice(df).orderBy("seq").collect()][1].endswith("for this class.")


AUTHS = [
    ("A", ["/srv/app*", "x?y"], "2999-01-01"), ("B", ["/srv/*"], "2000-01-01"), ("C", ["[ab]-*", "host"], "not a date"),
    ("D", ["/srv/app/core"], "2999-01-01"), ("E", ["*"], "2000-01-01"), ("F", ["[", "a*b*"], "2999-01-01"), ("G", ["[!q]z"], "2999-12-31"),
]


def authorizations(spark, auths):
    texts = [(i, json.dumps({"authorizations": [dict(organization=o, scope=s, authorized_by="x", permission_ref="r", expires=e)]})) for i, (o, s, e) in enumerate(auths)]
    return governance.load_authorizations(spark.createDataFrame(texts or [(0, "{}")], "i int, j string"), "j", "i")


def test_decisions_equal_brute_force(spark):
    targets = ["/srv/app/core/x", "/srv/other", "xzy", "x?y", "a-1", "hostile", "elsewhere", "[", "[x", "aXbY", "a*b*c", "kz", "qz", "/srv/app.new"]
    today = dt.date.today()

    def valid(e):
        try:
            return dt.date.fromisoformat(e) >= today
        except ValueError:
            return False

    def decide(t):
        cover = [(o, e) for o, s, e in AUTHS if any(fnmatch.fnmatchcase(t, p) or t.startswith(p.rstrip("*")) for p in s)]
        granted = [o for o, e in cover if valid(e)]
        if granted:
            return ("AUTHORIZED", granted[0])
        return ("DENIED", "authorization expired" if cover else "out of scope")

    df = spark.createDataFrame([(t,) for t in targets], "target string")
    got = {r.target: (r.status, r.organization or r.detail) for r in governance.decide(df, authorizations(spark, AUTHS)).collect()}
    assert got == {t: decide(t) for t in targets}
    none = governance.decide(df, authorizations(spark, [])).select("detail").distinct().collect()
    assert [r[0] for r in none] == ["no authorization file"]


def test_wildcard_scopes_equal_brute_force(spark):
    """Heads, tails, grams, classes, open brackets, literal stars and text-free globs."""
    draw = random.Random(8)
    alphabet = ["a", "b", "/", ".", "*", "?", "[ab]", "[!a]", "[", "]", "[]a]", "core", "example", "ä", "**", "x1"]
    scopes = ["".join(draw.choices(alphabet, k=draw.randrange(0, 7))) for _ in range(150)] + ["*", "", "?*", "[ab]*", "*xample"]
    words = ["a", "b", "/", ".", "[", "]", "*", "core", "example", "ä", "x1", "x"]
    targets = ["".join(draw.choices(words, k=draw.randrange(0, 7))) for _ in range(400)]
    for chosen in (scopes, scopes[:40], scopes[-2:], scopes[-3:-1]):
        auths = [(f"o{i:03}", [p], "2999-01-01" if i % 3 else "2000-01-01") for i, p in enumerate(chosen)]
        df = spark.createDataFrame([(t,) for t in targets], "target string")
        got = {r.target: (r.organization, r.detail) for r in governance.decide(df, authorizations(spark, auths)).collect()}
        for t in targets:
            cover = [(o, e) for o, (p,), e in auths if fnmatch.fnmatchcase(t, p) or t.startswith(p.rstrip("*"))]
            granted = [o for o, e in cover if e > "2001"]
            want = (granted[0], "scope match") if granted else (None, "authorization expired" if cover else "out of scope")
            assert got[t] == want, t


def test_every_request_has_its_row(spark, tmp_path):
    asked = [(1, "/srv/app", "scan"), (2, "/srv/app", "scan"), (3, "/srv/app", "scan"), (4, "/srv/app", " Wipe "), (5, None, "scan"), (6, "no", None)]
    df = spark.createDataFrame(asked, "id long, target string, wanted string")
    decided = governance.decide_requests(df, authorizations(spark, AUTHS[:1]), "wanted")
    want = [(1, "AUTHORIZED"), (2, "AUTHORIZED"), (3, "AUTHORIZED"), (4, "REFUSED"), (5, "DENIED"), (6, "DENIED")]
    assert rows(decided, "id", "status") == want
    assert rows(decided.where("id IN (4, 5)"), "detail", "organization") == [("forbidden action", None), ("no target", None)]
    for run in ("r1", "r1", "r2"):
        governance.append_audit(decided, str(tmp_path / "log"), run, ("id",))
    log = spark.read.json(str(tmp_path / "log"))
    assert rows(log, "run", "id") == [(run, i) for run in ("r1", "r2") for i in range(1, 7)]


def test_sarif_results_are_numbered_without_a_sort(spark):
    df = findings(spark, [plain(i, rule_id=f"R{i % 3}") for i in range(9)])
    plan = report.sarif_results(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan and "filter(scalar-subquery" not in plan
    some = spark.createDataFrame([([0, 2, 2, 5], i) for i in [-1, 0, 1, 2, 4, 5, 9, None]] + [([], 1), (None, 1)], "v array<int>, o int")
    got = [r[0] for r in some.select(algebra._not_above("v", F.col("o"), 4)).collect()]
    assert got == [0, 1, 1, 3, 3, 4, 4, 0, 0, 0]


def test_globs_meet_few_targets_through_a_short_piece(spark, monkeypatch):
    """Globs that differ in a short piece alone are not paired with every target that has the long one."""
    targets = spark.range(2000).selectExpr("concat('h', id % 9, '.example.com/view/x', id % 400) AS target")
    patterns = spark.range(300).selectExpr("concat('h?*.example.com/[pv]*/x', id, '?') AS pattern", "id AS grant")
    pairs, match = [], scopes.glob_matches
    monkeypatch.setattr(scopes, "glob_matches", lambda df: pairs.append(df) or match(df))
    got = dict(rows(scopes.matched(targets, patterns), "target", "grant"))
    names = {r.target for r in targets.collect()}
    want = {t: int(t.rsplit("x", 1)[1][:-1]) for t in names if len(t.rsplit("x", 1)[1]) > 1}
    assert got == want
    assert pairs[0].count() < 20 * len(names)


def test_decisions_are_joined_without_broadcasts(spark):
    """Small files may hold many scopes and requests; none of them goes through the driver whole."""
    df = spark.range(9).selectExpr("id", "concat('/srv/', id) AS target")
    auths = spark.range(9).selectExpr(
        "'o' AS organization", "array(concat('*v/', id), concat('/s', id)) AS scope", "'a' AS authorized_by",
        "'p' AS permission_ref", "'2999-01-01' AS expires", "id AS auth_seq",
    )
    plan = governance.decide_requests(df, auths)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_incomplete_authorizations_drop(spark):
    text = json.dumps({"authorizations": [{"organization": "a"}, dict(organization="b", scope=["*"], authorized_by="x", permission_ref="r", expires="2999-01-01")]})
    df = spark.createDataFrame([(0, text), (1, "[]"), (2, "{bad")], "i int, j string")
    assert rows(governance.load_authorizations(df, "j", "i"), "organization") == [("b",)]


def test_audit_appends(spark, tmp_path):
    df = spark.createDataFrame([("/srv/app",), ("no",)], "target string")
    decided = governance.decide(df, authorizations(spark, AUTHS[:1]))
    for _ in range(2):
        governance.append_audit(decided, str(tmp_path / "log"))
    assert rows(spark.read.json(str(tmp_path / "log")), "action", "target") == [("AUTHORIZED", "/srv/app")] * 2 + [("DENIED", "no")] * 2


def test_assessment(spark):
    decided = governance.decide(spark.createDataFrame([("/srv/app",), ("no",)], "target string"), authorizations(spark, AUTHS[:1]))
    f = findings(spark, [plain(1, cwe="cwe-78"), plain(0, cwe="CWE-999")]).withColumn("target", F.explode(F.array(F.lit("/srv/app"), F.lit("no"))))
    got = rows(governance.assess(f, decided), "target", "cwe", "statically_reachable", "non_destructive")
    assert got == [("/srv/app", "CWE-78", True, True), ("/srv/app", "CWE-999", False, True)]
    asked = f.withColumn("action", F.lit(" DDoS "))
    assert governance.assess(asked, decided, F.col("action")).count() == 0


def test_scorecard(spark):
    cases = [("p1", "a", "vulnerable", "C1", True), ("p2", "a", "secure", "C1", True), ("p3", "b", "vulnerable", "C2", False), ("p4", "b", "secure", "C2", False)]
    df = spark.createDataFrame(cases, "path string, case_id string, side string, cwe string, modelled boolean")
    hits = findings(spark, [plain(1, file="p1", cwe="C1"), plain(2, file="p4", cwe="C9")])
    scored = scorecard.score_cases(df, hits)
    got = {r.scope: r for r in scorecard.scorecard(scored).collect()}
    assert (got["modelled"].tp, got["modelled"].fp, got["modelled"].recall, got["modelled"].passed) == (1, 0, 1.0, True)
    assert (got["overall"].recall, got["overall"].fpr, got["overall"].precision, got["overall"].passed) == (0.5, 0.5, 0.5, False)
    assert rows(scorecard.missed_cases(scored), "case_id") == [("b",)]
    assert rows(scorecard.false_positives(scored), "case_id", "rule_id") == [("b", "R")]


def test_rule_table(spark):
    rules = catalog.rules(spark)
    assert rules.count() == rules.select("rule_id").distinct().count() == 103
    assert catalog.rules_for_language(rules, "python").count() == 17
    assert catalog.rules_for_language(rules, "cobol").count() == 58
    assert rules.where("language IS NOT NULL").select("cwe").distinct().count() == 13
    assert catalog.advisories(spark).count() == 73
    assert catalog.advisories(spark).select("name").distinct().count() == 53


def test_version_keys(spark):
    pairs = [("1.2", "1.10", True), ("1.2.0", "1.2", False), ("2.0", "1.9.9", False), ("v1.0", "1.0.1", True), ("1.0-rc1", "1.0", True), ("1.0", "1.0-rc1", False), ("0", "0.0.1", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where((T.version_key(F.col("a")) < T.version_key(F.col("b"))) != F.col("want")).count() == 0


def test_rows_of_other_engines_are_all_kept(spark):
    row = "'%s' AS engine, 0 AS engine_rank, 0 AS pack_rank, 'f.py' AS file, 3 AS line, 'R' AS rule_id, 'CWE-1' AS cwe, 't' AS title, %d AS seq"
    rows = [spark.sql("SELECT " + row % (engine, 1)) for engine in ["iac"] * 4 + ["sast"] * 3 + ["secrets"] * 2]
    kept = algebra.dedup_sast(schema.conform(algebra.union_all(rows)))
    assert {r["engine"]: r["count"] for r in kept.groupBy("engine").count().collect()} == {
        "iac": 4, "sast": 1, "secrets": 2,
    }


def test_limits_apply_only_when_given(spark):
    found = spark.range(300).selectExpr("id AS seq", "'HIGH' AS severity", "concat('CWE-', id % 9) AS cwe")
    assert algebra.limit_in_order(found).count() == 300
    assert algebra.limit_in_order(found, 7).count() == 7
    assert algebra.top_weaknesses(found).count() == 9
    assert algebra.top_weaknesses(found, 5).count() == 5


def test_versions_of_any_length_and_pre_releases(spark):
    pairs = [("1.2.0-rc1", "1.2.0"), ("1.2", "1.10"), ("9" * 30, "1" + "0" * 30), ("1.0-a", "1.0-b"), ("1.1.9", "1.2.0-rc1")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(T.version_key(F.col("a")) < T.version_key(F.col("b"))).count() == len(pairs)
    order = ["1.2.0-alpha", "1.2.0-alpha.1", "1.2.0-alpha.beta", "1.2.0-beta", "1.2.0-beta.2", "1.2.0-beta.11", "1.2.0-rc.9",
             "1.2.0-rc.10", "1.2.0-rc." + "9" * 30, "1.2.0", "1.2.1-0"]
    rising = spark.createDataFrame([(a, b) for i, a in enumerate(order) for b in order[i + 1 :]], "a string, b string")
    key = T.version_key
    assert rising.where((key(F.col("a")) < key(F.col("b"))) & ~(key(F.col("b")) < key(F.col("a")))).count() == 55
    same = spark.createDataFrame([("1.2", "v1.2.0"), ("1.2+x", "1.2.0+y"), ("01.2", "1.2")], "a string, b string")
    assert same.where(T.version_key(F.col("a")) == T.version_key(F.col("b"))).count() == 3
