"""File trees, manifests, external result files, full scans, streams, queries."""

import json
import os
import re

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import TABLES, canonical
from ravelin.operators import baseline, dependencies
from ravelin.plans import scan
from ravelin.plans.queries import QUERIES
from ravelin.sources import external, files as S, manifests
from ravelin.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def write(root, texts):
    for name, text in texts.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_tree_scan(spark, tmp_path):
    root = str(tmp_path / "build" / "project")  # the parent folder must not count
    write(root, {
        "app.py": "import hashlib\nhashlib.md5(x)\nDES.new(k)\n",
        "web/a.js": b"eval(x)\xff;\n",
        "node_modules/b.js": "eval(x);\n",
        "Requirements.txt": "flask==1.0\nnothing\n",
        "infra/main.tf": 'resource "aws_s3_bucket" "b" {}\n',
        "c/t.sol": "pragma solidity ^0.5.0;\n",
        "x.env": "token = 'Zx81kQ0pLm29VbTr5-Yw'\n",
        "bin.dat": bytes(range(256)),
    })
    found = scan.scan_tree(spark, root)
    assert rows(found.withColumn("rel", S.relative(F.col("file"), root)), "rel", "line", "rule_id", "engine") == [
        ("Requirements.txt", 0, "CVE-2018-1000656", "sca"), ("Requirements.txt", 0, "CVE-2023-30861", "sca"),
        ("app.py", 2, "P001", "sast"), ("app.py", 3, "P002", "sast"),
        ("c/t.sol", 0, "SC-SOL-002", "web3"), ("infra/main.tf", 0, "IAC-TF-001", "iac"),
        ("web/a.js", 1, "J001", "sast"), ("x.env", 1, "ENT-SECRET", "secrets"),
    ]
    evidence = found.where("rule_id = 'J001'").first().evidence
    assert evidence == "eval(x);"  # the bad byte is dropped
    assert rows(scan.scan_tree(spark, root, engines=["iac", "web3"], web3_cap=3), "engine") == [("iac",), ("web3",)]
    small = S.read_tree(spark, root, glob="*.{py,js}", max_bytes=20)
    assert rows(small, "rel") == [("node_modules/b.js",), ("web/a.js",)]


REQUIREMENTS = "# c\nDjango==4.1\n  flask >= 2.0 , <3\nx[a,b]~=1 ; y\n-e .\ngit+ssh://z\na.b-c\n===\npkg===1.0\n"


def test_manifests(spark, files):
    texts = {
        "p/requirements-dev.txt": REQUIREMENTS,
        "p/package.json": json.dumps({"dependencies": {"A": "^1.0", "b": "* "}, "peerDependencies": {"c": ">=2 <3"}, "optionalDependencies": {"d": "=4"}}),
        "q/package.json": "[1]", "r/package.json": "{broken",
        "p/go.mod": "module m\n\nrequire (\n\ta.b/C v1.2.3\n  d/e/v2 v0.1-x // i\n)\nrequire f v9\n",
        "p/Cargo.toml": 'A = "1.0"\nb = { version = "2.1", x = 1 }\nc = { path = "x" }\nd = "^3"\n',
        "p/Gemfile": "gem 'Rails', '~> 6.1'\ngem \"puma\"\n",
        "p/Pipfile": 'a = "==1"\nb = "*"\nc = *\n',
        "node_modules/x/requirements.txt": "z==1\n", "venv/requirements.txt": "w==1\n",
    }
    df = files(texts)
    eco = rows(manifests.ecosystem_dependencies(df), "ecosystem", "name", "version")
    assert eco == sorted([
        ("PyPI", "django", "4.1"), ("PyPI", "flask", "2.0"), ("PyPI", "x", "1"), ("PyPI", "a.b-c", ""), ("PyPI", "pkg", "1.0"),
        ("npm", "a", "1.0"), ("npm", "b", ""), ("npm", "c", "2 <3"),
        ("Go", "a.b/C", "1.2.3"), ("Go", "d/e/v2", "0.1-x"),
        ("crates.io", "a", "1.0"), ("crates.io", "b", "2.1"), ("RubyGems", "rails", "6.1"), ("RubyGems", "puma", ""),
    ])
    static = rows(manifests.static_dependencies(df).where("file not like '%requirements%'"), "file", "name", "version")
    assert static == _static_expected(texts)


def _static_expected(texts):
    """The static reading with plain Python."""
    out = []
    for section in manifests.STATIC_SECTIONS:
        for k, v in json.loads(texts["p/package.json"]).get(section, {}).items():
            out.append(("p/package.json", k.lower(), v.lstrip("^~>=<")))
    for m in re.finditer(manifests.GO_MODULE_STATIC, texts["p/go.mod"], re.M):
        out.append(("p/go.mod", m.group(1).split("/")[-1].lower(), m.group(2)))
    for m in re.finditer(manifests.CARGO_STATIC, texts["p/Cargo.toml"], re.M):
        out.append(("p/Cargo.toml", m.group(1).lower(), m.group(2)))
    for m in re.finditer(manifests.PIPFILE, texts["p/Pipfile"], re.M):
        out.append(("p/Pipfile", m.group(1).lower(), m.group(2).lstrip("^~>= ")))
    return sorted(out)


def osv_frame(spark, records):
    texts = [(json.dumps(r),) for r in records] + [("[]",), ("{oops",)]
    return external.osv_advisories(spark.createDataFrame(texts, "j string"), "j").where("id <> 'OSV-UNKNOWN'")


def advisory(i, name, events, **more):
    return {"id": i, "affected": [{"package": {"name": name, "ecosystem": "npm"}, "ranges": [{"events": events}]}], **more}


def test_osv(spark):
    osv = osv_frame(spark, [
        advisory("O1", "Left", [{"introduced": "0"}, {"fixed": "1.2"}], aliases=["X", "CVE-1"], summary="s", severity=[{"type": "CVSS_V3", "score": "9.8"}]),
        advisory("O2", "left", [{"introduced": "1.10"}], details="d" * 300, database_specific={"severity": "low"}),
        advisory("O3", "left", [{"introduced": "1.0"}, {"fixed": "1.1"}, {"introduced": "1.5"}, {"fixed": "1.6"}], severity=[{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}]),
        advisory("O4", "left", [{"introduced": "0"}], database_specific={"severity": "odd"}, references=[{"url": str(i)} for i in range(5)]),
    ])
    assert rows(osv, "id", "cve", "severity") == [("O1", "CVE-1", "CRITICAL"), ("O2", "O2", "LOW"), ("O3", "O3", "LOW"), ("O4", "O4", "MEDIUM")]
    assert {r.id: len(r.summary) for r in osv.collect()} == {"O1": 1, "O2": 300, "O3": 0, "O4": 0}
    deps = spark.createDataFrame(
        [("a", "left", "1.1.9", "npm", 0), ("b", "left", "1.1.9", "npm", 0), ("a", "left", "1.10.1", "npm", 0), ("a", "left", "1.5.3", "npm", 0), ("a", "left", "", "npm", 0), ("a", "left", "1.0.5", "PyPI", 0)],
        "file string, name string, version string, ecosystem string, pos int",
    )
    got = rows(dependencies.osv_findings(deps, osv), "installed_version", "cve", "file", "fixed_in")
    assert got == [
        ("", "CVE-1", "a", "1.2"), ("", "O2", "a", "latest"), ("", "O3", "a", "1.1"), ("", "O4", "a", "latest"),
        ("1.1.9", "CVE-1", "b", "1.2"), ("1.1.9", "O4", "b", "latest"),
        ("1.10.1", "O2", "a", "latest"), ("1.10.1", "O4", "a", "latest"),
        ("1.5.3", "O3", "a", "1.1"), ("1.5.3", "O4", "a", "latest"),
    ]


def test_sca_falls_back(spark, files):
    df = files({"requirements.txt": "flask==1.0\nleft==1.0\n"})
    osv = osv_frame(spark, [{**advisory("O1", "left", [{"introduced": "0"}]), "affected": [{"package": {"name": "left", "ecosystem": "PyPI"}, "ranges": [{"events": [{"introduced": "0"}]}]}]}])
    assert rows(scan.sca_findings(df, osv), "rule_id", "source") == [("O1", "osv_scanner")]
    assert rows(scan.sca_findings(df, osv.where("false")), "source") == [("dependency_scanner",)] * 2


def test_external_formats(spark, tmp_path):
    write(str(tmp_path), {
        "a.json": json.dumps({"results": {"detectors": [
            {"check": "c", "impact": "High", "description": " first\nsecond", "elements": [{"source_mapping": {}}, {"source_mapping": {"filename_short": "x.sol", "lines": [7, 8]}}]},
            {"check": "d", "impact": "Odd", "elements": []}]}}),
        "bad.json": "not json", "list.json": "[1, 2]",
    })
    texts = external.read_json_texts(spark, str(tmp_path)).withColumn("o", F.lit(0))
    got = rows(external.slither_findings(texts, "json", "o", "root"), "rule_id", "severity", "title", "file", "line")
    assert got == [("slither:c", "HIGH", "first", "x.sol", 7), ("slither:d", "INFO", "d", "root", 0)]
    sem = {"results": [
        {"check_id": "a.b", "path": "p.py", "start": {"line": 3, "col": 2}, "extra": {"message": "m", "severity": "ERROR", "lines": " x ", "metadata": {"cwe": ["CWE-79: x"], "owasp": ["A1"], "references": ["r1", "r2"]}}},
        {"check_id": "a.b", "path": "p.py", "start": {"line": 3}, "extra": {"message": "again"}},
        {"check_id": "c", "path": "p.py", "extra": {"metadata": {"cwe": "cwe-22", "fix": "do"}}}]}
    df = spark.createDataFrame([(0, json.dumps(sem))], "o int, json string")
    found = external.semgrep_findings(df, "json", "o")
    assert rows(found, "rule_id", "severity", "cwe", "line", "recommendation", "message") == [
        ("a.b", "HIGH", "CWE-79", 3, "r1", "m"), ("c", "MEDIUM", "CWE-22", 1, "do", "c")]
    cargo = {"vulnerabilities": {"list": [{"advisory": {"id": "R1", "cvss": 7.5, "title": "t"}, "package": {"name": "n", "version": "1"}}, {"advisory": {"id": "R2", "aliases": ["A", "B"]}}]}}
    df = spark.createDataFrame([(0, json.dumps(cargo)), (1, "{}")], "o int, json string")
    assert rows(external.cargo_audit_findings(df, "json", "o"), "rule_id", "severity", "title", "cve") == [
        ("R1", "HIGH", "n 1: t", "R1"), ("R2", "HIGH", "crate : advisory", "A, B")]
    scores = spark.createDataFrame([("9.8",), ("7.5",), ("5.0",), ("2.0",), (None,), ("x",)], "s string")
    assert [r[0] for r in scores.select(external.cvss_bucket(F.col("s"), "HIGH")).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "HIGH", "HIGH"]


def test_stream_of_files(spark, tmp_path):
    root, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    write(root, {"a.js": "eval(x);\n", "b.js": "eval(known);\n"})
    known = baseline.with_fingerprint(scan.detect(S.read_tree(spark, root, glob="b.js"), ["lines"]), root).select("fingerprint")
    known.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))

    def run():
        arrivals = incremental.read_arrivals(spark, root, "*.js")
        incremental.run_once(incremental.new_findings(arrivals, known, root, ["lines"]), out, mark)
        return rows(spark.read.parquet(out), "evidence")

    assert run() == [("eval(x);",)]
    write(root, {"c.js": "eval(y);\n", "sub/a.js": "eval(x);\n"})
    assert run() == [("eval(x);",), ("eval(x);",), ("eval(y);",)]
    assert run() == [("eval(x);",), ("eval(x);",), ("eval(y);",)]
    # The same file with a later change: its old finding is not new, however much later.
    os.utime(os.path.join(root, "a.js"), (4e9, 4e9))
    write(root, {"d.js": "eval(z);\n"})
    assert run() == [("eval(x);",), ("eval(x);",), ("eval(y);",), ("eval(z);",)]


@pytest.mark.parametrize("folder", [False, True])
def test_streams_read_a_table_of_one_file_or_of_many(spark, tmp_path, folder):
    def table(name, records, schema_):
        df = spark.createDataFrame(records, schema_)
        if folder:
            df.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            df.toPandas().to_parquet(tmp_path / f"{name}.parquet")

    table("pages", [(i, f"http://a.example.com/en/{i}") for i in range(9)], "page_id long, url string")
    table("supplier", [(6, "S", 1)], "s_suppkey long, s_name string, s_nationkey int")
    got = rows(entry.queries()["t02_stream_decisions"](spark, str(tmp_path)), "page_id", "action", "organization")
    assert got == [(i, "AUTHORIZED", "S") for i in range(9)]
    secret = "padding\napi_key = '%s'"
    word = "Zx9QmT4vLr7KpW2sYd8NbH5cJf3GaE6uX%dRkVoPqIlSwBt"
    table("documents", [(i, secret % (word % i)) for i in range(6)] + [(9, "one\n" + secret % (word % 9))], "doc_id long, text string")
    got = rows(entry.queries()["t01_stream_new_findings"](spark, str(tmp_path)), "file")
    assert got == [("doc/9.txt",)]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 9


EXPENSIVE = {"t01_stream_new_findings", "t02_stream_decisions", "d27_scan_with_semgrep"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", [n for i, n in enumerate(entry.queries()) if i % 4 == 0 and n in entry.oracle_sql() and n not in EXPENSIVE])
def test_queries_match_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    rel = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, rel.fetchall())


def test_every_query_has_an_oracle_or_reads_files():
    assert set(QUERIES) - set(entry.oracle_sql()) == {"s01_file_tree"}


def test_scan_reads_only_what_its_packs_look_at_and_tells_the_rest(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(root, {"a.JS": "eval(x);\n", "b.txt": "eval(x);", "big.js": "eval(y);" + " " * 300, "k.sol": "selfdestruct(a);"})
    glob = scan.tree_glob(["lines"])
    assert {r[0] for r in rows(S.list_tree(spark, root, glob), "rel")} == {"a.JS", "big.js"}
    assert scan.tree_glob(["lines", "secrets"]) is None
    assert rows(S.read_tree(spark, root, glob, max_bytes=100), "rel") == [("a.JS",)]
    assert [(r[0][-6:], *r[1:]) for r in rows(S.unread(spark, root, glob, 100), "path", "engine", "reason")] == [("big.js", "all", "oversize")]
    found = scan.scan_tree(spark, root, engines=["sast", "web3"], web3_cap=1)
    assert sorted({r[0] for r in rows(found, "engine")}) == ["sast", "web3"]
    assert found.where("engine = 'sast'").count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1
