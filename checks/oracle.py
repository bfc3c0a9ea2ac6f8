"""DuckDB statements that compute what the named queries compute.

They share the fixed values (patterns, word lists, rule table) with the library
and nothing else: relations here are plain SQL over the driver tables.
"""

from ravelin import catalog, schema
from ravelin.functions import entropy as E
from ravelin.functions import text as T
from ravelin.operators import contracts as C
from ravelin.operators import evasion as V
from ravelin.operators import governance as G
from ravelin.operators import iac as I
from ravelin.operators import linepass
from ravelin.operators import linerules as L
from ravelin.operators import secrets as S
from ravelin.plans import derived as D
from ravelin.plans.seeded import snippets
from ravelin.sources import files as FS
from ravelin.sources import manifests as M

ORACLE = {}


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def ql(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values(rows, columns) -> str:
    body = ",\n".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


def case_map(expr, table, default="NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def pick(items, index) -> str:
    return f"list_extract({ql(items)}, CAST(({index}) + 1 AS BIGINT))"


def has_any(path, names) -> str:
    return f"list_has_any(string_split({path}, '/'), {ql(names)})"


def contains_any(text, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def m(text, pattern) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


WS = q(T.WHITESPACE)


def lines_of(text) -> str:
    return f"string_split_regex({text}, {q(T.LINE_END)})"


def strip(text) -> str:
    return f"trim({text}, {WS})"


# --- relations ---------------------------------------------------------------

SNIPPETS = values(snippets(), "sid, name, attach, snippet, case_id, side, cwe, language, modelled")
N = len(snippets())
RELATIONS = {
    "seeded": f"""
SELECT doc_id, 'src/' || doc_id || '/' || name AS path, list_extract(string_split(name, '/'), -1) AS base,
  CASE WHEN regexp_matches(list_extract(string_split(name, '/'), -1), '.\\.[^.]+$') THEN regexp_extract(name, '(\\.[^./]+)$', 1) ELSE '' END AS ext,
  CASE attach WHEN 'json' THEN replace(snippet, '%s', CAST(to_json([text]) AS VARCHAR))
    WHEN 'hash' THEN snippet || chr(10) || '# ' || regexp_replace(text, {q(T.LINE_END)}, chr(10) || '# ', 'g')
    ELSE snippet || chr(10) || text END AS content,
  name, snippet, case_id, side, cwe, language, modelled
FROM documents JOIN {SNIPPETS} s ON doc_id % {N} = sid""",
    "split": f"SELECT path, base, ext, {lines_of('content')} AS parts FROM seeded",
    "arrays": "SELECT path, base, ext, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS ls FROM split",
    "lines": "SELECT path, base, ext, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM arrays",
    "rules": "SELECT * FROM " + values(
        [(r[0], r[1], r[2], r[3], r[5], r[8], r[11], r[9], r[10]) for r in catalog.rule_rows()],
        "rule_id, cwe, severity, title, chain, engine, source, engine_rank, pack_rank",
    ),
    "event_findings": f"""
SELECT {pick(schema.ENGINES, 'event_id % 5')} AS engine, event_id % 5 AS engine_rank, event_id % 3 AS pack_rank,
  event_id AS seq, {pick(['SC-TON-', 'SC-SOL-', 'EV-'], 'event_id % 3')} || event_type AS rule_id,
  CASE WHEN value < 20 THEN 'LOW' WHEN value < 60 THEN 'MEDIUM' WHEN value < 120 THEN 'HIGH' WHEN value < 200 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  'Saw ' || event_type AS title, 'events' AS source,
  CASE WHEN user_id % 11 > 0 THEN 'cwe-' || {pick(['89', '78', '79', '327', '22', '1'], 'user_id % 6')} END AS cwe,
  CASE WHEN event_id % 3 = 2 THEN {pick(['SOLANA', 'COSMWASM'], 'user_id % 2')} END AS chain,
  'src/u' || user_id || '.py' AS file, event_id % 50 AS line, '  ' || props || ' ' || chr(9) || ' x  ' AS evidence
FROM events""",
    "prints": """
SELECT *, left(sha1(concat_ws('|', rule_id, replace(file, 'src/', ''), coalesce(cwe, ''), title,
  trim(regexp_replace(evidence, '\\s+', ' ', 'g')))), 16) AS fingerprint FROM event_findings""",
    "weights": "SELECT *, " + case_map("severity", schema.RISK_WEIGHT, "0") + " AS weight FROM event_findings",
    "parts_osv": f"""
SELECT p_partkey AS k, 'pkg-' || p_partkey AS name, {pick(D.ECOSYSTEMS, 'p_partkey % 4')} AS ecosystem,
  'GHSA-' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'CVE-' || p_partkey ELSE 'GHSA-' || p_partkey END AS cve,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'about ' || p_name END AS summary,
  (p_partkey % 5) || '.' || (p_partkey % 3) AS introduced,
  CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 5 + 2) || '.0.' || (p_partkey % 2) END AS fixed,
  CASE WHEN p_partkey % 4 > 0 AND p_partkey % 5 > 0 THEN
      CASE WHEN (p_partkey % 101) >= 90 THEN 'CRITICAL' WHEN (p_partkey % 101) >= 70 THEN 'HIGH' WHEN (p_partkey % 101) >= 40 THEN 'MEDIUM' ELSE 'LOW' END END AS scored,
  {pick(['HIGH', 'LOW', 'MEDIUM'], 'p_partkey % 3')} AS named
FROM part""",
    "osv": "SELECT *, CASE WHEN scored IS NOT NULL THEN scored WHEN k % 4 > 0 THEN 'LOW' ELSE named END AS severity FROM parts_osv",
    "deps": f"""
SELECT 'm' || lpad(CAST(l_orderkey % 100 AS VARCHAR), 2, '0') || '/requirements.txt' AS file, 'pkg-' || l_partkey AS name,
  (CAST(floor(l_quantity) AS BIGINT) % 8) || '.' || l_linenumber || CASE WHEN l_linenumber = 1 THEN '.0' ELSE '' END AS version,
  {pick(D.ECOSYSTEMS, 'l_partkey % 4')} AS ecosystem, l_linenumber AS pos, l_orderkey, l_linenumber FROM lineitem""",
    "auths": f"""
SELECT s_suppkey AS k, s_name AS organization, s_suppkey % 6 AS p, 'nation ' || s_nationkey AS authorized_by, 'ref-' || s_suppkey AS permission_ref,
  CASE WHEN s_suppkey % 4 = 0 THEN '2020-01-01' WHEN s_suppkey % 9 = 0 THEN 'bad' WHEN s_suppkey % 6 = 3 THEN '2021-01-01' ELSE '2999-12-31' END AS expires
FROM supplier WHERE s_suppkey % 10 <> 3""",
    "auths_fp": "SELECT *, left(sha256(organization || '|' || authorized_by || '|' || permission_ref || '|' || expires), 16) AS fingerprint FROM auths",
    "scopes": "SELECT * FROM " + values(
        [
            (0, r"^http://.*\.example\.com/en/.*$|^http://$"), (1, r"^https://m\."), (2, r"^http://blog\."),
            (3, r"^https://spam-farm\.example\.org/"), (4, r"^.*://.*/de/..*$"), (5, r"^https://blog\.tion"),
        ],
        "p, rx",
    ),
    "decided": """
SELECT url AS target, min(k) FILTER (WHERE expires = '2999-12-31') AS granted, count(k) AS covered
FROM (SELECT DISTINCT url FROM pages) t
LEFT JOIN (SELECT * FROM auths_fp JOIN scopes USING (p)) a ON regexp_matches(url, rx) OR (p = 0 AND starts_with(url, 'http://*.example.com/en/'))
GROUP BY url""",
    "decisions": """
SELECT target, CASE WHEN granted IS NULL THEN 'DENIED' ELSE 'AUTHORIZED' END AS status,
  CASE WHEN granted IS NOT NULL THEN 'scope match' WHEN covered > 0 THEN 'authorization expired' ELSE 'out of scope' END AS detail,
  fingerprint AS authorization, organization
FROM decided LEFT JOIN auths_fp ON granted = k""",
    "requests": f"""
SELECT event_id, 'h' || (user_id % 97) || '.example.com/' || event_type || '/x' || (event_id % 400) AS target,
  event_id % 5 = 0 AS forbidden FROM events""",
    "wild_scopes": f"""
SELECT s_suppkey AS k, s_name AS organization, left(sha256(s_name || '|nation ' || s_nationkey || '|ref-' || s_suppkey || '|' ||
    CASE WHEN s_suppkey % 3 = 0 THEN '2020-01-01' ELSE '2999-12-31' END), 16) AS fingerprint, s_suppkey % 3 <> 0 AS alive,
  unnest(['*/x' || s_suppkey, '*h' || s_suppkey || '.example*/click/*', 'h?*.example.com/[pv]*/x' || s_suppkey || '?',
    {pick(D.SCOPES, 's_suppkey % 6')}]) AS pattern FROM supplier""",
    "wild_decisions": """
SELECT target, CASE WHEN granted IS NULL THEN 'DENIED' ELSE 'AUTHORIZED' END AS status,
  CASE WHEN granted IS NOT NULL THEN 'scope match' WHEN covered > 0 THEN 'authorization expired' ELSE 'out of scope' END AS detail,
  fingerprint AS authorization, organization FROM (
    SELECT target, min(k) FILTER (alive) AS granted, count(k) AS covered FROM (SELECT DISTINCT target FROM requests) t
    LEFT JOIN wild_scopes ON target GLOB pattern OR starts_with(target, rtrim(pattern, '*')) GROUP BY target)
  LEFT JOIN (SELECT DISTINCT k, fingerprint, organization FROM wild_scopes) g ON granted = g.k""",
}
NEEDS = {
    "split": ["seeded"], "arrays": ["split"], "lines": ["arrays"], "prints": ["event_findings"],
    "weights": ["event_findings"], "osv": ["parts_osv"], "auths_fp": ["auths"],
    "decided": ["auths_fp", "scopes"], "decisions": ["decided"],
    "wild_decisions": ["requests", "wild_scopes"],
}


def with_(names, body, extra=()) -> str:
    """``body`` behind the relations it needs."""
    order = []

    def visit(name):
        for parent in NEEDS.get(name, []):
            visit(parent)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    heads = [f"{n} AS MATERIALIZED ({RELATIONS[n]})" if n in ("seeded", "lines") else f"{n} AS ({RELATIONS[n]})" for n in order]
    heads += [f"{n} AS ({sql})" for n, sql in extra]
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def add(name, body, names=(), extra=()):
    ORACLE[name] = with_(names, body, extra)


LANG = lambda ext="ext": case_map(f"lower({ext})", FS.LANGUAGE)
NOT_SKIPPED = f"NOT {has_any('path', FS.SOURCE_SKIP_DIRS)}"

# --- sources -----------------------------------------------------------------

add("s02_text_table", "SELECT 'doc/' || doc_id || '.txt' AS path, '.txt' AS ext, strlen(text) AS length, length(text) AS chars FROM documents")
add("s03_tolerant_decode", f"SELECT doc_id, length(text) + 2 AS replaced, length(replace(text, chr(65533), '')) AS ignored, md5(replace(text, chr(65533), '')) AS digest FROM documents")
DOC_LINES = ("doc_lines", f"""SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM
(SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS ls FROM (SELECT doc_id, {lines_of('text')} AS parts FROM documents))""")
add("s04_lines", "SELECT 'doc/' || doc_id || '.txt' AS path, n AS line_no, length(line) AS chars, md5(line) AS digest FROM doc_lines", extra=[DOC_LINES])


def req_sql(keep):
    version = "v" if keep else "ltrim(v, '=')"
    return f"""SELECT path AS file, lower(regexp_extract(s, {q(M.BARE_REQUIREMENT)}, 1)) AS name, {version} AS version,
  row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS pos FROM
  (SELECT path, n, s, regexp_extract(s, {q(M.REQUIREMENT)}, 2) AS v FROM
    (SELECT path, n, regexp_replace({strip('line')}, '\\[.*?\\]', '', 'g') AS s, {strip('line')} AS raw FROM lines WHERE regexp_matches(lower(base), 'requirements.txt$'))
   WHERE NOT regexp_matches(raw, '^(#|-|git\\+|$)'))
  WHERE regexp_matches(s, {q(M.BARE_REQUIREMENT)})"""


def findall_sql(base, pattern, name="lower(n)", version="v", flags="(?m)", group2="2"):
    p = q(flags + pattern)
    v = f"list_transform(regexp_extract_all(content, {p}, 2), lambda x: coalesce(x, ''))"
    if group2 == "cargo":
        v = f"list_transform(list_zip(regexp_extract_all(content, {p}, 2), regexp_extract_all(content, {p}, 3)), lambda z: CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END)"
    return f"""SELECT file, {name} AS name, {version} AS version, pos FROM
  (SELECT path AS file, unnest(regexp_extract_all(content, {p}, 1)) AS n, unnest({v}) AS v,
    unnest(range(len(regexp_extract_all(content, {p}, 1)))) AS pos FROM seeded WHERE lower(base) = {q(base)})"""


def json_sql(sections, chars):
    # the document text inside the JSON only feeds the keywords
    parts = []
    for i, section in enumerate(sections):
        parts.append(f"""SELECT path AS file, {i} AS sec, k AS key, json_extract_string(content, '$.{section}."' || k || '"') AS val,
        row_number() OVER (PARTITION BY path) AS r FROM (SELECT path, content, unnest(json_keys(content, '$.{section}')) AS k FROM seeded WHERE base = 'package.json')""")
    return f"""SELECT file, lower(key) AS name, ltrim(val, {q(chars)}) AS version, row_number() OVER (PARTITION BY file ORDER BY sec, r) - 1 AS pos FROM ({' UNION ALL '.join(parts)})"""


READ = {
    "s05_requirements": req_sql(False),
    "s05_requirements_static": req_sql(True),
    "s06_package_json": json_sql(M.SECTIONS, "^~>=<* "),
    "s07_go_mod": findall_sql("go.mod", M.GO_MODULE, name="n"),
    "s07_go_mod_static": findall_sql("go.mod", M.GO_MODULE_STATIC, name="lower(list_extract(string_split(n, '/'), -1))"),
    "s08_cargo": findall_sql("cargo.toml", M.CARGO, flags="(?mi)", group2="cargo"),
    "s08_cargo_static": findall_sql("cargo.toml", M.CARGO_STATIC),
    "s09_gemfile": findall_sql("gemfile", M.GEM, version="ltrim(v, '~> =')"),
    "s10_pipfile": findall_sql("pipfile", M.PIPFILE, version="ltrim(v, '^~>= ')"),
}
for name, sql in READ.items():
    add(name, sql, ["lines"] if "requirements" in name else ["seeded"])
ECO = [("s05_requirements", "PyPI"), ("s06_package_json", "npm"), ("s07_go_mod", "Go"), ("s08_cargo", "crates.io"), ("s09_gemfile", "RubyGems")]
add("s11_manifest_dispatch", " UNION ALL ".join(f"SELECT file, name, version, {q(e)} AS ecosystem FROM ({READ[k]})" for k, e in ECO), ["lines"])
STATIC_DEPS = ("static_deps", " UNION ALL ".join(f"SELECT file, name, version, pos FROM ({s})" for s in [
    READ["s05_requirements_static"], json_sql(M.STATIC_SECTIONS, "^~>=<"), READ["s07_go_mod_static"], READ["s08_cargo_static"], READ["s10_pipfile"]]))
ADVISORIES = ("advisories", "SELECT * FROM " + values(catalog.advisory_rows(), "name, cve, severity, fixed_in, summary"))

add("s12_semgrep", """
SELECT 'rules.' || event_type AS rule_id, 'src/u' || user_id || '.py' AS file, event_id % 50 + 1 AS line, user_id % 80 + 1 AS col,
  CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'MEDIUM' END AS severity,
  'CWE-' || (user_id % 90 + 10) AS cwe, 'call(' || props || ')' AS evidence, 'https://r.example/' || user_id AS recommendation,
  CAST(75 AS DOUBLE) AS confidence, 'security' AS category
FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id, event_id % 50 ORDER BY event_id) = 1""")
add("s13_slither", """
SELECT 'slither:' || CASE WHEN event_id % 9 > 0 THEN event_type ELSE 'detector' END AS rule_id,
  CASE event_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE WHEN event_id % 4 > 0 THEN event_type || ' here' WHEN event_id % 9 > 0 THEN event_type ELSE 'Slither finding' END AS title,
  CASE WHEN event_id % 8 > 0 THEN 'c' || user_id || '.sol' ELSE '' END AS file,
  CASE WHEN event_id % 8 > 0 THEN event_id % 90 + 1 ELSE 0 END AS line, 'web3:slither' AS source FROM events""")
CARGO_SQL = """
SELECT 'RUSTSEC-' || event_id AS rule_id,
  CASE WHEN event_id % 5 = 0 THEN 'HIGH' WHEN event_id % 101 >= 90 THEN 'CRITICAL' WHEN event_id % 101 >= 70 THEN 'HIGH' WHEN event_id % 101 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  'crate' || user_id || ' ' || (event_id % 4) || '.1: ' || CASE WHEN event_id % 6 > 0 THEN 'bad ' || event_type ELSE 'advisory' END AS title,
  CASE WHEN event_id % 3 = 0 THEN 'CVE-' || event_id || ', X-1' ELSE 'RUSTSEC-' || event_id END AS cve,
  'crate' || user_id AS package, (event_id % 4) || '.1' AS installed_version FROM events"""
add("s14_cargo_audit", CARGO_SQL)
add("s15_osv_dump", "SELECT id, cve, severity, summary, 4 AS refs, 'https://r.example/0/' || k AS first_ref FROM osv", ["osv"])
add("s16_json_objects", """
SELECT 'e' || event_id AS id, true AS is_object, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
UNION ALL SELECT 'd' || doc_id, CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END, NULL FROM documents""")
add("s17_baseline_load", """
SELECT DISTINCT left(sha1(x), 16) AS fingerprint FROM (SELECT props AS x FROM events WHERE event_id % 3 = 2 UNION ALL SELECT event_type FROM events WHERE event_id % 3 = 2)""")
add("s18_authorizations", f"SELECT organization, authorized_by, permission_ref, expires, {pick(D.SCOPES, 'p')} AS scope, '' AS contact FROM auths", ["auths"])

# --- sinks and finding algebra ----------------------------------------------

COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = {q(s)}) AS {s.lower()}" for s in schema.SEVERITIES)
SCORE = "CAST(least(100, sum(weight)) AS INTEGER)"
LEVEL = f"CASE WHEN {SCORE} >= 60 THEN 'CRITICAL' WHEN {SCORE} >= 30 THEN 'HIGH' WHEN {SCORE} >= 10 THEN 'MEDIUM' WHEN {SCORE} > 0 THEN 'LOW' ELSE 'CLEAN' END"
EXIT = f"CASE WHEN {SCORE} >= 30 THEN 3 WHEN {SCORE} >= 10 THEN 2 WHEN {SCORE} > 0 THEN 1 ELSE 0 END"
ORDER = "engine_rank, pack_rank, file, seq, rule_id"
add("k01_json_report", f"SELECT 'events' AS target, {LEVEL} AS risk_level, {SCORE} AS risk_score, count(*) AS total, {EXIT} AS exit_code, {COUNTS} FROM weights", ["weights"])
SARIF = ("sarif", f"""
SELECT t.*, dense_rank() OVER (ORDER BY first_row) - 1 AS rule_index FROM
 (SELECT *, min(row_no) OVER (PARTITION BY rule_id) AS first_row FROM
  (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS row_no FROM event_findings QUALIFY row_no <= 200)) t""")
SARIF_ALL = ("sarif", SARIF[1].replace(" QUALIFY row_no <= 200", ""))
add("k01_tool_summary", f"SELECT 'events' AS target, {LEVEL} AS risk_level, {SCORE} AS risk_score, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS total, {COUNTS} FROM weights", ["weights"])
add("w14_tool_findings", f"SELECT rule_id, severity, title, cwe, file, line, source FROM event_findings WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL') ORDER BY {ORDER} LIMIT 200", ["event_findings"])
add("k02_sarif_results", f"""
SELECT rule_id, rule_index, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' WHEN severity = 'LOW' THEN 'note' ELSE 'none' END AS level,
  {case_map('severity', {'CRITICAL': '9.3', 'HIGH': '7.5', 'MEDIUM': '5.0', 'LOW': '3.1', 'INFO': '0.0'})} AS security_severity,
  file, greatest(1, line) AS start_line, seq FROM sarif""", ["event_findings"], [SARIF_ALL])
add("k02_sarif_parts", f"""
SELECT rule_id, rule_index, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' WHEN severity = 'LOW' THEN 'note' ELSE 'none' END AS level,
  title AS message, file, greatest(1, line) AS start_line, first_value(coalesce(cwe, '')) OVER (PARTITION BY rule_id ORDER BY row_no) AS rule_cwe FROM sarif""", ["event_findings"], [SARIF_ALL])
add("k02_sarif_document", """
SELECT '2.1.0' AS version, count(*) AS results, count(DISTINCT rule_id) AS rules, arg_min(rule_id, row_no) AS first_rule, arg_min(rule_id, row_no) AS rule_zero FROM sarif""", ["event_findings"], [SARIF])
add("k03_baseline_save", "SELECT DISTINCT fingerprint FROM prints ORDER BY 1", ["prints"])
add("k03_baseline_saved", "SELECT fingerprint, count(*) OVER () AS saved FROM (SELECT DISTINCT fingerprint FROM prints)", ["prints"])
add("k04_audit_rows", "SELECT status AS action, target, organization, detail, true AS stamped FROM decisions", ["decisions"])

add("f01_language", f"SELECT path, {LANG()} AS language FROM seeded", ["seeded"])
add("f02_skip_dirs", f"SELECT path, {has_any('path', FS.SOURCE_SKIP_DIRS)} AS skipped FROM seeded", ["seeded"])
add("f03_size_cut", f"SELECT path, strlen(content) * 80 AS length FROM seeded WHERE {LANG()} IS NOT NULL AND strlen(content) * 80 <= 1500000 AND {NOT_SKIPPED}", ["seeded"])
add("f04_asset_skip", f"SELECT * FROM (SELECT page_id, {pick(['.png', '.PNG', '.py', '.svg', '.md'], 'page_id % 5')} AS ext FROM pages) WHERE lower(ext) NOT IN ('.png', '.svg')")
MINIFIED = f"""(length(regexp_replace(left(text, 4096), '[\\x20-\\x7f\\t\\n\\r]', '', 'g')) / greatest(length(left(text, 4096)), 1) > 0.1
 OR len(list_filter({lines_of('text')}, lambda s: length(s) > 2000)) > 0)"""
add("f05_minified", f"SELECT doc_id, {MINIFIED} AS minified FROM documents")
add("f06_comments", f"""SELECT * FROM (SELECT path, n AS line_no, {m('line', T.COMMENT_CODE)} AS code, {m('line', T.COMMENT_SECRETS)} AS secrets, {m('line', T.COMMENT_SOLIDITY)} AS solidity FROM lines)
WHERE code OR secrets OR solidity""", ["lines"])


def pack_sql(pack, ext_test, comment=T.COMMENT_CODE):
    """Hits of a line pack; a look-ahead becomes a negated prefix test."""
    parts = []
    for k, (rule_id, pattern) in enumerate(L.RULES[pack]):
        test = m("line", pattern)
        if rule_id == "SOL005":
            head = pattern.split("(?!")[0]
            # one call per line in the snippets: strip up to the call, look at the rest
            test = f"{m('line', head)} AND NOT {m('line', head + r'\s*;?\s*require')}"
        elif rule_id == "SOL007":
            head = pattern.split("(?!")[0]
            test = f"{m('line', head)} AND NOT {m('line', head + r'\s+(?:view|pure|returns)')}"
        elif rule_id == "SOL009":
            # the blank before the look-ahead may be given back
            test = m("line", r"(owner|admin)\s*=(\s|\s*([^m\s]|m[^s]|ms[^g]|msg[^.]|$))")
        if rule_id in L.GATES:
            test += " AND " + m("line", L.GATES[rule_id])
        parts.append(f"SELECT path, n, line, {q(rule_id)} AS rule_id FROM lines WHERE {ext_test} AND {test}")
    return f"""SELECT path AS file, n AS line, rule_id, {strip('line')} AS evidence FROM ({' UNION ALL '.join(parts)})
 WHERE NOT {m('line', comment)}"""


def ext_in(language):
    return f"lower(ext) IN ({', '.join(q(e) for e, l in FS.LANGUAGE.items() if l == language)}) AND {NOT_SKIPPED}"


def meta(sql, columns="file, line, rule_id, severity, cwe, evidence"):
    return f"SELECT {columns} FROM ({sql}) h JOIN rules USING (rule_id)"


SOURCE = " UNION ALL ".join(f"({pack_sql(lang, ext_in(lang))})" for lang in L.LANGUAGES)
for i, lang in enumerate(L.LANGUAGES):
    add(f"d{i + 1:02d}_{lang}", meta(pack_sql(lang, ext_in(lang))), ["lines", "rules"])
add("f07_context_gate", meta(pack_sql("java", ext_in("java"))) + " WHERE rule_id = 'A005'", ["lines", "rules"])
add("f08_min_severity", "SELECT seq, severity FROM event_findings WHERE severity IN ('HIGH', 'CRITICAL')", ["event_findings"])
add("f09_rules_by_language", f"SELECT rule_id, count(*) AS hits FROM ({SOURCE}) WHERE rule_id LIKE 'H%' GROUP BY 1", ["lines"])
add("f11_refusals", f"""
SELECT event_id, CASE WHEN forbidden THEN 'REFUSED' ELSE 'DENIED' END AS status,
  CASE WHEN forbidden THEN 'forbidden action' ELSE 'out of scope' END AS detail, CAST(NULL AS VARCHAR) AS organization FROM requests""", ["requests"])
add("f11_deny_list", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'REFUSED' ELSE 'ALLOWED' END AS status FROM events")
CHAIN = f"CASE WHEN {contains_any('content', C.COSMWASM_MARKERS)} THEN 'COSMWASM' WHEN {contains_any('content', C.SOLANA_MARKERS)} THEN 'SOLANA' END"
add("f12_chain_of", f"SELECT path, {CHAIN} AS chain FROM seeded WHERE ext = '.rs'", ["seeded"])
PRAGMA = f"regexp_extract(content, {q(C.EVM['pragma'])}, 1)"
OLD = f"""coalesce(TRY_CAST(regexp_extract({PRAGMA}, '(\\d+)\\.(\\d+)', 1) AS INTEGER) = 0 AND TRY_CAST(regexp_extract({PRAGMA}, '(\\d+)\\.(\\d+)', 2) AS INTEGER) < 8, false)"""
add("f13_old_compiler", f"SELECT path, {OLD} AS old FROM seeded WHERE ext = '.sol'", ["seeded"])

# --- secrets -----------------------------------------------------------------


def shannon(v):
    chars = f"string_split({v}, '')"
    return f"""CAST(0 AS DOUBLE) - list_sum(list_transform(list_distinct({chars}), lambda c: (len(list_filter({chars}, lambda x: x = c)) / length({v})) * log2(len(list_filter({chars}, lambda x: x = c)) / length({v}))))"""


def encoding(v):
    return f"""CASE WHEN regexp_full_match({v}, '[0-9a-fA-F]+') THEN 'hex'
 WHEN regexp_full_match({v}, '[A-Za-z0-9+/=]+') AND length({v}) % 4 = 0 AND regexp_full_match({v}, '[A-Za-z0-9+/]*={{0,2}}') THEN 'base64'
 WHEN regexp_full_match({v}, '[A-Za-z0-9_\\-]+') THEN 'alphanumeric'
 WHEN regexp_full_match({v}, '[A-Za-z0-9%_.~\\-]+') THEN 'url' ELSE 'generic' END"""


def unescape(text):
    for safe, raw in [("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        text = f"replace({text}, {q(safe)}, {q(raw)})"
    return text


WIDE = S.ASSIGNMENT.replace(r"[\w.]", r"[\p{L}\p{N}_.]")
NAMED = contains_any("name", E.SECRET_NAMES)
BENIGN = "(" + " OR ".join(m("value", p) for p in S.BENIGN) + ")"
THRESHOLD = case_map("encoding", E.THRESHOLD)
MIN_LENGTH = case_map("encoding", E.MIN_LENGTH)
SEVERITY = f"""CASE WHEN {contains_any('name', E.CRITICAL_NAMES)} THEN 'CRITICAL' WHEN entropy >= 5.5 OR {contains_any('name', E.HIGH_NAMES)} THEN 'HIGH'
 WHEN entropy >= 4.5 THEN 'MEDIUM' ELSE 'LOW' END"""
KEPT = f"""NOT ({m('value', S.UUID)} OR {m('value', S.ALL_CAPS)} OR ({m('value', S.LONG_HASH)} AND confidence < 70) OR {m('value', S.VERSION)})"""
MASK = "CASE WHEN length(value) <= 8 THEN '****' ELSE left(value, 4) || repeat('*', least(length(value) - 8, 24)) || right(value, 4) END"


def likely(ext):
    return f"""(length(value) >= {MIN_LENGTH} AND ({NAMED} OR NOT {BENIGN})
 AND entropy >= {THRESHOLD} + CASE WHEN {NAMED} THEN 0 WHEN lower({ext}) IN ({', '.join(q(e) for e in S.CODE_EXTENSIONS)}) THEN 1.0 ELSE 0.6 END)"""


def measured(source, key):
    """(key, n, k, name, value, encoding, entropy, confidence) of assignments in (key, n, line)."""
    p = q(WIDE)
    return f"""SELECT *, CASE WHEN {NAMED} THEN 90.0::DOUBLE ELSE 65.0::DOUBLE END AS confidence FROM
 (SELECT *, {encoding('value')} AS encoding, {shannon('value')} AS entropy FROM
  (SELECT {key}, n, unnest(range(len(regexp_extract_all(line, {p}, 1)))) AS k, rtrim(lower(unnest(regexp_extract_all(line, {p}, 1))), '._') AS name,
    unnest(regexp_extract_all(line, {p}, 2)) AS value FROM ({source})))"""


PAGE_LINES = f"SELECT page_id, 0 AS n, unnest({lines_of(unescape('html'))}) AS line FROM pages"
CAND = ("cand", measured(PAGE_LINES, "page_id"))
add("f14_likely_secret", f"SELECT page_id, name, value, {likely(q('.html'))} AS likely FROM cand", extra=[CAND])
add("f15_secret_filter", f"SELECT page_id, value, {KEPT} AS kept FROM cand", extra=[CAND])
add("p06_secret_severity", f"SELECT page_id, name, value, {SEVERITY} AS severity FROM cand", extra=[CAND])
add("d11_candidate_profile", "SELECT page_id, name, value, encoding, round(entropy, 3) AS entropy, confidence FROM cand", extra=[CAND])


def secrets_sql(lines_sql, ext):
    """Accepted assignments, then bare strings, first wins by the whole value."""
    p = q(S.QUOTED)
    bare = f"""SELECT *, 45.0::DOUBLE AS confidence FROM (SELECT *, {encoding('value')} AS encoding, {shannon('value')} AS entropy FROM
  (SELECT file, n, ext, unnest(range(len(regexp_extract_all(line, {p}, 1)))) AS k, '' AS name, unnest(regexp_extract_all(line, {p}, 1)) AS value FROM src))"""
    return f"""WITH src AS ({lines_sql}),
 named AS ({measured('SELECT * FROM src', 'file, ext')}), bare AS ({bare}),
 every AS (SELECT file, n, 0 AS kind, k, name, value, encoding, entropy, confidence FROM named WHERE {likely(ext)}
  UNION ALL SELECT file, n, 1, k, name, value, encoding, entropy, confidence FROM bare WHERE entropy >= {THRESHOLD} + 0.5),
 firsts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY file, n, value ORDER BY kind, k) = 1)
SELECT file, n AS line, {SEVERITY} AS severity, {MASK} AS evidence, encoding, name AS var_name, CASE kind WHEN 0 THEN 'assignment' ELSE 'standalone' END AS context_type,
 confidence, round(entropy, 3) AS entropy FROM firsts WHERE {KEPT}"""


NOT_COMMENT = f"NOT {m('line', T.COMMENT_SECRETS)}"
DOC_SECRET_LINES = f"""SELECT 'doc/' || doc_id || '.txt' AS file, '.txt' AS ext, n, line FROM doc_lines WHERE {NOT_COMMENT}"""
add("d11_secrets", "SELECT * FROM (" + secrets_sql(DOC_SECRET_LINES, "ext") + ")", extra=[DOC_LINES])
SEEDED_SECRET_LINES = f"""SELECT path AS file, ext, n, line FROM lines WHERE {NOT_COMMENT} AND NOT {has_any('path', S.SKIP_DIRS)}"""
add("d11_secrets_seeded", "SELECT * FROM (" + secrets_sql(SEEDED_SECRET_LINES, "ext") + ")", ["lines"])
add("w04_secret_dedup", """
SELECT event_id, CASE WHEN true THEN 1 END AS by12, CASE WHEN left(md5(props || '0'), 2) = left(md5(props || '1'), 2) THEN 1 ELSE 2 END AS by16 FROM events""")

# --- projections -------------------------------------------------------------

add("p01_normalise", f"""
SELECT event_id, CASE WHEN s IN ({', '.join(q(x) for x in schema.SEVERITIES)}) THEN s ELSE 'INFO' END AS severity,
  CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 7 = 0 THEN props WHEN event_id % 11 > 0 THEN 'R' || user_id ELSE 'Finding' END AS title,
  CASE WHEN event_id % 6 = 0 THEN 'tool' ELSE 'outside' END AS source
FROM (SELECT *, CASE WHEN event_id % 3 = 1 THEN 'HIGH' WHEN event_id % 4 = 0 THEN 'BOGUS' WHEN event_id % 2 = 0 THEN 'LOW' ELSE 'INFO' END AS s FROM events)""")
add("p02_finding", meta(SOURCE, "file, line, rule_id, severity, cwe, evidence, title, title AS message, source, engine"), ["lines", "rules"])
add("j09_rule_meta", meta(SOURCE, "file, line, rule_id, cwe, severity"), ["lines", "rules"])
add("p03_web3_source", "SELECT seq, rule_id, CASE WHEN rule_id LIKE 'SC-TON%' THEN 'web3:ton' WHEN rule_id LIKE 'SC-SOL%' THEN 'web3:evm' ELSE 'web3' END AS source FROM event_findings", ["event_findings"])
add("p04_mask", f"SELECT doc_id, {MASK} AS masked, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS value FROM documents) WHERE length(value) > 6 GROUP BY 1, 2")
SEV5 = pick(schema.SEVERITIES, "event_id % 5")
add("p07_severity_maps", f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'HIGH' WHEN event_id % 101 >= 90 THEN 'CRITICAL' WHEN event_id % 101 >= 70 THEN 'HIGH' WHEN event_id % 101 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS cvss,
  CASE event_type WHEN 'error' THEN 'HIGH' ELSE 'MEDIUM' END AS semgrep,
  {pick(['error', 'error', 'warning', 'note', 'none'], 'event_id % 5')} AS level, {pick(['9.3', '7.5', '5.0', '3.1', '0.0'], 'event_id % 5')} AS score FROM events""")
add("p08_osv_severity", "SELECT id, severity AS reproduced, coalesce(scored, named) AS skipping_vectors FROM osv", ["osv"])
add("p09_fixed_version", "SELECT id, coalesce(fixed, 'latest') AS fixed_in, 'latest' AS other FROM osv", ["osv"])
add("p10_fingerprint", "SELECT seq, fingerprint FROM prints", ["prints"])
add("p11_authorization_fingerprint", "SELECT organization, fingerprint FROM auths_fp", ["auths_fp"])
NOTES = ("notes", "SELECT * FROM " + values([(n[0], *n[1:]) for n in catalog.CWE_NOTES], "kb_cwe, name, why, fix"))
HEADING = "rtrim('* ' || title || '  [' || severity || ']  ' || coalesce(cwe, ''))"
PLACE = "'  at        ' || file || CASE WHEN line <> 0 THEN ':' || line ELSE '' END"
add("p12_explanations", f"""
SELECT seq, {HEADING} AS heading, {PLACE} AS location, length({HEADING}) + 1 + length({PLACE}) + 1 +
 CASE WHEN name IS NOT NULL THEN length(chr(10) || '  weakness  ' || name || '.' || chr(10) || '  effect    ' || why || chr(10) || '  remedy    ' || fix || chr(10)
   || '  see also  https://cwe.mitre.org/data/definitions/' || substring(kb_cwe, 5) || '.html')
 ELSE length(chr(10) || '  ' || title || chr(10) || '  (No note for this weakness class.)') END AS chars
FROM event_findings LEFT JOIN notes ON upper(cwe) = kb_cwe""", ["event_findings"], [NOTES])
add("w14_explain_first", f"SELECT seq, {HEADING} AS heading FROM event_findings ORDER BY {ORDER} LIMIT 20", ["event_findings"])
add("w14_validate_first", "SELECT 'ASSESSED' AS action, target, 'rule=R' || i AS detail, organization FROM pages JOIN decisions ON url = target, (VALUES (0), (1)) v(i) WHERE status = 'AUTHORIZED'", ["decisions"])
add("p12_fix_advice", "SELECT seq, 'Recommended fix (' || coalesce(cwe, '') || '): ' || coalesce(fix, 'Apply the standard remediation for this class.') AS advice FROM event_findings LEFT JOIN notes ON upper(cwe) = kb_cwe", ["event_findings"], [NOTES])
add("p13_narrow", "SELECT rule_id, severity, title, cwe, file, line, source FROM event_findings", ["event_findings"])

# --- joins -------------------------------------------------------------------

STATIC_JOIN = """SELECT file, name AS package, version AS installed_version, cve, severity, fixed_in, CASE WHEN version = '' THEN name ELSE name || '==' || version END AS evidence
FROM static_deps JOIN advisories USING (name)"""
add("j01_static_advisories", STATIC_JOIN, ["lines"], [STATIC_DEPS, ADVISORIES])


def vkey(v):
    return f"list_transform(string_split(regexp_replace({v}, '(\\.0+)+$', ''), '.'), lambda x: CAST(x AS BIGINT))"


LAST = ("last_file", "SELECT name, version, ecosystem, max(file) AS file FROM deps GROUP BY ALL")
add("j02_osv_advisories", f"""
SELECT file, name AS package, version AS installed_version, cve, severity, coalesce(fixed, 'latest') AS fixed_in
FROM last_file JOIN osv USING (name, ecosystem) WHERE {vkey('introduced')} <= {vkey('version')} AND (fixed IS NULL OR {vkey('version')} < {vkey('fixed')})""", ["deps", "osv"], [LAST])
add("j03_notes", "SELECT seq, kb_cwe, name FROM event_findings LEFT JOIN notes ON upper(cwe) = kb_cwe", ["event_findings"], [NOTES])
add("j04_baseline_gate", "SELECT seq, fingerprint FROM prints WHERE fingerprint NOT IN (SELECT fingerprint FROM prints WHERE line % 2 = 0)", ["prints"])
add("j05_suppressed", "SELECT count(*) AS suppressed FROM prints WHERE fingerprint IN (SELECT fingerprint FROM prints WHERE line % 2 = 0)", ["prints"])
add("j04_flagged", "SELECT fingerprint IN (SELECT fingerprint FROM prints WHERE line % 2 = 0) AS is_known, count(*) AS findings FROM prints GROUP BY 1", ["prints"])
add("j06_authorization", "SELECT target, status, detail, \"authorization\", organization FROM decisions", ["decisions"])
add("j06_wildcard_scopes", "SELECT target, status, detail, \"authorization\", organization FROM wild_decisions", ["wild_decisions"])
add("k04_audit_requests", """
SELECT event_id, CASE WHEN forbidden THEN 'REFUSED' ELSE status END AS action, target, CASE WHEN NOT forbidden THEN organization END AS organization,
  CASE WHEN forbidden THEN 'forbidden action' ELSE detail END AS detail, true AS stamped FROM requests JOIN wild_decisions USING (target)""", ["wild_decisions"])
add("w06_first_authorization", "SELECT target, organization FROM decisions WHERE status = 'AUTHORIZED'", ["decisions"])
add("j11_assessment", f"""
SELECT target, organization, 'R' || i AS rule_id, {pick(['CWE-89', 'CWE-78', 'CWE-22'], 'i')} AS cwe, page_id % 3 > 0 AND i * (page_id % 2) <> 0 AS statically_reachable,
 {pick([catalog.ASSESSMENT_NOTES['CWE-89'], catalog.ASSESSMENT_NOTES['CWE-78'], catalog.DEFAULT_ASSESSMENT_NOTE], 'i')} AS reproduction_note
FROM pages JOIN decisions ON url = target, (VALUES (0), (1), (2)) v(i) WHERE status = 'AUTHORIZED'""", ["decisions"])

# Syntax facts need a grammar, so the Python hits are stated per snippet:
# (file of the snippet, line, rule).  They hold wherever the snippet is seeded.
PYTHON_HITS = [
    ("py-hash-vulnerable.py", 5, "P001"), ("py-hash-new-vulnerable.py", 5, "P001"),
    ("py-cipher-vulnerable.py", 2, "P002"), ("py-ecb-vulnerable.py", 1, "P003"),
    ("py-verify-vulnerable.py", 5, "P004"), ("py-context-vulnerable.py", 5, "P004"),
    ("py-pickle-vulnerable.py", 5, "P005"), ("py-yaml-vulnerable.py", 6, "P006"),
    ("py-eval-vulnerable.py", 1, "P007"), ("py-os-vulnerable.py", 2, "P008"),
    ("py-shell-vulnerable.py", 5, "P009"), ("py-sql-vulnerable.py", 4, "P010"),
    ("py-sql-variable-vulnerable.py", 4, "P010"), ("py-sql-helper-vulnerable.py", 5, "P015"),
    ("py-template-vulnerable.py", 1, "P011"), ("py-random-vulnerable.py", 6, "P012"),
    ("py-xml-vulnerable.py", 4, "P013"), ("py-path-vulnerable.py", 1, "P014"),
    ("py-xpath-vulnerable.py", 2, "P016"), ("py-ldap-vulnerable.py", 1, "P017"),
]
YAML_HITS = [
    ("cf.yaml", "IAC-CF-001", "SecurityGroupIngress port 22 CidrIp 0.0.0.0/0"),
    ("cf.yaml", "IAC-CF-001", "SecurityGroupIngress port 22 CidrIp ::/0"),
    ("pod.yml", "IAC-K8S-005", "securityContext.privileged: true"),
    ("pod.yml", "IAC-K8S-005", "securityContext.privileged: true"),
]
PY = f"""SELECT path AS file, hn AS line, rule_id, trim(string_split(snippet, chr(10))[hn]) AS evidence FROM seeded JOIN {values(PYTHON_HITS, 'name, hn, rule_id')} h USING (name)"""
YAML = f"""SELECT path AS file, 0 AS line, rule_id, evidence FROM seeded JOIN {values(YAML_HITS, 'name, rule_id, evidence')} h USING (name)"""
add("d10_python", meta(PY), ["seeded", "rules"])
add("j07_dynamic_variables", meta(PY) + " WHERE rule_id = 'P010'", ["seeded", "rules"])
add("j08_query_helpers", meta(PY) + " WHERE rule_id = 'P015'", ["seeded", "rules"])
add("d17_cloudformation", meta(YAML) + " WHERE rule_id = 'IAC-CF-001'", ["seeded", "rules"])
add("d18_kubernetes", meta(YAML) + " WHERE rule_id = 'IAC-K8S-005'", ["seeded", "rules"])

# --- contracts and Terraform -------------------------------------------------


def frame(first, last):
    return f"list_slice(ls, greatest(1, {first}), {last})"


def joined(first, last):
    return f"array_to_string({frame(first, last)}, chr(10))"


def file_hit(rule_id, where, evidence="NULL"):
    return f"SELECT path AS file, 0 AS line, {q(rule_id)} AS rule_id, {evidence} AS evidence FROM seeded WHERE {where}"


def line_hit(rule_id, where, evidence=strip("line")):
    return f"SELECT path AS file, n AS line, {q(rule_id)} AS rule_id, {evidence} AS evidence FROM lines WHERE {where}"


def first_hit(rule_id, where, evidence=strip("line")):
    return line_hit(rule_id, where, evidence) + " QUALIFY row_number() OVER (PARTITION BY path ORDER BY n) = 1"


def union(parts):
    return " UNION ALL ".join(f"({p})" for p in parts)


REDACTED = f"regexp_replace({strip('line')}, {q(linepass.QUOTED_VALUE)}, '\"***\"', 'g')"
TON = "lower(ext) IN ('.fc', '.func', '.tolk')"
TON_SQL = union([
    file_hit("SC-TON-001", f"{TON} AND NOT {m('content', C.TON['sender'])}"),
    file_hit("SC-TON-004", f"{TON} AND contains(content, 'recv_internal') AND NOT {m('content', C.TON['bounce'])}"),
    line_hit("SC-TON-002", f"{TON} AND {m('line', C.TON['random'])}"),
    line_hit("SC-TON-003", f"{TON} AND {m('line', C.TON['loop'])}"),
    line_hit("SC-TON-005", f"{TON} AND {m('line', C.TON['address'])}"),
    line_hit("SC-COM-001", f"{TON} AND {m('line', C.CREDENTIAL)}", REDACTED),
])
SOL = "lower(ext) = '.sol'"


def destroyed(loose):
    frame_ = frame("n - 9", "n")
    if loose:
        guard = f"len(list_filter({frame_}, lambda s: contains(s, 'onlyOwner') OR contains(s, 'require(msg.sender') OR contains(s, 'modifier'))) > 0"
    else:
        guard = f"list_has_any({frame_}, {ql(C.EVM_GUARDS)})"
    return line_hit("SC-SOL-005", f"{SOL} AND {m('line', C.EVM['destroy'])} AND NOT {guard}")


EVM_SQL = union([
    file_hit("SC-SOL-002", f"{SOL} AND {OLD} AND NOT contains(content, 'SafeMath')"),
    line_hit("SC-SOL-003", f"{SOL} AND {m('line', C.EVM['origin'])} AND {m('line', C.EVM['guarded'])}"),
    destroyed(False),
    line_hit("SC-SOL-006", f"{SOL} AND {m('line', C.EVM['time'])} AND {m('line', C.EVM['decision'])}"),
    line_hit("SC-SOL-004", f"{SOL} AND {m('line', C.EVM['low_level'])} AND NOT {m(joined('n + 1', 'n + 4'), 'success|require')}"),
    first_hit("SC-SOL-001", f"{SOL} AND {m('line', C.EVM['external'])} AND {m(joined('n + 1', 'n + 8'), C.EVM['write'])}", "NULL"),
    line_hit("SC-COM-001", f"{SOL} AND {m('line', C.CREDENTIAL)}", REDACTED),
])
RUST = ("rust", f"SELECT path, {CHAIN} AS chain_of FROM seeded WHERE ext = '.rs' AND NOT {has_any('path', ['__pycache__', 'target'])}")
SOLANA = "path IN (SELECT path FROM rust WHERE chain_of = 'SOLANA')"
COSM = "path IN (SELECT path FROM rust WHERE chain_of = 'COSMWASM')"
ENTRY = f"{SOLANA} AND contains(content, 'process_instruction')"
P = C.SOLANA
SOLANA_SQL = union([
    file_hit("SC-SOL-NA-001", f"{ENTRY} AND NOT {m('content', P['signer'])} AND NOT {m('content', P['framework_signer'])}"),
    file_hit("SC-SOL-NA-002", f"{ENTRY} AND NOT {m('content', P['owner'])} AND NOT {m('content', P['framework'])}"),
    first_hit("SC-SOL-NA-003", f"{SOLANA} AND path NOT IN (SELECT path FROM seeded WHERE {m('content', P['checked'])}) AND {m('line', P['arithmetic'])}"),
    "SELECT file, line, CASE WHEN " + m("raw", P["any_target"]) + " THEN 'SC-SOL-NA-005' ELSE 'SC-SOL-NA-004' END, evidence FROM ("
    + first_hit("x", f"{SOLANA} AND {m('line', P['invoke'])}").replace(" FROM lines", ", line AS raw FROM lines") + ")",
    line_hit("SC-SOL-NA-006", f"{SOLANA} AND {m('line', P['unchecked'])}"),
])
W = C.COSMWASM
COSM_SQL = union([
    file_hit("SC-CW-001", f"{COSM} AND {m('content', W['execute'])} AND NOT {m('content', W['admin'])}"),
    file_hit("SC-CW-002", f"{COSM} AND {m('content', W['execute'])} AND NOT {m('content', W['funds'])}"),
    file_hit("SC-CW-003", f"{COSM} AND {m('content', W['reply'])} AND NOT {m('content', W['reply_id'])}"),
    first_hit("SC-CW-004", f"{COSM} AND {m('line', W['save'])} AND {m(joined('n + 1', 'n + 8'), W['sub_message'])}"),
    line_hit("SC-CW-005", f"{COSM} AND {m('line', W['address'])}"),
])
SOLPACK_SQL = pack_sql("solidity", SOL, T.COMMENT_SOLIDITY)
TF = "ext = '.tf'"
TF_SQL = union([
    file_hit("IAC-TF-001", f"{TF} AND contains(content, 'aws_s3_bucket') AND NOT contains(content, 'server_side_encryption')", "'server_side_encryption_configuration not found'"),
    first_hit("IAC-TF-002", f"{TF} AND path IN (SELECT path FROM seeded WHERE contains(content, 'aws_security_group')) AND (contains(line, 'from_port') OR contains(line, 'to_port')) AND contains(line, '22') AND {m(joined('n - 4', 'n + 5'), I.TF_OPEN)}"),
    first_hit("IAC-TF-008", f"{TF} AND {m('line', I.TF_CREDENTIAL)}", f"regexp_replace({strip('line')}, '=\\s*\"[^\"]+\"', '= \"***\"', 'g')"),
])
BASE = ["lines", "rules"]
add("d16_terraform", meta(TF_SQL), BASE)
add("d20_ton", meta(TON_SQL), BASE)
add("d21_evm", meta(EVM_SQL), BASE)
add("d22_solidity", meta(SOLPACK_SQL), BASE)
add("d23_solana", meta(SOLANA_SQL), BASE, [RUST])
add("d24_cosmwasm", meta(COSM_SQL), BASE, [RUST])
add("f10_text_presence", "SELECT file, rule_id FROM (" + union([TON_SQL, EVM_SQL, TF_SQL]) + ") WHERE rule_id IN ('SC-TON-001', 'SC-TON-004', 'SC-SOL-002', 'IAC-TF-001')", ["lines"])
add("p05_redaction", meta(union([TON_SQL, EVM_SQL, TF_SQL])) + " WHERE rule_id IN ('SC-COM-001', 'IAC-TF-008')", BASE)
add("w07_first_per_file", "SELECT file, line, rule_id FROM (" + union([TF_SQL, SOLANA_SQL, COSM_SQL]) + ") WHERE rule_id IN ('IAC-TF-002', 'IAC-TF-008', 'SC-SOL-NA-003', 'SC-SOL-NA-004', 'SC-SOL-NA-005', 'SC-CW-004')", ["lines"], [RUST])
add("w08_ahead_four", meta(EVM_SQL) + " WHERE rule_id = 'SC-SOL-004'", BASE)
add("w09_ahead_eight", meta(EVM_SQL) + " WHERE rule_id = 'SC-SOL-001'", BASE)
add("w10_save_then_message", meta(COSM_SQL) + " WHERE rule_id = 'SC-CW-004'", BASE, [RUST])
add("w11_around", meta(TF_SQL) + " WHERE rule_id = 'IAC-TF-002'", BASE)
add("w12_behind", f"SELECT file AS path, line, 'whole_line' AS guards FROM ({destroyed(False)}) UNION ALL SELECT file, line, 'substring' FROM ({destroyed(True)})", ["lines"])
add("s19_rule_table", f"SELECT rule_id, cwe, severity, hits FROM rules JOIN (SELECT rule_id, count(*) AS hits FROM ({union([SOURCE, TON_SQL, EVM_SQL])}) GROUP BY 1) USING (rule_id)", BASE)

# --- evasion -----------------------------------------------------------------

NL_LINES = ("nl_lines", f"SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT path, string_split(content, chr(10)) AS ls FROM seeded WHERE {LANG()} IS NOT NULL)")
# RE2 has no possessive quantifier; the greedy one matches the same text here.
CHAIN_RX = V.CHR_CHAIN.replace("{2,}+", "{2,}")
PRINTABLE = r"^[\x20-\x7e\t\n\r]+$"


def revealed(expr, kind, source, where="true"):
    return f"""SELECT file, line, t AS evidence, {q(kind)} AS kind FROM (SELECT path AS file, n AS line, {expr} AS t FROM ({source}) WHERE {where})
 WHERE {m('t', PRINTABLE)} AND {m('t', V.DANGEROUS)}"""


B64 = revealed("TRY(decode(from_base64(x)))", "base64", f"SELECT path, n, unnest(regexp_extract_all(line, {q(V.BASE64)}, 1)) AS x FROM nl_lines", "length(x) % 4 = 0")
HEX = revealed("TRY(decode(unhex(replace(x, '\\x', ''))))", "hex", f"SELECT path, n, unnest(regexp_extract_all(line, {q(V.HEX)}, 1)) AS x FROM nl_lines")
add("d12_base64", B64, ["seeded"], [NL_LINES])
add("d13_hex", HEX, ["seeded"], [NL_LINES])


def spanning(pattern, codes):
    """Matches over the whole text; the line comes from the text before them."""
    p = q(pattern)
    pieces = f"string_split_regex(content, {p})"
    source = f"""SELECT path, x, len(regexp_extract_all(array_to_string(list_slice(pieces, 1, k), ''), chr(10))) + len(regexp_extract_all(array_to_string(list_slice(found, 1, k - 1), ''), chr(10))) + 1 AS n
  FROM (SELECT path, pieces, found, unnest(found) AS x, generate_subscripts(found, 1) AS k FROM
   (SELECT path, {pieces} AS pieces, regexp_extract_all(content, {p}) AS found FROM seeded WHERE {LANG()} IS NOT NULL))"""
    text = f"array_to_string(list_transform({codes}, lambda c: chr(CAST(c AS INTEGER))), '')"
    return revealed(f"CASE WHEN len({codes}) >= 3 AND len(list_filter({codes}, lambda c: CAST(c AS INTEGER) NOT BETWEEN 1 AND 255)) = 0 THEN {text} END", "char-code", source)


CODES1 = f"regexp_extract_all(x, {q(V.CHR)}, 1)"
CODES2 = f"list_filter(list_transform(string_split(regexp_extract(x, {q(V.FROM_CHAR_CODE)}, 1), ','), lambda c: {strip('c')}), lambda c: c <> '')"
CHR_SQL = union([spanning(CHAIN_RX, CODES1), spanning(V.FROM_CHAR_CODE, CODES2)])
add("d14_charcode", CHR_SQL, ["seeded"])
FRAG = f"array_to_string(regexp_extract_all(line, {q(V.FRAGMENT)}, 1), '')"
CONCAT_SQL = f"""SELECT path AS file, n AS line, {FRAG} AS evidence, 'concat' AS kind FROM lines
 WHERE {LANG()} IS NOT NULL AND {m('line', V.CONCAT)} AND {m(FRAG, V.DANGEROUS)} AND NOT {m('line', V.DANGEROUS)}"""
add("d15_split_strings", CONCAT_SQL, ["lines"])
add("d19_iac_dispatch", """
SELECT path, CASE WHEN ext = '.tf' THEN 'terraform' WHEN contains(content, 'AWSTemplateFormatVersion') OR contains(content, 'AWS::') THEN 'cloudformation'
 WHEN contains(content, 'apiVersion') AND contains(content, 'kind') THEN 'kubernetes' END AS kind FROM seeded WHERE ext IN ('.tf', '.yml', '.yaml')""", ["seeded"])

# --- aggregations ------------------------------------------------------------

SCORED = ("scored", f"""
SELECT s.path, case_id, side, s.cwe, modelled, coalesce(bool_or(h.cwe = s.cwe), false) AS hit, count(h.cwe) > 0 AS flagged
FROM seeded s LEFT JOIN (SELECT file, cwe FROM ({union([SOURCE, PY])}) JOIN rules USING (rule_id)) h ON file = path WHERE case_id IS NOT NULL GROUP BY ALL""")
add("j10_scored_cases", "SELECT path, case_id, side, hit, flagged FROM scored", BASE, [SCORED])
CARD = """SELECT {scope} AS scope, count(*) FILTER (WHERE side = 'vulnerable') AS cases, count(*) FILTER (WHERE side = 'vulnerable' AND hit) AS tp, count(*) FILTER (WHERE side = 'secure' AND flagged) AS fp,
 round(count(*) FILTER (WHERE side = 'vulnerable' AND hit) / count(*) FILTER (WHERE side = 'vulnerable'), 3) AS recall,
 round(count(*) FILTER (WHERE side = 'secure' AND flagged) / count(*) FILTER (WHERE side = 'secure'), 3) AS fpr,
 round(count(*) FILTER (WHERE side = 'vulnerable' AND hit) / (count(*) FILTER (WHERE side = 'vulnerable' AND hit) + count(*) FILTER (WHERE side = 'secure' AND flagged)), 3) AS precision,
 count(*) FILTER (WHERE side = 'secure' AND flagged) = 0 AND count(*) FILTER (WHERE side = 'vulnerable' AND hit) / count(*) FILTER (WHERE side = 'vulnerable') >= 0.9 AS passed FROM scored WHERE {where}"""
add("g09_scorecard", CARD.format(scope="'modelled'", where="modelled") + " UNION ALL " + CARD.format(scope="'overall'", where="true"), BASE, [SCORED])
add("g09_missed_cases", "SELECT DISTINCT case_id, cwe, modelled FROM scored WHERE side = 'vulnerable' AND NOT hit", BASE, [SCORED])
add("g09_false_positives", "SELECT DISTINCT case_id, '' AS rule_id FROM scored WHERE side = 'secure' AND flagged", BASE, [SCORED])
add("g01_by_severity", f"SELECT {COUNTS} FROM event_findings", ["event_findings"])
add("g02_risk_per_file", f"SELECT file, count(*) AS total, {SCORE} AS risk_score FROM weights GROUP BY 1", ["weights"])
add("g03_risk_level", f"SELECT file, {SCORE} AS risk_score, {LEVEL} AS risk_level, {EXIT} AS exit_code FROM weights GROUP BY 1", ["weights"])
add("g04_engine_rollup", "SELECT engine, severity, count(*) AS findings FROM event_findings GROUP BY ROLLUP (engine, severity)", ["event_findings"])
add("g05_engine_summary", "SELECT engine, severity, count(*) AS findings, count(DISTINCT file) AS files FROM event_findings GROUP BY 1, 2", ["event_findings"])
add("g06_per_chain", "SELECT chain, count(*) AS findings FROM event_findings WHERE chain IS NOT NULL GROUP BY 1", ["event_findings"])
FIRST = f"min(({ORDER}))"
TOP = f"SELECT cwe, count(*) AS findings FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS r FROM event_findings) WHERE cwe IS NOT NULL GROUP BY 1 ORDER BY findings DESC, min(r) LIMIT 5"
add("g07_top_weaknesses", TOP, ["event_findings"])
add("g07_summary", f"""
SELECT (SELECT count(*) FROM event_findings) || ' findings (' || (SELECT string_agg(severity || ' ' || n, ', ' ORDER BY severity || ' ' || n) FROM (SELECT severity, count(*) AS n FROM event_findings GROUP BY 1))
 || '). Most common: ' || (SELECT string_agg(cwe || ' x' || findings, ', ' ORDER BY findings DESC, cwe) FROM ({TOP})) || '.' AS summary""", ["event_findings"])
add("g08_languages", f"SELECT language, count(*) AS files FROM (SELECT {case_map('lower(ext)', FS.HISTOGRAM_LANGUAGE)} AS language FROM seeded WHERE NOT {has_any('path', FS.HISTOGRAM_SKIP_DIRS)}) WHERE language IS NOT NULL GROUP BY 1", ["seeded"])
LANG_OF = case_map("left(rule_id, 1)", {p: n for n, p in catalog.LANGUAGE_PREFIX.items()})
add("g10_rule_summary", f"SELECT {LANG_OF} AS language, count(*) AS rules, count(DISTINCT cwe) AS classes, string_agg(DISTINCT cwe, ',' ORDER BY cwe) AS cwes FROM rules WHERE rule_id IN (SELECT rule_id FROM ({SOURCE})) GROUP BY 1", BASE)
add("g11_silent_rules", f"SELECT rule_id FROM rules WHERE length(rule_id) = 4 AND rule_id <> 'E001' AND rule_id NOT IN (SELECT rule_id FROM ({SOURCE}))", BASE)
add("g12_entropy", f"SELECT doc_id, round(max(CASE WHEN w = '' THEN 0.0 ELSE {shannon('w')} END), 3) AS top, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents) GROUP BY 1")
add("g13_last_file", "SELECT * FROM last_file", ["deps"], [LAST])

# --- windows, limits, sets ---------------------------------------------------

add("w01_dedup", f"SELECT seq, cwe, file, line, engine FROM event_findings QUALIFY row_number() OVER (PARTITION BY coalesce(cwe, title), file, line ORDER BY {ORDER}) = 1", ["event_findings"])
add("w02_dedup_by_rule", f"SELECT seq, rule_id, file, line FROM event_findings QUALIFY row_number() OVER (PARTITION BY rule_id, file, line ORDER BY {ORDER}) = 1", ["event_findings"])
CAPPED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN pack_rank = 0 THEN 'contracts' ELSE coalesce(chain, 'solidity') END ORDER BY {order}) AS rn FROM {src})
 WHERE rn <= CASE WHEN pack_rank = 0 THEN 6 ELSE 3 END"""
add("w03_cap_per_chain", f"SELECT seq, chain, pack_rank FROM ({CAPPED.format(order=ORDER, src='event_findings')})", ["event_findings"])
add("w05_rule_index", "SELECT rule_index, rule_id, count(*) AS n FROM sarif GROUP BY 1, 2", ["event_findings"], [SARIF_ALL])
add("w13_severity_order", f"SELECT seq, severity, file FROM event_findings ORDER BY {case_map('severity', {s: i for i, s in enumerate(schema.SEVERITIES)})}, {ORDER}", ["event_findings"])
add("w14_first_findings", f"SELECT seq, engine, file FROM event_findings ORDER BY {ORDER} LIMIT 200", ["event_findings"])
add("w15_file_cap", f"SELECT path FROM seeded WHERE {LANG()} IS NOT NULL AND {NOT_SKIPPED} ORDER BY path LIMIT 40", ["seeded"])
add("u01_union", "SELECT engine, seq, CASE WHEN engine = 'web3' THEN chain END AS chain FROM event_findings", ["event_findings"])
add("u02_distinct_dependencies", "SELECT DISTINCT name, version, ecosystem FROM deps", ["deps"])
add("u03_distinct_fingerprints", "SELECT DISTINCT fingerprint FROM prints", ["prints"])
add("u04_rules_never_fired", "SELECT kb_cwe AS cwe FROM notes WHERE kb_cwe NOT IN (SELECT upper(cwe) FROM event_findings WHERE cwe IS NOT NULL)", ["event_findings"], [NOTES])
add("u05_fallback", "SELECT seq, severity, engine, CASE severity WHEN 'LOW' THEN 'empty' ELSE 'full' END AS \"case\" FROM event_findings WHERE severity IN ('LOW', 'HIGH')", ["event_findings"])

# --- compositions ------------------------------------------------------------

# Order of the contract pack inside a file, for the caps.
WEB3 = union([TON_SQL, EVM_SQL, SOLPACK_SQL, SOLANA_SQL, COSM_SQL])
WEB3_POS = """CASE WHEN rule_id IN ('SC-TON-001', 'SC-SOL-002', 'SC-SOL-NA-001', 'SC-CW-001') THEN 0 WHEN rule_id IN ('SC-TON-004', 'SC-SOL-NA-002', 'SC-CW-002') THEN 1
 WHEN rule_id IN ('SC-SOL-NA-003', 'SC-CW-003') THEN 2 WHEN rule_id IN ('SC-SOL-NA-004', 'SC-SOL-NA-005', 'SC-CW-004') THEN 3
 WHEN rule_id = 'SC-SOL-001' THEN 1000000000000 WHEN rule_id = 'SC-COM-001' AND file LIKE '%.sol' THEN 2000000000000 + line
 WHEN rule_id LIKE 'SOL%' THEN (CAST(substring(rule_id, 4) AS BIGINT) - 1) * 1000000000 + line
 WHEN rule_id LIKE 'SC-SOL-NA%' OR rule_id LIKE 'SC-CW%' THEN line * 100
 ELSE line * 100 + CASE rule_id WHEN 'SC-TON-003' THEN 1 WHEN 'SC-TON-005' THEN 2 WHEN 'SC-COM-001' THEN 3 WHEN 'SC-SOL-005' THEN 1 WHEN 'SC-SOL-006' THEN 2 WHEN 'SC-SOL-004' THEN 3 ELSE 0 END END"""
WEB3_ALL = f"SELECT h.*, pack_rank, engine_rank, chain, source, {WEB3_POS} AS seq FROM ({WEB3}) h JOIN rules USING (rule_id)"
add("d25_web3", f"SELECT file, line, rule_id, source FROM ({CAPPED.format(order='pack_rank, file, seq, rule_id', src='(' + WEB3_ALL + ')')})", BASE, [RUST])
add("d26_sca", f"""
SELECT file, cve AS rule_id, severity, 'dependency_scanner' AS source, package, installed_version FROM ({STATIC_JOIN})
UNION ALL SELECT 'Cargo.lock', rule_id, severity, 'sca:cargo-audit', package, installed_version FROM ({CARGO_SQL})""", ["lines"], [STATIC_DEPS, ADVISORIES])
EVASION = f"SELECT file, line, 'E001' AS rule_id, evidence, row_number() OVER () AS pos FROM ({union([B64, HEX, CHR_SQL, CONCAT_SQL])}) WHERE NOT {has_any('file', FS.SOURCE_SKIP_DIRS)}"
PACK_POS = case_map("rule_id", {rid: k for pack in L.LANGUAGES for k, (rid, _) in enumerate(L.RULES[pack])}, "0")
SAST = f"""SELECT 'sast' AS engine, file, line, rule_id, severity, cwe, evidence, source FROM
 (SELECT * FROM (SELECT file, line, rule_id, evidence, {PACK_POS} AS pos FROM ({union([SOURCE, PY])}) UNION ALL {EVASION}) JOIN rules USING (rule_id))
 QUALIFY row_number() OVER (PARTITION BY cwe, file, line ORDER BY pack_rank, pos) = 1"""
add("d27_full_scan", f"""
SELECT * FROM ({SAST})
UNION ALL SELECT 'secrets', file, line, 'ENT-SECRET', severity, 'CWE-798', evidence, 'entropy_analyzer' FROM ({secrets_sql(SEEDED_SECRET_LINES, 'ext')})
UNION ALL SELECT engine, file, line, rule_id, severity, cwe, evidence, source FROM ({union([TF_SQL, YAML, WEB3])}) JOIN rules USING (rule_id)
UNION ALL SELECT 'sca', file, 0, cve, severity, 'CWE-1035', evidence, 'dependency_scanner' FROM ({STATIC_JOIN})""", BASE, [RUST, STATIC_DEPS, ADVISORIES, NL_LINES])
SEMGREP = ORACLE["s12_semgrep"]
add("d27_scan_with_semgrep", f"""
SELECT source, file, line, rule_id, cwe FROM ({SAST})
UNION ALL SELECT 'semgrep', file, line, rule_id, cwe FROM (SELECT * FROM ({SEMGREP}) QUALIFY row_number() OVER (PARTITION BY cwe, file, line ORDER BY first_id) = 1)""".replace("AS category", "AS category, event_id AS first_id"), BASE, [NL_LINES])
add("d27_scan_errors", f"""
SELECT path, CASE WHEN size > 9000 THEN 'all' ELSE {pick(['sast', 'iac', 'all'], 'k')} END AS engine,
  CASE WHEN size > 9000 THEN 'oversize' ELSE {pick(['python-unparsed', 'yaml-shape', 'bad-bytes'], 'k')} END AS reason
FROM (SELECT 'bad/' || doc_id || {pick(['.py', '.yaml', '.txt'], 'doc_id % 3')} AS path, doc_id % 3 AS k,
  CASE doc_id % 3 WHEN 0 THEN 7 + strlen(text) WHEN 1 THEN 39 + strlen('# ' || regexp_replace(text, {q(T.LINE_END.replace('x{85}', 'x{0085}'))}, chr(10) || '# ', 'g')) ELSE strlen(text) + 2 END AS size FROM documents)
UNION ALL SELECT path, 'all', 'oversize' FROM seeded WHERE strlen(content) > 9000
UNION ALL SELECT path, 'iac', 'yaml-shape' FROM seeded WHERE name = 'null.yaml' AND strlen(content) <= 9000""", ["seeded"])
SOURCE_DEDUP = f"SELECT * FROM (SELECT *, {PACK_POS} AS pos FROM ({SOURCE}) JOIN rules USING (rule_id)) QUALIFY row_number() OVER (PARTITION BY cwe, file, line ORDER BY pos) = 1"
add("flagship_risk_by_language", f"""
SELECT {LANG_OF} AS language, count(*) AS total, {SCORE} AS risk_score, {COUNTS}, {LEVEL} AS risk_level, {EXIT} AS exit_code
FROM (SELECT *, {case_map('severity', schema.RISK_WEIGHT, '0')} AS weight FROM ({SOURCE_DEDUP})) GROUP BY 1""", BASE)

# --- scalar functions and streams -------------------------------------------

add("e04_collapse_whitespace", f"SELECT doc_id, md5({strip("regexp_replace(text, '[\\s\\v\\x1c-\\x1f\\x{85}\\x{a0}\\p{Z}]+', ' ', 'g')")}) AS digest FROM documents")
add("e06_decoders", "SELECT event_id, event_type || ' ' || props AS from_base64, event_type || ' ' || props AS from_hex FROM events")
add("e07_encoding_class", f"""
SELECT {encoding('w')} AS encoding, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+')) AS w FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT md5(props) FROM events) WHERE w <> '' GROUP BY 1""")


def escape(text):
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = f"replace({text}, {q(raw)}, {q(safe)})"
    return text


add("e13_html_escape", f"SELECT page_id, md5({escape('html')}) AS escaped, md5({unescape('html')}) AS unescaped FROM pages")
add("e14_glob", "SELECT url, url GLOB 'http://*.example.com/??/*' AS g0, url GLOB '*[0-9]' AS g1, regexp_matches(url, '\\.[^h].*#top$') AS g2, starts_with(url, 'https://m.') AS g3 FROM pages")
add("e15_version_keys", f"SELECT l_orderkey, l_linenumber, version, {vkey('version')} < [3, 2] AS below, version IN ('3.1', '3.1.0') AS same, l_orderkey % 12 < 9 AS earlier, true AS before_release FROM deps", ["deps"])
PRINT = "left(sha1('ENT-SECRET|' || replace(file, 'doc/', '') || '|CWE-798|High-entropy ' || encoding || ' string (entropy=' || printf('%.2f', raw) || ')' || CASE WHEN var_name <> '' THEN ' in ''' || var_name || '''' ELSE '' END || '|' || evidence), 16)"
T01 = secrets_sql(DOC_SECRET_LINES, "ext").replace("round(entropy, 3) AS entropy FROM firsts", "entropy AS raw FROM firsts")
add("t01_stream_new_findings", f"""
SELECT any_value(file) AS file, any_value(evidence) AS evidence, 'ENT-SECRET' AS rule_id FROM (SELECT *, {PRINT} AS fingerprint FROM ({T01}))
GROUP BY fingerprint HAVING bool_and(line % 2 <> 0)""", extra=[DOC_LINES])
FACT = "rule_id IN ('P001', 'P003', 'P016')"
add("x01_facts_in_sql", f"SELECT file, line, rule_id FROM ({PY}) WHERE rule_id = 'P007'", ["seeded"])
add("x02_fact_rules", f"""
SELECT file, line, rule_id, CASE rule_id WHEN 'P001' THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM ({PY}) WHERE {FACT}
UNION ALL SELECT file, line, rule_id, 'HIGH' FROM ({YAML})""", ["seeded"])
ONCE = f"""
SELECT any_value(file) AS file, any_value(evidence) AS evidence, 'ENT-SECRET' AS rule_id FROM (SELECT *, {PRINT} AS fingerprint FROM ({T01})) GROUP BY fingerprint"""
add("t01_stream_two_runs", ONCE, extra=[DOC_LINES])
add("t01_stream_remembered", ONCE, extra=[DOC_LINES])
add("t02_stream_decisions", "SELECT page_id, status AS action, target, organization, detail FROM pages JOIN decisions ON url = target", ["decisions"])
