"""Scan plans: files -> findings.

All packs of a scan share one pass: parsed facts and rules on whole texts are columns
over the ``files`` row, line rules are predicates over its lines, split once for all
packs.  The source is read once and nothing is shuffled until findings (a tiny share
of the input) are de-duplicated or counted.
"""

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import catalog, schema
from ravelin.functions import tables
from ravelin.functions import text as T
from ravelin.operators import (
    algebra, contracts, evasion, iac, linepass, linerules, pyrules, secrets,
)
from ravelin.operators import dependencies as deps
from ravelin.sources import files as S
from ravelin.sources import manifests

PACKS = [
    "python", "lines", "evasion", "secrets", "iac", "contracts", "solidity", "multichain",
]
ENGINE_PACKS = {
    "sast": ["python", "lines", "evasion"],
    "secrets": ["secrets"],
    "iac": ["iac"],
    "web3": ["contracts", "solidity", "multichain"],
}
WEB3_CAP = 3  # findings shown per chain when caps are on


def with_facts(files: DataFrame, packs: list, tolerant_yaml: bool = False) -> DataFrame:
    """Add the columns the packs share: routing, text variants, parsed facts."""
    ext = F.lower("ext")
    out = files.withColumns(
        {
            "language": F.when(
                S.is_scannable(F.col("rel"), F.col("ext"), F.col("length")), S.language(ext)
            ),
            "source_text": S.without_bad_bytes(F.col("content"), F.col("lossy")),
            "yaml_kind": iac.yaml_kind(F.col("ext"), F.col("content")),
        }
    )
    if "multichain" in packs:
        rust = (ext == ".rs") & ~S.in_folder(F.col("rel"), ["__pycache__", "target"])
        out = out.withColumn("chain", F.when(rust, contracts.chain_of(F.col("content"))))
    # Both readers in one step, so that rows pass Python once.
    parsed = {}
    if "python" in packs:
        parsed["py_facts"] = pyrules.facts(F.col("language") == "python", F.col("source_text"))
    if "iac" in packs:
        parsed["yaml_facts"] = iac.yaml_facts(F.col("yaml_kind"), F.col("content"), tolerant_yaml)
    if parsed:
        out = out.withColumns(parsed)
    return out


def line_groups(packs: list, substring_guards: bool = False, skip_minified: bool = False) -> list:
    """Line rules of the packs that have some."""
    groups = []
    if "lines" in packs:
        groups += linerules.language_groups()
    if "evasion" in packs:
        groups += evasion.groups()
    if "secrets" in packs:
        groups += secrets.groups(skip_minified)
    if "contracts" in packs:
        groups += contracts.groups(substring_guards)
    if "solidity" in packs:
        groups += linerules.solidity_groups()
    if "multichain" in packs:
        groups += contracts.multichain_groups()
    return groups


def file_hits(pack: str) -> Column:
    """Hits of a pack's rules on whole texts, over the columns of ``with_facts``.

    Building the expression takes longer than planning it, so it is kept.
    """
    return _file_hits(pack, id(SparkContext._gateway))


@lru_cache(maxsize=None)
def _file_hits(pack: str, gateway: int) -> Column:
    ext, low, content = F.col("ext"), F.lower("ext"), F.col("content")
    source, language = S.without_bad_bytes(content, F.col("lossy")), F.col("language")
    none = schema.no_hits()
    if pack == "python":
        return pyrules.python_hits(F.col("py_facts"), source)
    if pack == "evasion":
        return F.when(language.isNotNull(), evasion.file_hits(source)).otherwise(none)
    if pack == "iac":
        return iac.iac_hits(ext, content, F.col("yaml_facts"))
    if pack == "contracts":
        return contracts.contract_file_hits(low, content)
    if pack == "multichain":
        return contracts.multichain_file_hits(F.col("chain"), content)
    if pack in ("lines", "secrets", "solidity"):
        return none
    raise ValueError(f"unknown pack {pack!r}")


def detect(
    files: DataFrame, packs: list | None = None, tolerant_yaml: bool = False,
    substring_guards: bool = False, skip_minified: bool = False,
) -> DataFrame:
    """Findings of the given packs, before de-duplication.  No file is left out unless
    ``skip_minified`` keeps minified ones from the secrets pack."""
    packs = PACKS if packs is None else packs
    whole = F.concat(*[file_hits(p) for p in packs])
    facts = with_facts(files, packs, tolerant_yaml)
    if skip_minified:
        facts = facts.withColumn("minified", secrets.is_minified(F.col("content")))
    return as_findings(_hits(facts, line_groups(packs, substring_guards, skip_minified), whole))


def _hits(facts: DataFrame, groups: list, whole: Column) -> DataFrame:
    """(path, hit...) of line rules and of the columns over whole files."""
    if not groups:
        return facts.select("path", F.inline(whole))
    kept = [c for c in ("path", "rel", "ext", "language", "chain") if c in facts.columns]
    rows = linepass.matched_lines(facts, groups, kept)
    code, line, n = F.col("code"), F.col("s"), F.col("n")
    hits = F.when(code == linepass.FILE, whole)
    if any(g.code == linepass.SECRET for g in groups):
        hits = hits.when(code == linepass.SECRET, secrets.line_hits(line, n, F.col("ext")))
    if any(g.code == linepass.JOINED for g in groups):
        hits = hits.when(code == linepass.JOINED, evasion.joined_hits(line, n))
    if linepass.codes(groups):
        hits = hits.otherwise(linepass.rule_hits(groups))
    return rows.select("path", F.inline(hits))


def detect_added(files: DataFrame, added: list) -> DataFrame:
    """Findings of rules given as rows (rule id, language, pattern, cwe, severity,
    title).  The rows are part of the plan, as the built-in rules are."""
    rows = _hits(with_facts(files, []), linerules.added_groups(added), schema.no_hits())
    table = files.sparkSession.createDataFrame(
        [(r[0], r[3], r[4], r[5], None, None, None, r[1], "sast", 0, 0, "sast") for r in added],
        catalog.RULE_SCHEMA,
    )
    return as_findings(rows, table)


READERS = {
    "python": "python_facts(IF(language = 'python', source_text, NULL))",
    "yaml": "yaml_facts(yaml_kind, content)",
}


def detect_facts(files: DataFrame, added: list) -> DataFrame:
    """Findings of rules given as rows (rule id, reader, predicate, cwe, severity, title): a predicate
    is SQL over one fact row ``f`` of the Python or YAML reader."""
    tables.register(files.sparkSession)
    parts = []
    for reader, call in READERS.items():
        mine = [(k, row) for k, row in enumerate(added) if row[1] == reader]
        if mine:
            tests = ", ".join(f"IF({row[2]}, {k}, NULL)" for k, row in mine)
            ids = F.array(*[F.lit(row[0]) for row in added])
            facts = files.sparkSession.sql(
                f"SELECT path, content, f, explode(array({tests})) AS k FROM (SELECT path, content, struct(f.*) AS f"
                f" FROM {{files}}, LATERAL {call} f)",
                files=with_facts(files, []),
            ).where("k IS NOT NULL")
            line = F.coalesce(F.col("f.line"), F.lit(0)) if reader == "python" else F.lit(0)
            text = F.coalesce(F.get(T.splitlines(F.col("content")), line - 1), F.lit(""))
            evidence = T.strip(text) if reader == "python" else F.concat_ws(" ", "f.kind", "f.name")
            one = schema.hit(rule_id=F.get(ids, F.col("k")), line=line, evidence=evidence, seq=line.cast("bigint") * 1000 + F.col("k"))
            parts.append(facts.select("path", one.alias("h")).select("path", "h.*"))
    table = files.sparkSession.createDataFrame(
        [(r[0], r[3], r[4], r[5], None, None, None, r[1], "sast", 0, 0, "sast") for r in added],
        catalog.RULE_SCHEMA,
    )
    return as_findings(algebra.union_all(parts), table)


def as_findings(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Join hits with the rule table and lay them out as findings."""
    rules = catalog.rules(rows.sparkSession) if rules is None else rules
    rule_table = rules.select(
        "rule_id", "cwe", "category", "chain", "recommendation", "engine",
        "engine_rank", "pack_rank", "source",
        F.col("severity").alias("rule_severity"), F.col("title").alias("rule_title"),
    )
    joined = rows.join(F.broadcast(rule_table), "rule_id")
    title = F.coalesce("title", "rule_title")
    message = F.coalesce("message", "rule_title")
    return schema.conform(
        joined.withColumns(
            {
                "severity": F.coalesce("severity", "rule_severity"),
                "title": title,
                "message": message,
                "description": message,
                "file": F.col("path"),
            }
        )
    )


def errors(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, engine, reason) of files that a pack could not read as they stand.

    Reasons: ``oversize`` (longer than ``max_bytes``, where that is given; such a file is not
    parsed), ``python-unparsed`` (no Python facts), ``yaml-shape`` (a document of the file gave
    no facts), ``bad-bytes`` (text was decoded with replacements).  ``sources.files.unread`` adds
    those of a tree that never became rows.
    """
    big = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    small = files.withColumns(
        {"oversize": big, "content": F.when(~big, F.col("content")), "lossy": F.col("lossy") & ~big}
    )
    facts = with_facts(small, ["python", "iac"])

    def told(column, engine):
        reasons = F.array_distinct(
            F.transform(F.filter(column, lambda f: f["kind"] == "error"), lambda f: f["name"])
        )
        return F.transform(
            F.coalesce(reasons, F.array().cast("array<string>")),
            lambda r: F.struct(F.lit(engine).alias("engine"), r.alias("reason")),
        )

    def whole(when, reason):
        one = F.array(F.struct(F.lit("all").alias("engine"), F.lit(reason).alias("reason")))
        return F.when(when, one).otherwise(F.array().cast("array<struct<engine:string,reason:string>>"))

    bad = F.concat(
        told(F.col("py_facts"), "sast"), told(F.col("yaml_facts"), "iac"),
        whole(F.col("lossy"), "bad-bytes"), whole(F.col("oversize"), "oversize"),
    )
    return facts.select("path", F.inline(bad))


def web3_findings(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Contract findings; with ``cap`` 2 x cap from the contract pack and cap
    from the Solidity pack and from each further chain."""
    found = detect(files, ENGINE_PACKS["web3"])
    return found if cap is None else algebra.cap_web3(found, cap)


def sca_findings(
    files: DataFrame, osv: DataFrame | None = None, cargo_audit: DataFrame | None = None
) -> DataFrame:
    """Dependency findings: advisory matches if there are any, else the fixed
    table; cargo-audit rows come on top."""
    static = deps.static_findings(manifests.static_dependencies(files))
    found = static
    if osv is not None:
        primary = deps.osv_findings(manifests.ecosystem_dependencies(files), osv)
        found = algebra.primary_or_fallback(primary, static)
    if cargo_audit is not None:
        found = found.unionByName(schema.conform(cargo_audit))
    return found


def scan(
    files: DataFrame,
    engines: list | None = None,
    osv: DataFrame | None = None,
    semgrep: DataFrame | None = None,
    slither: DataFrame | None = None,
    cargo_audit: DataFrame | None = None,
    manifest_files: DataFrame | None = None,
    web3_cap: int | None = None,
    tolerant_yaml: bool = False,
) -> DataFrame:
    """Full scan.  ``engines`` switches engines; external results are merged in.

    Manifests form the only second branch over the files; pass
    ``manifest_files`` (read with a name filter) to keep that branch small.
    """
    engines = schema.ENGINES if engines is None else engines
    packs = [p for e in engines if e != "sca" for p in ENGINE_PACKS[e]]
    parts = []
    if packs:
        found = detect(files, packs, tolerant_yaml)
        parts.append(found if web3_cap is None else algebra.cap_web3(found, web3_cap, mixed=True))
    if "sast" in engines and semgrep is not None:
        parts.append(schema.conform(semgrep))
    if "web3" in engines and slither is not None:
        parts.append(schema.conform(slither))
    if "sca" in engines:
        source = files if manifest_files is None else manifest_files
        parts.append(sca_findings(source, osv, cargo_audit))
    return algebra.dedup_sast(algebra.union_all(parts))


def tree_glob(packs: list) -> str | None:
    """File names that the packs look at, as one glob; None where that is every file."""
    if "secrets" in packs or not packs:
        return None
    suffixes = []
    if {"python", "lines", "evasion"} & set(packs):
        suffixes += S.LANGUAGE
    if "iac" in packs:
        suffixes += [".tf", ".yml", ".yaml"]
    if {"contracts", "solidity"} & set(packs):
        suffixes += [*contracts.TON_EXTENSIONS, ".sol"]
    if "multichain" in packs:
        suffixes.append(".rs")
    # Suffixes count in any case.
    names = ["*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in sorted(set(suffixes))]
    return "{" + ",".join(names) + "}"


def scan_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Scan a folder; manifests are read a second time, by name only.

    Only files that a pack of the ``engines`` looks at are listed and read; those no row can
    hold are left out and told by ``sources.files.unread``.
    """
    engines = options.get("engines") or schema.ENGINES
    return scan(
        S.read_tree(spark, root, glob=tree_glob([p for e in engines if e != "sca" for p in ENGINE_PACKS[e]])),
        manifest_files=S.read_tree(spark, root, glob=manifests.NAME_GLOB),
        **options,
    )
