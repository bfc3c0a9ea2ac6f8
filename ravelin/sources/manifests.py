"""Dependency manifests to (file, name, version, ecosystem, pos) rows.

Two readings exist, as in the two scanners they feed: the ecosystem reading
(for advisory dumps) and the static reading (for the fixed advisory table).
They differ in small ways, e.g. which part of a Go module path is the name.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.sources.files import in_folder

# Manifest names, skipped folders and line patterns.
NAME_GLOB = (
    "{*[rR]equirements*.txt,package.json,go.mod,[cC]argo.toml,[cC]argo.lock,"
    "[gG]emfile,[gG]emfile.lock,setup.cfg,[pP]ipfile}"
)
ECOSYSTEM_SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build"]
STATIC_SKIP_DIRS = ["node_modules", ".git", "__pycache__"]
STATIC_NAMES = [
    "requirements.txt", "requirements-dev.txt", "requirements-test.txt",
    "package.json", "cargo.toml", "go.mod", "pipfile",
]
REQUIREMENT = r"^([A-Za-z0-9_\-\.]+)\s*[=<>!~]{1,2}\s*([^\s;#,]+)"
BARE_REQUIREMENT = r"^([A-Za-z0-9_\-\.]+)"
GO_MODULE = r"^\s*([\w./\-]+)\s+v([^\s/]+)"
GO_MODULE_STATIC = r"^\s*([^\s]+)\s+v([^\s]+)"
CARGO = (
    r'^([a-z0-9_\-]+)\s*=\s*(?:"([0-9][^"]*)"|\{[^}]*version\s*=\s*"([0-9][^"]*)")'
)
CARGO_STATIC = r"^([a-z0-9_\-]+)\s*=\s*[\"\{]([0-9][^\s\"']+)"
GEM = r"gem\s+['\"]([^'\"]+)['\"]\s*(?:,\s*['\"]([^'\"]+)['\"])?"
PIPFILE = r"^([A-Za-z0-9_\-]+)\s*=\s*[\"\*]([^\"]*)[\"\*]?"
SECTIONS = ["dependencies", "devDependencies", "peerDependencies"]
STATIC_SECTIONS = SECTIONS + ["optionalDependencies"]

# (?m) with \n as the only line end
MULTILINE = "(?md)"

DEPS = "array<struct<name:string,version:string>>"


def _pair(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(T.rx(pattern)), F.lit(group))


def _pairs(text: Column, pattern: str, name=F.lower, version=lambda v: v) -> Column:
    return F.zip_with(
        _all(text, pattern, 1), _all(text, pattern, 2),
        lambda n, v: _pair(name(n), version(v)),
    )


def requirements(text: Column, keep_equals: bool = False) -> Column:
    """Pinned or bare names; options, comments and git links are skipped."""
    lines = F.transform(T.splitlines(text), T.strip)
    wanted = F.filter(lines, lambda s: ~s.rlike(r"^(#|-|git\+|$)"))
    bare = F.transform(wanted, lambda s: F.regexp_replace(s, r"\[.*?\]", ""))

    def parse(s: Column) -> Column:
        version = F.regexp_extract(s, T.rx(REQUIREMENT), 2)
        if not keep_equals:
            version = F.ltrim(version, F.lit("="))
        return _pair(F.lower(F.regexp_extract(s, BARE_REQUIREMENT, 1)), version)

    return F.filter(F.transform(bare, parse), lambda d: d["name"] != "")


def package_json(text: Column, sections: list, strip_chars: str) -> Column:
    """Entries of the dependency sections; text that is no object has none."""
    schema = ", ".join(f"{s} map<string,string>" for s in sections)
    parsed = F.from_json(text, schema)
    entries = F.concat(
        *[
            F.coalesce(F.map_entries(parsed[s]), F.array().cast("array<struct<key:string,value:string>>"))
            for s in sections
        ]
    )
    return F.transform(
        entries, lambda e: _pair(F.lower(e["key"]), F.ltrim(e["value"], F.lit(strip_chars)))
    )


def go_mod(text: Column) -> Column:
    return _pairs(text, MULTILINE + GO_MODULE, name=lambda n: n)


def go_mod_static(text: Column) -> Column:
    return _pairs(
        text, MULTILINE + GO_MODULE_STATIC,
        name=lambda n: F.lower(F.element_at(F.split(n, "/"), -1)),
    )


def cargo(text: Column) -> Column:
    pattern = "(?mdi)" + CARGO
    plain, table = _all(text, pattern, 2), _all(text, pattern, 3)
    versions = F.zip_with(plain, table, lambda a, b: F.when(a != "", a).otherwise(b))
    return F.zip_with(
        _all(text, pattern, 1), versions, lambda n, v: _pair(F.lower(n), v)
    )


def cargo_static(text: Column) -> Column:
    return _pairs(text, MULTILINE + CARGO_STATIC)


def gemfile(text: Column) -> Column:
    return _pairs(text, GEM, version=lambda v: F.ltrim(v, F.lit("~> =")))


def pipfile(text: Column) -> Column:
    return _pairs(text, MULTILINE + PIPFILE, version=lambda v: F.ltrim(v, F.lit("^~>= ")))


def _explode(files: DataFrame, kind: Column, parse: Column, ecosystem: Column) -> DataFrame:
    return (
        files.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            F.col("path").alias("file"),
            ecosystem.alias("ecosystem"),
            F.posexplode(parse).alias("pos", "d"),
        )
        .select("file", "d.name", "d.version", "ecosystem", "pos")
    )


def ecosystem_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies with their ecosystem, from all manifest types."""
    name = F.lower(T.basename(F.col("path")))
    text, kind = F.col("content"), F.col("kind")
    detected = F.when(
        ~in_folder(F.col("rel"), ECOSYSTEM_SKIP_DIRS),
        F.when(name.contains("requirements") & name.endswith(".txt"), "PyPI")
        .when(name == "setup.cfg", "PyPI")
        .when(name == "package.json", "npm")
        .when(name == "go.mod", "Go")
        .when(name.isin("cargo.toml", "cargo.lock"), "crates.io")
        .when(name.isin("gemfile", "gemfile.lock"), "RubyGems"),
    )
    parsed = (
        F.when(kind == "PyPI", requirements(text))
        .when(kind == "npm", package_json(text, SECTIONS, "^~>=<* "))
        .when(kind == "Go", go_mod(text))
        .when(kind == "crates.io", cargo(text))
        .when(kind == "RubyGems", gemfile(text))
    )
    return _explode(files, detected, parsed, kind)


def static_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies for the fixed advisory table; they carry no ecosystem."""
    name = F.lower(T.basename(F.col("path")))
    text, kind = F.col("content"), F.col("kind")
    detected = F.when(
        (name.isin(STATIC_NAMES) | name.endswith("requirements.txt"))
        & ~in_folder(F.col("rel"), STATIC_SKIP_DIRS),
        F.when(name.endswith(".txt"), "requirements").otherwise(name),
    )
    parsed = (
        F.when(kind == "requirements", requirements(text, keep_equals=True))
        .when(kind == "package.json", package_json(text, STATIC_SECTIONS, "^~>=<"))
        .when(kind == "cargo.toml", cargo_static(text))
        .when(kind == "go.mod", go_mod_static(text))
        .when(kind == "pipfile", pipfile(text))
    )
    return _explode(files, detected, parsed, F.lit(None).cast("string"))
