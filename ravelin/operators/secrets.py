"""Entropy-based secret detection over files or any text column.

The work per line is one expression: candidates by regex, a typed struct per
candidate, acceptance as boolean columns, first-wins inside the
line.  The de-duplication keys hold the line number, so no shuffle is needed.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import entropy as E
from ravelin.functions import text as T
from ravelin.operators.linepass import SECRET, Group, has_any, quoted
from ravelin.schema import hit

# What counts as an assignment, as a quoted string, as benign.
ASSIGNMENT = r"([a-zA-Z_][\w.]*?)\s*[:=]\s*[\"']([A-Za-z0-9+/=_\-]{10,})[\"']"
QUOTED = r"[\"']([A-Za-z0-9+/=_\-]{20,})[\"']"
QUOTED_RUN = r"[\"'][A-Za-z0-9+/=_\-]{10,}[\"']"
BENIGN = [
    r"^(?i:[0-9a-f]{32,64})$",
    r"^[0-9a-fA-F]{64}$",
    r"(?i:(?:test|mock|fake|example|placeholder|dummy|sample|xxx))",
]
UUID = r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
ALL_CAPS = r"^[A-Z0-9_]{6,}$"
LONG_HASH = r"^(?i:[0-9a-f]{32,})$"
VERSION = r"^\d+\.\d+\.\d+"
SKIP_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz",
    ".bin", ".exe", ".dll", ".so", ".pyc", ".lock", ".woff", ".woff2", ".ttf",
    ".eot", ".map", ".svg",
]
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build",
    ".next", "vendor",
]
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".java", ".go", ".rb", ".rs", ".c", ".cpp", ".cs",
    ".swift", ".kt", ".php", ".scala", ".clj",
]


def is_minified(text: Column) -> Column:
    """A line over 2000 characters, or a tenth of the head not printable ASCII.

    An explicit guard: no scan leaves a file out unless ``skip_minified`` is set.
    """
    head = F.substring(text, 1, 4096)
    # DEL counts as printable here.
    junk = F.length(F.regexp_replace(head, r"[\x20-\x7f\t\n\r]+", ""))
    long_line = F.exists(T.splitlines(text), lambda s: F.length(s) > 2000)
    return (
        F.when(junk / F.greatest(F.length(head), F.lit(1)) > 0.1, True)
        .when(F.length(text) > 2000, long_line)
        .otherwise(False)
    )


def may_hold_secret(text: Column) -> Column:
    """A quoted run of ten characters is part of every candidate."""
    return text.rlike(QUOTED_RUN)


def is_likely_secret(
    value: Column, name: Column, entropy: Column, encoding: Column, ext: Column
) -> Column:
    """Acceptance of an assignment candidate.

    A benign shape rejects it unless the name speaks for a secret; without such
    a name the threshold rises by 0.6, in code files by 1.0.
    """
    named = E.is_secret_name(name)
    benign = F.lit(False)
    for pattern in BENIGN:
        benign = benign | value.rlike(pattern)
    threshold = E.by_class(encoding, E.THRESHOLD)
    required = (
        F.when(named, threshold)
        .when(ext.isin(CODE_EXTENSIONS), threshold + 1.0)
        .otherwise(threshold + 0.6)
    )
    return (
        (F.length(value) >= E.by_class(encoding, E.MIN_LENGTH))
        & (named | ~benign)
        & (entropy >= required)
    )


def survives_filter(value: Column, confidence: Column) -> Column:
    """False for UUIDs, constants, versions and unnamed hashes."""
    return ~(
        value.rlike(UUID)
        | value.rlike(ALL_CAPS)
        | (value.rlike(LONG_HASH) & (confidence < 70))
        | value.rlike(VERSION)
    )


def assignment_candidates(line: Column) -> Column:
    """array<struct<name, value>> of all assignments on a line."""
    names = F.regexp_extract_all(line, F.lit(T.rx(ASSIGNMENT)), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(T.rx(ASSIGNMENT)), F.lit(2))
    return F.zip_with(
        names,
        values,
        lambda n, v: F.struct(
            F.rtrim(F.lower(n), F.lit("._")).alias("name"), v.alias("value")
        ),
    )


def measured(candidates: Column, context: str) -> Column:
    """Add encoding, entropy and confidence to struct<name, value>."""
    return F.transform(
        candidates,
        lambda c: F.struct(
            c["name"].alias("name"),
            c["value"].alias("value"),
            E.encoding_class(c["value"]).alias("encoding"),
            E.shannon(c["value"]).alias("entropy"),
            (
                F.when(E.is_secret_name(c["name"]), 90.0).otherwise(65.0)
                if context == "assignment"
                else F.lit(45.0)
            ).alias("confidence"),
            F.lit(context).alias("context"),
        ),
    )


def line_secrets(line: Column, ext: Column) -> Column:
    """Accepted candidates of one line, assignments before bare strings."""
    named = F.filter(
        measured(assignment_candidates(line), "assignment"),
        lambda c: is_likely_secret(
            c["value"], c["name"], c["entropy"], c["encoding"], ext
        ),
    )
    bare = F.filter(
        measured(
            F.transform(
                F.regexp_extract_all(line, F.lit(QUOTED), F.lit(1)),
                lambda v: F.struct(F.lit("").alias("name"), v.alias("value")),
            ),
            "standalone",
        ),
        lambda c: c["entropy"] >= E.by_class(c["encoding"], E.THRESHOLD) + 0.5,
    )
    return F.concat(named, bare)


def first_by_prefix(items: Column, width: int | None = None) -> Column:
    """Keep an item unless an earlier one has the same value, or the same first
    ``width`` characters where a width is given."""

    def part(item):
        return item["value"] if width is None else F.substring(item["value"], 1, width)

    return F.filter(
        items,
        lambda c, i: ~F.exists(F.slice(items, 1, i), lambda e: part(e) == part(c)),
    )


def groups(skip_minified: bool = False) -> list:
    """Lines that may hold a secret, behind the file guards: type, folder, minified if asked for."""
    folders = f"arrays_overlap(split(rel, '/'), array({', '.join(map(quoted, SKIP_DIRS))}))"
    files = f"lower(ext) NOT IN ({', '.join(map(quoted, SKIP_EXTENSIONS))}) AND NOT {folders}"
    if skip_minified:
        files += " AND NOT minified"
    return [Group(files, has_any("{s}", ["\"", "'"]), f"{{s}} RLIKE {quoted(QUOTED_RUN)}", [], T.COMMENT_SECRETS, code=SECRET)]


def line_hits(line: Column, n: Column, ext: Column, post_filter: bool = True) -> Column:
    """array<HIT> for one line; ``post_filter=False`` gives the raw candidates."""

    def describe(items: Column) -> Column:
        kept = first_by_prefix(items)
        if post_filter:
            kept = F.filter(kept, lambda c: survives_filter(c["value"], c["confidence"]))
        return F.transform(kept, lambda c, k: to_hit(c, k, n))

    return T.bind(line_secrets(line, F.lower(ext)), describe)


def to_hit(c: Column, k: Column, line: Column) -> Column:
    title = F.concat(
        F.lit("High-entropy "), c["encoding"],
        F.format_string(" string (entropy=%.2f)", c["entropy"]),
        F.when(c["name"] != "", F.concat(F.lit(" in '"), c["name"], F.lit("'")))
        .otherwise(""),
    )
    return hit(
        rule_id=F.lit("ENT-SECRET"),
        line=line,
        evidence=E.mask(c["value"]),
        seq=line.cast("bigint") * 100_000 + k,
        severity=E.secret_severity(c["entropy"], c["name"]),
        title=title,
        message=title,
        confidence=c["confidence"],
        entropy=F.round(c["entropy"], 3),
        encoding=c["encoding"],
        var_name=c["name"],
        context_type=c["context"],
    )
