"""Line rules of all packs in one pass over the lines of a file.

A file is split once.  Its lines become rows, a literal prefilter that all packs share drops most
of them, and the patterns run as predicates over the line column: split, explode, prefilter and
patterns are one generated stage.  Only lines with a match leave it, with the number of the rule;
the text leaves it once per file, for the rules that look at whole files (row 0).

Rules are grouped: a group says which files it is for, which sign and which plain words a line must
hold (a text without the sign is not even split), and which lines are comments.  A rule is a predicate over ``s``
(the line), ``n`` (its number from 1) and ``lines`` (all lines of the file, for frames).
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.schema import hit

# Fixed value: what is masked in the evidence of a credential.
QUOTED_VALUE = r"\"[^\"]{4,}\""

#: Codes of rows that are no rule match: the file itself, a line for the secrets pack, a line with
#: strings joined.
FILE, SECRET, JOINED = -1, -2, -3

def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def found(column: str, pattern: str) -> str:
    return f"{column} RLIKE {quoted(T.rx(pattern))}"


def has_any(column: str, words: list) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def after(count: int) -> str:
    """The ``count`` lines after the line, as one text."""
    return f"array_join(slice(lines, n + 1, {count}), '\\n')"


def around(back: int, ahead: int) -> str:
    """Lines n - back .. n + ahead."""
    return f"slice(lines, greatest(n - {back}, 1), n + {ahead} - greatest(n - {back}, 1) + 1)"


class Rule(NamedTuple):
    """``test`` decides; the position of a hit is ``n * scale + shift``."""

    rule_id: str
    test: str
    scale: int
    shift: int
    redacted: bool = False
    title: str | None = None
    confidence: float | None = None


class Group(NamedTuple):
    """``files`` is a condition over the file's columns.  ``sign`` (single characters, nearly as cheap
    as reading the text) and ``hint`` (plain words) are necessary conditions over {s}: texts without
    the sign are not split, lines without sign and hint are not tested.  ``clean`` groups read lines without bad bytes.  Matches of a group
    with a ``code`` are its lines, not rules."""

    files: str
    sign: str
    hint: str
    rules: list
    comment: str | None = None
    clean: bool = False
    code: int | None = None


    def signed(self, column: str) -> str:
        return self.sign.replace("{s}", column)

    def hinted(self, column: str) -> str:
        return f"{self.signed(column)} AND {self.hint.replace('{s}', column)}"


def codes(groups: list) -> list:
    """(group, rule) by code."""
    return [(group, rule) for group in groups for rule in group.rules]


def matched_lines(files: DataFrame, groups: list, kept: list) -> DataFrame:
    """(kept..., content, n, s, code): a row per match, and one with code FILE and n 0 per file.

    ``files`` has ``content``, ``lossy`` and what the groups' conditions name.  ``kept`` columns come with
    every row, so they should be small; ``content`` and columns whose name ends in ``_facts`` come
    with the file's row only.  ``s`` is the line as its group reads it.
    """
    bits = [
        f"IF({g.files} AND (lossy OR {g.signed('content')}), {1 << i}L, 0L)" for i, g in enumerate(groups)
    ]
    facts = [c for c in files.columns if c.endswith("_facts")]
    other = f"content RLIKE {quoted(T.OTHER_LINE_END)} OR {has_any('content', T.WIDE_LINE_ENDS)}"
    split = f"IF({other}, split(content, {quoted(T.LINE_END)}, -1), split(content, '\\n', -1))"
    none = "CAST(array() AS array<string>)"
    file_rows = files.select(
        *kept, "content", "lossy", *facts, F.expr(" + ".join(bits) or "0L").alias("groups")
    ).withColumn("lines", F.expr(f"IF(groups = 0, {none}, {split})"))
    # The outer form adds no inferred filter, which would split every text again.
    rows = file_rows.select(
        "*", F.expr("posexplode_outer(concat(array(CAST(NULL AS STRING)), lines))").alias("n", "raw")
    )
    hints = [f"groups & {1 << i} <> 0 AND {g.hinted('raw')}" for i, g in enumerate(groups)]
    rows = rows.where(" OR ".join(["n = 0", "lossy", *(f"({h})" for h in hints)]))
    rows = rows.withColumn("clean", F.expr(f"IF(lossy, translate(raw, '{T.REPLACEMENT}', ''), raw)"))

    def matches(i: int, group: Group, base: int) -> str:
        s = "clean" if group.clean else "raw"
        ok = [f"groups & {1 << i} <> 0", group.hinted(s)]
        if group.comment:
            ok.append(f"NOT {found(s, group.comment)}")
        if group.code is not None:
            out = f"array({group.code})"
        else:
            tests = [f"IF({r.test.replace('{s}', s)}, {base + k}, CAST(NULL AS INT))" for k, r in enumerate(group.rules)]
            out = f"array({', '.join(tests)})"
        return f"IF({' AND '.join(ok)}, {out}, CAST(array() AS array<int>))"

    parts, base = [], 0
    for i, group in enumerate(groups):
        parts.append(matches(i, group, base))
        base += len(group.rules)
    found_codes = f"concat({', '.join(parts)})" if parts else "CAST(array() AS array<int>)"
    clean = [str(k) for k, (g, _) in enumerate(codes(groups)) if g.clean]
    clean += [str(g.code) for g in groups if g.clean and g.code is not None]
    line = f"IF(code IN ({', '.join(clean)}), clean, raw)" if clean else "raw"
    whole = [F.expr(f"IF(n = 0, {c}, NULL)").alias(c) for c in ["content", *facts]]
    rows = rows.select(
        *kept, "lossy", *whole, "n", "raw", "clean",
        F.expr(f"explode_outer(IF(n = 0, array({FILE}), {found_codes}))").alias("code"),
    )
    return rows.where("code IS NOT NULL").select(*kept, "lossy", "content", *facts, "n", F.expr(line).alias("s"), "code")


def rule_hits(groups: list) -> Column:
    """The hit of a row with a rule's code, as an array."""

    def by_code(value) -> Column:
        return F.get(F.array(*[F.lit(value(rule)) for _, rule in codes(groups)]), F.col("code"))

    n, line = F.col("n").cast("bigint"), T.strip(F.col("s"))
    masked = F.regexp_replace(line, QUOTED_VALUE, '"***"')
    return F.array(
        hit(
            rule_id=by_code(lambda r: r.rule_id),
            line=F.col("n"),
            evidence=F.when(by_code(lambda r: r.redacted), masked).otherwise(line),
            seq=n * by_code(lambda r: r.scale) + by_code(lambda r: r.shift),
            title=by_code(lambda r: r.title),
            confidence=by_code(lambda r: r.confidence),
        )
    )
