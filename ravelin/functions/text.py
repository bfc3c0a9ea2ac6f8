"""Text helpers shared by all packs: decoding, lines, trimming, regex flags."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that are stripped as white space, and what ends a
# line.  Both follow Python's str methods.
WHITESPACE = "".join(
    chr(code)
    for code in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680,
                 *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# All line ends but \\n: those of one byte, spelled out so that the class is a table, and the others.
OTHER_LINE_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}]"
WIDE_LINE_ENDS = [chr(0x2028), chr(0x2029)]
REPLACEMENT = chr(0xFFFD)


def rx(pattern: str) -> str:
    """Turn on Unicode classes, so that \\w, \\s and \\b mean what they do in Python."""
    return "(?U)" + pattern


def search(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, rx(r"\s+"), " "))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; ``body`` returns an array."""
    return F.flatten(F.transform(F.array(value), body))


def splitlines(text: Column) -> Column:
    """Lines of a text; a final line end does not open another line.

    Splitting on one character is several times faster than on the full pattern,
    so texts without the rarer line ends take that way.
    """
    other = text.rlike(OTHER_LINE_END)
    for mark in WIDE_LINE_ENDS:
        other = other | text.contains(mark)
    split = F.when(other, F.split(text, LINE_END, -1)).otherwise(
        F.split(text, "\n", -1)
    )
    return bind(
        split,
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts),
    )


def contains_any(text: Column, words: list) -> Column:
    """Plain substring tests: by far the cheapest way to rule a text out."""
    return reduce(or_, [text.contains(word) for word in words])


def numbered(lines: Column) -> Column:
    """array<struct<n, s>>: 1-based line number and line."""
    return F.transform(lines, lambda s, i: F.struct((i + 1).alias("n"), s.alias("s")))


def decode(content: Column, errors: str = "replace") -> Column:
    """Bytes to text; bad bytes become U+FFFD or, with ``ignore``, vanish.

    With ``ignore`` a U+FFFD that was validly encoded in the file vanishes too.
    """
    text = F.make_valid_utf8(content.cast("string"))
    if errors == "ignore":
        return F.translate(text, REPLACEMENT, "")
    return text


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Suffix with its dot, as written; '' for 'name', '.name' and 'name.'."""
    return F.regexp_extract(path, r"(?s)[^/](\.[^./]+)$", 1)


# First characters of a comment line, per group of packs.
COMMENT_CODE = r"^\s*(//|\*|/\*|#)"
COMMENT_SECRETS = r"^\s*(#|//|/\*|\*|<!--|;)"
COMMENT_SOLIDITY = r"^\s*(//|/\*|\*)"


def is_comment(line: Column, pattern: str = COMMENT_CODE) -> Column:
    return search(line, pattern)


def html_escape(text: Column) -> Column:
    for raw, safe in [
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html_unescape(text: Column) -> Column:
    """The entities that hide quotes and operators in stored pages."""
    for safe, raw in [
        ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
        ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ]:
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def glob_regex(pattern: Column) -> Column:
    """Shell glob to an anchored regex; '*' and '?' also cross '/'."""
    quoted = F.regexp_replace(pattern, r"([.^$+(){}|\\])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[(?![^\]]+\])", r"\\[")
    quoted = F.regexp_replace(quoted, r"\[!", "[^")
    quoted = F.replace(quoted, F.lit("*"), F.lit(".*"))
    quoted = F.replace(quoted, F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), quoted, F.lit(r"\z"))


def glob_head(pattern: Column) -> Column:
    """The literal text before the first wildcard of a glob."""
    return F.regexp_extract(pattern, r"(?s)^[^*?\[]*", 0)


def version_key(version: Column) -> Column:
    """Dotted version as a comparable struct: release numbers, then release above pre-release.

    Numbers of any length compare by value, build metadata (after '+') does not count, and
    trailing zeros do not either: 1.2 and 1.2.0 are the same release, 1.2.0-rc1 is below it.
    Pre-release identifiers compare one by one: numbers by value and below words, and a longer
    list is above its beginning, so 1.2.0-rc < 1.2.0-rc.9 < 1.2.0-rc.10 < 1.2.0-rc.x.
    """
    release = F.regexp_extract(version, r"^[vV=]*([^-+]*)", 1)
    release = F.regexp_replace(release, r"(\.0+)+$", "")
    before = F.regexp_extract(version, r"^[vV=]*[^-+]*-([^+]*)", 1)

    def number(part):
        digits = F.regexp_extract(part, r"^0*(\d*)", 1)
        return F.struct(F.length(digits).alias("n"), digits.alias("digits"))

    def identifier(part):
        word = ~part.rlike(r"^\d+$")
        return F.struct(
            word.alias("word"), number(F.when(word, "").otherwise(part)).alias("number"),
            F.when(word, part).otherwise("").alias("text"),
        )

    key = F.struct(
        F.transform(F.split(release, r"\."), number).alias("release"),
        (before == "").alias("final"),
        F.transform(F.split(before, r"\."), identifier).alias("before"),
    )
    return F.when(version.isNotNull(), key)
