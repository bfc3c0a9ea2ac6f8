"""Hidden payloads: base64, hex escapes, char codes and split strings (E001).

A hit needs a decoded text that is printable ASCII and holds a dangerous token.
Line numbers of the decoders count '\\n' only; split strings use all line ends.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators.linepass import JOINED, Group, found, has_any
from ravelin.schema import hit, no_hits

# Dangerous tokens and the shapes that are decoded.
DANGEROUS = (
    r"(?i:\b(eval|exec|system|popen|subprocess|/bin/sh|/bin/bash|cmd\.exe|"
    r"powershell|Invoke-Expression|IEX|base64_decode|shell_exec|passthru|"
    r"rm\s+-rf|DROP\s+TABLE|DELETE\s+FROM|UNION\s+SELECT|os\.system|"
    r"import\s+os|__import__|require\(|child_process|wget\s|curl\s+-))"
)
BASE64 = r"['\"`]([A-Za-z0-9+/]{16,}={0,2})['\"`]"
HEX = r"((?:\\x[0-9A-Fa-f]{2}){8,})"
CONCAT = r"['\"]\s*[+.]\s*['\"]"
FRAGMENT = r"['\"]([^'\"]*)['\"]"
CHR = r"(?i:chr\(\s*(\d{1,3})\s*\))"
CHR_CHAIN = r"(?i:chr\(\s*\d{1,3}\s*\)(?:\s*[+.]\s*chr\(\s*\d{1,3}\s*\)){2,}+)"
FROM_CHAR_CODE = r"(?i:(?:String\s*\.\s*)?fromCharCode\(\s*([\d,\s]{5,})\))"
PRINTABLE = r"^[\x20-\x7e\t\n\r]+\z"

STRIDE = 1_000_000_000_000  # room for the hits of one decoder


def is_dangerous(text: Column) -> Column:
    return T.search(text, DANGEROUS)


def revealing(decoded: Column) -> Column:
    """The decoded text if it is printable and dangerous, else null."""
    return F.when(decoded.rlike(PRINTABLE) & is_dangerous(decoded), decoded)


def decode_base64(blob: Column) -> Column:
    return F.when(
        F.length(blob) % 4 == 0,
        F.make_valid_utf8(F.try_to_binary(blob, F.lit("base64")).cast("string")),
    )


def decode_hex(blob: Column) -> Column:
    raw = F.unhex(F.replace(blob, F.lit("\\x"), F.lit("")))
    return F.make_valid_utf8(raw.cast("string"))


def decode_codes(codes: Column) -> Column:
    """Text of at least three byte codes; null when one is no byte."""
    bad = F.exists(codes, lambda c: c.isNull() | (c > 255))
    return F.when(
        (F.size(codes) >= 3) & ~F.coalesce(bad, F.lit(True)),
        F.array_join(F.transform(codes, lambda c: F.chr(c)), ""),
    )


def chain_codes(match: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(match, F.lit(T.rx(CHR)), F.lit(1)),
        lambda d: d.try_cast("int"),
    )


def list_codes(match: Column) -> Column:
    inside = F.regexp_extract(match, T.rx(FROM_CHAR_CODE), 1)
    cells = F.transform(F.split(inside, ","), lambda c: T.strip(c))
    return F.transform(F.filter(cells, lambda c: c != ""), lambda c: c.try_cast("int"))


def _hit(kind: str, rank: int, revealed: Column, line: Column, k: Column) -> Column:
    return hit(
        rule_id=F.lit("E001"),
        line=line,
        evidence=revealed,
        seq=F.lit(rank * STRIDE) + line.cast("bigint") * 100_000 + k,
        message=F.concat(
            F.lit(f"{kind} payload, decoded: "), revealed
        ),
        encoding=F.lit(kind),
    )


def _kept(hits: Column) -> Column:
    return F.filter(hits, lambda h: h["evidence"].isNotNull())


def _per_line(
    text: Column, pattern: str, decoder, kind: str, rank: int, word: str | None = None
) -> Column:
    """Decoders whose matches never span a line."""
    possible = text.rlike(pattern)
    if word:
        possible = text.contains(word) & possible
    lines = F.filter(
        T.numbered(F.split(text, "\n", -1)), lambda x: x["s"].rlike(pattern)
    )
    hits = F.flatten(
        F.transform(
            lines,
            lambda x: F.transform(
                F.regexp_extract_all(x["s"], F.lit(pattern), F.lit(1)),
                lambda m, k: _hit(kind, rank, revealing(decoder(m)), x["n"], k),
            ),
        )
    )
    return F.when(possible, _kept(hits)).otherwise(no_hits())


def _spanning(text: Column, pattern: str, codes, rank: int, word: str) -> Column:
    """Char codes may span lines: count the line ends before each match."""
    pattern = T.rx(pattern)

    def newlines(s: Column) -> Column:
        return F.regexp_count(s, F.lit("\n"))

    def with_matches(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        # line ends in the piece before match k and in match k - 1
        steps = F.zip_with(
            F.slice(pieces, 1, F.size(found)),
            F.concat(F.array(F.lit("")), found),
            lambda piece, before: newlines(F.coalesce(piece, F.lit("")))
            + newlines(F.coalesce(before, F.lit(""))),
        )

        # A zero per line end and a one per match: the place of the k-th one,
        # less k, is the number of line ends before it.  Linear in the matches.
        marks = F.flatten(
            F.transform(
                steps, lambda n: F.concat(F.array_repeat(F.lit(0), n), F.array(F.lit(1)))
            )
        )
        places = F.filter(
            F.transform(marks, lambda mark, i: F.when(mark == 1, i)),
            lambda place: place.isNotNull(),
        )
        decoded = F.zip_with(
            found,
            F.transform(places, lambda place, k: place - k + 1),
            lambda m, n: F.struct(revealing(decode_codes(codes(m))).alias("t"), n.alias("n")),
        )
        return F.transform(
            F.filter(decoded, lambda d: d["t"].isNotNull()),
            lambda d, k: _hit("char-code", rank, d["t"], d["n"], k),
        )

    return F.when(
        text.contains("(") & F.lower(text).contains(word) & text.rlike(pattern),
        T.bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_matches),
    ).otherwise(no_hits())


def base64_hits(text: Column) -> Column:
    return _per_line(text, BASE64, decode_base64, "base64", 0)


def hex_hits(text: Column) -> Column:
    return _per_line(text, HEX, decode_hex, "hex", 1, word="\\x")


def charcode_hits(text: Column) -> Column:
    return F.concat(
        _spanning(text, CHR_CHAIN, chain_codes, 2, "chr("),
        _spanning(text, FROM_CHAR_CODE, list_codes, 3, "fromcharcode("),
    )


def file_hits(text: Column) -> Column:
    """Decoders that count line ends themselves or span lines."""
    return F.concat(base64_hits(text), hex_hits(text), charcode_hits(text))


def groups() -> list:
    """Lines of source files where strings are joined."""
    return [Group("language IS NOT NULL", has_any("{s}", ["\"", "'"]), found("{s}", CONCAT), [], clean=True, code=JOINED)]


def joined_hits(line: Column, n: Column) -> Column:
    """The fragments of one line, if they spell a token the line itself does not show."""
    spelled = F.array_join(F.regexp_extract_all(line, F.lit(FRAGMENT), F.lit(1)), "")
    shown = F.when(is_dangerous(spelled), spelled)
    return F.when(
        ~is_dangerous(line) & shown.isNotNull(), F.array(_hit("concat", 4, shown, n, F.lit(0)))
    ).otherwise(no_hits())
