"""Line-pattern rules: nine language packs and the Solidity line pack.

A pack is a short list of (rule id, pattern).  Every pattern needs one of a few
plain words; only texts that hold such a word are split into lines, and only such
lines are tested rule by rule (``linepass``).  Nothing is shuffled.
"""

from ravelin.functions import text as T
from ravelin.operators.linepass import Group, Rule, found, has_any, quoted

# Patterns per language, in the order they are tested.
JAVASCRIPT = [
    ("J001", r"(^|[^.\w])eval\s*\("),
    ("J002", r"\b(exec|execSync|spawn)\s*\([^)]*(`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+)"),
    ("J003", r"\.innerHTML\s*=\s*[^;]*(`[^`]*\$\{|\+)"),
    ("J004", r"createHash\s*\(\s*['\"](md5|sha1)['\"]"),
    ("J005", r"(rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0)"),
]
GO = [
    ("G001", r"\b(md5|sha1|des|rc4)\.New(Cipher)?\s*\("),
    ("G002", r"InsecureSkipVerify\s*:\s*true"),
    ("G003", r"exec\.Command(Context)?\s*\([^)]*(\+|fmt\.Sprintf|\"-c\")"),
    ("G004", r"\.(Query|QueryRow|Exec|QueryContext|ExecContext)\s*\([^)]*(fmt\.Sprintf|\"\s*\+|\+\s*\w)"),
]
JAVA = [
    ("A001", r"(?i:getInstance\s*\(\s*\"(MD5|SHA-?1|DES|DES/|RC4|AES/ECB))"),
    ("A002", r"(Runtime\.getRuntime\(\)\.exec|new\s+ProcessBuilder)\s*\([^)]*\+"),
    ("A003", r"\.(executeQuery|executeUpdate|execute)\s*\(\s*\"[^\"]*\"\s*\+"),
    ("A004", r"new\s+ObjectInputStream\s*\("),
    ("A005", r"new\s+Random\s*\("),
    ("A006", r"\.(evaluate|compile)\s*\(\s*\"[^\"]*\"\s*\+"),
]
PHP = [
    ("H005", r"(^|[^.\w])eval\s*\("),
    ("H002", r"\b(system|exec|shell_exec|passthru|popen|proc_open)\s*\([^)]*(\$|\.)"),
    ("H003", r"(->query|->exec|mysqli_query)\s*\(\s*[\"'][^\"']*(\$\w|[\"']\s*\.\s*\$)"),
    ("H001", r"(^|[^.\w>])(md5|sha1)\s*\("),
    ("H004", r"\bunserialize\s*\("),
    ("H006", r"->(xpath|evaluate)\s*\(\s*[\"'].*(\$\w|[\"']\s*\.\s*\$)"),
]
RUBY = [
    ("R005", r"(^|[^.\w:])eval\s*[\s(]"),
    ("R002", r"(`[^`]*#\{|\b(system|exec)\s*\([^)]*#\{|%x[\{(][^})]*#\{)"),
    ("R003", r"\.(execute|where|find_by_sql|from|order|group)\s*\(\s*[\"'].*#\{"),
    ("R004", r"(Marshal\.load|YAML\.load)\s*\("),
    ("R001", r"Digest::(MD5|SHA1)\b"),
]
CSHARP = [
    ("C001", r"(MD5|SHA1|DES|TripleDES)\.Create\s*\(|new\s+(MD5|SHA1|DES)CryptoServiceProvider"),
    ("C002", r"Process\.Start\s*\([^)]*\+"),
    ("C003", r"(new\s+SqlCommand\s*\(|CommandText\s*=)\s*(\$@?\"|@?\"[^\"]*\"\s*\+)"),
    ("C004", r"new\s+BinaryFormatter\s*\("),
    ("C005", r"\.(SelectNodes|SelectSingleNode)\s*\(\s*(\$@?\"|@?\"[^\"]*\"\s*\+)"),
]
KOTLIN = [
    ("K001", r"(?i:getInstance\s*\(\s*\"(MD5|SHA-?1|DES|DES/|RC4|AES/ECB))"),
    ("K002", r"(Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\s*\([^)]*(\+|\$)"),
    ("K003", r"\.(executeQuery|executeUpdate|execute|rawQuery)\s*\(\s*\"[^\"]*(\$\{?\w|\"\s*\+)"),
    ("K004", r"ObjectInputStream\s*\("),
]
RUST = [
    ("U001", r"\b(Md5::new|Sha1::new|md5::compute)\b"),
    ("U002", r"(\.arg|\.args|Command::new)\s*\(\s*&?format!\s*\("),
    ("U003", r"\b(query|execute|query_as)\s*\(\s*&?format!\s*\("),
]
CPP = [
    ("X001", r"\b(strcpy|strcat|sprintf|gets)\s*\("),
    ("X002", r"\bsystem\s*\([^)]*(\+|c_str\s*\()"),
    ("X003", r"\b(MD5_Init|SHA1_Init|EVP_md5|EVP_sha1)\s*\("),
]
# A rule listed here needs a second pattern on the same line.
GATES = {
    "A005": r"(?i:(token|secret|key|passwd|password|pwd|nonce|salt|otp|session|csrf))",
}
SOLIDITY = [
    ("SOL001", r"\.(transfer|send|call)\s*\{?[^}]*\}?\s*\("),
    ("SOL002", r"tx\.origin\s*=="),
    ("SOL003", r"uint\d*\s+\w+\s*=\s*\w+\s*[+\-\*]"),
    ("SOL004", r"selfdestruct\s*\("),
    ("SOL005", r"\.call\s*\{[^}]*\}\s*\([^)]*\)(?!\s*;?\s*require)"),
    ("SOL006", r"block\.(timestamp|number|difficulty|prevrandao)"),
    ("SOL007", r"function\s+\w+\s*\([^)]*\)\s*(?:public|external)(?!\s+(?:view|pure|returns))"),
    ("SOL008", r"for\s*\([^;]+;\s*\w+\s*<\s*\w+\.length"),
    ("SOL009", r"(owner|admin)\s*=\s*(?!msg\.sender)"),
    ("SOL010", r"delegatecall\s*\("),
    ("SOL011", r"(mapping|uint|address)\s+\w+\s*;\s*\n.*function.*\n.*\.call"),
    ("SOL012", r"abi\.encodePacked\s*\([^)]*,"),
    ("SOL013", r"(initialize|init)\s*\([^)]*\)\s*(?:public|external)"),
    ("SOL014", r"revert\s*\(\s*\)"),
    ("SOL015", r"ecrecover\s*\("),
]
RULES = {
    "javascript": JAVASCRIPT, "go": GO, "java": JAVA, "php": PHP, "ruby": RUBY,
    "csharp": CSHARP, "kotlin": KOTLIN, "rust": RUST, "cpp": CPP, "solidity": SOLIDITY,
}
LANGUAGES = [name for name in RULES if name != "solidity"]
# Words of which a line must hold one to match any rule of the pack.
WORDS = {
    "javascript": [
        "eval", "exec", "spawn", "innerHTML", "createHash", "rejectUnauthorized",
        "NODE_TLS_REJECT_UNAUTHORIZED",
    ],
    "go": [".New", "InsecureSkipVerify", "exec.Command", ".Query", ".Exec"],
    "java": [
        "Runtime.getRuntime", "ProcessBuilder", ".execute", "ObjectInputStream",
        "Random", ".evaluate", ".compile",
    ],
    "php": [
        "eval", "system", "exec", "passthru", "popen", "proc_open", "->query",
        "mysqli_query", "md5", "sha1", "unserialize", "->xpath",
    ],
    "ruby": [
        "eval", "#{", "Marshal.load", "YAML.load", "Digest::",
    ],
    "csharp": [
        ".Create", "CryptoServiceProvider", "Process.Start", "SqlCommand",
        "CommandText", "BinaryFormatter", ".SelectNodes", ".SelectSingleNode",
    ],
    "kotlin": [
        "Runtime.getRuntime", "ProcessBuilder", ".execute", ".rawQuery",
        "ObjectInputStream",
    ],
    "rust": ["Md5::new", "Sha1::new", "md5::compute", "format!"],
    "cpp": ["strcpy", "strcat", "sprintf", "gets", "system", "MD5_Init", "SHA1_Init", "EVP_"],
    "solidity": [
        ".transfer", ".send", ".call", "tx.origin", "uint", "selfdestruct", "block.",
        "function", "for", "owner", "admin", "delegatecall", "mapping", "address",
        "encodePacked", "init", "revert", "ecrecover",
    ],
}
# Signs of which a line must hold one; nearly as cheap to look for as reading the text.
SIGNS = {
    "javascript": ["(", "=", "rejectUnauthorized"], "go": ["(", "InsecureSkipVerify"], "java": ["("],
    "php": ["("], "ruby": ["(", "#", "eval", "Digest"], "csharp": ["(", "\"", "CryptoServiceProvider"],
    "kotlin": ["("], "rust": ["(", "::"], "cpp": ["("], "solidity": ["(", "=", "block."],
}
# The same, for rules that ignore case; compared in lower case.
FOLDED_WORDS = {"java": ["getinstance"], "kotlin": ["getinstance"]}
# The Solidity pack numbers hits rule by rule, the others line by line.
RULE_STRIDE = 1_000_000_000




def _test(rule_id: str, pattern: str) -> str:
    test = found("{s}", pattern)
    return f"{test} AND {found('{s}', GATES[rule_id])}" if rule_id in GATES else test


def language_groups() -> list:
    """The nine line-pattern languages, routed by language."""
    groups = []
    for name in LANGUAGES:
        hint = has_any("{s}", WORDS[name])
        if name in FOLDED_WORDS:
            hint = f"({hint} OR {has_any('lower({s})', FOLDED_WORDS[name])})"
        rules = [Rule(rid, _test(rid, pattern), 100, k) for k, (rid, pattern) in enumerate(RULES[name])]
        groups.append(Group(f"language <=> '{name}'", has_any("{s}", SIGNS[name]), hint, rules, T.COMMENT_CODE, clean=True))
    return groups


def solidity_groups() -> list:
    """The Solidity line pack for ``.sol`` files outside ``.git``; it counts hits rule by rule."""
    rules = [
        Rule(rid, _test(rid, pattern), 1, k * RULE_STRIDE, confidence=75.0)
        for k, (rid, pattern) in enumerate(SOLIDITY)
    ]
    files = "lower(ext) = '.sol' AND NOT array_contains(split(rel, '/'), '.git')"
    return [Group(files, has_any("{s}", SIGNS["solidity"]), has_any("{s}", WORDS["solidity"]), rules, T.COMMENT_SOLIDITY)]


def added_groups(added: list) -> list:
    """Rules added by a user: (rule id, language, pattern, ...) rows."""
    groups = []
    for name in sorted({row[1] for row in added}):
        rules = [
            Rule(rid, found("{s}", pattern), 100, k)
            for k, (rid, pattern) in enumerate((r[0], r[2]) for r in added if r[1] == name)
        ]
        groups.append(Group(f"language <=> {quoted(name)}", "true", "true", rules, T.COMMENT_CODE, clean=True))
    return groups
