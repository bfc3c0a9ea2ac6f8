"""Rule table, advisory table and CWE notes as small literal frames.

All of them are fixed in size (about a hundred rows), so joins against them
carry a broadcast hint.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Built-in source rules (id, cwe, severity).  Titles are ours.
SOURCE_RULES = [
    ("P001", "CWE-327", "MEDIUM", "Broken hash function used"),
    ("P002", "CWE-327", "HIGH", "Broken cipher used"),
    ("P003", "CWE-327", "MEDIUM", "Cipher in ECB mode"),
    ("P004", "CWE-295", "HIGH", "Certificate checks switched off"),
    ("P005", "CWE-502", "HIGH", "Object deserialization of raw bytes"),
    ("P006", "CWE-502", "HIGH", "YAML loaded with an object-building loader"),
    ("P007", "CWE-95", "HIGH", "Dynamic code passed to eval or exec"),
    ("P008", "CWE-78", "HIGH", "Shell command through the os module"),
    ("P009", "CWE-78", "HIGH", "Subprocess started through a shell"),
    ("P010", "CWE-89", "HIGH", "SQL text assembled at run time"),
    ("P011", "CWE-79", "MEDIUM", "Template or markup from run-time text"),
    ("P012", "CWE-330", "MEDIUM", "Predictable random value in a security role"),
    ("P013", "CWE-611", "MEDIUM", "XML parsed with entities enabled"),
    ("P014", "CWE-22", "HIGH", "File opened at a path taken from a request"),
    ("P015", "CWE-89", "HIGH", "Run-time SQL handed to a query helper"),
    ("P016", "CWE-643", "HIGH", "XPath text assembled at run time"),
    ("P017", "CWE-90", "HIGH", "LDAP filter assembled without escaping"),
    ("J001", "CWE-95", "HIGH", "Dynamic code passed to eval"),
    ("J002", "CWE-78", "HIGH", "Command with interpolated text"),
    ("J003", "CWE-79", "MEDIUM", "Assembled text written to innerHTML"),
    ("J004", "CWE-327", "MEDIUM", "Broken hash function used"),
    ("J005", "CWE-295", "HIGH", "Certificate checks switched off"),
    ("G001", "CWE-327", "MEDIUM", "Broken hash or cipher used"),
    ("G002", "CWE-295", "HIGH", "Certificate checks switched off"),
    ("G003", "CWE-78", "HIGH", "Command with concatenated text"),
    ("G004", "CWE-89", "HIGH", "SQL text assembled at run time"),
    ("A001", "CWE-327", "MEDIUM", "Broken hash or cipher used"),
    ("A002", "CWE-78", "HIGH", "Command with concatenated text"),
    ("A003", "CWE-89", "HIGH", "SQL text concatenated"),
    ("A004", "CWE-502", "HIGH", "Object stream deserialized"),
    ("A005", "CWE-330", "MEDIUM", "Predictable random value in a security role"),
    ("A006", "CWE-643", "HIGH", "XPath text concatenated"),
    ("H001", "CWE-327", "MEDIUM", "Broken hash function used"),
    ("H002", "CWE-78", "HIGH", "Command with variable text"),
    ("H003", "CWE-89", "HIGH", "SQL text interpolated or concatenated"),
    ("H004", "CWE-502", "HIGH", "unserialize on raw data"),
    ("H005", "CWE-95", "HIGH", "Dynamic code passed to eval"),
    ("H006", "CWE-643", "HIGH", "XPath text interpolated or concatenated"),
    ("R001", "CWE-327", "MEDIUM", "Broken hash function used"),
    ("R002", "CWE-78", "HIGH", "Command with interpolated text"),
    ("R003", "CWE-89", "HIGH", "SQL text interpolated"),
    ("R004", "CWE-502", "HIGH", "Object deserialization of raw data"),
    ("R005", "CWE-95", "HIGH", "Dynamic code passed to eval"),
    ("C001", "CWE-327", "MEDIUM", "Broken hash or cipher used"),
    ("C002", "CWE-78", "HIGH", "Command with concatenated text"),
    ("C003", "CWE-89", "HIGH", "SQL text interpolated or concatenated"),
    ("C004", "CWE-502", "HIGH", "Binary formatter deserialization"),
    ("C005", "CWE-643", "HIGH", "XPath text interpolated or concatenated"),
    ("K001", "CWE-327", "MEDIUM", "Broken hash or cipher used"),
    ("K002", "CWE-78", "HIGH", "Command with assembled text"),
    ("K003", "CWE-89", "HIGH", "SQL text interpolated or concatenated"),
    ("K004", "CWE-502", "HIGH", "Object stream deserialized"),
    ("U001", "CWE-327", "MEDIUM", "Broken hash function used"),
    ("U002", "CWE-78", "HIGH", "Command argument built by format!"),
    ("U003", "CWE-89", "HIGH", "SQL text built by format!"),
    ("X001", "CWE-676", "HIGH", "Unbounded copy function"),
    ("X002", "CWE-78", "HIGH", "system() with assembled text"),
    ("X003", "CWE-327", "MEDIUM", "Broken hash function used"),
]

# Rule id prefix per language.
LANGUAGE_PREFIX = {
    "python": "P", "javascript": "J", "go": "G", "java": "A", "php": "H",
    "ruby": "R", "csharp": "C", "kotlin": "K", "rust": "U", "cpp": "X",
}

# Contract, Solidity, IaC, evasion and secret rules
# (id, chain, severity, category, cwe).  Titles and advice are ours.
OTHER_RULES = [
    # smart contracts on TON and EVM
    ("SC-TON-001", None, "HIGH", "ACCESS_CONTROL", "CWE-284",
     "Sender address never checked", "Compare the sender with a stored owner."),
    ("SC-TON-002", None, "HIGH", "RANDOMNESS", "CWE-338",
     "Predictable randomness", "Use commit-reveal or randomize by logical time."),
    ("SC-TON-003", None, "MEDIUM", "GAS", "CWE-400",
     "Loop without a clear bound", "Bound the number of iterations."),
    ("SC-TON-004", None, "MEDIUM", "LOGIC", "CWE-754",
     "Bounced messages not handled", "Handle the bounced flag and restore state."),
    ("SC-TON-005", None, "LOW", "LOGIC", "CWE-547",
     "Address fixed in code", "Keep privileged addresses in storage."),
    ("SC-COM-001", None, "CRITICAL", "SECRETS", "CWE-798",
     "Credential fixed in contract source", "Move it out of the source and rotate it."),
    ("SC-SOL-001", None, "CRITICAL", "LOGIC", "CWE-841",
     "State written after an external call", "Update state first or use a guard."),
    ("SC-SOL-002", None, "HIGH", "ARITHMETIC", "CWE-190",
     "Old compiler without overflow checks", "Use compiler 0.8 or checked math."),
    ("SC-SOL-003", None, "HIGH", "ACCESS_CONTROL", "CWE-284",
     "Authentication by tx.origin", "Use msg.sender."),
    ("SC-SOL-004", None, "HIGH", "LOGIC", "CWE-252",
     "Result of a low-level call ignored", "Check the returned flag."),
    ("SC-SOL-005", None, "CRITICAL", "ACCESS_CONTROL", "CWE-284",
     "Unguarded selfdestruct", "Restrict it to the owner."),
    ("SC-SOL-006", None, "MEDIUM", "LOGIC", "CWE-829",
     "Decision based on block time", "Avoid block time in decisions."),
    # Solidity line pack
    ("SOL001", None, "CRITICAL", "Reentrancy", "CWE-362",
     "External call may come before the state update", "Change state first, call last."),
    ("SOL002", None, "HIGH", "Access Control", "CWE-284",
     "Comparison with tx.origin", "Compare msg.sender instead."),
    ("SOL003", None, "HIGH", "Integer Overflow", "CWE-190",
     "Unsigned value from unchecked arithmetic", "Use checked arithmetic."),
    ("SOL004", None, "CRITICAL", "Access Control", "CWE-284",
     "Contract can be destroyed", "Restrict or remove selfdestruct."),
    ("SOL005", None, "HIGH", "Unchecked Return", "CWE-703",
     "Low-level call without a check", "Require success after the call."),
    ("SOL006", None, "HIGH", "Randomness", "CWE-338",
     "Block value used as entropy", "Use a verifiable random source."),
    ("SOL007", None, "HIGH", "Access Control", "CWE-284",
     "Open function that may change state", "Add an access modifier."),
    ("SOL008", None, "MEDIUM", "Gas / DoS", "CWE-400",
     "Loop over a growing array", "Page the loop or cap the array."),
    ("SOL009", None, "HIGH", "Access Control", "CWE-284",
     "Owner set to something other than the sender", "Transfer ownership in two steps."),
    ("SOL010", None, "MEDIUM", "Delegatecall", "CWE-682",
     "delegatecall into foreign code", "Keep storage layouts identical."),
    ("SOL011", None, "HIGH", "Reentrancy", "CWE-362",
     "State variable next to an external call", "Use a reentrancy guard."),
    ("SOL012", None, "MEDIUM", "Hash Collision", "CWE-20",
     "Packed encoding of several values", "Use the unpacked encoding."),
    ("SOL013", None, "HIGH", "Initializer", "CWE-284",
     "Initializer open to anyone", "Allow initialization only once."),
    ("SOL014", None, "LOW", "Error Handling", "CWE-703",
     "Revert without a reason", "Give a reason or a custom error."),
    ("SOL015", None, "MEDIUM", "Signature Validation", "CWE-284",
     "Recovered signer may be the zero address", "Reject the zero address."),
    # Solana and CosmWasm
    ("SC-SOL-NA-001", "SOLANA", "CRITICAL", "ACCESS_CONTROL", "CWE-284",
     "Signer never checked", "Require the account to be a signer."),
    ("SC-SOL-NA-002", "SOLANA", "HIGH", "ACCESS_CONTROL", "CWE-284",
     "Account owner never checked", "Compare the owner with the program id."),
    ("SC-SOL-NA-003", "SOLANA", "HIGH", "ARITHMETIC", "CWE-190",
     "Unchecked arithmetic", "Use the checked operations."),
    ("SC-SOL-NA-004", "SOLANA", "MEDIUM", "ACCESS_CONTROL", "CWE-284",
     "Cross-program call", "Check target program and signer seeds."),
    ("SC-SOL-NA-005", "SOLANA", "CRITICAL", "ACCESS_CONTROL", "CWE-284",
     "Cross-program call to any target", "Compare the target with a known id."),
    ("SC-SOL-NA-006", "SOLANA", "HIGH", "LOGIC", "CWE-345",
     "Account data read without its type tag", "Check the discriminator."),
    ("SC-CW-001", "COSMWASM", "HIGH", "ACCESS_CONTROL", "CWE-284",
     "Execute handler without an admin check", "Compare the sender with the admin."),
    ("SC-CW-002", "COSMWASM", "MEDIUM", "LOGIC", "CWE-754",
     "Execute handler ignores attached funds", "State which funds are expected."),
    ("SC-CW-003", "COSMWASM", "HIGH", "LOGIC", "CWE-754",
     "Reply handler ignores the message id", "Dispatch on the message id."),
    ("SC-CW-004", "COSMWASM", "MEDIUM", "LOGIC", "CWE-362",
     "State saved before a sub-message", "Save it in the reply handler."),
    ("SC-CW-005", "COSMWASM", "LOW", "LOGIC", "CWE-547",
     "Address fixed in code", "Pass addresses at instantiation."),
    # infrastructure as code
    ("IAC-TF-001", None, "HIGH", "ENCRYPTION", "CWE-311",
     "Bucket without encryption at rest", "Configure server-side encryption."),
    ("IAC-TF-002", None, "CRITICAL", "NETWORK", "CWE-284",
     "SSH open to the world", "Restrict the source range."),
    ("IAC-TF-008", None, "CRITICAL", "SECRETS", "CWE-798",
     "Credential fixed in configuration", "Use variables or a secrets manager."),
    ("IAC-CF-001", None, "CRITICAL", "NETWORK", "CWE-284",
     "SSH open to the world", "Restrict the source range."),
    ("IAC-K8S-005", None, "CRITICAL", "PRIVILEGE", "CWE-269",
     "Privileged container", "Drop the privileged flag."),
    # hidden payloads and secrets
    ("E001", None, "HIGH", None, "CWE-506",
     "Hidden payload decodes to a dangerous command", "Review what it decodes to."),
    ("ENT-SECRET", None, "LOW", "High Entropy Secret", "CWE-798",
     "High-entropy string", "Remove it, rotate it, keep it in a secrets manager."),
]

# Known advisories, name | cve | severity | first fixed version.
# Summaries are ours.
ADVISORIES = """
django | CVE-2024-38875 | HIGH | 4.2.15 | slow text truncation
django | CVE-2024-27351 | HIGH | 4.2.11 | slow regular expression
django | CVE-2023-43665 | HIGH | 4.2.6 | slow regular expression
django | CVE-2023-36053 | HIGH | 3.2.20 | slow e-mail and URL validation
flask | CVE-2023-30861 | HIGH | 2.3.2 | session cookie may be cached
flask | CVE-2018-1000656 | HIGH | 0.12.3 | memory exhaustion by JSON
werkzeug | CVE-2024-34069 | HIGH | 3.0.3 | debugger code execution
werkzeug | CVE-2023-46136 | HIGH | 3.0.1 | slow multipart parsing
pillow | CVE-2023-50447 | HIGH | 10.2.0 | code execution by image expression
pillow | CVE-2023-44271 | HIGH | 10.0.1 | memory exhaustion
requests | CVE-2024-35195 | MEDIUM | 2.32.2 | certificate check skipped in session
requests | CVE-2023-32681 | MEDIUM | 2.31.0 | header leak on redirect
cryptography | CVE-2024-26130 | HIGH | 42.0.4 | crash on key bundle
cryptography | CVE-2023-49083 | MEDIUM | 41.0.6 | crash on certificate bundle
paramiko | CVE-2023-48795 | MEDIUM | 3.4.0 | handshake prefix truncation
paramiko | CVE-2022-24302 | MEDIUM | 2.10.1 | key file race
aiohttp | CVE-2024-23334 | HIGH | 3.9.2 | path traversal in static files
aiohttp | CVE-2024-27306 | MEDIUM | 3.9.4 | script injection in index pages
urllib3 | CVE-2024-37891 | MEDIUM | 2.2.2 | proxy header leak
urllib3 | CVE-2023-45803 | MEDIUM | 2.0.7 | body kept on redirect
starlette | CVE-2024-47874 | HIGH | 0.40.0 | memory exhaustion by form data
starlette | CVE-2023-29159 | MEDIUM | 0.27.0 | path traversal
pyyaml | CVE-2020-14343 | CRITICAL | 5.4 | code execution in full loader
setuptools | CVE-2024-6345 | CRITICAL | 70.0 | code execution by package URL
certifi | CVE-2023-37920 | HIGH | 2023.7.22 | withdrawn root certificate
idna | CVE-2024-3651 | MEDIUM | 3.7 | slow domain encoding
jinja2 | CVE-2024-34064 | MEDIUM | 3.1.4 | attribute injection
jinja2 | CVE-2024-22195 | MEDIUM | 3.1.3 | attribute injection
sqlalchemy | CVE-2019-7548 | HIGH | 1.3.0 | SQL injection in group by
lxml | CVE-2022-2309 | MEDIUM | 4.9.1 | null pointer
numpy | CVE-2021-33430 | MEDIUM | 1.22 | buffer overflow
pycryptodome | CVE-2023-52323 | MEDIUM | 3.20.0 | timing leak in OAEP
twisted | CVE-2024-41671 | CRITICAL | 24.7.0 | request ordering
twisted | CVE-2023-46137 | MEDIUM | 23.10.0 | response ordering
gunicorn | CVE-2024-1135 | HIGH | 22.0.0 | request smuggling
fastapi | CVE-2024-24762 | HIGH | 0.109.1 | slow form parsing
httpx | CVE-2021-41945 | CRITICAL | 0.23.0 | URL parsing flaw
pyopenssl | CVE-2023-49083 | MEDIUM | 23.3.0 | crash on certificate
tornado | CVE-2023-28370 | MEDIUM | 6.3.2 | open redirect
waitress | CVE-2024-49768 | CRITICAL | 3.0.1 | request race
waitress | CVE-2022-31015 | HIGH | 2.1.2 | worker crash
celery | CVE-2021-23727 | HIGH | 5.2.2 | command injection by task metadata
pydantic | CVE-2024-3772 | MEDIUM | 2.7.0 | slow e-mail validation
lodash | CVE-2021-23337 | HIGH | 4.17.21 | command injection in templates
lodash | CVE-2020-28500 | MEDIUM | 4.17.21 | slow trimming
axios | CVE-2023-45857 | MEDIUM | 1.6.0 | token leak
axios | CVE-2024-39338 | HIGH | 1.7.4 | request forgery
express | CVE-2024-29041 | MEDIUM | 4.19.2 | open redirect
semver | CVE-2022-25883 | HIGH | 7.5.2 | slow version parsing
moment | CVE-2022-31129 | HIGH | 2.29.4 | slow date parsing
path-to-regexp | CVE-2024-45296 | HIGH | 0.1.10 | slow route pattern
ws | CVE-2024-37890 | HIGH | 8.17.1 | crash on many headers
next | CVE-2024-34351 | HIGH | 14.1.1 | request forgery
next | CVE-2024-46982 | CRITICAL | 14.2.10 | cache poisoning
tar | CVE-2021-37713 | HIGH | 6.1.9 | path traversal
braces | CVE-2024-4068 | HIGH | 3.0.3 | memory exhaustion
minimatch | CVE-2022-3517 | HIGH | 3.0.5 | slow pattern expansion
undici | CVE-2024-30260 | MEDIUM | 6.11.1 | header leak
undici | CVE-2024-24758 | MEDIUM | 5.28.4 | header leak
jsonwebtoken | CVE-2022-23529 | HIGH | 9.0.0 | unsafe key object
jsonwebtoken | CVE-2022-23541 | MEDIUM | 9.0.0 | algorithm confusion
node-fetch | CVE-2022-0235 | HIGH | 3.1.1 | header leak on redirect
sharp | CVE-2023-25166 | HIGH | 0.32.1 | crash on image
got | CVE-2022-33987 | MEDIUM | 12.1.0 | redirect to socket
cross-fetch | CVE-2023-26157 | HIGH | 4.0.0 | request forgery
tough-cookie | CVE-2023-26136 | CRITICAL | 4.1.3 | prototype pollution
protobufjs | CVE-2023-36665 | CRITICAL | 7.2.5 | prototype pollution
mysql2 | CVE-2024-21508 | CRITICAL | 3.9.8 | code execution by parameter
sequelize | CVE-2023-22578 | CRITICAL | 6.19.1 | SQL injection
passport | CVE-2022-25896 | MEDIUM | 0.6.0 | session fixation
helmet | CVE-2021-23312 | MEDIUM | 4.0.0 | wrong policy directives
swagger-ui | CVE-2019-17495 | MEDIUM | 3.23.11 | style injection
socket.io | CVE-2022-2421 | CRITICAL | 4.5.2 | loose origin check
"""

# Weakness notes: which classes have one is fixed; names are the public CWE
# names, the two sentences are ours.
CWE_NOTES = [
    ("CWE-327", "Use of a broken or risky cryptographic algorithm",
     "The primitive no longer resists known attacks, so hashes can be forged and data read.",
     "Choose SHA-256 or newer, a password hash for passwords, and an authenticated mode."),
    ("CWE-295", "Improper certificate validation",
     "Without the check anybody on the path can pose as the server.",
     "Keep validation on and add a private root to the trust store if you need one."),
    ("CWE-502", "Deserialization of untrusted data",
     "The format can build any object, which an attacker turns into running code.",
     "Read a data-only format, or allow a short list of types."),
    ("CWE-95", "Code injection",
     "Text that reaches the evaluator runs with the rights of the process.",
     "Replace evaluation by parsing literals or by a table of allowed actions."),
    ("CWE-78", "OS command injection",
     "Text that reaches a shell can append further commands.",
     "Start the program directly with a list of arguments."),
    ("CWE-89", "SQL injection",
     "Text that becomes part of the statement can change what it does.",
     "Send values as bind parameters."),
    ("CWE-79", "Cross-site scripting",
     "Markup from outside runs in the browser of another user.",
     "Escape by default and render fixed templates."),
    ("CWE-330", "Use of insufficiently random values",
     "The next output of an ordinary generator can be computed.",
     "Take security values from the system's secure generator."),
    ("CWE-611", "XML external entity reference",
     "Entities let a document read local files and reach inner services.",
     "Switch off entity resolution and network access in the parser."),
    ("CWE-22", "Path traversal",
     "Dots and slashes in a name lead out of the intended folder.",
     "Keep only the base name and join it to a fixed root."),
    ("CWE-676", "Use of a potentially dangerous function",
     "The function writes without knowing the size of the target.",
     "Use the bounded variant or a string type."),
    ("CWE-643", "XPath injection",
     "Text that becomes part of the expression can select other nodes.",
     "Pass values as XPath variables."),
    ("CWE-90", "LDAP injection",
     "Text that becomes part of the filter can widen it.",
     "Escape values with the filter escaper of the library."),
    ("CWE-506", "Embedded malicious code",
     "Commands that are encoded or split up are a common mark of a backdoor.",
     "Decode it, find out who added it, and remove it."),
    ("CWE-798", "Use of hard-coded credentials",
     "Whoever can read the source can use the credential.",
     "Keep it in a secrets store and replace the leaked one."),
]

# Confirmation notes for assessments; which classes have one is fixed.
ASSESSMENT_NOTES = {
    "CWE-89": "Send a always-true condition to a test copy and compare row counts.",
    "CWE-78": "Append a harmless command inside a throw-away container.",
    "CWE-79": "Submit inert markup to a local page and see whether it renders.",
    "CWE-502": "Load a marker object in a sandbox and see whether it is built.",
    "CWE-327": "Read the code; the choice of primitive is the weakness.",
    "CWE-295": "Offer a self-signed certificate to a test client.",
}
DEFAULT_ASSESSMENT_NOTE = "Read the code in an environment you own."


def advisory_rows() -> list:
    return [
        tuple(part.strip() for part in line.split("|"))
        for line in ADVISORIES.strip().splitlines()
    ]


def _pack(rule_id: str) -> tuple:
    """(engine, engine_rank, pack_rank, source) from the family of a rule id."""
    if rule_id == "E001":
        return ("sast", 0, 2, "evasion")
    if rule_id == "ENT-SECRET":
        return ("secrets", 2, 0, "entropy_analyzer")
    if rule_id.startswith("IAC-"):
        return ("iac", 3, 0, "iac")
    if rule_id.startswith("SC-CW-"):
        return ("web3", 4, 2, "web3:cosmwasm")
    if rule_id.startswith("SC-SOL-NA-"):
        return ("web3", 4, 2, "web3:solana")
    if rule_id.startswith("SC-TON-"):
        return ("web3", 4, 0, "web3:ton")
    if rule_id.startswith("SC-SOL-"):
        return ("web3", 4, 0, "web3:evm")
    if rule_id.startswith("SC-COM-"):
        return ("web3", 4, 0, "web3")
    if rule_id.startswith("SOL"):
        return ("web3", 4, 1, "solidity_scanner")
    return ("sast", 0, 0, "sast")


RULE_SCHEMA = (
    "rule_id string, cwe string, severity string, title string, category string, "
    "chain string, recommendation string, language string, engine string, "
    "engine_rank int, pack_rank int, source string"
)


def rule_rows() -> list:
    language = {prefix: name for name, prefix in LANGUAGE_PREFIX.items()}
    rows = [
        (rid, cwe, sev, title, None, None, None, language[rid[0]], *_pack(rid))
        for rid, cwe, sev, title in SOURCE_RULES
    ]
    rows += [
        (rid, cwe, sev, title, category, chain, advice, None, *_pack(rid))
        for rid, chain, sev, category, cwe, title, advice in OTHER_RULES
    ]
    return rows


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        advisory_rows(),
        "name string, cve string, severity string, fixed_in string, summary string",
    )


def cwe_notes(spark: SparkSession) -> DataFrame:
    rows = [
        (*note, f"https://cwe.mitre.org/data/definitions/{note[0][4:]}.html")
        for note in CWE_NOTES
    ]
    return spark.createDataFrame(
        rows, "kb_cwe string, name string, why string, fix string, ref string"
    )


def assessment_notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(ASSESSMENT_NOTES.items()), "note_cwe string, note string"
    )


def rules_for_language(rules_df: DataFrame, language: str | None) -> DataFrame:
    """Source rules of one language; an unknown language keeps them all."""
    prefix = LANGUAGE_PREFIX.get((language or "").lower())
    source_rules = rules_df.where(F.col("language").isNotNull())
    if prefix is None:
        return source_rules
    return source_rules.where(F.col("rule_id").startswith(prefix))
