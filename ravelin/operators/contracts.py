"""Smart-contract packs: TON, EVM, Solana and CosmWasm.

Rules test the whole text, a line, or a frame of lines around one.  Line rules are
predicates of the shared line pass; rules on the whole text or on its first line
of a kind are columns over the file.  Frames are slices of the file's line array,
so a file needs no window and no shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators.linepass import Group, Rule, after, around, found, has_any, quoted
from ravelin.schema import hit, no_hits

# File types and patterns.
TON_EXTENSIONS = [".fc", ".func", ".tolk"]
CREDENTIAL = r"(?i:(private_key|secret_key|mnemonic|seed)\s*=\s*\"[^\"]{8,}\")"
TON = {
    "sender": r"(?i:get_sender\(\)|sender_address)|load_msg_addr\b",
    "bounce": r"(?i:bounced\$)",
    "random": r"(?i:\brandom\(\s*\)|\bnow\(\s*\)\s*%)",
    "loop": r"(?i:\brepeat\s*\(|while\s*\(true\))",
    "address": r"addr_none|\"[EUk][Qq][A-Za-z0-9_\-]{44,48}\"",
}
EVM = {
    "pragma": r"pragma\s+solidity\s+([^;]+);",
    "origin": r"\btx\.origin\b",
    "guarded": r"require|if\s*\(",
    "destroy": r"\bselfdestruct\s*\(|\bsuicide\s*\(",
    "time": r"\bblock\.timestamp\b|\bnow\b",
    "decision": r"require|if\s*\(|<=|>=|==",
    "external": r"\.(call|delegatecall|transfer|send)\s*[\(\{]",
    "low_level": r"\.call\{[^}]*\}\s*\(|\.call\s*\(",
    "write": r"\b\w+\s*[\+\-]?=\s*\w+|\bbalances?\s*\[",
}
# Words of which a line must hold one to match any line rule.
EVM_WORDS = ["tx.origin", "selfdestruct", "suicide", "block.timestamp", "now", ".call", "\""]
EVM_GUARDS = ["onlyOwner", "require(msg.sender", "modifier"]
SOLANA = {
    "signer": r"(?i:\.is_signer)",
    "owner": r"(?i:\.owner\s*==|check_id\s*\(|owner\s*\.\s*key)",
    "arithmetic": r"\b(\w+)\s*\+=\s*|\b(\w+)\s*\-=\s*|\b(\w+)\s*\*=\s*",
    "checked": r"\.(checked_add|checked_sub|checked_mul|saturating_add|saturating_sub)\s*\(",
    "invoke": r"\binvoke\s*\(|\binvoke_signed\s*\(",
    "any_target": r"(?i:invoke\s*\(\s*&\s*\w+_info\.clone\(\))",
    "unchecked": r"(?i:try_from_slice_unchecked|deserialize_unchecked)",
    "framework": r"#\[account\(",
    "framework_signer": r"(?i:Signer\s*<|#\[account\([^)]*signer)",
}
COSMWASM = {
    "admin": r"(?i:ADMIN\.load|admin\s*==\s*info\.sender|ensure_admin|only_owner)",
    "execute": r"(?i:pub fn execute\s*\(|ExecuteMsg::)",
    "funds": r"(?i:info\.funds|must_pay|nonpayable|one_coin)",
    "reply": r"pub fn reply\s*\(",
    "reply_id": r"REPLY_ID|reply_id|msg\.id\s*==",
    "save": r"(?i:\bSAVE\b|\bstore\(\)|\.save\s*\()",
    "sub_message": r"SubMsg::reply_on_success|SubMsg::new|SubMsg::reply_always",
    "address": r"\"cosmos[0-9a-z]{39}\"|\"osmo[0-9a-z]{39}\"|\"juno[0-9a-z]{39}\"",
}
COSMWASM_MARKERS = ["cosmwasm_std", "cw_storage_plus", "ExecuteMsg"]
SOLANA_MARKERS = ["solana_program", "anchor_lang", "AccountInfo"]

LATE = 1_000_000_000_000  # position of rules reported after all line rules


def chain_of(text: Column) -> Column:
    """Chain of a Rust source; CosmWasm is tested first."""
    return F.when(T.contains_any(text, COSMWASM_MARKERS), "COSMWASM").when(
        T.contains_any(text, SOLANA_MARKERS), "SOLANA"
    )


def is_old_compiler(text: Column) -> Column:
    """The first pragma asks for a 0.x compiler with x below 8."""
    wanted = F.regexp_extract(text, T.rx(EVM["pragma"]), 1)
    major = F.regexp_extract(wanted, r"(\d+)\.(\d+)", 1).try_cast("int")
    minor = F.regexp_extract(wanted, r"(\d+)\.(\d+)", 2).try_cast("int")
    return F.coalesce((major == 0) & (minor < 8), F.lit(False))


def after_lines(lines: Column, n: Column, count: int) -> Column:
    """The ``count`` lines that follow line ``n``, as one text."""
    return F.array_join(F.slice(lines, n + 1, F.lit(count)), "\n")


def window(lines: Column, n: Column, back: int, ahead: int) -> Column:
    """Lines n-back .. n+ahead."""
    start = F.greatest(n - back, F.lit(1))
    return F.slice(lines, start, n + ahead - start + 1)


def at_line(rule_id, x: Column, seq: Column, evidence: Column | None = None, **more):
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    return hit(
        rule_id=rule,
        line=x["n"],
        evidence=T.strip(x["s"]) if evidence is None else evidence,
        seq=seq,
        **more,
    )


def at_file(rule_id: str, when: Column, seq: int) -> Column:
    return F.when(
        when, hit(rule_id=F.lit(rule_id), line=F.lit(0), seq=F.lit(seq))
    )


def _matching(lines: Column, pattern: str) -> Column:
    return F.filter(T.numbered(lines), lambda x: T.search(x["s"], pattern))


def _credential(shift: int, scale: int = 100, title: str | None = None) -> Rule:
    return Rule("SC-COM-001", found("{s}", CREDENTIAL), scale, shift, redacted=True, title=title)


def groups(substring_guards: bool = False) -> list:
    """Line rules of TON and EVM files.

    The guard of SC-SOL-005 only counts when a whole line equals it; with
    ``substring_guards`` it may stand anywhere in the ten lines.
    """
    frame = around(9, 0)
    if substring_guards:
        guarded = has_any(f"array_join({frame}, '\\n')", EVM_GUARDS)
    else:
        guarded = f"arrays_overlap({frame}, array({', '.join(map(quoted, EVM_GUARDS))}))"
    unchecked = f"NOT {found(after(4), 'success|require')}"
    ton = [
        Rule("SC-TON-002", found("{s}", TON["random"]), 100, 0),
        Rule("SC-TON-003", found("{s}", TON["loop"]), 100, 1),
        Rule("SC-TON-005", found("{s}", TON["address"]), 100, 2),
        _credential(3),
    ]
    evm = [
        Rule("SC-SOL-003", f"{found('{s}', EVM['origin'])} AND {found('{s}', EVM['guarded'])}", 100, 0),
        Rule("SC-SOL-005", f"{found('{s}', EVM['destroy'])} AND NOT {guarded}", 100, 1),
        Rule("SC-SOL-006", f"{found('{s}', EVM['time'])} AND {found('{s}', EVM['decision'])}", 100, 2),
        Rule("SC-SOL-004", f"{found('{s}', EVM['low_level'])} AND {unchecked}", 100, 3),
        _credential(2 * LATE, 1, "Credential fixed in Solidity source"),
    ]
    return [
        Group(f"lower(ext) IN ({', '.join(map(quoted, TON_EXTENSIONS))})", has_any("{s}", ["(", "\"", "addr_none"]), "true", ton),
        Group("lower(ext) = '.sol'", has_any("{s}", ["(", "=", "<", ">", "\"", "require"]), has_any("{s}", EVM_WORDS), evm),
    ]


def multichain_groups() -> list:
    """Line rules of Solana and CosmWasm sources."""
    solana = Rule("SC-SOL-NA-006", found("{s}", SOLANA["unchecked"]), 100, 0)
    cosmwasm = Rule("SC-CW-005", found("{s}", COSMWASM["address"]), 100, 0)
    return [
        Group("chain <=> 'SOLANA'", "contains({s}, '_')", "true", [solana]),
        Group("chain <=> 'COSMWASM'", "contains({s}, '\"')", "true", [cosmwasm]),
    ]


def first_hit(text: Column, pattern: str, make, frame=None) -> Column:
    """``make(x)`` for the first line with the pattern (and ``frame(lines, x)``), for texts that hold the
    pattern at all: those without it are not split."""

    def of_lines(lines):
        matching = _matching(lines, pattern)
        if frame is not None:
            matching = F.filter(matching, lambda x: frame(lines, x))
        return F.transform(F.slice(matching, 1, 1), make)

    return F.when(T.search(text, pattern), T.bind(T.splitlines(text), of_lines)).otherwise(no_hits())


def ton_file_hits(text: Column) -> Column:
    return F.array_compact(
        F.array(
            at_file("SC-TON-001", ~T.search(text, TON["sender"]), 0),
            at_file(
                "SC-TON-004",
                text.contains("recv_internal") & ~T.search(text, TON["bounce"]),
                1,
            ),
        )
    )


def evm_file_hits(text: Column) -> Column:
    old = at_file("SC-SOL-002", is_old_compiler(text) & ~text.contains("SafeMath"), 0)
    first_reentrant = first_hit(
        text, EVM["external"], lambda x: at_line("SC-SOL-001", x, F.lit(LATE), F.lit(None)),
        lambda lines, x: T.search(after_lines(lines, x["n"], 8), EVM["write"]),
    )
    return F.concat(F.array_compact(F.array(old)), first_reentrant)


def solana_file_hits(text: Column) -> Column:
    entry = text.contains("process_instruction")
    framework_signer = T.search(text, SOLANA["framework_signer"])
    file_level = F.array_compact(
        F.array(
            at_file(
                "SC-SOL-NA-001",
                entry & ~T.search(text, SOLANA["signer"]) & ~framework_signer,
                0,
            ),
            at_file(
                "SC-SOL-NA-002",
                entry
                & ~T.search(text, SOLANA["owner"])
                & ~T.search(text, SOLANA["framework"]),
                1,
            ),
        )
    )
    arithmetic = first_hit(
        text, SOLANA["arithmetic"], lambda x: at_line("SC-SOL-NA-003", x, F.lit(2))
    )
    invoke = first_hit(
        text, SOLANA["invoke"],
        lambda x: at_line(
            F.when(T.search(x["s"], SOLANA["any_target"]), "SC-SOL-NA-005")
            .otherwise("SC-SOL-NA-004"),
            x,
            F.lit(3),
        ),
    )
    return F.concat(
        file_level,
        F.when(T.search(text, SOLANA["checked"]), no_hits()).otherwise(arithmetic),
        invoke,
    )


def cosmwasm_file_hits(text: Column) -> Column:
    execute = T.search(text, COSMWASM["execute"])
    file_level = F.array_compact(
        F.array(
            at_file("SC-CW-001", execute & ~T.search(text, COSMWASM["admin"]), 0),
            at_file("SC-CW-002", execute & ~T.search(text, COSMWASM["funds"]), 1),
            at_file(
                "SC-CW-003",
                T.search(text, COSMWASM["reply"])
                & ~T.search(text, COSMWASM["reply_id"]),
                2,
            ),
        )
    )
    early_save = first_hit(
        text, COSMWASM["save"], lambda x: at_line("SC-CW-004", x, F.lit(3)),
        lambda lines, x: T.search(after_lines(lines, x["n"], 8), COSMWASM["sub_message"]),
    )
    return F.concat(file_level, early_save)


def contract_file_hits(ext: Column, text: Column) -> Column:
    """Rules of TON and EVM files that look at the whole text or want its first line."""
    return (
        F.when(ext.isin(TON_EXTENSIONS), ton_file_hits(text))
        .when(ext == ".sol", evm_file_hits(text))
        .otherwise(no_hits())
    )


def multichain_file_hits(chain: Column, text: Column) -> Column:
    """The same for Solana and CosmWasm sources in Rust."""
    return (
        F.when(chain == "SOLANA", solana_file_hits(text))
        .when(chain == "COSMWASM", cosmwasm_file_hits(text))
        .otherwise(no_hits())
    )


def web3_source(rule_id: Column) -> Column:
    """Chain label of a contract finding, by its rule id."""
    upper = F.upper(rule_id)
    return (
        F.when(upper.contains("SC-TON"), "web3:ton")
        .when(upper.contains("SC-SOL"), "web3:evm")
        .otherwise("web3")
    )
