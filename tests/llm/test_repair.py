"""Coalescing Viterbi against a search that holds every string."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ravelin.llm import named, repair

BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text, fault) of rows (turn, role, text) in order."""
    rows = sorted(
        ((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        fault = None
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif body[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits, whole strings held."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def grow(best):
        for _ in range(3):
            for state, (cost, audit, done) in list(best.items()):
                way = (cost + 3, audit + "I", (*done, (names[follow[state]], "")))
                if follow[state] not in best or way[:2] < best[follow[state]][:2]:
                    best[follow[state]] = way
        return best

    best = grow({"": (0, "", ())})
    for role, text, fault in rows:
        after = {}

        def offer(state, way):
            if state not in after or way[:2] < after[state][:2]:
                after[state] = way

        for state, (cost, audit, done) in best.items():
            offer(state, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more, into = 3 * (fault == "truncated"), follow[state]
            if role[:1] == into or (role[:1] == "s" and state == ""):
                offer(role[:1], (cost + more, audit + "K", (*done, (role, text))))
            offer(into, (cost + 3 + more, audit + "R", (*done, (names[into], text))))
        best = grow(after)
    cost, audit, done = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    return cost, audit, done


def plain(rows):
    """The report and the digest of rows (conversation, turn, role, text)."""
    out = {}
    for name in {r[0] for r in rows}:
        mine = faults([r[1:] for r in rows if r[0] == name])
        turns = [r[1] for r in rows if r[0] == name and r[1] is not None]
        initials = [r[0][:1] for r in mine]
        cost, audit, done = cheapest(mine)
        found = [m[2] for m in mine]
        out[name] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest() if done else None,
        )
    return out


def found(spark, rows, schema="c long, t long, r string, x string"):
    done = repair.repair(spark.createDataFrame(rows, schema), "c", "t", "r", "x")
    hashes = {r["conversation"]: r["sha256"] for r in repair.digests(done.turns).collect()}
    return {
        r["conversation"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")],
                            hashes.get(r["conversation"]))
        for r in done.report.collect()
    }


def logs(seed, conversations, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "agent", "usher"]
    texts = ["Hi.", "Hi", "", " \n", None, "What?  ", "So!", "é", "ok.\x0b"]
    rows = []
    for c in range(conversations):
        for t in range(draw.randrange(longest)):
            role = draw.choice(roles) if draw.random() < 0.5 else ["user", "assistant"][t % 2]
            text = draw.choice(texts) if draw.random() < 0.5 else f"{t} done."
            rows += [(c or None, t if draw.random() < 0.9 else None, role, text)] * draw.choice([1, 1, 1, 1, 2])
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_same_as_search_with_whole_strings(spark, parts):
    rows = logs(parts, 60, 14)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("piece", [1, 4096])
def test_one_conversation_over_many_tasks(spark, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = [(7, t, r, x) for _, t, r, x in logs(11, 60, 14)] + [(7, 3, "user", "Same.")] * 200 + [(8, 0, "user", "A.")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame(rows, "c long, t long, r string, x string")
        parts = repair.ordered(df, "c", "t", "r", "x").where("conversation = 7").selectExpr("pos >> 33 AS p").distinct()
        assert parts.count() > 5
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_every_short_conversation(spark):
    kinds = [("system", "S."), ("user", "u."), ("assistant", "a."), ("user", ""), ("assistant", "cut"), ("tool", "t.")]
    rows, n = [], 0
    for size in range(1, 4):
        for pick in itertools.product(kinds, repeat=size):
            rows += [(n, t, r, x if x in ("", "cut") else f"{t}{x}") for t, (r, x) in enumerate(pick)]
            n += 1
    assert found(spark, rows) == plain(rows)


def test_nodes_live_only_while_undecided():
    """The tree of a long conversation stays small, also over a long run of deletes, and one line
    of edits is one node even where two lines never meet."""
    for step in (lambda i: ("ua"[i % 2], None), lambda i: ("u", "blank"), lambda i: ("a", None)):
        search = repair.Survivors("-")
        search.step(repair.OPENING, 0)
        emitted = 0
        for i in range(2000):
            search.step(repair.row_moves(*step(i)), i)
            emitted += sum(len("".join(n.edits)) for n in search.decided())
            live, todo = set(), [line[3] for line in search.best.values()]
            while todo:
                node = todo.pop()
                if node is not None and id(node) not in live:
                    live.add(id(node))
                    todo.append(node.up)
            assert len(live) < 16
        assert emitted > 1990 or i % 2 and step(0) == ("a", None)


def test_empty_long_and_clashing(spark):
    schema = "c long, t long, r string, x string, pos int, edit string, m string"
    assert found(spark, [], schema) == {}
    rows = [(1, 0, "user", "word " * 100_000 + ".", 1, "x", "y"), (1, 1, "assistant", "b.", 1, "x", "y")]
    assert found(spark, rows, schema) == plain([r[:4] for r in rows])


def test_query_damages_and_repairs(spark):
    out = {r["conv_id"]: tuple(r)[1:] for r in named.QUERIES["op13_structure_repair"](spark, "/root/testdata/sf0.01").collect()}
    rows = []
    logs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    for c, t, r, x in logs.select("conv_id", "turn", "role", "text").collect():
        draw = zlib.crc32(f"{c}:{t}".encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            x = ""
        if draw == 2:
            x = x.replace(".", "").replace("!", "").replace("?", "")
        if draw == 4:
            r = "user"
        rows += [(c, t, r, x)] * (1 + (draw == 3))
    want = plain(rows)
    empty = hashlib.sha256(b"").hexdigest()
    for c in {r[0] for r in logs.select("conv_id").collect()}:
        expected = want.get(c, (0, 0, 0, 0, 0, 0, "", None))
        assert out[c] == (*expected[:7], expected[7] or empty)
    odd = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert named.damaged(odd).where(F.col("role") == " ").count() <= 1
