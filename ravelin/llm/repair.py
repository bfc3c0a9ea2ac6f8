"""Repair of conversation structure by a Viterbi search with coalescing survivors.

A conversation is read row by row.  The search holds, for each of four states (nothing yet, after
a system turn, after a user turn, after an assistant turn), the cheapest edits that lead there.
The edits are nodes of a backpointer tree with reference counts: a node that no survivor leads
back to goes at once, and what lies above the youngest common ancestor of all survivors is decided
and leaves the tree as an emitted piece.  A survivor that no continuation can make win is dropped, and
a node with one child is merged into it.  Memory is what is still undecided: a few nodes as a rule,
and at worst (two lines that never meet) a pointer per row of the task's range.

Ties go to the edits that come first in ASCII order, over the whole string from the beginning.
Survivors share all that was emitted; of the undecided rest, the order between any two survivors
is carried along: two different strings stay in order when both are extended, and where one is the
beginning of the other it lacks inserts only, which the next row's edit decides.  So complete
suffixes are compared, with work per row that does not grow with them.

Rows are dealt by ranges of (conversation, turn, role, text, copy), so a conversation of any size
spreads over many tasks.  The search over a piece of a conversation that does not begin in the
task is made for each state it may begin in; a second pass, over pieces instead of rows, joins
them with the same tree.
"""

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import written

#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system, user or assistant turn.  A conversation may end in ENDS.
STATES, ENDS = "-sua", "-a"
#: Turn that may follow by rerole or insert, and the state it leads to.
NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Decided nodes of an emitted piece.
PIECE = 4096


#: What a survivor in the first state may cost more than one in the second before nothing that
#: follows can make it win: the inserts and reroles with which the second does the same.
MARGIN = {
    ("-", "s"): 6, ("-", "u"): 9, ("-", "a"): 6, ("s", "-"): 0, ("s", "u"): 3, ("s", "a"): 0,
    ("u", "-"): 3, ("u", "s"): 3, ("u", "a"): 3, ("a", "-"): 0, ("a", "s"): 6, ("a", "u"): 3,
}


class Node:
    """Edits after those of ``up``; ``refs`` counts children and survivors."""

    __slots__ = ("up", "edits", "at", "state", "refs")

    def __init__(self, up, edits, at, state):
        self.up, self.edits, self.at, self.state, self.refs = up, [edits], at, state, 1
        if up is not None:
            up.refs += 1

    def absorb(self) -> None:
        """Take over the edits of a parent that nothing else leads back to."""
        up = self.up
        up.edits += self.edits
        self.edits, self.at, self.state, self.up = up.edits, up.at, up.state, up.up


class Survivors:
    """The cheapest, then least edits into each state.  ``merged``: steps follow each other
    without gaps in ``at``, so chains of nodes may become one."""

    def __init__(self, state: str, merged: bool = True):
        self.merged = merged
        self.root = Node(None, "", None, state)
        # state -> (cost, rank of the line, inserts after the line, node)
        self.best = {state: (0, 0, "", self.root)}

    def step(self, moves: dict, at) -> None:
        """Advance by ``moves``: state reached -> [(state before, cost, edits)]."""
        won = {}
        for state, ways in moves.items():
            least = None
            for before, cost, edits in ways:
                line = self.best.get(before)
                if line is not None:
                    way = (line[0] + cost, line[1], line[2] + edits, before, edits)
                    if least is None or way < least:
                        least = way
            if least is not None:
                won[state] = least
        for state in [
            s for s in won if any(won[s][0] > won[t][0] + MARGIN.get((s, t), won[s][0]) for t in won if t != s)
        ]:
            del won[state]
        lines = {}
        for state, (_, rank, edits, _, _) in won.items():
            lines[state] = (rank, edits.rstrip("I"))
        order = {line: i for i, line in enumerate(sorted(set(lines.values())))}
        after = {}
        for state, (cost, _, tail, before, edits) in won.items():
            node = Node(self.best[before][3], edits, at, before) if edits else self.best[before][3]
            if not edits:
                node.refs += 1
            after[state] = (cost, order[lines[state]], tail[len(lines[state][1]) :], node)
        for _, _, _, node in self.best.values():
            self.release(node)
        self.best = after
        for _, _, _, node in after.values():
            if self.merged and node.up is not None and node.up is not self.root and node.up.refs == 1:
                node.absorb()

    def release(self, node: Node) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            up, node.up = node.up, None
            node = up

    def decided(self) -> list[Node]:
        """Nodes that all survivors share, oldest first; they leave the tree."""
        if self.root.refs > 1:
            return []
        path, node = [], next(iter(self.best.values()))[3]
        while node is not self.root:
            path.append(node)
            node = node.up
        out = []
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.up = None
            out.append(self.root)
        return out

    def rest(self, state: str) -> list[Node]:
        """Nodes of one survivor that are not decided yet, oldest first."""
        out, node = [], self.best[state][3]
        while node is not self.root:
            out.append(node)
            node = node.up
        return out[::-1]

    def winner(self, states: str) -> str:
        """The state of ``states`` with the cheapest, then least edits."""
        return min((s for s in states if s in self.best), key=lambda s: self.best[s][:3])


def inserted(ways: dict) -> dict:
    """Ways (state reached -> {state before: (cost, edits)}), with inserts after them."""
    changed = True
    while changed:
        changed = False
        for state in STATES:
            into = NEXT[state]
            for before, (cost, edits) in list(ways.get(state, {}).items()):
                longer = (cost + INSERT, edits + "I")
                if longer < ways.setdefault(into, {}).get(before, (float("inf"),)):
                    ways[into][before], changed = longer, True
    return {
        state: [(before, *way) for before, way in found.items()] for state, found in ways.items()
    }


def row_moves(initial: str, fault: str | None) -> dict:
    """What one row allows from each state: keep (L for a system turn), rerole, delete."""
    ways: dict = {}

    def offer(before, state, cost, edits):
        known = ways.setdefault(state, {})
        known[before] = min(known.get(before, (float("inf"),)), (cost, edits))

    more = TRUNCATED if fault == "truncated" else 0
    for state in STATES:
        offer(state, state, DELETE, "D")
        if fault in ("blank", "duplicate"):
            continue
        if initial == NEXT[state]:
            offer(state, initial, KEEP + more, "K")
        if state == "-" and initial == "s":
            offer(state, "s", KEEP + more, "L")
        offer(state, NEXT[state], REROLE + more, "R")
    return inserted(ways)


#: Inserts before the first row.
OPENING = inserted({"-": {"-": (0, "")}})


def stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def ordered(logs: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (pos, conversation, turn, role, text, initial, fault) as a written table; ``pos`` follows
    the order and is consecutive within its upper 31 bits.

    Equal rows are counted before they are dealt, so a row repeated often is no hot key.  A
    duplicate is found by comparing with the first place of its group; groups of one are left out
    and the others spread over salts.
    """
    rows = logs.select(
        F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    )
    rows = rows.groupBy("conversation", "turn", "role", "text").agg(F.count("*").alias("m"))
    name = F.coalesce(F.concat(F.lit("="), F.col("conversation").cast("string")), F.lit("-"))
    same = F.sha2(F.concat_ws("\x00", F.length(name), name, F.length("role"), "role", "text").cast("binary"), 256)
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)).alias("turn"))
    rows = rows.withColumns({
        "same": F.unhex(same), "place": place, "salt": F.pmod(F.xxhash64("turn"), F.lit(16)).cast("int"),
    })
    first = (
        rows.groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("turns")).where("turns > 1")
        .select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    )
    rows = rows.join(first, ["same", "salt"], "left")
    # Copies in two steps, so that no array grows with their number.
    block = 1 << 16
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / block))))
    many = F.least(F.lit(block).cast("long"), F.col("m") - F.col("b") * block)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    rows = rows.withColumn("copy", F.col("b") * block + F.col("i"))
    body = stripped(F.col("text"))
    later = (F.col("copy") > 0) | F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = (
        F.when(body == "", "blank").when(later, "duplicate")
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    order = ["conversation", "turn", "role", "text", "copy"]
    dealt = rows.select(*order, F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(
        dealt.select(F.monotonically_increasing_id().alias("pos"), "conversation", "turn", "role", "text", "initial", "fault"),
        "turns",
    )


class Segment:
    """The rows of one conversation in one range, searched for each state they may begin in."""

    def __init__(self, conversation, pos: int, known: bool):
        self.conversation, self.pos, self.known = conversation, pos, known
        self.searches = {state: Survivors(state) for state in ("-" if known else STATES)}
        self.pieces = {state: 0 for state in self.searches}
        self.held = {state: [] for state in self.searches}
        self.illegal, self.head, self.tail = 0, None, None
        if known:
            self.searches["-"].step(OPENING, pos)

    def add(self, pos: int, initial: str, moves: dict) -> list[tuple]:
        if self.head is None:
            self.head = initial
        elif self.tail + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.tail, out = initial, []
        for start, search in self.searches.items():
            search.step(moves, pos)
            self.held[start] += search.decided()
            if len(self.held[start]) >= PIECE:
                out.append(self.row(start, None, None, self.held[start]))
                self.held[start] = []
        return out

    def row(self, start, end, cost, nodes):
        self.pieces[start] += 1
        edits, first = "".join("".join(n.edits) for n in nodes), nodes[0] if nodes else None
        return (
            self.conversation, self.pos, start, self.pieces[start], end, cost, edits,
            first.at if first else self.pos, first.state if first else start,
            self.known, self.illegal, self.head, self.tail,
        )

    def done(self, closed: bool) -> list[tuple]:
        """Undecided edits per state at the end; of a closed conversation only the winner's."""
        out = []
        for start, search in self.searches.items():
            if self.held[start]:
                out.append(self.row(start, None, None, self.held[start]))
            ends = search.winner(ENDS) if closed else search.best
            for end in ends:
                out.append(self.row(start, "!" if closed else end, search.best[end][0], search.rest(end)))
        return out


def segments(rows: DataFrame) -> DataFrame:
    """Pieces of edits per conversation and range, for every state it may begin and end in."""
    kind = rows.schema["conversation"].dataType.simpleString()
    names = ["conversation", "pos", "start", "piece", "end", "cost", "edits", "at", "state", "known", "illegal", "head", "tail"]
    schema = (
        f"conversation {kind}, pos long, start string, piece long, end string, cost long, edits string,"
        " at long, state string, known boolean, illegal long, head string, tail string"
    )

    def search(batches):
        moves, part, segment, out = {}, None, None, []
        for batch in batches:
            shape = batch.schema.field("conversation").type
            columns = [batch.column(c).to_pylist() for c in ("pos", "conversation", "initial", "fault")]
            for pos, conversation, initial, fault in zip(*columns, strict=True):
                if pos >> 33 != part:
                    if segment:
                        out += segment.done(False)
                    part, segment = pos >> 33, Segment(conversation, pos, False)
                elif conversation != segment.conversation:
                    out += segment.done(True)
                    segment = Segment(conversation, pos, True)
                known = moves.get((initial, fault))
                if known is None:
                    known = moves[initial, fault] = row_moves(initial, fault)
                out += segment.add(pos, initial, known)
                if len(out) >= 5000:
                    yield table(out, shape)
                    out = []
        if segment:
            out += segment.done(False)
            yield table(out, shape)

    def table(out, shape):
        found = list(zip(*out, strict=True))
        types = [
            shape, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
            pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(),
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, types, strict=True)], names)

    parted = rows.select("pos", "conversation", "initial", "fault", F.shiftright("pos", 33).alias("part"))
    return parted.repartition("part").sortWithinPartitions("pos").mapInArrow(search, schema)


class Joined:
    """Pieces of one conversation, joined over its segments."""

    def __init__(self, conversation):
        self.conversation, self.search, self.tail = conversation, Survivors("-", False), None
        self.illegal, self.pos, self.number = 0, None, 0
        self.group: dict = {}

    def add(self, row) -> list[tuple]:
        out = []
        if row["pos"] != self.pos:
            if self.pos is None and not row["known"]:
                self.search.step(OPENING, (row["pos"], "-"))
            out, self.group, self.pos = self.close(), {}, row["pos"]
        self.group.setdefault(row["start"], []).append(row)
        return out

    def close(self) -> list[tuple]:
        """Take in the segment that was gathered: the shared pieces, then the ends."""
        if not self.group:
            return []
        moves: dict = {}
        spots = {}
        for start, rows in self.group.items():
            shared = [r for r in rows if r["end"] is None]
            trunk = "".join(r["edits"] for r in shared)
            for r in rows:
                if r["end"] is not None:
                    last, first = r, shared[0] if shared else r
                    spots[start] = (first["at"], first["state"])
                    moves.setdefault(r["end"], []).append((start, r["cost"], trunk + r["edits"]))
        if self.tail is not None and self.tail + last["head"] not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal, self.tail = self.illegal + last["illegal"], last["tail"]
        self.search.step(moves, spots)
        return [self.piece(node) for node in self.search.decided()]

    def piece(self, node):
        # A node of the opening has its own place; another one knows a place for each start.
        at, state = node.at if isinstance(node.at, tuple) else node.at[node.state]
        self.number += 1
        return (self.conversation, self.number, at, state, "".join(node.edits), None, None)

    def done(self) -> list[tuple]:
        out = self.close()
        end = "!" if "!" in self.search.best else self.search.winner(ENDS)
        out += [self.piece(node) for node in self.search.rest(end)]
        return [*out, (self.conversation, None, None, None, None, self.search.best[end][0], self.illegal)]


def joined(pieces: DataFrame) -> DataFrame:
    """Per conversation its decided pieces (number, at, state, edits), and one row with a null
    number that holds cost and illegal."""
    kind = pieces.schema["conversation"].dataType.simpleString()
    names = ["conversation", "number", "at", "state", "edits", "cost", "illegal"]

    def join(batches):
        one, out, begun = None, [], False
        for batch in batches:
            shape = batch.schema.field("conversation").type
            for row in batch.to_pylist():
                if not begun or row["conversation"] != one.conversation:
                    if begun:
                        out += one.done()
                    one, begun = Joined(row["conversation"]), True
                out += one.add(row)
            if len(out) >= 5000:
                yield table(out, shape)
                out = []
        if begun:
            yield table(out + one.done(), shape)

    def table(out, shape):
        types = [shape, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        found = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, types, strict=True)], names)

    dealt = pieces.repartition("conversation").sortWithinPartitions("conversation", "pos", "start", "piece")
    return dealt.mapInArrow(
        join,
        f"conversation {kind}, number long, at long, state string, edits string, cost long, illegal long",
    )


def single(pieces: DataFrame) -> DataFrame:
    """Edits one by one: (conversation, pos, k, edit, role); role is null for rows that stay."""
    kind = pieces.schema["conversation"].dataType.simpleString()

    def spell(batches):
        for batch in batches:
            shape, out = batch.schema.field("conversation").type, ([], [], [], [], [])
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pos, k, state = row["at"] - 1, 0, row["state"]
                for edit in row["edits"]:
                    if edit == "I":
                        k += 1
                    else:
                        pos, k = pos + 1, 0
                    if edit == "L":
                        state = "s"
                    elif edit != "D":
                        state = NEXT[state]
                    role = ROLES[state] if edit in "RI" else None
                    for column, value in zip(out, (row["conversation"], pos, k, edit, role), strict=True):
                        column.append(value)
                    if len(out[0]) >= 20_000:
                        yield table(out, shape)
                        out = ([], [], [], [], [])
            yield table(out, shape)

    def table(out, shape):
        types = [shape, pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, types, strict=True)], ["conversation", "pos", "k", "edit", "role"]
        )

    return pieces.where("edits <> ''").mapInArrow(
        spell, f"conversation {kind}, pos long, k long, edit string, role string"
    )


class Repair(NamedTuple):
    """``report``: one row per conversation.  ``turns``: the repaired rows in order of (pos, k), with the
    edit that made them (K, R or I)."""

    report: DataFrame
    turns: DataFrame


def repair(logs: DataFrame, conversation: str, turn: str, role: str, text: str) -> Repair:
    """Cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

    Rows go by turn (nulls first; ties by role, text); null roles and texts are one space, a null
    conversation is one like any other, other columns are not read.  A row's first fault counts:
    blank, duplicate (role and text seen earlier in the conversation; equal rows are duplicates of
    the first), truncated.  Keep costs 0, rerole 3, delete 4 (blank and duplicate rows must go),
    insert of an empty turn 3; a truncated row that stays costs 3 more.  Of equally cheap edits
    those whose initials come first in ASCII order are taken.

    ``report`` has conversation, gaps, blank, duplicate, truncated, illegal, cost, audit.  A
    conversation may lose all its rows: it keeps its row in ``report``, with one D for each.  An
    empty table gives no rows.  Texts may be of any length, they are never held by the search.  The audit is one
    character per edit, so its cell grows with the conversation; nothing else does.
    """
    rows = ordered(logs, conversation, turn, role, text)
    found = written(joined(segments(rows)), "edits")
    pieces = found.where("number IS NOT NULL")
    fault = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("conversation").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *fault.values())
    audit = F.array_join(F.sort_array(F.collect_list(F.struct("number", "edits")))["edits"], "")
    edits = found.groupBy("conversation").agg(
        F.replace(audit, F.lit("L"), F.lit("K")).alias("audit"), F.max("cost").alias("cost"),
        F.max("illegal").alias("illegal"),
    )
    report = counts.join(edits, counts["conversation"].eqNullSafe(edits["conversation"])).select(
        counts["conversation"], "gaps", *fault, "illegal", "cost", "audit"
    )
    each = single(pieces).where("edit <> 'D'")
    kept = each.where("edit <> 'I'").join(
        rows.select("pos", F.col("role").alias("_role"), "text"), "pos"
    ).select("conversation", "pos", "k", "edit", F.coalesce("role", "_role").alias("role"), "text")
    added = each.where("edit = 'I'").withColumn("text", F.lit(""))
    turns = kept.unionByName(added).withColumn("edit", F.replace("edit", F.lit("L"), F.lit("K")))
    return Repair(report, turns)


def digests(turns: DataFrame) -> DataFrame:
    """(conversation, sha256) over ``role:text`` of its turns, newline-joined, in lowercase hex.

    A digest takes a conversation's text in order, so one task streams it; nothing is gathered.
    """
    kind = turns.schema["conversation"].dataType.simpleString()

    def digest(batches):
        at, sha, begun = None, None, False
        for batch in batches:
            names, hashes = [], []
            shape = batch.schema.field("conversation").type
            columns = [batch.column(c).to_pylist() for c in ("conversation", "role", "text")]
            for name, role, text in zip(*columns, strict=True):
                if begun and name == at:
                    sha.update(f"\n{role}:{text}".encode())
                    continue
                if begun:
                    names.append(at)
                    hashes.append(sha.hexdigest())
                at, sha, begun = name, hashlib.sha256(f"{role}:{text}".encode()), True
            yield pa.RecordBatch.from_arrays([pa.array(names, shape), pa.array(hashes, pa.string())], ["conversation", "sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], shape), pa.array([sha.hexdigest()])], ["conversation", "sha256"]
            )

    dealt = turns.repartition("conversation").sortWithinPartitions("conversation", "pos", "k")
    return dealt.select("conversation", "role", "text").mapInArrow(digest, f"conversation {kind}, sha256 string")
