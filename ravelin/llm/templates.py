"""Benchmark decontamination by templates: also catches questions with other numbers or names.

Numbers, names (capitalised words inside a sentence) and units after numbers become typed
placeholders.  Windows of five template tokens are joined by hash.  A document contains an item
if it holds at least four fifths of the item's windows in alignments with consistent slots: each
value of the item stands for one value of the document, the one at most of its places (two values
may stand for the same one), and windows that show another value do not count.

An item of n windows of which m may be missing must show one of any m + 1, so candidates come
from the m + 1 windows that fewest items share, and a phrase common to all items joins nothing.
Documents' windows first pass a bit map of the benchmark's windows of fixed size.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import sliced, written

#: Template tokens of a window; share of an item's windows that counts as containing it.
WINDOW, LEAST = 5, 0.8
#: Literal tokens below which a window is also looked for by its own words.
LITERALS = 2
#: log2 of the bits of the map of benchmark windows: 1 MB whatever the benchmark holds.
MAP_BITS = 23
#: Words remembered by one worker before it starts afresh.
REMEMBERED = 200_000

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs ms day days week weeks month"
    " months year years second seconds minute minutes hour hours mile miles meter meters metre"
    " metres inch inches foot feet pound pounds gram grams kilogram kilograms liter liters litre"
    " litres dollar dollars euro euros cent cents usd eur gbp percent degrees km/h mph hz khz mhz"
    " ghz w kw mw v kv a kb mb gb tb k c f".split()
)
STRIPPED = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~…“”„‘’«»¿¡—–"
LITERAL, NUMBER, CAPITAL, UNIT = range(4)
NUMBER_MARK, NAME_MARK, UNIT_MARK = (
    np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\x00number", b"\x00name", b"\x00unit")
)
PRIME = np.uint64(0x100000001B3)


class Reader:
    """Template tokens of texts: per word a literal hash, a kind and whether it ends a sentence."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.facts: list[tuple[int, int, bool]] = []
        self.columns = None

    def fact(self, word: str):
        bare = word.strip(STRIPPED)
        low = (bare or word).lower()
        kind = LITERAL
        if any(c.isdigit() for c in bare):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif bare[:1].isupper():
            kind = CAPITAL
        ends = word.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", ":", "…")
        return xxhash.xxh3_64_intdigest(low.encode()), kind, ends

    def tokens(self, text: str | None):
        """(template token, own hash and is-slot flag per word, words)."""
        words = (text or "").split()
        if len(self.index) > REMEMBERED:
            self.forget()
        index, fresh = self.index, set(words).difference(self.index)
        for word in fresh:
            index[word] = len(self.facts)
            self.facts.append(self.fact(word))
        if fresh or self.columns is None:
            self.grow()
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        literal, kind, ends = (c[at] for c in self.columns)
        first = np.concatenate([[True], ends[:-1]])[: len(words)]
        after = np.concatenate([[False], kind[:-1] == NUMBER])[: len(words)]
        number, name = kind == NUMBER, (kind == CAPITAL) & ~first
        unit = (kind == UNIT) & after
        slot = number | name | unit
        token = np.where(number, NUMBER_MARK, np.where(name, NAME_MARK, np.where(unit, UNIT_MARK, literal)))
        return token, literal, slot, words

    def windows(self, text: str | None, size: int):
        """(hashes, is-slot flags per token, words): one window per start; a shorter text has one."""
        token, _, slot, words = self.tokens(text)
        return hashed(token, min(size, len(words))), slot, words

    def grow(self):
        start = 0 if self.columns is None else self.filled
        if self.columns is None or len(self.facts) > len(self.columns[0]):
            room = max(1 << 14, 2 * len(self.facts))
            old, self.columns = self.columns, (
                np.zeros(room, np.uint64), np.zeros(room, np.int8), np.zeros(room, bool)
            )
            if old is not None:
                for new, before in zip(self.columns, old, strict=True):
                    new[: len(before)] = before
        for column, values in zip(self.columns, zip(*self.facts[start:], strict=True), strict=False):
            column[start : len(self.facts)] = values
        self.filled = len(self.facts)


def hashed(token: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` tokens."""
    if not size:
        return np.zeros(0, np.uint64)
    n = max(0, len(token) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = (out ^ token[j : j + n]) * PRIME
        out ^= out >> np.uint64(29)
    return out


def keys(token: np.ndarray, literal: np.ndarray, slot: np.ndarray, size: int, full: int):
    """(hash, start, own, name) of the windows of ``size`` tokens.

    A window goes by its template.  One with fewer than LITERALS literal words, and one shorter
    than ``full``, goes by its own words too (``own``), and a short one with so few by them only.
    ``name`` is the same for the hashes of one window.
    """
    general = hashed(token, size)
    filled = np.concatenate([[0], np.cumsum(slot)])
    dense = size - (filled[size:] - filled[:-size])[: len(general)] < LITERALS
    short = size < full
    by_words = np.flatnonzero(dense | short)
    by_template = np.flatnonzero(~dense) if short else np.arange(len(general))
    exact = ~hashed(literal, size) if len(by_words) else general
    name = np.where(dense, exact, general) if short else general
    at = np.concatenate([by_template, by_words])
    own = np.arange(len(at)) >= len(by_template)
    return np.where(own, exact[at], general[at]), at, own, name[at]


def windows(
    rows: DataFrame, ids: list[str], text: str, size: int, bits: np.ndarray | None, lengths: list[int] = ()
) -> DataFrame:
    """(ids..., w, pos, slots, places, id, words, literals, bare): windows of column ``text``.

    Without ``bits`` the texts are items, and one shorter than a window has one window.  With it
    they are documents: windows on the bit map, of ``size`` and of the ``lengths`` of short items.
    ``slots`` are the words in the placeholders of a window, in order, ``places`` their word
    numbers; a window that goes by its own words has none.  ``id`` is one for all hashes of a
    window, ``words`` and ``literals`` the words and literal words of the text, ``bare`` whether a
    window has no literal word.
    """
    schema = rows.select(*ids).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    mask = np.uint64((1 << MAP_BITS) - 1)
    empty = np.zeros(0, np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in sliced(batches):
            counts, hashes, marks, starts, slots, places, sizes = [], [], [], [], [], [], []
            totals, literals, bare = [], [], []
            for text in batch.column(batch.num_columns - 1):
                token, literal, slot, words = reader.tokens(text.as_py())
                count, plain = 0, len(words) - int(slot.sum())
                for length in [min(size, len(words))] if bits is None else [size, *lengths]:
                    if not 0 < length <= len(words):
                        continue
                    found, at, own, name = keys(token, literal, slot, length, size)
                    if bits is not None:
                        low = (found & mask).astype(np.int64)
                        on = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                        found, at, own, name = found[on], at[on], own[on], name[on]
                    count += len(at)
                    hashes.append(found)
                    marks.append(name)
                    starts.append(at)
                    for i, exact in zip(at.tolist(), own.tolist(), strict=True):
                        here = (np.flatnonzero(slot[i : i + length]) + i).tolist()
                        bare.append(len(here) == length)
                        here = [] if exact else here
                        sizes.append(len(here))
                        slots.extend(words[k].strip(STRIPPED).lower() for k in here)
                        places.extend(here)
                counts.append(count)
                totals.append(len(words))
                literals.append(plain)
            row = np.repeat(np.arange(batch.num_rows), counts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(row)) for i in range(len(ids))),
                    pa.array(np.concatenate([empty.astype(np.uint64), *hashes]).view(np.int64)),
                    pa.array(np.concatenate([empty, *starts]).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(slots, pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                    pa.array(np.concatenate([empty.astype(np.uint64), *marks]).view(np.int64)),
                    pa.array(np.repeat(np.array(totals, np.int32), counts)),
                    pa.array(np.repeat(np.array(literals, np.int32), counts)),
                    pa.array(bare, pa.bool_()),
                ],
                [*ids, "w", "pos", "slots", "places", "id", "words", "literals", "bare"],
            )

    return rows.select(*ids, text).mapInArrow(
        read,
        f"{names}, w long, pos int, slots array<string>, places array<int>, id long, words int, literals int,"
        " bare boolean",
    )


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Map of the low bits of all hashes: one of fixed size per partition, joined on the driver."""
    mask = np.uint64((1 << MAP_BITS) - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS, bool)
        for batch in sliced(batches):
            own = np.asarray(batch.column(0)).view(np.uint64)
            bits[(own & mask).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["bits"])

    maps = hashes.select("w").coalesce(8).mapInArrow(mark, "bits binary").collect()  # 8 MB at most
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in maps:
        out |= np.frombuffer(row[0], np.uint8)
    return out


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def agreeing(met: Column) -> Column:
    """Of the matches ``met`` (w, slots of p, a, b) of one alignment those that agree on all slots.

    A value a takes the value b that stands at most of its places p.  Of equally frequent ones it
    takes itself, so one changed value costs its windows; without itself among them it takes none.
    """
    marks = F.array_distinct(F.flatten(F.transform(met, lambda m: m["slots"])))
    pair = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))

    def taken(s):
        votes = F.transform(
            F.array_distinct(F.transform(s, pair)),
            lambda x: F.struct(
                x["a"].alias("a"), x["b"].alias("b"),
                F.size(F.filter(s, lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"]))).alias("n"),
            ),
        )
        beats = lambda y, x: (y["a"] == x["a"]) & (y["b"] != x["b"]) & (
            (y["n"] > x["n"]) | ((y["n"] == x["n"]) & (x["a"] != x["b"]))
        )
        return bound(votes, lambda v: F.transform(
            F.filter(v, lambda x: ~F.exists(v, lambda y: beats(y, x))), pair
        ))

    def kept(s):
        return bound(taken(s), lambda good: F.filter(
            met, lambda m: F.forall(m["slots"], lambda x: F.array_contains(good, pair(x)))
        ))

    def single(s):
        values = F.size(F.array_distinct(F.transform(s, lambda x: x["a"])))
        return values == F.size(F.array_distinct(F.transform(s, pair)))

    return bound(marks, lambda s: F.when(single(s), met).otherwise(kept(s)))


def contaminated(
    docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str,
    window: int = WINDOW, least: float = LEAST,
) -> DataFrame:
    """(_key, _hash, _item, n_windows, n_matched, same_words, _item_hash) of contained items.

    Documents are known by key and text hash, so rows that share a key are judged by their own
    texts and repeated rows once; items likewise by id and text hash, so each text of an id is an
    item, also of a null id.  ``same_words`` says that all slots of the matched windows hold the
    item's own values.  An item shorter than a window is found by its own words, or as a template
    if it has LITERALS literal words.  An item with fewer, or with windows of slots alone that
    reach ``least``, says nothing as a template and is found with its own values only.  Empty or
    null texts and items match nothing; null keys are kept as keys; repeated items count once.
    """
    bench = items.select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).distinct()
    bench = bench.select(F.xxhash64(F.col("_item").isNull(), "_item", "_text").alias("_no"), "_item", "_text")
    asked = written(windows(bench, ["_no"], "_text", window, None), "items")
    bits = bit_map(asked)
    lengths = [r[0] for r in asked.where(F.col("words") < window).select("words").distinct().collect()]  # 1 to 4
    texts = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    hits = windows(texts, ["_key", "_hash"], "_text", window, bits, lengths)
    hits = written(hits.select("_key", "_hash", "w", "pos", "slots"), "hits")

    need = asked.groupBy("_no", "id").agg(F.first("literals").alias("literals"), F.first("bare").alias("bare"))
    total = need.groupBy("_no").agg(
        F.count("*").alias("n_windows"),
        ((F.first("literals") < LITERALS) | (F.count_if("bare") >= F.ceil(F.count("*") * least))).alias("own"),
    )
    shared = need.groupBy("id").agg(F.count("*").alias("items"))
    place = F.expr("row_number() OVER (PARTITION BY _no ORDER BY items, id)")
    missing = F.col("n_windows") - F.ceil(F.col("n_windows") * least)
    probes = (
        need.select("_no", "id").join(shared, "id").join(total, "_no").withColumn("place", place)
        .where(F.col("place") <= missing + 1).select("_no", "id")
        .join(asked.select("_no", "id", "w").distinct(), ["_no", "id"]).select("w", "_no")
    )
    probes = written(probes, "probes")
    pairs = hits.select("_key", "_hash", "w").join(probes, "w").select("_key", "_hash", "_no").distinct()
    wanted = pairs.join(
        asked.select("_no", "id", "w", F.col("pos").alias("at"), F.col("slots").alias("values"), "places"), "_no"
    )
    same = [F.col("h._key").eqNullSafe(F.col("p._key"))] + [
        F.col(f"h.{c}") == F.col(f"p.{c}") for c in ("_hash", "w")
    ]
    slots = F.arrays_zip(F.col("p.places").alias("p"), F.col("p.values").alias("a"), F.col("h.slots").alias("b"))
    met = (
        hits.alias("h").join(wanted.alias("p"), same)
        .select("p._key", "p._hash", "p._no", (F.col("h.pos") - F.col("p.at")).alias("shift"),
                F.struct("p.id", slots.cast("array<struct<p:int,a:string,b:string>>").alias("slots")).alias("m"))
    )
    # A shift holds at most two matches per window of the item, so these lists are small.
    aligned = met.groupBy("_key", "_hash", "_no", "shift").agg(F.collect_list("m").alias("met"))
    found = (
        aligned.select("_key", "_hash", "_no", F.explode(agreeing(F.col("met"))).alias("m"))
        .groupBy("_key", "_hash", "_no", F.col("m.id").alias("id"))
        .agg(F.min(F.exists("m.slots", lambda x: x["a"] != x["b"])).alias("differ"))
        .groupBy("_key", "_hash", "_no")
        .agg(F.count("*").alias("n_shown"), F.count_if(~F.col("differ")).alias("n_own"))
    )
    matched = F.when(F.col("own"), F.col("n_own")).otherwise(F.col("n_shown"))
    names = bench.select("_no", "_item", F.xxhash64("_text").alias("_item_hash"))
    return (
        found.join(total, "_no").withColumn("n_matched", matched)
        .where(F.col("n_matched") >= F.ceil(F.col("n_windows") * least)).join(names, "_no")
        .select("_key", "_hash", "_item", "n_windows", "n_matched",
                (F.col("n_matched") == F.col("n_own")).alias("same_words"), "_item_hash")
    )


def without_contaminated(
    docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str
) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; columns as they are."""
    found = contaminated(docs, key, text, items, item, item_text)
    gone = written(found.select("_key", "_hash").distinct(), "contaminated")
    same = docs[key].eqNullSafe(gone["_key"]) & (F.xxhash64(docs[text]) == gone["_hash"])
    return docs.join(gone, same, "left_anti")
