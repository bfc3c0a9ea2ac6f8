"""Repeated passages: windows of words as edges of a de Bruijn graph, compacted to paths.

An edge is a window of ``window`` consecutive words.  Each window has an anchor, its k-mer of
least hash, and consecutive windows with one anchor form a segment.  Equal windows have equal
anchors, so only segments whose anchor occurs again can hold a repeated edge, and equal segments
are one path of the graph.

1. One scan turns texts into packed words and segments (anchor hash, segment hash, place).
2. Segments whose anchor is unique fall out; equal ones fold into one path with the place of its
   first occurrence as source coordinates.
3. Where an anchor has several segments, they may share part of their windows: these few are
   opened into edges, and each edge is joined to its first occurrence.
4. Neighbouring covered segments and edges whose sources are neighbours too compact into long
   spans (document, start, length, source document, source start).
5. Both ends of every span are digested from the words themselves and compared, so no hash
   decides alone; on a mismatch everything is repeated with another seed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import dropped, sliced, written

#: Words of an anchor k-mer.
ANCHOR = 6
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes remembered by one worker before it starts afresh.
REMEMBERED = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self, seed: int):
        self.seed, self.memory = seed, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        for word in set(words).difference(memory):
            memory[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


class Spans:
    """Hashes of any spans of one text, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, hashes: np.ndarray, seed: int):
        base = mixed(np.array([seed + 7], np.uint64) * ODD)[0] | np.uint64(1)
        self.powers = np.cumprod(np.full(len(hashes) + 1, base)) if len(hashes) else None
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        if len(hashes):
            np.cumsum(hashes * self.powers[:-1], out=self.prefix[1:])
            inverse = pow(int(base), -1, 1 << 64)
            self.back = np.cumprod(np.full(len(hashes) + 1, np.uint64(inverse)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = self.prefix[stop] - self.prefix[start]
        return mixed(total * self.back[start] + (stop - start).astype(np.uint64))


def segments(hashes: np.ndarray, spans: Spans, window: int, k: int):
    """(anchor hash, segment hash, first window, number of windows) of a text's segments."""
    n = len(hashes) - window + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
    at = np.arange(len(hashes) - k + 1)
    kmers = spans.of(at, at + k)
    width = window - k + 1
    least, reach = at, 1
    while reach < width:  # the last of the least of 1, 2, 4, ... neighbours
        step = min(reach, width - reach)
        left, right = least[:-step], least[step:]
        least = np.where(kmers[right] <= kmers[left], right, left)
        reach += step
    # The last place, not the hash alone, tells segments apart: no two windows of a segment
    # can then be equal, also where a text repeats itself at once.
    fresh = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    counts = np.diff(np.concatenate([fresh, [n]]))
    return kmers[least[fresh]], spans.of(fresh, fresh + counts + window - 1), fresh, counts


def packed(text: bytes) -> bytes:
    return zstandard.compress(text, 3)


def words_of_packed(data: bytes | None) -> list[bytes]:
    return zstandard.decompress(data).split() if data is not None else []


def lists(counts: list[int], **columns) -> pa.Array:
    """Rows of lists of structs from flat columns."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    fields = [pa.array(c) for c in columns.values()]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, list(columns)))


def flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)


def scanned(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """One row per row of ``docs`` (_rest, _key, _text): row id, packed text, segments."""
    rest = docs.schema["_rest"].dataType.simpleString()
    kind = docs.schema["_key"].dataType.simpleString()
    k = min(ANCHOR, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes(seed)
        for batch in sliced(batches):
            words, z, found = [], [], []
            for text in batch.column("_text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                parts = raw.split() if raw else []
                hashes = words_of.of(parts)
                found.append(segments(hashes, Spans(hashes, seed), window, k))
                words.append(len(parts))
                z.append(packed(raw) if raw is not None else None)
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_rid"), batch.column("_rest"), batch.column("_key"),
                    pa.array(words, pa.int64()),
                    pa.array(z, pa.binary()),
                    lists(
                        [len(x) for x in columns[2]],
                        h=flat(columns[0], np.uint64).view(np.int64),
                        g=flat(columns[1], np.uint64).view(np.int64),
                        lo=flat(columns[2], np.int32), n=flat(columns[3], np.int32),
                    ),
                ],
                ["_rid", "_rest", "_key", "n_words", "z", "segs"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("_rid"), "_rest", "_key", "_text")
    return numbered.mapInArrow(
        scan,
        f"_rid long, _rest {rest}, _key {kind}, n_words long, z binary, "
        "segs array<struct<h:long,g:long,lo:int,n:int>>",
    )


def opened(texts: DataFrame, wanted: DataFrame, window: int, seed: int) -> DataFrame:
    """(w, _key, _rid, pos): the edges of the segments listed per row in ``wanted`` (_rid, segs)."""
    kind = texts.schema["_key"].dataType.simpleString()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes(seed)
        for batch in sliced(batches):
            hashes, places, counts = [], [], []
            rows = zip(batch.column("z"), batch.column("segs"), strict=True)
            for z, segs in rows:
                own = words_of.of(words_of_packed(z.as_py()))
                at = np.concatenate([np.arange(x["lo"], x["lo"] + x["n"]) for x in segs.as_py()])
                hashes.append(Spans(own, seed).of(at, at + window))
                places.append(at)
                counts.append(len(at))
            row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat(hashes, np.uint64).view(np.int64)),
                    batch.column("_key").take(row), batch.column("_rid").take(row),
                    pa.array(flat(places, np.int32)),
                ],
                ["w", "_key", "_rid", "pos"],
            )

    return (
        texts.select("_rid", "_key", "z").join(wanted, "_rid")
        .mapInArrow(edges, f"w long, _key {kind}, _rid long, pos int")
    )


def paths(covered: DataFrame) -> DataFrame:
    """Spans (_rid, pos, n, src_rid, src_pos) of neighbours whose sources are neighbours too.

    ``covered`` has disjoint runs of windows with the place of their source.
    """
    by_place = "PARTITION BY _rid ORDER BY pos"
    before = covered.selectExpr(
        "*",
        f"lag(pos + n) OVER ({by_place}) <=> pos AND lag(src_rid) OVER ({by_place}) <=> src_rid"
        f" AND lag(src_pos + n) OVER ({by_place}) <=> src_pos AS follows",
    )
    numbered = before.selectExpr(
        "*", f"sum(if(follows, 0, 1)) OVER ({by_place} ROWS UNBOUNDED PRECEDING) AS path"
    )
    return numbered.groupBy("_rid", "path").agg(
        F.min("pos").alias("pos"), F.sum("n").cast("int").alias("n"),
        F.min("src_rid").alias("src_rid"), F.min("src_pos").alias("src_pos"),
    ).drop("path")


def applied(texts: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """Texts without the covered words, and digests of the spans listed in ``asked``."""
    rest = texts.schema["_rest"].dataType.simpleString()
    kind = texts.schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            removed, kept, counts, digests = [], [], [], []
            for z, spans in zip(batch.column("z"), batch.column("spans"), strict=True):
                spans = spans.as_py()
                counts.append(len(spans or ()))
                if not spans:
                    removed.append(0)
                    kept.append(z.as_py())
                    continue
                words = words_of_packed(z.as_py())
                keep = np.ones(len(words), bool)
                for x in spans:
                    stop = x["pos"] + x["n"] + window - 1
                    text = b" ".join(words[x["pos"] : stop])
                    digests.append((x["pos"], x["n"], xxhash.xxh3_128_hexdigest(text)))
                    if x["own"]:
                        keep[x["pos"] : stop] = False
                left = np.flatnonzero(keep).tolist()
                removed.append(len(words) - len(left))
                text = b" ".join([words[i] for i in left])
                kept.append(packed(text) if removed[-1] else z.as_py())
            pos, n, digest = zip(*digests, strict=True) if digests else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_rid"), batch.column("_rest"), batch.column("_key"),
                    batch.column("n_words"),
                    pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
                    lists(
                        counts, pos=pa.array(pos, pa.int32()), n=pa.array(n, pa.int32()),
                        digest=pa.array(digest, pa.string()),
                    ),
                ],
                ["_rid", "_rest", "_key", "n_words", "n_removed", "kept", "digests"],
            )

    return (
        texts.select("_rid", "_rest", "_key", "n_words", "z").join(asked, "_rid", "left")
        .mapInArrow(
            cut,
            f"_rid long, _rest {rest}, _key {kind}, n_words long, n_removed long, kept binary, "
            "digests array<struct<pos:int,n:int,digest:string>>",
        )
    )


def attempt(docs: DataFrame, window: int, seed: int):
    """(result, number of spans whose words differ from those of their source)."""
    texts = written(scanned(docs, window, seed), "texts")
    every = texts.select("_rid", "_key", F.inline("segs"))
    again = every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    found = written(every.join(again, "h", "left_semi"), "segments")
    first = F.min(F.struct("_key", "_rid", F.col("lo").alias("pos"))).alias("src")
    path = written(found.groupBy("h", "g").agg(first, F.max("n").alias("n")), "paths")
    several = path.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    wanted = (
        path.join(several, "h", "left_semi")
        .groupBy(F.col("src._rid").alias("_rid"))
        .agg(F.collect_list(F.struct(F.col("src.pos").alias("lo"), "n")).alias("segs"))
    )  # at most the segments of one document in a group
    edge = written(opened(texts, wanted, window, seed), "edges")
    start = edge.groupBy("w").agg(
        F.min(F.struct("_key", "_rid", "pos")).alias("src"), F.count("*").alias("c")
    )
    source = [F.col("src._rid").alias("src_rid"), F.col("src.pos").alias("src_pos")]
    by_edge = edge.join(start.where("c > 1"), "w").where(
        "_rid <> src._rid OR pos <> src.pos"
    ).select("_rid", "pos", F.lit(1).alias("n"), *source)
    by_path = found.join(path.drop("n"), ["h", "g"]).where(
        "_rid <> src._rid OR lo <> src.pos"
    ).select("_rid", F.col("lo").alias("pos"), "n", *source)
    spans = written(paths(by_edge.unionByName(by_path)), "spans")
    dropped(found, path, edge)
    # Distinct places only: a source that a third of all documents repeat is asked for once.
    places = (
        spans.select("_rid", "pos", "n", F.lit(True).alias("own"))
        .union(spans.select("src_rid", "src_pos", "n", F.lit(False)))
        .groupBy("_rid", "pos", "n").agg(F.max("own").alias("own"))
    )
    asked = places.groupBy("_rid").agg(F.collect_list(F.struct("pos", "n", "own")).alias("spans"))
    result = written(applied(texts, asked, window), "kept")
    dropped(texts)
    digests = result.select("_rid", F.inline("digests"))
    mine = spans.join(digests, ["_rid", "pos", "n"])
    theirs = digests.select(
        F.col("_rid").alias("src_rid"), F.col("pos").alias("src_pos"), "n",
        F.col("digest").alias("source_digest"),
    )
    differ = mine.join(theirs, ["src_rid", "src_pos", "n"]).where("digest <> source_digest")
    wrong = differ.count()
    dropped(spans)
    return result, wrong


def judged(docs: DataFrame, window: int, seed: int, joined: bool) -> DataFrame:
    """(_rest, _key, n_words, n_removed, kept) of rows (_rest, _key, _text)."""
    for turn in range(5):
        result, wrong = attempt(docs, window, seed + turn)
        if not wrong:
            break
        dropped(result)
    else:
        raise RuntimeError("segment hashes collided under five seeds")
    rest, kind = (docs.schema[c].dataType.simpleString() for c in ("_rest", "_key"))

    def text(z):
        if joined:
            return b" ".join(words_of_packed(z)).decode()
        return zstandard.decompress(z).decode() if z is not None else None

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept = [text(z.as_py()) for z in batch.column("kept")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(kept, pa.string())],
                ["_rest", "_key", "n_words", "n_removed", "kept"],
            )

    return result.select("_rest", "_key", "n_words", "n_removed", "kept").mapInArrow(
        plain, f"_rest {rest}, _key {kind}, n_words long, n_removed long, kept string"
    )


def dedup(docs: DataFrame, key: str, text: str, window: int = 20, seed: int = 42) -> DataFrame:
    """(key, n_words, n_removed, kept) for every row of ``docs``.

    Words are runs without ASCII white space.  A word goes if some window of ``window`` words
    that covers it also starts earlier: at a smaller key, or earlier in the same text.  Windows
    are judged on the texts as they come in.  ``kept`` joins the other words by one space.
    Null texts have no words; null keys count as smallest; rows with equal keys are taken in an
    order of their own, and each gives a row of the result.
    """
    narrow = docs.select(
        F.lit(0).alias("_rest"), F.col(key).alias("_key"), F.col(text).alias("_text")
    )
    return judged(narrow, window, seed, joined=True).drop("_rest").withColumnRenamed("_key", key)


def without_repeats(
    docs: DataFrame, key: str, text: str, window: int = 20, seed: int = 42, size: str | None = None
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all columns stay.

    Texts that lose nothing, null ones included, stay as they are; others are their kept words
    joined by one space, and column ``size``, if named, is their new length in characters.
    """
    rest = [F.col(c) for c in docs.columns if c not in (key, text)]
    packed_rest = F.struct(*rest) if rest else F.lit(0)
    narrow = docs.select(packed_rest.alias("_rest"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    done = judged(narrow, window, seed, joined=False)
    columns = []
    for c in docs.columns:
        value = F.col("_key") if c == key else F.col("kept") if c == text else F.col("_rest")[c]
        if c == size:
            kind = docs.schema[c].dataType
            value = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(value)
        columns.append(value.alias(c))
    return done.select(*columns)
