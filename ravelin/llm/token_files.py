"""Token ids in flat binary files that training jobs map into memory.

A folder holds, per part, ``part-N.ids`` (unsigned 16- or 32-bit integers, little-endian),
``part-N.offsets`` (unsigned 64-bit: where each document starts in the part, and the end) and
``part-N.keys`` (Arrow file of the document keys), and the table ``parts`` with each part's base:
the number of ids in all parts before it, from prefix sums of the parts' totals.  Parts are in
ascending key order, so a global offset is base plus offset.
"""

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Bytes of text that one part should hold.
PART_BYTES = 32 << 20
#: Words of one generation that a worker remembers; bytes of text tokenised at a time, texts read
#: back at a time.
REMEMBERED, SLICE_BYTES, SLICE = 450_000, 6 << 20, 200
#: New runs of letters in one text, and what may follow a word's letters.
RUN_WORDS, TAIL = 100, b".,!?;:"


class Memory:
    """Two generations of a bounded dictionary: what is still in use outlives the younger one."""

    def __init__(self):
        self.young, self.old = {}, {}

    def missing(self, names) -> list:
        """The names that neither generation has; those of the older move to the younger."""
        young, old = self.young, self.old
        unseen = [name for name in names if name not in young]
        young.update((name, old[name]) for name in unseen if name in old)
        return [name for name in unseen if name not in old]

    def turn(self) -> None:
        """Start a generation when the younger is full; call when nothing is being looked up."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young


class Encoder:
    """Ids of texts, with a memory of words where the vocabulary allows it.

    Texts are split and their words counted as Arrow columns: Python sees each distinct word of
    some megabytes once, and the ids of all words are gathered as numpy arrays.  A word of letters and a tail of punctuation are separate for such a vocabulary.  New runs
    of ASCII go to the model at once, if probes show that its front leaves them alone; others
    are tokenised many to a text, where tokens that end a word tell them apart.
    """

    def __init__(self, definition: str, kind: str, separate_words: bool, special_as_text: bool = False):
        self.model = Tokenizer.from_str(definition)
        self.model.encode_special_tokens = special_as_text
        self.kind, self.separate_words = kind, separate_words
        self.memory, self.parts = Memory(), Memory()
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        probes = ["a", "the", "internationalisation", "zzxqj", "...", ",", "?!;", "thing"]
        self.plain = [self.direct(x) for x in probes] == self.pack(probes)
        if suffix:
            self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith(suffix)]] = True

    def pack(self, texts: list[str]) -> list[bytes]:
        coded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in coded]

    def direct(self, run: str) -> bytes:
        """Ids of lower-case ASCII letters or punctuation, from the model without its front."""
        return np.array([token.id for token in self.model.model.tokenize(run)], self.kind).tobytes()

    def learn_runs(self, runs: list[bytes]) -> None:
        """Remember runs of letters or of punctuation, RUN_WORDS of them to a text."""
        width = np.dtype(self.kind).itemsize
        if self.plain:
            easy = [run for run in runs if run.isascii()]
            tokenize = self.model.model.tokenize
            code = self.kind[0] + "%d" + {"2": "H", "4": "I"}[self.kind[-1]]
            for run in easy:
                ids = [token.id for token in tokenize(run.decode())]
                self.parts.young[run] = struct.pack(code % len(ids), *ids)
            runs = [run for run in runs if not run.isascii()]
        for start in range(0, len(runs), RUN_WORDS):
            some = runs[start : start + RUN_WORDS]
            text = b" ".join(some).decode()
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * width
            if len(stops) == len(some) and stops[-1] == len(ids) * width:
                packed, stops = ids.tobytes(), stops.tolist()
                self.parts.young.update(
                    (run, packed[i:j]) for run, i, j in zip(some, [0, *stops], stops, strict=False)
                )
            else:  # no such tokens: one by one
                self.parts.young.update(zip(some, self.pack([run.decode() for run in some]), strict=True))

    def learn(self, fresh: list[bytes]) -> None:
        halves, odd = [], []
        for word in fresh:
            body = word.rstrip(TAIL)
            if body.isalpha() or (not body.isascii() and body.decode().isalpha()):
                # Only ASCII is lower-cased here; the library does the rest.
                halves.append((word, body.lower(), word[len(body) :]))
            else:
                odd.append(word)  # added tokens hold other signs than letters and the tail's
        self.parts.turn()
        runs = {body for _, body, _ in halves} | {tail for _, _, tail in halves if tail}
        self.learn_runs(self.parts.missing(runs))
        parts, memory = self.parts.young, self.memory.young
        memory.update((w, parts[body] + parts[tail] if tail else parts[body]) for w, body, tail in halves)
        for start in range(0, len(odd), RUN_WORDS):
            some = odd[start : start + RUN_WORDS]
            memory.update(zip(some, self.pack([word.decode() for word in some]), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if not self.separate_words:
            packed = self.pack(texts.to_pylist())
            sizes = np.array([len(p) for p in packed], np.int64) // np.dtype(self.kind).itemsize
            return np.frombuffer(b"".join(packed), self.kind), sizes
        split = pc.ascii_split_whitespace(texts)  # ASCII white space only
        words = split.flatten().dictionary_encode()
        names = words.dictionary.cast(pa.binary()).to_pylist()
        self.memory.turn()
        self.learn(self.memory.missing(names))
        packed = list(map(self.memory.young.__getitem__, names))
        flat = np.frombuffer(b"".join(packed), self.kind)
        size = np.array([len(p) for p in packed], np.int64) // np.dtype(self.kind).itemsize
        code = words.indices.to_numpy()
        counts = size[code]
        ends = np.concatenate([[0], np.cumsum(counts)])
        # Where each word's ids lie in ``flat``, less where they go.
        shift = (np.cumsum(size) - size)[code] - ends[:-1]
        ids = flat[np.repeat(shift, counts) + np.arange(ends[-1])]
        last = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, np.diff(ends[last], prepend=0)


_LOADED: dict[tuple, Encoder] = {}


def encoder(definition: str, kind: str, separate_words: bool, special_as_text: bool) -> Encoder:
    """The worker's encoder: tasks that follow each other share its memory."""
    key = (hash(definition), kind, separate_words, special_as_text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(definition, kind, separate_words, special_as_text)
    return _LOADED[key]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column in runs of some megabytes, a longer text alone."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def opened(uri: str):
    """(file system, path) of a URI or an absolute path."""
    return files.FileSystem.from_uri(uri)


def put(uri: str, write) -> None:
    """Write a file under another name and move it into place: a repeated task replaces it whole."""
    system, path = opened(uri)
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as stream:
        write(stream)
    system.move(aside, path)


def mapped(uri: str, kind: str) -> np.ndarray:
    """The numbers of a file: a memory map where the file system has one, else its bytes."""
    system, path = opened(uri)
    if isinstance(system, files.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return np.zeros(0, kind)
        return np.memmap(path, kind, "r")
    with system.open_input_file(path) as stream:
        return np.frombuffer(stream.read_buffer(), kind)


def write_documents(
    docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int, folder: str,
    separate_words: bool = False, special_as_text: bool = False,
) -> DataFrame:
    """Tokenise every text, append ``end_id``, and write the files; returns the table of parts.

    Documents stand in ascending key order, nulls first; equal keys in the order of their
    texts' hashes.  Null texts are empty; texts may be of any length, other columns are not read.
    Strings of added tokens in a text become those tokens, as the library does by default, or
    ordinary text with ``special_as_text``.  ``separate_words`` may be set for a vocabulary that
    drops white space and never joins over it: each distinct word is then tokenised once.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    size = Tokenizer.from_str(definition.value).get_vocab_size()
    kind = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    narrow = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    total = narrow.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    ordered = narrow.repartitionByRange(parts, "_key").sortWithinPartitions(
        "_key", F.xxhash64("_text"), "_text"
    )
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, coder = f"{folder}/part-{part:06d}", encoder(definition.value, kind, separate_words, special_as_text)
        keys, sizes = [], [np.zeros(0, np.int64)]

        def ids(stream):
            for batch in batches:
                keys.append(batch.column("_key"))
                for texts in slices(batch.column("_text")):
                    found, counts = coder.encode(texts)
                    stream.write(np.insert(found, np.cumsum(counts), end_id).astype(kind).tobytes())
                    sizes.append(counts + 1)

        put(f"{name}.ids", ids)
        sizes = np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        put(f"{name}.offsets", lambda stream: stream.write(offsets.tobytes()))
        if keys:
            table = pa.table({"key": pa.chunked_array(keys)})

            def save(stream):
                with pa.ipc.new_file(stream, table.schema) as writer:
                    writer.write_table(table)

            put(f"{name}.keys", save)
        counts = [pa.array([x], pa.int64()) for x in (part, len(sizes), int(offsets[-1]))]
        yield pa.RecordBatch.from_arrays(counts, ["part", "documents", "ids"])

    ordered.mapInArrow(write, "part long, documents long, ids long").write.parquet(f"{folder}/totals")
    # One row per part of 32 MB text: prefix sums over a few numbers each.
    totals = sorted(map(tuple, spark.read.parquet(f"{folder}/totals").collect()))
    base, rows = 0, []
    for part, count, size in totals:
        rows.append((part, base, count, size, kind))
        base += size
    table = spark.createDataFrame(rows, "part long, base long, documents long, ids long, kind string")
    table.write.parquet(f"{folder}/parts")
    return spark.read.parquet(f"{folder}/parts")


def read_documents(spark: SparkSession, folder: str, key_type: str) -> DataFrame:
    """(key, start, ids) of every document: its global offset and its ids as packed
    little-endian unsigned 32-bit integers, read from the mapped files part by part."""
    parts = spark.read.parquet(f"{folder}/parts").where("documents > 0")
    spread = parts.repartitionByRange(max(1, parts.count()), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/part-{row['part']:06d}"
                ids, offsets = mapped(f"{name}.ids", row["kind"]), mapped(f"{name}.offsets", "<u8")
                system, path = opened(f"{name}.keys")
                with system.open_input_file(path) as stream:
                    keys = pa.ipc.open_file(stream).read_all().column("key").combine_chunks()
                for a in range(0, row["documents"], SLICE):
                    at = offsets[a : a + SLICE + 1].astype(np.int64)
                    packed = [ids[i:j].astype("<u4").tobytes() for i, j in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(a, SLICE), pa.array(at[:-1] + row["base"], pa.int64()),
                            pa.array(packed, pa.binary()),
                        ],
                        ["key", "start", "ids"],
                    )

    return spread.mapInArrow(read, f"key {key_type}, start long, ids binary")
