"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary, one of toxic text.

Words become 8-byte codes (their hashes), so a match of the compressor is a match of whole words.
The ordinary dictionary is trained on windows of ordinary text.  The toxic one is not trained on
whole windows of toxic text, which are ordinary words for the most part, but on what is left of
them when only words stay that toxic texts hold far more often than ordinary ones.  Every window of
a text is compressed with the ordinary dictionary and with both; the bytes that the toxic dictionary
saves are counted per text, and a logistic model calibrates thresholds on these counts.
Dictionaries and calibration learn from disjoint halves of a bounded sample of labelled rows.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.shared import sliced

#: Labelled rows to learn from, per class.  Of a text with more words, that many in whole runs of
#: RUN words, evenly spread over the text, are learned from.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_WORDS, RUN = 4000, 8000, 2048, 16
#: Words of a window and between windows; largest gain told apart.
WINDOW, STEP, TOP = 8, 4, 16
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 8_192
#: Share of toxic texts a telling word is in, and how much more often than in ordinary ones.
SUPPORT, LIFT = 0.01, 20.0
REMEMBERED = 200_000
STRIPPED = ".,!?;:\"'()[]{}…“”„«»¡¿"


class Coder:
    """Texts as runs of 8-byte word codes."""

    def __init__(self):
        self.memory: dict[str, bytes] = {}

    def code(self, text: str | None) -> bytes:
        words = (text or "").split()
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        for word in set(words).difference(self.memory):
            bare = word.strip(STRIPPED).lower()
            self.memory[word] = xxhash.xxh3_64_digest(bare) if bare else b""
        return b"".join(map(self.memory.__getitem__, words))


def sampled(coded: bytes) -> bytes:
    """The codes of a text, or of SAMPLE_WORDS of its words in whole runs."""
    width = 8 * RUN
    if len(coded) <= 8 * SAMPLE_WORDS:
        return coded
    runs = -(-len(coded) // width)
    chosen = np.linspace(0, runs - 1, SAMPLE_WORDS // RUN).astype(int)
    return b"".join(coded[width * i : width * (i + 1)] for i in chosen.tolist())


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compressor whose only knowledge is ``content``; matches of six bytes or more."""
    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_FAST, min_match=6, window_log=17, hash_log=15, chain_log=15,
        search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    known = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=known)


def gains(coded: bytes, ordinary, both) -> np.ndarray:
    """Histogram over all windows of the bytes that the toxic dictionary saves, 0 to TOP."""
    counts = np.zeros(TOP + 1)
    words = len(coded) // 8
    if not words:
        return counts
    one, two = ordinary.compress, both.compress
    for start in range(0, max(1, words - WINDOW + STEP), STEP):
        window = coded[8 * start : 8 * (start + WINDOW)]
        saved = len(one(window)) - len(two(window))
        counts[min(max(saved, 0), TOP)] += 1
    return counts


def features(histograms: np.ndarray) -> np.ndarray:
    above = histograms[:, ::-1].cumsum(axis=1)[:, ::-1]
    total = np.maximum(above[:, :1], 1)
    return np.concatenate([np.log1p(above[:, 1:]), above[:, 1:] / total, np.log(total)], axis=1)


def dictionary(texts: list[np.ndarray], size: int) -> bytes:
    """Content of a dictionary trained on runs of sixteen words; short samples stand as they are."""
    raw = [text.tobytes() for text in texts]
    windows = [x[i : i + 128] for x in raw for i in range(0, len(x), 128)]
    order = np.random.default_rng(5).permutation(len(windows))[:40_000]
    windows = [windows[i] for i in order]
    try:
        return zstandard.train_dictionary(size, windows, k=16, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from
        return b"".join(windows)[-size:]


class Model:
    """Two dictionaries and the calibration of their gains."""

    def __init__(self, coded: list[bytes], toxic: np.ndarray, turn: np.ndarray):
        """Learns dictionaries from rows with ``turn``, thresholds from the others."""
        parts = [np.frombuffer(x, np.uint64) for x in coded]
        bad = [x for x, y, t in zip(parts, toxic, turn, strict=True) if y and t]
        good = [x for x, y, t in zip(parts, toxic, turn, strict=True) if not y and t]
        telling = self.telling(bad, good)
        self.ordinary = dictionary(good, ORDINARY_BYTES)
        self.toxic = dictionary([x[np.isin(x, telling)] for x in bad], TOXIC_BYTES)
        rest = [x for x, t in zip(coded, turn, strict=True) if not t]
        self.fit(self.measure(rest), toxic[~turn])

    @staticmethod
    def telling(bad: list[np.ndarray], good: list[np.ndarray]) -> np.ndarray:
        """Words that toxic texts hold far more often than ordinary ones."""
        words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, bad)]), return_counts=True)
        others, m = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, good)]), return_counts=True)
        seen = np.zeros(len(words))
        if len(others):
            at = np.minimum(np.searchsorted(others, words), len(others) - 1)
            seen = np.where(others[at] == words, m[at], 0)
        lift = (n / max(1, len(bad))) / ((seen + 0.5) / max(1, len(good)))
        return words[(n >= max(3, SUPPORT * len(bad))) & (lift >= LIFT)]

    def measure(self, coded: list[bytes]) -> np.ndarray:
        one, two = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
        rows = [gains(x, one, two) for x in coded]
        return np.array(rows).reshape(len(rows), TOP + 1)

    def fit(self, histograms: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> None:
        """Logistic regression by Newton steps; without both labels every score is the mean."""
        x, y = features(histograms), toxic.astype(float)
        self.mean, self.spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (0.0, 1.0)
        self.weights = np.zeros(2 * TOP + 2)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.weights[-1] = np.log(share / (1 - share))
        if len(np.unique(y)) < 2:
            return
        z = np.concatenate([(x - self.mean) / self.spread, np.ones((len(x), 1))], axis=1)
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (y - p) - penalty * self.weights
            bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            self.weights = self.weights + np.linalg.solve(bend, slope)

    def score(self, histograms: np.ndarray) -> np.ndarray:
        z = (features(histograms) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


SAMPLED = pa.schema([("h", pa.int64()), ("y", pa.bool_()), ("coded", pa.binary())])


def learned(
    docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, learn=None
) -> Model:
    """Model from at most SAMPLE_TOXIC and SAMPLE_ORDINARY labelled rows, those of least hash.

    ``learn`` (a condition on _key) chooses the rows that may be learned from; rows with null
    key or label are not, several labels of a key count as their mean.  Texts of any length are
    learned from (``sampled``) and scored whole; equal texts are learned from once.  One task
    learns from the sample, at most 16 KB a row; the driver receives the dictionaries and weights.
    """
    known = labels.select(F.col(label_key).alias("_key"), F.col(label).alias("_label")).dropna()
    known = known.where(learn if learn is not None else F.lit(True))
    known = known.groupBy("_key").agg((F.avg("_label") >= 0.5).alias("_label"))
    some = [
        known.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(size)
        for value, size in ((True, SAMPLE_TOXIC), (False, SAMPLE_ORDINARY))
    ]
    sample = some[0].union(some[1])  # at most 12,000 keys
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col(text).isNotNull())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in sliced(batches):
            coded = [sampled(coder.code(t.as_py())) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_hash"), batch.column("_label"), pa.array(coded, pa.binary())],
                ["h", "y", "coded"],
            )

    rows = (
        texts.join(F.broadcast(sample), "_key").select(F.xxhash64("_text").alias("_hash"), "_label", "_text")
        .mapInArrow(code, "h long, y boolean, coded binary")
        .groupBy("h").agg(F.max("y").alias("y"), F.first("coded").alias("coded"))
    )

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([*batches], SAMPLED).sort_by("h")
        hashes = table.column("h").to_numpy()
        toxic = np.array(table.column("y").to_pylist(), bool)
        model = Model(table.column("coded").to_pylist(), toxic, hashes % 2 == 0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    done = rows.repartition(1).mapInArrow(learn_all, "model binary").first()
    return pickle.loads(bytes(done["model"]))


def scored(docs: DataFrame, text: str, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic, from all of its windows.

    Null and empty texts have no windows and the score of such a text.
    """
    rest = [f for f in docs.schema.fields if f.name != name]
    docs = docs.select([f.name for f in rest])
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        one, two = compressor(model.ordinary), compressor(model.ordinary + model.toxic)
        for batch in sliced(batches):
            rows = [gains(coder.code(t.as_py()), one, two) for t in batch.column(at)]
            found = model.score(np.array(rows).reshape(len(rows), TOP + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(score, schema)
