"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of every text are computed once.  Random cosines of the standardised statistics
approximate a Gaussian kernel; each partition of labelled rows adds up its part of the normal
equations, the driver solves one small system, and pooled neighbours of binned scores calibrate
the result to a probability.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import written

#: Cosines, width of the kernel, ridge, bins of the calibration, partitions whose sums meet.
COSINES, WIDTH, RIDGE, BINS, SUMS = 256, 6.0, 1.0, 1000, 32
#: Rows of a batch, and characters of a text counted at a time.
SLICE, BLOCK = 2000, 1 << 20

NAMES = (
    "chars", "words", "word_length", "word_length_spread", "distinct_words", "top_word", "upper",
    "digit", "symbol", "stop", "other", "space", "lines", "line_words", "same_lines", "short_lines",
    "sentence_words", "marked_words", "doubled_words", "same_pairs", "runs", "title_words", "vowels",
    "longest_word",
)
SYMBOLS = np.zeros(128, bool)
SYMBOLS[[ord(c) for c in "#&%*$@^~<>|{}[]=+_\\/!"]] = True
MARKS = tuple("#&%*$@^~|!")
VOWELS = np.zeros(128, bool)
VOWELS[[ord(c) for c in "aeiouyAEIOUY"]] = True


def statistics(text: str | None) -> list[float]:
    """NAMES of a whole text; an empty or null text gives zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.zeros(7, np.int64)  # upper, digit, symbol, full stop, non-ASCII, space, vowel
    runs, last = 0, -1
    for start in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[start : start + BLOCK].encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(codes, 127)
        counts += [
            np.count_nonzero(x)
            for x in (
                (codes >= 65) & (codes <= 90), (codes >= 48) & (codes <= 57), SYMBOLS[low],
                codes == 46, codes > 127, (codes == 32) | ((codes >= 9) & (codes <= 13)), VOWELS[low],
            )
        ]
        runs += np.count_nonzero(codes[1:] == codes[:-1]) + int(codes[0] == last)
        last = int(codes[-1])
    n, m = len(text), len(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    return [
        np.log1p(n), np.log1p(m), sizes.mean(), sizes.std(), len(seen) / m, max(seen.values()) / m,
        counts[0] / n, counts[1] / n, counts[2] / n, counts[3] / n, counts[4] / n, counts[5] / n,
        np.log1p(len(lines)), np.log1p(m / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), np.log1p(m / (1 + counts[3])),
        sum(w[-1] in MARKS for w in words) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, 1 - pairs / max(1, m - 1),
        runs / n, sum(map(str.istitle, words)) / m, counts[6] / n, np.log1p(sizes.max()),
    ]


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, stats) for every row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = np.array([statistics(t.as_py()) for t in part.column(1)], np.float64)
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(NAMES))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), values.cast(pa.list_(pa.float64()))], ["_key", "stats"]
                )

    return docs.select(key, text).mapInArrow(measure, f"_key {kind}, stats array<double>")


def arrays(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.asarray(batch.column(name).flatten()).reshape(-1, width)


class Model:
    """Standardised statistics and their random cosines; weights and calibration once fitted."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = draw.normal(0, 1 / WIDTH, (len(mean), COSINES)) * np.sqrt(2)
        self.shift = draw.uniform(0, 2 * np.pi, COSINES)
        self.weights = self.edges = self.levels = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / COSINES)
        return np.concatenate([waves, x / 8, np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def pooled(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing levels of bins (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for count, one in zip(counts, ones, strict=True):
        blocks.append([count, one, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), one / count) for count, one, k in blocks])


def fitted(labelled: DataFrame, seed: int = 7) -> Model:
    """Model of rows (stats, y): all of them, through sums of at most SUMS partitions."""
    width = len(NAMES)
    dealt = written(labelled.select("stats", "y").repartition(SUMS), "labelled")

    def summed(size, add):
        """Sum over all rows of a vector of ``size`` numbers that ``add`` makes of a batch."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += add(arrays(batch, "stats", width), np.asarray(batch.column("y"), np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        rows = dealt.coalesce(SUMS).mapInArrow(run, "sums binary").collect()
        return sum((np.frombuffer(r[0]) for r in rows), np.zeros(size))

    moments = summed(
        2 * width + 1,
        lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]),
    )
    count = max(moments[0], 1)
    mean = moments[1 : width + 1] / count
    spread = np.sqrt(np.maximum(moments[width + 1 :] / count - mean**2, 0))
    model = Model(mean, spread, seed)
    d = COSINES + width + 1

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = summed(d * d + d, normal)
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * np.eye(d), sums[d * d :])

    def binned(x, y):
        at = np.clip((model.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    sums = summed(2 * BINS, binned)
    filled = np.flatnonzero(sums[:BINS])
    if filled.size:
        model.edges = (filled + 0.5) / BINS * 2 - 0.5
        model.levels = pooled(sums[:BINS][filled], sums[BINS:][filled])
    else:  # no labels: no opinion
        model.edges, model.levels = np.zeros(1), np.full(1, 0.5)
    return model


def scored(
    docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, learn=None
) -> DataFrame:
    """(key, score) for every row of ``docs``; score is the probability of label 1.

    ``labels`` may hold several rows of a key (their mean counts, from one half up as 1) and
    nulls (ignored); ``learn`` (a condition on _key) chooses the rows to learn from.  Empty and
    null texts have a score like any other; without any label every score is 0.5.
    """
    stats = written(measured(docs, key, text), "statistics")
    known = labels.select(F.col(label_key).alias("_key"), F.col(label).alias("y")).dropna()
    known = known.groupBy("_key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    model = fitted(stats.where(learn if learn is not None else F.lit(True)).join(known, "_key"))
    kind = stats.schema["_key"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(arrays(batch, "stats", len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found)], ["key", "score"])

    return stats.mapInArrow(score, f"key {kind}, score double").withColumnRenamed("key", key)
