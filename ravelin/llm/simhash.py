"""SimHash near-duplicates: exact pairs within a Hamming radius from vantage-point trees.

The bits of a fingerprint are split into blocks, with one vantage-point tree per block.  Two
fingerprints at most ``max_bits`` apart are, in some block, at most ``max_bits // blocks``
apart, so that is the query radius of every tree, and the triangle bound prunes the branches
further away.  A tree node holds a vantage point and the median distance to it;
a fingerprint's home is one leaf, and it also queries each leaf whose border lies within the
radius.  Leaves are the shards of a Spark shuffle; inside a shard the same splitting goes on,
and pairs that survive are compared over all bits.

Trees are built from a bounded, hash-ordered sample of the fingerprints; every fingerprint is
routed, so the sample decides the balance of the shards and never the result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import components, written

BITS = 64
#: Blocks of a fingerprint, a tree each.  At most 4 differing bits are none in one of five, so the
#: radius is 0 and a row visits one leaf of each tree.  With three blocks the radius is 1 and rows
#: near a border visit several; the rows of the shuffle then grow faster than the input.
BLOCKS = 5
#: Fingerprints that a leaf should hold, and the most that the driver samples to build trees.
LEAF, SAMPLE = 16_384, 65_536
#: Members of one task's comparison; a fuller leaf is dealt into chunks that meet pairwise.
CHUNK = 32_768
#: Below this many members a shard is compared directly.
DIRECT = 256
#: Shingles hashed at a time.
BLOCK = 100_000


def fingerprint(text: str | None, words: int) -> int:
    """Bits set in over half of the XXH64 hashes (seed 42) of all word shingles, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space.  A text with fewer words is
    one shingle, a text with none (or null) has fingerprint 0.
    """
    parts = (text or "").encode().lower().split()  # bytes: only ASCII is touched
    if not parts:
        return 0
    total = max(1, len(parts) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, total, BLOCK):
        stop = min(total, start + BLOCK)
        columns = [parts[start + i : stop + i] for i in range(words)]
        shingles = zip(*columns, strict=True) if len(parts) >= words else [parts]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, shingles)]
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > total).tolist())


def fingerprints(docs: DataFrame, text: str, words: int, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column of fingerprints (the 64 bits as a signed number)."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = [fingerprint(t, words) for t in texts]
            yield pd.Series(np.array(made, np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(text)))


def block_masks(blocks: int) -> list[np.uint64]:
    """Contiguous bit masks, sizes as even as can be."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [
        np.uint64(sum(1 << b for b in range(lo, hi)))
        for lo, hi in zip(edges, edges[1:], strict=False)
    ]


def distance(a: np.ndarray, b, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def split(values: np.ndarray, mask: np.uint64, tries: int = 4):
    """(vantage point, median distance) that divides the values, or None if none of a few does."""
    for k in range(tries):
        point = values[(len(values) * k) // tries]
        far = distance(values, point, mask)
        middle = int(np.partition(far, len(far) // 2)[len(far) // 2])
        for at in (middle, middle - 1):
            inside = np.count_nonzero(far <= at)
            if 0 < inside < len(far):
                return point, at
    return None


class Tree:
    """A vantage-point tree over the bits of one mask."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, leaf: int):
        self.mask, self.leaves = mask, 0
        self.root = self.grow(np.asarray(sample, np.uint64), leaf)

    def grow(self, values, leaf):
        found = split(values, self.mask) if len(values) > leaf else None
        if found is None:
            self.leaves += 1
            return self.leaves - 1
        inside = distance(values, found[0], self.mask) <= found[1]
        return (*found, self.grow(values[inside], leaf), self.grow(values[~inside], leaf))

    def route(self, values: np.ndarray, radius: int):
        """Arrays (index of value, leaf, is home): the home leaf and all that the radius meets."""
        found = []
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, at, home = todo.pop()
            if not at.size:
                continue
            if isinstance(node, int):
                found.append((at, np.full(at.size, node), home))
                continue
            point, middle, near, away = node
            far = distance(values[at], point, self.mask).astype(np.int64)
            inside = far <= middle
            left, right = far - radius <= middle, far + radius > middle
            todo.append((near, at[left], (home & inside)[left]))
            todo.append((away, at[right], (home & ~inside)[right]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]


def links(home, query, mask, radius: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into home, into query) at most ``max_bits`` apart, found by splitting on; at most
    512 x 4096 at a time, to be folded before the next."""
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    todo = [(np.arange(len(home)), np.arange(len(query)))]
    while todo:
        h, q = todo.pop()
        if not h.size or not q.size:
            continue
        cut = split(home[h], mask) if h.size > DIRECT else None
        if cut is None:
            for i in range(0, h.size, 512):
                for j in range(0, q.size, 4096):
                    a, b = h[i : i + 512], q[j : j + 4096]
                    x, y = np.nonzero(distance(home[a][:, None], query[b], every) <= max_bits)
                    if x.size:
                        yield a[x], b[y]
            continue
        point, middle = cut
        fh = distance(home[h], point, mask).astype(np.int64)
        fq = distance(query[q], point, mask).astype(np.int64)
        todo.append((h[fh <= middle], q[fq - radius <= middle]))
        todo.append((h[fh > middle], q[fq + radius > middle]))


class Forest:
    """Least member of each linked group; keeps one edge per member instead of all pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            roots = self.roots()
            a, b = roots[a], roots[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def near_edges(prints: DataFrame, max_bits: int, blocks: int, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints linked at ``max_bits`` or fewer bits.

    ``prints`` has distinct, non-null longs in column ``f``.  Every task returns a spanning
    forest of the links it finds, so a group of near copies never becomes all its pairs; the
    connected components of the result are those of all links.
    """
    radius, masks, chunk = max_bits // blocks, block_masks(blocks), CHUNK
    total = prints.count()
    wanted = min(SAMPLE, max(1024, 16 * (total // leaf)))
    sample = prints.orderBy(F.xxhash64("f"), "f").limit(wanted).toArrow().column("f")
    sample = sample.to_numpy().astype(np.int64).view(np.uint64)
    per_leaf = max(2, int(leaf * len(sample) / max(total, 1)))
    trees = [Tree(sample, mask, per_leaf) for mask in masks]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["f"].to_numpy(np.int64)
            for k, tree in enumerate(trees):
                at, shard, home = tree.route(values.view(np.uint64), radius)
                yield pd.DataFrame(
                    {"tree": np.int32(k), "shard": shard.astype(np.int32), "home": home,
                     "f": values[at]}
                )

    routed = prints.mapInPandas(route, "tree int, shard int, home boolean, f long")
    sizes = routed.groupBy("tree", "shard").agg(
        F.ceil(F.count("*") / chunk).cast("int").alias("chunks")
    )
    # At most blocks * SAMPLE / 2 leaves of three numbers each: a few MB whatever the input.
    dealt = routed.join(F.broadcast(sizes), ["tree", "shard"]).withColumn(
        "chunk", F.pmod(F.xxhash64("f"), F.col("chunks")).cast("int")
    )
    # Chunk i meets chunk j in the group (least, greatest); most leaves have one chunk.
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "tree", "shard", "home", "f", "chunk",
        F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
    )

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        tree, _, lo, hi = key
        values, place = np.unique(group["f"].to_numpy(np.int64), return_inverse=True)
        bits, forest = values.view(np.uint64), Forest(len(values))
        home, side = group["home"].to_numpy(bool), group["chunk"].to_numpy()
        # Homes of either chunk against all rows of the other; within one chunk against itself.
        for left, right in {(lo, hi), (hi, lo)}:
            h, q = place[home & (side == left)], place[side == right]
            for a, b in links(bits[h], bits[q], masks[tree], radius, max_bits):
                forest.join(h[a], q[b])
        roots = forest.roots()
        moved = np.flatnonzero(roots != np.arange(len(values)))
        return pd.DataFrame({"a": values[moved], "b": values[roots[moved]]})

    return met.groupBy("tree", "shard", "lo", "hi").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str, text: str, words: int = 4, max_bits: int = 4, blocks: int = BLOCKS
) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is the smallest
    key reachable over links, the row's own included.  Equal fingerprints are compared once.
    Null keys are kept and never chosen as smallest unless a group has no other; repeated rows
    are repeated in the result; null and empty texts have fingerprint 0 and link like others.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = written(fingerprints(narrow, "_text", words, "f").select("_key", "f"), "prints")
    labelled, best = grouped(marked, max_bits, blocks)
    # One row per fingerprint class: the class with a third of all documents is joined once,
    # and adaptive execution splits its documents.
    named = labelled.join(best, "c").select("f", F.col("best.least").alias("component_id"))
    return marked.join(named, "f").select(
        F.col("_key").alias(key),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def grouped(marked: DataFrame, max_bits: int, blocks: int):
    """(classes (f, least, c), groups (c, best)) of fingerprinted rows (_key, f).

    ``c`` names the linked group of a fingerprint, ``best`` its smallest key with fingerprint.
    """
    classes = written(marked.groupBy("f").agg(F.min("_key").alias("least")), "classes")
    member = components(near_edges(classes.select("f"), max_bits, blocks))
    labelled = written(
        classes.join(member, classes.f == member.node, "left").select(
            "f", "least", F.coalesce("component", "f").alias("c")
        ),
        "labelled",
    )
    keyed = F.when(F.col("least").isNotNull(), F.struct("least", "f"))
    return labelled, labelled.groupBy("c").agg(F.min(keyed).alias("best"))


def keep_first(
    docs: DataFrame, key: str, text: str, words: int = 4, max_bits: int = 4, blocks: int = BLOCKS
) -> DataFrame:
    """One document of each group: the row with the smallest key; columns as they are.

    Rows with a null key are kept (they cannot be told apart), and so are repeated rows of the
    kept document.
    """
    # Own names for all columns, so that none of the caller's can clash.
    free = [f"_{i}_" for i in range(len(docs.columns))]
    at, body = (free[docs.columns.index(c)] for c in (key, text))
    marked = fingerprints(docs.toDF(*free), body, words, "_print")
    known = marked.where(F.col(at).isNotNull())
    known = written(known.select(F.col(at).alias("_key"), F.col("_print").alias("f")), "prints")
    _, best = grouped(known, max_bits, blocks)
    keeper = best.select(F.col("best.f").alias("_print"), F.col("best.least").alias(at))
    one = keeper.withColumn("_kept", F.lit(True))
    joined = marked.join(one, [at, "_print"], "left")
    return joined.where(F.col("_kept") | F.col(at).isNull()).select(*free).toDF(*docs.columns)
