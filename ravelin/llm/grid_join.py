"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine at least t lie within eps = sqrt(2 - 2t).  Vectors are sorted by their
grid cells (side eps) on the leading principal dimensions and cut into sequence intervals.
Intervals form a tree of three levels inside a partition; pairs of intervals are joined from the
top, and a pair whose boxes lie further apart than eps is skipped with all below it.  Leaf pairs
that remain are compared in double precision.  The principal dimensions come from a bounded
sample; they decide what is skipped, never what is found.
"""

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import components, written
from ravelin.llm.simhash import Forest

#: Vectors of a leaf interval, children of an interval, principal dimensions, sampled vectors.
LEAF, FAN, DIMENSIONS, SAMPLE = 1024, 32, 8, 20_000
#: Allowance for rounding in the bounds.
SLACK = 1e-9


def sound(vector) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def unit(vector) -> np.ndarray:
    """The vector at length 1; scaled first, so that no finite double over- or underflows."""
    v = np.asarray(vector, np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def principal(vectors: DataFrame, dimensions: int) -> dict[int, np.ndarray]:
    """Leading directions per vector length, from at most SAMPLE vectors of the smallest hashes."""
    sample = vectors.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"]
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(np.asarray(v, np.float64))
    axes = {}
    for size, members in by_size.items():
        rows = np.array([unit(x) for x in members])
        _, _, across = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)
        axes[size] = across[:dimensions]
    return axes


def intervals(vectors: DataFrame, eps: float, axes: dict[int, np.ndarray]) -> DataFrame:
    """Leaf intervals (label, size, node, lo, hi, ids, weights, data) in grid order.

    ``vectors`` has label, id, weight, v; coordinates past the known axes count as 0, which
    only widens what is compared.
    """
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spots = np.zeros((len(batch), DIMENSIONS))
            for i, v in enumerate(batch["v"]):
                across = axes.get(len(v))
                if across is not None:
                    spots[i, : len(across)] = across @ unit(v)
            batch["spot"] = list(spots)
            batch["cell"] = list(np.floor(spots / eps).astype(np.int32))
            batch["size"] = [len(v) for v in batch["v"]]
            yield batch

    kind = vectors.schema["v"].dataType.simpleString()
    placed = vectors.select("label", "id", "weight", "v").mapInPandas(
        place,
        f"label {vectors.schema['label'].dataType.simpleString()}, id long, weight long, v {kind},"
        " spot array<double>, cell array<int>, size int",
    )
    order = ["label", "size", "cell", "id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, count, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            while len(held):
                same = (held["label"] == held["label"].iloc[0]) & (held["size"] == held["size"].iloc[0])
                run = int(same.to_numpy().argmin()) if not same.all() else len(held)
                if run == len(held) and run < LEAF:
                    break
                yield leaf(held.iloc[: min(run, LEAF)], top + count)
                held, count = held.iloc[min(run, LEAF) :], count + 1
        if held is not None and len(held):
            yield leaf(held, top + count)

    def leaf(rows, node):
        spots = np.stack(rows["spot"].to_list())
        return pd.DataFrame(
            {
                "label": rows["label"].iloc[:1].to_numpy(), "size": rows["size"].iloc[:1].to_numpy(),
                "node": node, "lo": [spots.min(axis=0)], "hi": [spots.max(axis=0)],
                "ids": [rows["id"].to_numpy(np.int64).tobytes()],
                "weights": [rows["weight"].to_numpy(np.int64).tobytes()],
                "data": [np.stack(rows["v"].to_list()).astype(np.float64).tobytes()],
            }
        )

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(
        cut,
        f"label {vectors.schema['label'].dataType.simpleString()}, size int, node long,"
        " lo array<double>, hi array<double>, ids binary, weights binary, data binary",
    )


def level(nodes: DataFrame, fan: int) -> DataFrame:
    """Parents of nodes: runs of ``fan`` neighbours in a partition's sequence, with their boxes."""
    up = F.shiftleft(F.shiftright("node", 32), 32) + F.floor(F.col("node").bitwiseAND(0xFFFFFFFF) / fan)
    boxes = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(DIMENSIONS)]
    boxes += [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(DIMENSIONS)]
    grown = nodes.groupBy("label", "size", up.alias("node")).agg(*boxes)
    return grown.select(
        "label", "size", "node",
        F.array(*[f"l{i}" for i in range(DIMENSIONS)]).alias("lo"),
        F.array(*[f"h{i}" for i in range(DIMENSIONS)]).alias("hi"),
    )


def near(eps: float):
    """Condition: the boxes of a and b are at most eps apart."""
    def gap(i):
        far = F.greatest(F.col("a.lo")[i] - F.col("b.hi")[i], F.col("b.lo")[i] - F.col("a.hi")[i], F.lit(0.0))
        return far * far

    return reduce(add, map(gap, range(DIMENSIONS))) <= eps * eps + SLACK


def surviving(leaves: DataFrame, eps: float) -> DataFrame:
    """Pairs (x, y), x <= y, of leaf nodes that may hold a link."""
    boxes = leaves.select("label", "size", "node", "lo", "hi")
    middle = written(level(boxes, FAN), "intervals")
    top = level(middle, FAN)

    def cells(margin):
        first = [F.floor(F.col(c)[0] / eps + m).cast("long") for c, m in (("lo", -margin), ("hi", margin))]
        return F.sequence(*first)

    # Boxes within eps meet in a cell of the first dimension; the least such cell counts.
    a = top.withColumn("at", F.explode(cells(0)))
    b = top.withColumn("from", F.floor(F.col("lo")[0] / eps - 1).cast("long")).withColumn(
        "at", F.explode(cells(1))
    )
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.size") == F.col("b.size"))
    start = F.greatest(F.floor(F.col("a.lo")[0] / eps).cast("long"), F.col("b.from"))
    pairs = (
        a.alias("a").join(b.alias("b"), same & (F.col("a.at") == F.col("b.at")))
        .where((F.col("a.node") <= F.col("b.node")) & (F.col("a.at") == start) & near(eps))
        .select("a.label", "a.size", F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    )
    up = F.shiftleft(F.shiftright("node", 32), 32) + F.floor(F.col("node").bitwiseAND(0xFFFFFFFF) / FAN)
    for nodes in (middle, boxes):
        below = nodes.withColumn("up", up)
        keys = lambda side, end: (
            (F.col("p.label") == F.col(f"{side}.label")) & (F.col("p.size") == F.col(f"{side}.size"))
            & (F.col(f"p.{end}") == F.col(f"{side}.up"))
        )
        pairs = (
            pairs.alias("p").join(below.alias("a"), keys("a", "x")).join(below.alias("b"), keys("b", "y"))
            .where(((F.col("p.x") < F.col("p.y")) | (F.col("a.node") <= F.col("b.node"))) & near(eps))
            .select("p.label", "p.size", F.col("a.node").alias("x"), F.col("b.node").alias("y"))
        )
    return pairs


def compared(leaves: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(id, n, other): links of each vector in one leaf pair, and one of its group's edges."""
    data = leaves.select("node", "ids", "weights", "data", "size")
    left = data.withColumnsRenamed({c: f"{c}_x" for c in ("ids", "weights", "data")}).withColumnRenamed("node", "x")
    right = data.drop("size").withColumnsRenamed({c: f"{c}_y" for c in ("ids", "weights", "data")})
    full = pairs.select("x", "y").join(left, "x").join(right.withColumnRenamed("node", "y"), "y")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                sides = []
                for end in "xy":
                    v = np.frombuffer(getattr(row, f"data_{end}")).reshape(-1, row.size)
                    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
                    sides.append(v / np.linalg.norm(v, axis=1, keepdims=True))
                ids = [np.frombuffer(getattr(row, f"ids_{end}"), np.int64) for end in "xy"]
                weights = [np.frombuffer(getattr(row, f"weights_{end}"), np.int64) for end in "xy"]
                linked = sides[0] @ sides[1].T >= least
                alone = row.x == row.y
                if alone:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                names = ids[0] if alone else np.concatenate(ids)
                n = linked @ weights[1]
                n = n if alone else np.concatenate([n, weights[0] @ linked])
                # One edge per vector keeps a group connected: no group becomes all its pairs.
                order = np.argsort(names, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                a, b = np.nonzero(linked)
                forest = Forest(len(names))
                forest.join(rank[a], rank[b if alone else b + len(ids[0])])
                roots = names[order][forest.roots()][rank]
                hit = n > 0
                yield pd.DataFrame({"id": names[hit], "n": n[hit], "other": roots[hit]})

    return full.mapInPandas(compare, "id long, n long, other long")


def near_duplicates(
    vectors: DataFrame, key: str, vector: str, label: str, least: float = 0.98
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Vectors of one label (and length) link at a cosine of ``least`` or more, in double
    precision.  Null labels or keys and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing.  ``n_links`` counts other vectors; equal vectors
    are compared once and count each; fully repeated rows are one vector.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")
    )
    rows = rows.withColumn("ok", F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("v")))
    good = rows.where("ok").drop("ok").distinct()
    classes = written(
        good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vectors"
    )
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    leaves = written(intervals(classes, eps, principal(classes, DIMENSIONS)), "leaves")
    found = written(compared(leaves, surviving(leaves, eps), least), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = (
        classes.join(counts, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    met = rows.join(known, ["label", "v"], "left")
    alive = F.col("ok") & F.col("component").isNotNull()
    component = F.when(alive, F.col("component")).otherwise(F.col("id"))
    return met.select(
        F.col("id").alias(key), F.when(alive, F.col("n")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )
