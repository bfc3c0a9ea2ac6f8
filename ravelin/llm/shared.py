"""Folder shared by driver and executors, written tables, connected components."""

import tempfile
import uuid
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of each table of ``written`` that is still in use.
FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@cache
def local_root() -> str:
    return tempfile.mkdtemp(prefix="ravelin-")


def shared_folder(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A new folder name below ``root``, else below the folder that the cluster names in
    spark.checkpoint.dir.

    Where neither is given and driver and tasks share one machine, a temporary folder takes its
    place; on a cluster that is an error.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or local_root()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: the lineage ends here, so a lost
    executor costs a read and no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    FOLDERS[table] = folder
    return table


def sliced(batches, rows: int = 500):
    """Arrow batches in slices, so that a task holds the results of a few hundred texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more.

    Only safe once all that was derived from them is itself a written table.
    """
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(FOLDERS.pop(table))
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node reachable, for the undirected ``edges`` (a, b).

    Alternating large-star and small-star rounds: each hangs a node's neighbours under the
    smallest of them, as aggregates and joins on the node, until nothing changes.  Hubs are
    safe: the minimum has a map-side step and the join may be split by adaptive execution.
    Edges with a null end and loops are left out; nodes without edges do not appear.
    """
    stars = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    stars = written(stars, "stars")
    before = None
    for _ in range(rounds):
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        )
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(least.select("u", "m"))
        last, stars = stars, written(small.distinct(), "stars")
        dropped(last)
        now = stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return nodes.union(roots.distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
