"""Continuous scanning: arriving files in, findings not seen before out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import baseline, governance
from ravelin.plans import scan
from ravelin.sources import files as S


def read_arrivals(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """A stream of new text files below ``root``."""
    reader = spark.readStream.format("text").option("wholetext", True)
    reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.regexp_replace("_metadata.file_path", r"^file:/*", "/")
    raw = reader.load(root).select(path.alias("path"), F.col("value").alias("text"))
    return S.from_table(raw, F.col("path"), F.col("text"))


def new_findings(files: DataFrame, known: DataFrame, root: str, packs: list) -> DataFrame:
    """Findings of a stream of files that neither the baseline nor the stream has had before.

    Detection is a projection; only fingerprints are state, one per distinct finding, and they
    are kept for good: a finding is new once, however long ago it was.  The state is spread by
    fingerprint and lives with the checkpoint; with many findings use the RocksDB state store.
    A stream with a new checkpoint starts from the baseline that ``remember`` has written.
    """
    found = scan.detect(files, packs)
    fresh = baseline.with_fingerprint(found, root).join(known.distinct(), "fingerprint", "left_anti")
    return fresh.dropDuplicates(["fingerprint"])


def remember(spark: SparkSession, out: str, path: str) -> int:
    """Add the fingerprints that ``run_once`` has emitted to a baseline; returns how many.

    A stream with a new checkpoint reads the baseline, so it does not report them again.
    """
    return baseline.add(spark.read.parquet(out).select("fingerprint"), path)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived, append to a parquet table, stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()


def log_decisions(
    stream: DataFrame, authorizations: DataFrame, out: str, checkpoint: str,
    action: str | None = None, keep: tuple = (),
) -> None:
    """Decide on a stream of requests and append one log row per request.

    A batch is written to a folder of its own query and number, so a retried batch
    replaces itself and no other query's rows, also under a new checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decided = governance.decide_requests(batch, authorizations, action)
        rows = governance.audit_rows(decided, keep)
        # The checkpoint names the query: its id survives restarts and is new with a new one.
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows.write.mode("overwrite").json(f"{out}/query={query_id}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
