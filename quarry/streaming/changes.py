"""Streaming re-index.

Changes (rel_path, ts, content or null for a removed file) arrive as a stream; each trigger takes a batch, keeps the latest
change of every file, and applies it through the same hash-gated index run as a full one, which makes it idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.indexing import index_files
from quarry.plans.store import Store


def latest_changes(changes: DataFrame, key: str = "rel_path", ts: str = "ts") -> DataFrame:
    """One row per key: its latest change (ties by the greatest remaining columns); works on batches and, in update mode, on
    streams, and combines map-side."""
    rest = [c for c in changes.columns if c not in (key, ts)]
    return changes.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("x")).select(key, "x.*")


def quiet_periods(changes: DataFrame, quiet: str = "200 milliseconds", watermark: str = "1 minute") -> DataFrame:
    """Bursts of changes per file: one row when a file has been quiet for ``quiet``, with its last time and count."""
    df = changes.withWatermark("ts", watermark) if changes.isStreaming else changes
    return df.groupBy("rel_path", F.session_window("ts", quiet).alias("w")).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n")).select("rel_path", "ts", "n")


def settled_changes(changes: DataFrame, quiet: str = "200 milliseconds", watermark: str = "1 second") -> DataFrame:
    """The latest change (rel_path, ts, content) of each burst, once its file has been quiet; in append mode on streams."""
    df = changes.withWatermark("ts", watermark) if changes.isStreaming else changes
    last = df.groupBy("rel_path", F.session_window("ts", quiet).alias("w")).agg(F.max(F.struct("ts", "content")).alias("x"))
    return last.select("rel_path", "x.ts", "x.content")


def apply_changes(batch: DataFrame, store: Store, embedder) -> dict:
    """Index changed files and drop removed ones."""
    last = latest_changes(batch.select("rel_path", "ts", "content")).cache()
    try:
        gone = last.filter("content is null").select("rel_path")
        if not gone.isEmpty():
            store.delete_by_files(gone, ("chunks", "texts", "postings", "lengths", "state"))
        files = last.filter("content is not null").select("rel_path", "content", F.unix_seconds("ts").alias("last_modified"))
        return index_files(files, store, embedder, complete=False)
    finally:
        last.unpersist()


def reindex_stream(changes: DataFrame, root: str, embedder, checkpoint: str, *, every: str | None = None, quiet: str | None = None):
    """Start the query; without ``every`` it stops when all that is there has been read.  With ``quiet`` a file is indexed when
    it has had no change for so long, by the times of the changes."""
    spark = changes.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        store = Store.open_or_create(spark, root, model=embedder.name, dim=embedder.dim)
        apply_changes(batch, store, embedder)

    changes = changes if quiet is None else settled_changes(changes, quiet)
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def recover(store: Store, files: DataFrame, embedder) -> dict:
    """Run again the files that a broken run left pending."""
    return index_files(files.join(store.pending().select("rel_path"), "rel_path", "left_semi"), store, embedder, complete=False)
