"""Incremental indexing: hash gate, secret gates, chunking, reuse of vectors by content, publication."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.secrets import contains_secret, skip_file
from quarry.functions.text import file_hash, percentage
from quarry.operators.chunk import chunk_files, shallow_documents
from quarry.plans.store import FORMAT, TABLES, Store, release
from quarry.sources.embedders import embedded, prefixes


def changed_files(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Files (rel_path, hash, ...) that are new, differ, or were not indexed to the end."""
    if force:
        return files
    known = state.select("rel_path", F.col("hash").alias("old"), "status")
    return files.join(known, "rel_path", "left").filter(~F.col("hash").eqNullSafe(F.col("old")) | ~F.col("status").eqNullSafe(F.lit("indexed"))).drop("old", "status")


def vanished_files(files: DataFrame, state: DataFrame) -> DataFrame:
    return state.join(files, "rel_path", "left_anti").select("rel_path")


def plan_reuse(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunks with ``vector`` from (content_hash, vector) where the same content was embedded before, else null."""
    one = known.groupBy("content_hash").agg(F.first("vector").alias("vector"))
    return chunks.join(one, "content_hash", "left")


def missing_vectors(planned: DataFrame, embedder, content: str = "content") -> DataFrame:
    """(content_hash, made): each distinct missing content embedded once."""
    missing = planned.filter("vector is null").select("content_hash", content).dropDuplicates(["content_hash"])
    return missing.select("content_hash", embedded(F.col(content), embedder, prefixes(embedder.name)[0]).alias("made"))


def with_vectors(planned: DataFrame, made: DataFrame) -> DataFrame:
    return planned.join(made, "content_hash", "left").withColumn("vector", F.coalesce("vector", "made")).drop("made")


def embed_missing(planned: DataFrame, embedder, content: str = "content") -> DataFrame:
    """Embed each distinct missing content once."""
    return with_vectors(planned, missing_vectors(planned, embedder, content))


def coverage(files: DataFrame, state: DataFrame, text_ready: bool = True) -> DataFrame:
    """(total, indexed, pct, status): share of files whose present content is indexed."""
    ok = F.col("old").eqNullSafe(F.col("hash")) & F.col("status").eqNullSafe(F.lit("indexed"))
    df = files.join(state.select("rel_path", F.col("hash").alias("old"), "status"), "rel_path", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("indexed"))
    pct = F.when(F.col("total") == 0, 0.0).otherwise(percentage("indexed", "total"))
    pct = pct if text_ready else F.least(pct, F.lit(99.9))
    return df.withColumn("pct", pct).withColumn("status", F.when(F.col("indexed") == 0, "empty").when((F.col("indexed") == F.col("total")) & F.lit(text_ready), "full").otherwise("partial"))


@contextmanager
def _work(store: Store):
    """Gives a function that writes a table once and reads it back; the tables go at the end of the block, or once one is kept ``instead``."""
    top = f"work/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str, instead: str | None = None) -> DataFrame:
        df.write.options(**FORMAT).parquet(f"{store.root}/{top}/{name}")
        if instead:
            store.drop(f"{top}/{instead}")
        release(store.spark)
        return df.sparkSession.read.schema(df.schema).parquet(f"{store.root}/{top}/{name}")

    try:
        yield kept
    finally:
        store.drop(top)


def index_shallow(files: DataFrame, store: Store) -> int:
    """A projected document for every file that has no deep ones yet; secrets never enter the index."""
    deep = store.table("texts").filter("index_depth = 'deep'").select("rel_path").distinct()
    docs = shallow_documents(files.filter(~skip_file("rel_path")).join(deep, "rel_path", "left_anti")).filter(~contains_secret("content"))
    with _work(store) as kept:
        docs = kept(docs.withColumn("index_depth", F.lit("shallow")).select(*[f.split()[0] for f in TABLES["texts"].split(", ")]), "shallow")
        n = docs.count()
        if n:
            store.replace(docs.select("rel_path").distinct(), store.text_rows(docs))
            store.set_phase("partial")
    return n


def index_files(files: DataFrame, store: Store, embedder, *, force: bool = False, complete: bool = True, max_lines: int = 200, overlap: int = 25, doc_lines: int = 40, now: int | None = None) -> dict:
    """Bring the store up to ``files`` (rel_path, content, last_modified); ``complete`` if they are the whole tree, so that
    files of the store that are not among them are removed.  Returns the run's counts.

    Files are pending before the first change and indexed after the last one is published; a run that breaks off is
    repaired by the next, which takes pending files for changed.
    """
    files = files.filter(~skip_file("rel_path")).withColumn("hash", file_hash(F.col("content").cast("binary")))
    state = store.table("state")
    with _work(store) as kept:
        todo = kept(changed_files(files, state, force), "todo")
        gone = vanished_files(files, state) if complete else state.limit(0).select("rel_path")
        total, changed, vanished = files.count(), todo.count(), gone.count()
        stats = {"status": "ok", "files": total, "changed": changed, "unchanged": total - changed, "failed": 0, "chunks": 0, "embeddings": 0, "reused": 0, "skipped_secrets": 0, "removed": vanished}
        if vanished:
            gone = kept(gone, "gone")
            store.delete_by_files(gone, ("chunks", "texts", "postings", "lengths", "state"))
        if changed:
            paths = kept(todo.select("rel_path", "hash"), "paths")
            store.set_status(paths, "pending")
            chunks = chunk_files(todo, max_lines=max_lines, overlap=overlap, doc_lines=doc_lines).withColumn("secret", contains_secret("content"))
            # Chunks are made once; of those with secrets only the number is wanted.
            chunks = chunks.withColumn("content", F.when(~F.col("secret"), F.col("content")))
            planned = kept(plan_reuse(chunks, store.existing_embeddings(paths)), "planned", instead="todo")
            counts = planned.agg(F.count_if(~F.col("secret")), F.count_if(~F.col("secret") & F.col("vector").isNotNull()), F.count_if("secret")).first()
            stats |= {"chunks": counts[0], "reused": counts[1], "embeddings": counts[0] - counts[1], "skipped_secrets": counts[2]}
            vectors = kept(missing_vectors(planned.filter("not secret"), embedder), "vectors")
            rows = with_vectors(planned.filter("not secret").drop("secret"), vectors)
            none = store.spark.createDataFrame([], TABLES["texts"])
            store.replace(paths, {"chunks": rows, "texts": none}, index=True, inserted=store.manifest["inserted"] + counts[0])
            store.set_status(paths, "indexed", now)
            store.optimize()
        if complete:
            store.set_phase("full", now)
        return stats
