"""Exact dedup as a stateful stream (operator 4).

Every row gives a light record: digest of the text without white space, length, stable identifier and content
locator (file and row number).  A Structured Streaming aggregation keyed by digest keeps, in disk-backed
(RocksDB) state without expiry, the count of rows and the identifier and locator of the row that stays; it combines
within each input partition before it shuffles, so a digest with a third of all rows reaches the state as a
few rows.  Rows whose digest was met before are then checked against the retained row's full bytes, read by
locator; rows that differ (digest collisions) are grouped by their full text instead.

Texts of any length are hashed and compared whole.

Defined results: null texts count as empty, and all empty texts are equal; among rows that tie in length and
doc_id the first by (file, row) stays, null doc_ids come last; an empty table gives an empty result; extra columns
are kept by :func:`exact_dedup` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, choose_places, conf, drop_path, located, new_path, only, scratch, table, write_table, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def records(rows: DataFrame, at: list[str], digest_bytes: int = 32) -> DataFrame:
    """Light records (digest, sha, chars, id, at, row) of rows with their locator."""
    sha = F.unhex(F.sha2(normalised("text").cast("binary"), 256))
    light = rows.select(sha.alias("sha"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.col("doc_id").alias("id"), F.col(at[0]).alias("at"), F.col(at[1]).alias("row"))
    return light.withColumn("digest", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha"))


def _best() -> Column:
    return F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), "id", "at", "row"))


def keyed_state(log: DataFrame, log_path: str, state_path: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """(digest, n, best) after the stream has read all of ``log_path``.

    ``state_path`` holds the checkpoint: run again with the same paths after more files have come, and only those are read.
    """
    spark = log.sparkSession
    state_path = state_path or new_path(spark, "dedup-state")
    out = f"{state_path}/updates"
    read = spark.readStream.schema(log.schema)
    if files_per_trigger:
        read = read.option("maxFilesPerTrigger", files_per_trigger)
    grouped = read.parquet(log_path).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best().alias("best"))

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        drop_path(spark, path)
        write_table(batch, path)

    with conf(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true", spark__sql__streaming__stateStore__unloadOnCommit="true"):
        grouped.writeStream.outputMode("update").option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    made = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made):
        return spark.createDataFrame([], grouped.schema)
    updates = spark.read.schema(grouped.schema.add("batch", "integer")).parquet(out)
    return updates.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("x")).select("digest", "x.n", "x.best")


def classes(docs: DataFrame, digest_bytes: int = 32, files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows with locator, classes, locator names); classes: one light row per row of ``docs``:
    at, row, id, sha, keep_id, group_size, kept."""
    rows, at = located(docs)
    return rows, _classes(rows, at, digest_bytes, files_per_trigger), at


def _classes(rows: DataFrame, at: list[str], digest_bytes: int = 32, files_per_trigger: int | None = None) -> DataFrame:
    spark = rows.sparkSession
    light = records(rows, at, digest_bytes)
    path = new_path(spark, "dedup-log")
    write_table(light, path)
    log = spark.read.schema(light.schema).parquet(path)
    groups = written(keyed_state(log, path, files_per_trigger=files_per_trigger), "dedup-groups")
    again = groups.filter("n > 1").select("digest", F.col("best.at").alias("b_at"), F.col("best.row").alias("b_row"))
    places = written(log.join(again, "digest").select("at", "row", "digest", "b_at", "b_row"), "dedup-places")
    texts = choose_places(rows.select(*at, "text"), at, places, keep=True)
    texts = texts.select(F.col(at[0]).alias("at"), F.col(at[1]).alias("row"), normalised("text").alias("bytes"))
    # Never broadcast: choosing and writing in one task would take two Python workers, and both stay.
    hits = written(texts.join(places.hint("merge"), ["at", "row"]), "dedup-hits")
    retained = hits.filter("at = b_at and row = b_row").select("digest", F.col("bytes").alias("b_bytes"))
    odd = hits.join(retained, "digest").filter("bytes != b_bytes").select("digest", "at", "row", "bytes")
    odd = written(odd, "dedup-odd")
    if odd.isEmpty():
        out = log.join(groups, "digest")
        return out.select("at", "row", "id", "sha", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("at") == F.col("best.at")) & (F.col("row") == F.col("best.row"))).alias("kept"))
    odd = odd.join(log.drop("digest"), ["at", "row"]).withColumnRenamed("bytes", "whole")
    apart = odd.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("n"), _best().alias("best"))
    odd_rows = odd.join(apart, ["digest", "whole"]).select("digest", "at", "row", "id", "sha", "n", "best")
    fewer = groups.join(odd.groupBy("digest").agg(F.count(F.lit(1)).alias("less")), "digest", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")
    out = log.join(odd.select("at", "row"), ["at", "row"], "left_anti").join(fewer, "digest").select("digest", "at", "row", "id", "sha", "n", "best").unionByName(odd_rows)
    return out.select("at", "row", "id", "sha", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("at") == F.col("best.at")) & (F.col("row") == F.col("best.row"))).alias("kept"))


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, at = located(docs)
    with scratch(docs.sparkSession) as keep:
        dropped = keep(written(_classes(rows, at, **options).filter("not kept").select("at", "row"), "dedup-dropped"))
    return only(choose_places(rows, at, dropped, keep=False), docs.columns)


def op4_exact_dedup(spark, sf_dir):
    _, found, _ = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
with d as (select doc_id, coalesce(length(text), 0) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
g as (select t, count(*) as n, first(doc_id order by chars desc, doc_id) as keep_id from d group by t)
select doc_id, keep_id, n as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""
