"""Work tables written by Python workers: their rows, what failed attempts leave, and that the JVM wrote none of their files."""

import glob
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, dedup, hashing, minhash
from quarry.llm.katz import katz_scores
from quarry.llm.minhash import near_dedup
from quarry.llm.substrings import remove_repeats


def shared(spark):
    return common.shared_dir(spark).removeprefix("file:").replace("//", "/")


@pytest.fixture
def made(spark, monkeypatch):
    """The files of folders that are made from now on, none of which is deleted."""
    monkeypatch.setattr(common, "drop_path", lambda *_: None)
    before = set(glob.glob(f"{shared(spark)}/quarry/*"))
    return lambda: [os.path.join(d, f) for top in set(glob.glob(f"{shared(spark)}/quarry/*")) - before for d, _, names in os.walk(top) for f in names]


def by_jvm(files):
    """Checksums and markers, for each of which Hadoop starts a child process under file:."""
    return [f for f in files if f.endswith((".crc", "_SUCCESS"))]


def test_written_table_equals_its_rows(spark, docs):
    df = docs.select("*", F.lit(None).cast("long").alias("none"), F.struct("doc_id", F.array("text").alias("t")).alias("s"))
    got = common.written(df, "t-written")
    assert got.schema == common.staged(df, "t-staged").schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert not glob.glob(f"{got.staged_at.removeprefix('file:')}/_temporary")


def test_rows_are_written_where_they_are_made(spark, made):
    df = spark.range(0, 5000, 1, 3).selectExpr("id", "id % 7 as k")
    one = common.written(common.mapped(df, lambda bs: (b for b in bs), df.schema), "t-mapped")
    two = common.written(common.grouped(df, ["k"], lambda key, t: t, "id long, k long"), "t-grouped")
    rows = sorted(df.collect())
    assert sorted(one.collect()) == rows and sorted(two.collect()) == rows
    assert common.written(df.filter("id < 0"), "t-empty").collect() == []
    assert len(made()) == 3 + 7


def test_other_types_and_failing_tasks(spark):
    odd = spark.sql("select map('a', 1) as m, timestamp'2020-01-01 00:00:00' as t")
    assert common.written(odd, "t-odd").collect() == odd.collect()

    def fails(batches):
        for b in batches:
            yield b
            raise ValueError("a task that fails")

    with pytest.raises(Exception, match="a task that fails"):
        common.written(common.mapped(spark.range(10), fails, "id long"), "t-fails")


def test_katz_starts_no_children_for_its_tables(docs, made):
    assert katz_scores(docs, unit_tokens=500, bucket_tokens=500).count() == docs.count()
    assert made() and not by_jvm(made())


def test_substrings_start_no_children_for_their_tables(docs, made):
    assert remove_repeats(docs).count() == docs.count()
    assert made() and not by_jvm(made())


def test_near_dedup_starts_no_children_for_its_tables(docs, made):
    assert 0 < near_dedup(docs, percent=80).count() < docs.count()
    assert made() and not by_jvm(made())


def test_stages_are_made_in_small_batches(spark, tmp_path):
    """Rows of a stage go to and from Python in small batches, whenever the caller makes them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "concat('text ', id) as text").write.parquet(f"{tmp_path}/d")
    for old, most in (("10000", common.BATCH_ROWS), ("0", common.BATCH_ROWS), ("100", 100)):
        with common.conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=old):
            out = dict(corpus_pipeline.STAGES)["exact dedup"](spark, spark.read.parquet(f"{tmp_path}/d"), None)
            sizes = [r.n for r in out.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()]
            assert sum(sizes) == 3000 and max(sizes) <= most
            assert int(spark.conf.get(key)) == most


@pytest.mark.parametrize(("module", "name", "run"), [(dedup, "dedup-hits", dedup.exact_dedup), (minhash, "near-sets", minhash.near_dedup)])
def test_no_task_holds_two_workers(docs, monkeypatch, module, name, run):
    """Texts that are chosen by place are joined in another stage, however small the other side is."""
    plans, write = {}, module.written
    monkeypatch.setattr(module, "written", lambda df, at, **o: plans.setdefault(at, df._jdf.queryExecution().executedPlan().toString()) and write(df, at, **o))
    run(docs).count()
    assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]


def test_idle_workers_hold_no_powers():
    hashing.shingles([b"some words of a text"], 2)
    assert hashing._powers.cache_info().currsize
    hashing.trim()
    assert not hashing._powers.cache_info().currsize
