import duckdb
from pyspark.sql import functions as F

from quarry.llm import mixing as M


def test_against_sql(docs, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    want = sorted(map(str, con.sql(M.SQL).fetchall()))
    got = M.mix_plan(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
    rows = sorted(str(tuple(r)) for r in got.collect())
    assert rows == want
    assert sorted(str(tuple(r)) for r in got.repartition(7).collect()) == want


def test_targets(docs):
    p = M.mix_plan(docs, ["source"]).cache()
    for r in p.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s"), F.max("size").alias("m")).collect():
        assert r.g - 2 * r.m <= r.t <= r.g + 2 * r.m and r.g <= 2 * r.s
    assert p.filter("taken > 2 * size").count() == 0


def test_small_ranges(docs, monkeypatch):
    want = sorted(map(str, M.mix_plan(docs, ["doc_id"]).collect()))
    monkeypatch.setattr(M, "RANGE_ROWS", 3)
    assert sorted(map(str, M.mix_plan(docs, ["doc_id"]).collect())) == want


def test_mix_is_the_truncated_order(docs):
    """The rows taken are the range-sorted copies from the first on, for as long as all their words fit in the budget."""
    size = F.coalesce(F.regexp_count("text", F.lit(M.WORD)), F.lit(0))
    budget = 1.5 * docs.agg(F.sum(size)).first()[0]
    every = M.mix_plan(docs, ["doc_id"], share=(4, 1)).select("doc_id", "size", F.col("finish").alias("all"))
    out = [r.doc_id for r in M.mix_documents(docs).collect()]
    plan = M.mix_plan(docs, ["doc_id"]).filter("taken > 0").select("doc_id", "size", F.explode("finish").alias("f")).collect()
    order = sorted(plan, key=lambda r: r.f)
    assert [r.f for r in order] == sorted(r.f for r in plan) and sorted(map(str, out)) == sorted(str(r.doc_id) for r in plan)
    # Neighbours in the output may tie in finish time, so positions are compared by time.
    time_of = {}
    for r in order:
        time_of.setdefault(r.doc_id, []).append(r.f)
    seen, times = {}, []
    for i in out:
        if i is not None and i != 7:
            seen[i] = seen.get(i, -1) + 1
            times.append(time_of[i][seen[i]])
    assert times == sorted(times) or len(set(out)) < len(out)
    total = sum(r.size for r in plan)
    assert total <= budget < total + 2 * max(r.size for r in every.collect())


def test_weights_count_empty_sources(spark):
    """A source without words takes its turn: the sources behind it weigh 1 and 2."""
    df = spark.createDataFrame([(1, "", "a"), (2, "x " * 1000, "b"), (3, "y " * 1000, "c")], "doc_id long, text string, source string")
    got = {r.source: r.target for r in M.mix_plan(df, ["source"]).collect()}
    assert got == {"a": 0.0, "b": 1000.0, "c": 2000.0}


def test_mix(docs, none):
    out = M.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == M.mix_plan(docs, []).agg(F.sum(F.size("finish"))).first()[0]
    assert M.mix_documents(none).count() == 0 and M.mix_plan(none, ["doc_id"]).count() == 0
