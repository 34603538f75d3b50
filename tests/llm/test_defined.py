"""Defined results for odd inputs, for every operator: clashing names, very long texts, empty tables, repeated rows."""

import random

import pytest
from conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, dedup, katz, minhash, mixing, packing, quality, substrings, urls, warc
from quarry.llm.common import new_path

CLASH = "finish finish_ id at row n sig sketch bucket unit key size src words file pos m k cid root digest chars own base target cum taken range g no_source piece start length ids_crc32 sequence_id page host r".split()


def plain(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


OPERATORS = {
    "quality": (lambda df: quality.quality_scores(df, None), ["doc_id", "n_words", "base_failed", "kept"]),
    "mixing": (lambda df: mixing.mix_plan(df, ["doc_id"]), ["doc_id", "size", "taken"]),
    "mixed": (mixing.mix_documents, ["doc_id", "text"]),
    "dedup": (lambda df: dedup.classes(df)[1], ["id", "keep_id", "group_size", "kept"]),
    "deduped": (dedup.exact_dedup, ["doc_id", "text"]),
    "minhash": (lambda df: minhash.near_groups(df)[1], ["id", "n", "component_id"]),
    "near_deduped": (minhash.near_dedup, ["doc_id", "text"]),
    "substrings": (substrings.remove_repeats, ["doc_id", "n_removed", "kept_sha256"]),
    "packing": (packing.pack_documents, ["doc_id", "piece", "length", "ids_crc32"]),
    "katz": (katz.katz_scores, ["doc_id", "n_tokens", "n_known"]),
}


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    long = prose(rng, 200_000, 30_000)
    rows = [(1, prose(rng, 80), "a"), (2, long, "a"), (3, long + " end", "b"), (4, None, "b"), (5, "", None), (None, prose(rng, 70), None), (1, "x", "a"), (6, "w" * 300_000, "c")]
    rows += [rows[0]] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(odd, name):
    run, columns = OPERATORS[name]
    wide = odd.withColumns({c: F.lit("x") for c in CLASH})
    assert plain(run(wide), columns) == plain(run(odd), columns)
    assert run(wide.limit(0)).count() == 0
    if "text" in columns:
        assert run(wide).columns == wide.columns


def test_long_texts_are_whole(odd):
    found = {r.id: (r.n, r.component_id) for r in minhash.near_groups(odd.filter("doc_id in (2, 3)"))[1].collect()}
    assert found[2][0] > 190_000 and found[3] == (found[2][0] + 1, 2)
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in substrings.remove_repeats(odd.filter("doc_id in (2, 3, 6)")).collect()}
    assert gone[2][1] == 0 and gone[3] == (gone[2][0] + 4, gone[2][0]) and gone[6] == (300_000, 299_999)


def test_pipeline(spark, odd, tmp_path):
    odd.withColumns({c: F.lit("x") for c in CLASH}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        now, before = stage(spark, now, str(tmp_path)), now
        assert now.columns == before.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    places = out.select("file", "row", "piece").collect()
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {1, 2, 3, None} and len(set(places)) == len(places)
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pages(spark):
    rows = [(1, "http://bad.com/en/1", "é" * 300_000), (2, "http://f.io/" + "a" * 50_000, '<a href="http://bad.com/x">'), (2, "http://f.io/b", "é" * 300_000), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = df.withColumns({c: F.lit("x") for c in [*CLASH, "refers", "html_", "sha", "payload", "offset"]})
    columns = ["page_id", "host", "path", "rule", "verdict"]
    assert plain(urls.filter_urls(wide), columns) == plain(urls.filter_urls(df), columns) and urls.filter_urls(wide.limit(0)).count() == 0

    def read(pages):
        root = new_path(spark, "t-warc")
        captures = warc.write_archives(pages, root)
        index = warc.write_index(captures, root)
        return warc.resolve(warc.read_records(warc.lookup(captures.select("key").distinct(), index, root), root))

    got = read(wide)
    assert plain(got, ["page_id", "payload_bytes", "record_type", "refers_to"]) == plain(read(df), ["page_id", "payload_bytes", "record_type", "refers_to"])
    assert {(r.page_id, r.record_type, r.payload_bytes) for r in got.collect()} == {(1, "revisit", 600_000), (2, "response", 600_000), (2, "response", 27), (None, "response", 0)}
    assert read(wide.limit(0)).count() == 0


def test_rules_that_tie(spark):
    rules = [("a.com", "/x", "allow"), ("com", "/x/yy", "block"), ("com", "/x/yz", "allow"), ("m", "/x/y", "block")]
    df = spark.createDataFrame([(1, "http://a.com/x/yy", None)], "page_id long, url string, html string")
    assert urls.filter_urls(df, [("a.com", "/x/", "allow"), ("com", "/x/yy", "block")]).first().rule == "com/x/yy"
    assert urls.filter_urls(df, rules).first().verdict == "block"


def test_conversations(spark):
    rows = [(1, 0, "user", "é" * 200_000), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.withColumns({c: F.lit("x") for c in [*CLASH, "path", "depth", "up", "parent", "score", "steps"]})
    read = lambda x: plain(chat.read_back(chat.format_conversations(x).withColumnRenamed("conv_id", "path")), ["conv_id", "n_turns", "turns_sha256", "loss_chars"])
    assert read(wide) == read(df) and len(read(df)) == 2 and read(wide.limit(0)) == []
