import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import minhash, packing, quality
from test_minhash import brute as near_brute
from test_minhash import shingles


def test_stages_and_run(spark, docs, sf_dir, rows):
    """run() against plain code for the filters; each stage keeps the columns, and the mix keeps near its budget."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = {(r.doc_id, r.n_words, r.word_chars) for r in quality.quality_scores(docs, labels).filter("kept").collect()}
    left = [r for r in rows if (r[0], *quality.rule_stats(r[1])[:2]) in judged]
    groups = {}
    for r in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1]), r[0] is None, r[0] or 0, r))
    left = [min(g, key=lambda x: x[:3])[3] for g in groups.values()]
    roots = near_brute([r[:2] for r in left])
    ids = {i for i, n, c in roots if i == c or not n}
    left = [r for r in left if (-1 if r[0] is None else r[0]) in ids]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        if k == 2:
            assert sorted(str(r.doc_id) for r in now.collect()) == sorted(str(r[0]) for r in left)
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.groupBy("doc_id", "piece").count()
    allowed = {r[0] for r in left}
    assert {r.doc_id for r in got.collect()} <= allowed
    ids = [r[0] for r in left]
    assert all(r["count"] <= 2 * ids.count(r.doc_id) for r in got.collect())
    encode = packing.encoder()
    size = {r[0]: len((r[1] or "").encode().split()) for r in left}
    lengths = {r[0]: len(encode(r[1])) + 1 for r in left}
    total = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("piece") == 0, 1)).alias("k")).collect()
    assert all(r.n == r.k * lengths[r.doc_id] for r in total if ids.count(r.doc_id) == 1)
    words = sum(len((r[1] or "").encode().split()) for r in left)
    taken = sum(size[r.doc_id] * r.k for r in total)
    assert abs(taken - 1.5 * words) <= 10 * max(size.values())


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_near_stage_links_at_80(spark):
    """Pairs on both sides of 0.8, most of them under the 0.85 of op7, against all pairs."""
    rng = random.Random(8)
    rows = []
    for g in range(60):
        text = [f"g{g}x{i}" for i in range(120)]
        extra = [f"new{g}x{i}" for i in range(18 + g % 24)]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(text + extra))]
    # At 0.8 exactly: 116 of 145 shingles.
    assert similar(rows[22][1], rows[23][1]) == 0.8
    exact = [similar(rows[2 * g][1], rows[2 * g + 1][1]) for g in range(60)]
    assert any(0.8 <= s < 0.85 for s in exact) and any(s < 0.8 for s in exact) and any(s >= 0.85 for s in exact)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = dict(corpus_pipeline.STAGES)["near dedup"]
    want = sorted([2 * g for g in range(60)] + [2 * g + 1 for g in range(60) if exact[g] < 0.8])
    assert sorted(r.doc_id for r in near(spark, df, None).collect()) == want
    by_op7 = sorted([2 * g for g in range(60)] + [2 * g + 1 for g in range(60) if exact[g] < 0.85])
    assert sorted(r.doc_id for r in minhash.near_dedup(df, percent=85).collect()) == by_op7
