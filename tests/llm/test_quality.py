import os
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_stats(rows):
    for t in {r[1] for r in rows if len(r[1] or "") < 5000} | {"a b c a b c", "a a a a", "x\u00a0y z"}:
        assert Q.rule_stats(t) == brute(t), t


def test_scores(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert sorted((r.n_words, r.n_repeat_words) for r in got) == sorted(Q.rule_stats(r[1])[::4] for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in got)
    kept = Q.quality_filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert Q.quality_scores(none, labels).count() == 0 and Q.quality_filter(none, None).count() == 0
    assert Q.quality_filter(docs, labels.filter("false")).count() == sum(not r.base_failed for r in got)


def test_forest_and_threshold():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 2)), [[9.0, 9.0]] * 5])
    s = Q.IsolationForest(x, 50, 128, 1).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.99)
    cut = Q.calibrate(s, np.arange(505) < 500, 0.01)
    assert (s[500:] > cut).all() and (s[:500] > cut).mean() <= 0.01
    assert Q.calibrate(s, np.ones(505, bool), 0.01) == np.inf and Q.calibrate(np.array([1.0, 1.0]), np.array([True, False]), 0.01) == np.inf


def test_verdicts(spark):
    """Every verdict by plain walks through the model's trees; without the method all that pass the base stay."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 7))))
    rows = [(i, " ".join(word() + "#|" * (i % 8 == 0 and i > 40) for _ in range(40 if i % 9 == 1 else 90))) for i in range(90)]
    docs = spark.createDataFrame([*rows, (90, None)], "doc_id long, text string")
    df = docs.select("doc_id", (F.col("doc_id") % 8 != 0).cast("int").alias("quality")).filter("doc_id > 40")
    model = Q.fit_quality(Q.quality_stats(docs), df, most_false_rejects=0.5)
    assert model.forest is not None and model.cut < np.inf and set(model.rates) == {"fitted", "held out"}
    for r in Q.quality_scores(docs, df, most_false_rejects=0.5).collect():
        s = np.array([[r[c] for c in Q.STATS]])
        paths = []
        level = [np.floor(s[0, 1] / max(s[0, 0], 1)), *(np.floor(4 * s[0, i] / max(s[0, 0], 1)) for i in (2, 3, 4))]
        for feature, cut, left, right, path in model.forest.trees:
            at = 0
            while left[at] != at:
                at = left[at] if level[feature[at]] <= cut[at] else right[at]
            paths.append(path[at])
        score = 2 ** (-np.mean(paths) / Q._average_path(model.forest.size))
        failed = s[0, 0] < 50 or 100 * s[0, 4] > 50 * s[0, 0]
        assert abs(score - r.anomaly) < 1e-12 and r.base_failed == failed and r.kept == (not failed and score <= model.cut)
    rejected = Q.quality_scores(docs, df, most_false_rejects=0.5).filter("not base_failed and not kept").count()
    assert rejected > 0


def test_on_given_labels(spark):
    """The threshold is finite, decides, and does on held-out labels what it does on fitted ones."""
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        return
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rates = Q.fit_quality(Q.quality_stats(docs.join(labels, "doc_id", "left_semi")), labels).rates
    assert all(r[0] <= 0.002 and r[1] >= 0.9 for r in rates.values()), rates


def test_held_out(spark):
    """On held-out labels nearly all good rows stay and most bad ones go."""
    rng = np.random.default_rng(1)
    def text(bad):
        w = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 7)))) for _ in range(120)]
        return " ".join(x + "#$" if bad and rng.random() < 0.4 else x for x in w)

    df = spark.createDataFrame([(i, text(i % 10 == 0)) for i in range(600)], "doc_id long, text string")
    labels = df.filter("doc_id < 300").select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    got = Q.quality_scores(df, labels).filter("doc_id >= 300").toPandas()
    bad = got.doc_id % 10 == 0
    assert got.kept[~bad].mean() > 0.98 and got.kept[bad].mean() < 0.2


def made(spark, *kinds):
    """Statistics of texts of 100 words: (rows, characters, symbols) by kind, ids from 0 in order of the kinds."""
    rows = [(n, chars, symbols) for n, chars, symbols in kinds for _ in range(n)]
    return spark.createDataFrame([(i, 100, chars, symbols, 0, 0) for i, (_, chars, symbols) in enumerate(rows)], "id long, " + ", ".join(f"{c} long" for c in Q.STATS))


def test_every_row_fits_the_forest(spark):
    """No row is left out of the forest: it changes with each single one, here 1 of 3004."""
    kinds = [(2000, 500, 0), (1000, 400, 0), (1, 600, 0), (1, 900, 100), (1, 400, 300), (1, 2000, 0)]
    score = lambda ks: Q.fit_quality(made(spark, *ks), None, trees=4, leaf_sample=16).judge(np.array([[100, 500, 0, 0, 0], [100, 600, 0, 0, 0], [100, 900, 100, 0, 0]]))[1]
    whole = score(kinds)
    assert (score(kinds[::-1]) == whole).all()
    for k in kinds[2:]:
        assert (score([x for x in kinds if x != k]) != whole).any(), k


def test_every_label_sets_the_threshold(spark):
    """Rates are those of all 24 030 labelled rows, and a cut that rejects 23 of 22 623 good rows is too much for 0.001."""
    stats = made(spark, (22_600, 500, 0), (7, 500, 0), (1_400, 900, 300), (23, 1_400, 700))
    labels = stats.select(F.col("id").alias("doc_id"), (~F.col("id").between(22_600, 24_006)).cast("int").alias("quality"))
    model = Q.fit_quality(stats, labels)
    score = model.judge(np.array([[100, 500, 0, 0, 0], [100, 900, 300, 0, 0], [100, 1_400, 700, 0, 0]]))[1]
    assert score[0] < score[1] < score[2] and model.cut == np.inf and model.rates["fitted"] == (0.0, 0.0)
    model = Q.fit_quality(stats, labels, most_false_rejects=0.00102)
    assert score[0] < model.cut < score[1] and model.rates["fitted"] == (23 / 22_623, 1_400 / 1_407)
    assert set(model.judge(np.array([[100, 500, 0, 0, 0], [100, 900, 300, 0, 0]]))[2]) == {True, False}


def test_deals(spark):
    """Each row is in as many trees as every other, any range of trees is the same, and tasks score as one walk does."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(2000, 4)).astype(float)
    forest = Q.IsolationForest(x, 50, 64, 1)
    assert (forest.groups, forest.rounds, len(forest)) == (32, 2, 64)
    for turn in range(2):
        dealt = np.zeros((32, len(forest.rows)), dtype=np.int64)
        for group, part, counts in forest._deal(turn, 0, 32, np.arange(len(forest.rows)), forest.counts, 0, 32):
            dealt[group, part] = counts
        assert (dealt.sum(0) == forest.counts).all() and dealt.sum(1).min() > 30 and dealt.sum(1).max() < 100
    trees = list(forest.trees)
    assert len(trees) == 64 and all((a == b).all() for s, t in zip(trees[5:41], forest.grown(5, 41), strict=True) for a, b in zip(s, t, strict=True))
    forest = Q.IsolationForest(x, 300, 64, 1)
    apart = Q.IsolationForest(x, 300, 64, 1)
    apart.score_apart(spark, apart.rows)
    assert len(apart.known) == len(apart.rows) and (apart.score(x) == forest.score(x)).all()
    assert (forest.score(x + 100) == forest.score(np.full((1, 4), 5.0))).all()
