"""Quality rules with an isolation forest (operator 2).

Rule statistics are computed per whole text; a base rule fails short or repetitive texts; an isolation forest over
the statistics gives each other document a path-length score, and one threshold on this score, calibrated on labelled rows,
decides.  The forest sees rates per word in levels of STEP: within a level good texts differ by chance only, and splits
between levels are what isolates a text, so the score depends on the forest as a whole and on no single rule.

The forest is grown from every document that passes the base rule: the rows are dealt at random into groups of about
``leaf_sample``, each to exactly one of them, and every group grows one tree.  Where that gives fewer than ``trees`` trees, all rows are
dealt again, so that each is in equally many.  Only levels matter to a tree, so what is dealt are counts of rows by level vector:
any range of trees can be grown anywhere from these counts alone, tasks walk the distinct vectors through their own
trees and send back sums of path lengths, and no tree is kept.  The threshold is calibrated on every labelled row that passes.  What it does on
labels that it has not seen is measured apart: each of HELD_OUT folds is judged by a threshold from the others; the
model reports reject rates for both.

The driver holds one count and one score per distinct level vector (20 at sf0.1).  A text whose words have c characters on
average takes c bytes at least, and at most 100 * (c + 1) vectors have that level, so their number grows at most with
input ** (2 / 3).

Defined results: a null text has no words and fails the base rule; an empty table gives an empty result; rows that repeat a
doc_id are each judged; equal statistics have equal scores, and a score at the threshold stays; several labels of one
doc_id count as the best of them; without usable labels (or where no threshold separates) the forest rejects
nothing; texts of any length are read whole; extra columns, whatever their names, are kept by
:func:`quality_filter` and ignored by :func:`quality_scores`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, scratch, staged, table
from quarry.llm.hashing import slices

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MOST_REPEAT = 50, 50
#: Width of a level, per word, and the number of folds in which labelled rows are held out.
STEP, HELD_OUT = 0.25, 4
#: Sums of path lengths are whole numbers of this unit, so they don't depend on the order of tasks; trees a task grows.
UNIT, TREES_A_TASK = 2.0**-40, 64


def rule_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The five statistics of one whole text, in the order of STATS."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    lines = text.split("\n")
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(SPACES))
            else:
                seen.add(line)
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count: dict[tuple, int] = {}
            for w in windows:
                count[w] = count.get(w, 0) + 1
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, dup, repeat


def features(stats: np.ndarray) -> np.ndarray:
    """Levels for the forest from rows of STATS: characters, symbols, repeated lines and repeated words per word."""
    s = stats.astype(np.float64)
    per_word = s[:, 1:] / np.maximum(s[:, :1], 1)
    return np.floor(per_word / np.array([1.0, STEP, STEP, STEP]))


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits over all ``rows`` (each ``counts`` times), every row in one tree of each of ``rounds`` deals.
    Trees are grown when they are asked for, the same ones whatever range is asked for."""

    def __init__(self, rows: np.ndarray, trees: int, leaf_sample: int, seed: int, counts: np.ndarray | None = None):
        self.rows, at = np.unique(rows + 0.0, axis=0, return_inverse=True)
        self.counts = np.zeros(len(self.rows), dtype=np.int64)
        np.add.at(self.counts, at.reshape(-1), 1 if counts is None else counts)
        self.seed, n = seed, int(self.counts.sum())
        self.groups = max(1, math.ceil(n / leaf_sample))
        self.rounds = max(1, math.ceil(trees / self.groups))
        self.size = n / self.groups
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.known: dict[bytes, float] = {}

    def __len__(self) -> int:
        return self.groups * self.rounds

    def _deal(self, turn: int, low: int, high: int, part: np.ndarray, counts: np.ndarray, first: int, last: int):
        """(group, rows, counts) of the groups from ``first`` to before ``last``: halves of the groups share rows by chance."""
        if last <= low or high <= first:
            return
        if high - low == 1:
            yield low, part, counts
            return
        mid = (low + high) // 2
        below = np.random.default_rng([self.seed, turn, low, high]).binomial(counts, (mid - low) / (high - low))
        for x, y, share in ((low, mid, below), (mid, high, counts - below)):
            there = share > 0
            yield from self._deal(turn, x, y, part[there], share[there], first, last)

    def grown(self, first: int, last: int):
        """The trees from number ``first`` to before ``last``, as flat arrays: feature, cut, left, right, path."""
        for turn in range(first // self.groups, -(-last // self.groups)):
            at = turn * self.groups
            for group, part, counts in self._deal(turn, 0, self.groups, self.rows, self.counts, first - at, last - at):
                yield self._grow(part, counts, np.random.default_rng([self.seed, turn, group, group + 1]))

    @property
    def trees(self):
        return self.grown(0, len(self))

    def _grow(self, rows: np.ndarray, counts: np.ndarray, rng: np.random.Generator):
        feature, cut, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, n: np.ndarray, depth: int) -> int:
            at = len(feature)
            for x, v in ((feature, 0), (cut, 0.0), (left, at), (right, at), (path, depth + _average_path(int(n.sum())))):
                x.append(v)
            if depth < self.depth and len(part) > 1:
                low, high = part.min(0), part.max(0)
                f = int(rng.choice(np.flatnonzero(high > low)))
                c = float(rng.uniform(low[f], high[f]))
                below = part[:, f] <= c
                feature[at], cut[at] = f, c
                left[at] = node(part[below], n[below], depth + 1)
                right[at] = node(part[~below], n[~below], depth + 1)
            return at

        node(rows, counts, 0)
        return tuple(np.array(x) for x in (feature, cut, left, right, path))

    def clip(self, rows: np.ndarray) -> np.ndarray:
        """Rows outside the range of all cuts take the same paths as those at its border."""
        return np.clip(rows + 0.0, self.rows.min(0), self.rows.max(0))

    def walk(self, rows: np.ndarray, first: int, last: int) -> np.ndarray:
        """Sum of the path lengths of each row over a range of trees, in UNIT."""
        total = np.zeros(len(rows), dtype=np.int64)
        every = np.arange(len(rows))
        for feature, cut, left, right, path in self.grown(first, last):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(rows[every, feature[at]] <= cut[at], left[at], right[at])
            total += np.rint(path / UNIT).astype(np.int64)[at]
        return total

    def learn(self, rows: np.ndarray, total) -> np.ndarray:
        """Scores from the sums over all trees; they are kept, so that :meth:`score` looks these rows up."""
        mean = np.array([int(t) for t in total], dtype=np.float64) * UNIT / len(self)
        got = np.exp2(-mean / max(_average_path(self.size), 1e-9))
        self.known.update(zip(map(bytes, np.ascontiguousarray(rows)), got.tolist(), strict=True))
        return got

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for anomalies, under 0.5 for ordinary rows."""
        distinct, at = np.unique(self.clip(rows), axis=0, return_inverse=True)
        keys = list(map(bytes, distinct))
        new = distinct[[k not in self.known for k in keys]]
        if len(new):
            steps = range(0, len(self), TREES_A_TASK)
            self.learn(new, sum(self.walk(new, i, min(i + TREES_A_TASK, len(self))).astype(object) for i in steps))
        return np.array([self.known[k] for k in keys])[at.reshape(-1)]

    def score_apart(self, spark: SparkSession, rows: np.ndarray) -> None:
        """Scores of distinct, clipped rows to be looked up, each task growing its own trees."""
        n = len(self)
        tasks = math.ceil(n / TREES_A_TASK)

        def run(batches):
            for i in (i for b in batches for i in b.column(0).to_pylist()):
                total = self.walk(rows, i * TREES_A_TASK, min((i + 1) * TREES_A_TASK, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(total)], ["at", "total"])

        parts = spark.range(0, tasks, 1, tasks).mapInArrow(run, "at long, total long")
        got = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toPandas()
        self.learn(rows[got["at"].to_numpy()], got["total"])


def calibrate(scores: np.ndarray, good: np.ndarray, most_false_rejects: float, counts: np.ndarray | None = None) -> float:
    """The score above which rows are rejected: best (true minus false reject rate) of the cuts that reject at most
    ``most_false_rejects`` of the good rows; infinity where no cut does better than none.  A row counts ``counts`` times."""
    counts = np.ones(len(scores), dtype=np.int64) if counts is None else counts
    n_good, n_bad = int(counts[good].sum()), int(counts[~good].sum())
    if not n_good or not n_bad:
        return math.inf
    best, cut = 0.0, math.inf
    order = np.argsort(-scores, kind="stable")
    s, g, n = scores[order], good[order], counts[order]
    false, true = np.cumsum(n * g) / n_good, np.cumsum(n * ~g) / n_bad
    for i in np.flatnonzero(np.append(s[1:] < s[:-1], True)):
        if false[i] > most_false_rejects:
            break
        if true[i] - false[i] > best:
            best, cut = true[i] - false[i], (s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1e-9
    return float(cut)


def _base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MOST_REPEAT * stats[:, 0])


def _stats_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([rule_stats(t) for t in column.to_pylist()], dtype=np.int64).reshape(-1, len(STATS))


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATS...) of every row; the text is read whole, in Arrow batches, and shuffled nowhere."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in (p for x in batches for p in slices(x)):
            s = _stats_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, i]) for i in range(len(STATS)))], ["id", *STATS])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in STATS))


class QualityModel:
    """A forest and its threshold; ``rates`` has the reject rates of good and bad labelled rows, fitted
    (all, at ``cut``) and held out (all, each fold at a threshold from the others)."""

    def __init__(self, forest: IsolationForest | None = None, cut: float = math.inf):
        self.forest, self.cut, self.rates = forest, cut, {}

    def judge(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, anomaly (the forest's score), kept."""
        failed = _base_failed(stats)
        anomaly = self.forest.score(features(stats)) if self.forest is not None and len(stats) else np.zeros(len(stats))
        return failed, anomaly, ~failed & (anomaly <= self.cut)


def _histogram(rows: DataFrame, clip=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct level vectors of all ``rows`` (STATS and further whole numbers, which are appended) and their counts, on the driver."""
    names = [f"k{i}" for i in range(len(rows.columns) - 1)]
    at = len(STATS)

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            s = np.column_stack([c.to_numpy() for c in b.columns])
            levels = features(s[:, :at])
            keys, n = np.unique(np.column_stack([clip(levels) if clip else levels, s[:, at:]]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(len(names))), pa.array(n)], [*names, "n"])

    parts = rows.mapInArrow(run, ", ".join(f"{c} double" for c in names) + ", n long")
    got = parts.groupBy(*names).agg(F.sum("n").alias("n")).toPandas()
    return got[names].to_numpy(dtype=np.float64), got["n"].to_numpy(dtype=np.int64)


def fit_quality(stats: DataFrame, labels: DataFrame | None, *, trees: int = 64, leaf_sample: int = 256, most_false_rejects: float = 0.001, seed: int = 7) -> QualityModel:
    """Forest, from all rows that pass the base rule, and threshold, from all labelled ones of them.  There are at least
    ``trees`` trees, of about ``leaf_sample`` rows each.  ``most_false_rejects`` bounds the share of good labelled rows
    that the threshold may reject."""
    spark = stats.sparkSession
    passing = stats.filter(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MOST_REPEAT} * n_words")
    levels, counts = _histogram(passing.select(*STATS))
    if not len(levels):
        return QualityModel()
    model = QualityModel(IsolationForest(levels, trees, leaf_sample, seed, counts))
    model.forest.score_apart(spark, _histogram(stats.select(*STATS), model.forest.clip)[0])
    if labels is None:
        return model
    best = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    fold = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(HELD_OUT))
    known, n = _histogram(passing.join(best, "id").select(*STATS, (F.col("quality") > 0).cast("long").alias("good"), fold.alias("fold")))
    if not len(known):
        return model
    score, good, fold = model.forest.score(known[:, :-2]), known[:, -2] > 0, known[:, -1]
    model.cut = calibrate(score, good, most_false_rejects, n)
    unseen = {k: calibrate(score[fold != k], good[fold != k], most_false_rejects, n[fold != k]) for k in np.unique(fold)}
    for name, cut in (("fitted", model.cut), ("held out", np.array([unseen[k] for k in fold]))):
        model.rates[name] = tuple(float(n[k & (score > cut)].sum() / n[k].sum()) if k.any() else None for k in (good, ~good))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame | None, **fit) -> DataFrame:
    """One row per document: doc_id, STATS, base_failed, anomaly (the forest's score), kept."""
    stats = staged(quality_stats(docs), "quality")
    model = fit_quality(stats, labels, **fit)
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = np.column_stack([b.column(i + 1).to_numpy() for i in range(len(STATS))]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, model.judge(s))], ["doc_id", *STATS, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, anomaly double, kept boolean")


def quality_filter(docs: DataFrame, labels: DataFrame | None, **fit) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  The second pass recomputes the statistics beside
    the text: that costs CPU but no shuffle of texts at any size."""
    with scratch(docs.sparkSession):
        model = fit_quality(staged(quality_stats(docs), "quality"), labels, **fit)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for part in slices(b):
                yield part.filter(pa.array(model.judge(_stats_of(part.column(at)))[2]))

    return map_rows(docs, run)


def quality_base(spark, sf_dir):
    """The columns of operator 2 that SQL can express: all but the forest's verdict."""
    return op2_quality_rules(spark, sf_dir).drop("anomaly", "kept")


def op2_quality_rules(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


BASE_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
tri as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from tri) where n > 1),
rep as (select r, count(distinct i + k) as n from again, (select unnest([0, 1, 2]) as k) group by r),
l as (select r, generate_subscripts(ls, 1) as i, unnest(ls) as x from (select r, string_split(t, chr(10)) as ls from d)),
dup as (select r, count(*) as n from (select r, x, row_number() over (partition by r, x order by i) as k from l) where k > 1 and regexp_matches(x, '[^\x20\x09-\x0D]') group by r)
select doc_id, len(w)::bigint as n_words, (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::bigint as word_chars,
       len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
       len(w) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(w) as base_failed
from d join w using (r) left join rep using (r) left join dup using (r)
"""
