"""Near-duplicate documents by bottom-k sketches of one hash function (operator 7).

A document's set is its distinct 5-word shingles, hashed to 64 bits; its sketch the SKETCH smallest values.
Documents with equal sets form one class, so copies cost nothing further on.  Inverted lists of the INDEX smallest
values give overlaps: values held by one class only are useless, and a class that keeps too few shared values
can have no partner, so both are pruned, repeatedly.  Two sets at the threshold share each of the smallest values
of their union with that probability; what fewer are shared with probability below 1e-8 follows from it (:func:`_least`):
4 of 16 at 0.85, 2 of 16 at 0.8.

Candidates come in two steps, neither of which writes out all pairs of a long list:
1. each list's most central class (the one whose values are held by most classes) against all others of the list;
2. where a list still spans several components: all pairs across components in lists of at most SHORT classes;
   in longer ones each class outside of the list's largest component, as a query, against all classes of the
   list by their sketches, in blocks of bounded size; full sets are written once and read by place, and only links are written.
The union's sketch estimates the similarity of candidates; what may reach the threshold is verified on the full sets, and
components of the verified links give the groups.

Full sets are made in slices of a batch; no dictionary of words is kept.

Defined results: a null text or one without words has an empty set and is linked with nothing; fewer words than a shingle
make the whole sequence one shingle; rows with a null doc_id are linked with nothing and kept; rows that repeat a
doc_id count as documents that share an id; an empty table gives an empty result; extra columns are kept by
:func:`near_dedup` whatever their names.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import choose_places, components, located, make_dir, mapped, new_path, only, release, scratch, small_batches, table, written
from quarry.llm.hashing import binaries, shingles, slices, trim

WORDS, SKETCH, INDEX, SHORT = 5, 64, 16, 24
#: Classes of a long list that one block holds, and bytes of full sets that a task keeps at hand.
BLOCK_CLASSES, CACHE_BYTES = 8192, 16 << 20
#: Similarity threshold of operator 7 as hundredths; the chance with which pruning or the estimate may miss a pair at a threshold.
PERCENT, MISSED = 85, 1e-8


def _least(percent: int, size: int) -> int:
    """The most of ``size`` smallest values that a pair at the threshold shares with a chance of at least 1 - MISSED."""
    p, below = percent / 100, 0.0
    for k in range(size):
        below += math.comb(size, k) * p**k * (1 - p) ** (size - k)
        if below >= MISSED:
            return k
    return size


def document_sketches(docs: DataFrame, words: int = WORDS, sketch: int = SKETCH) -> DataFrame:
    """(id, at, row, n, sig binary, sketch binary): sig identifies the set, sketch holds its smallest values."""

    def run(batches):
        for part in (p for b in batches for p in slices(b)):
            sets = shingles(binaries(part.column(3)), words)
            n = pa.array([len(s) for s in sets], pa.int64())
            sig = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            low = pa.array([s[:sketch].tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], n, sig, low], ["id", "at", "row", "n", "sig", "sketch"])

    return mapped(docs, run, "id long, at string, row long, n long, sig binary, sketch binary")


def _index(classes: DataFrame, index: int) -> DataFrame:
    """(val, cid, n): the smallest values of each class."""

    def run(batches):
        for b in batches:
            cid, n, val = [], [], []
            for c, k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = np.frombuffer(s, dtype=np.int64)[:index]
                val.append(v)
                cid.append(np.full(len(v), c))
                n.append(np.full(len(v), k))
            if val:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (val, cid, n)], ["val", "cid", "n"])

    return classes.select("cid", "n", "sketch").mapInArrow(run, "val long, cid long, n long")


def _prune(rows: DataFrame, index: int, percent: int, rounds: int = 2) -> DataFrame:
    """Index rows that may take part in a pair, with df, the classes that hold the value."""
    need = F.greatest(F.lit(1), F.floor(F.least(F.col("n"), F.lit(index)) * _least(percent, index) / index))
    for k in range(rounds):
        shared = rows.groupBy("val").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        rows = written(rows.join(shared, "val"), "near-shared")
        enough = rows.groupBy("cid", "n").agg(F.count(F.lit(1)).alias("k"), F.sum("df").alias("central")).filter(F.col("k") >= need).select("cid", "central")
        rows = rows.join(enough, "cid")
        rows = written(rows if k == rounds - 1 else rows.drop("df", "central"), "near-index")
    return rows


def _sized(percent: int) -> F.Column:
    return (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Similarity by the union's sketch: of the k smallest values of the union, the share that both have."""
    union = np.union1d(a, b)
    if len(a) == k or len(b) == k:
        union = union[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean()) if len(union) else 0.0


def _pairs_where(test):
    """mapInArrow over (a, b, bytes of a, bytes of b): the pairs for which ``test`` of both arrays holds."""

    def run(batches):
        for part in (p for b in batches for p in slices(b, 256)):
            both = zip(part.column(2), part.column(3), strict=True)
            keep = [test(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in both]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, bytes of a, bytes of b) from ``sets`` (cid, bytes)."""
    one, two = (sets.toDF(*x) for x in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, sketch: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    least = _least(percent, sketch) / sketch

    def similar(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    sift, check = _pairs_where(lambda x, y: _estimate(x, y, sketch) >= least), _pairs_where(similar)
    likely = written(mapped(_beside(pairs, classes.select("cid", "sketch")), sift, "a long, b long"), "near-likely")
    full = _full_sets(likely.select(F.col("a").alias("cid")).unionByName(likely.select(F.col("b").alias("cid"))), classes, docs, words)
    with small_batches(docs.sparkSession):
        return written(mapped(_beside(likely, full), check, "a long, b long"), "near-links")


def _texts_of(cids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(cid, text) for the given classes: one text of each."""
    used = written(cids.distinct().join(classes.select("cid", "at", "row"), "cid"), "near-used")
    picked = choose_places(texts.select("at", "row", "text"), ["at", "row"], used, keep=True)
    # Never broadcast: choosing and what follows in one task would take two Python workers, and both stay.
    return picked.join(used.hint("merge"), ["at", "row"]).select("cid", "text")


def _full_sets(cids: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(cid, full binary) for the given classes: their sorted shingle hashes."""

    def sets(batches):
        for part in (p for b in batches for p in slices(b, 256)):
            full = [s.tobytes() for s in shingles(binaries(part.column(1)), words)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(full, pa.binary())], ["cid", "full"])

    with small_batches(texts.sparkSession):
        return written(mapped(_texts_of(cids, classes, texts), sets, "cid long, full binary"), "near-sets")


def _placed_sets(cids: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> tuple[DataFrame, str]:
    """(cid, n, file, start) and the shared folder of the files: each class's full set is written once, and read by place."""
    spark = texts.sparkSession
    root = new_path(spark, "near-full")
    make_dir(spark, root)

    def write(batches):
        store, top = fs.FileSystem.from_uri(root)
        name, out, at = uuid.uuid4().hex, None, 0
        try:
            for part in (p for b in batches for p in slices(b, 256)):
                sets = shingles(binaries(part.column(1)), words)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                out = out or store.open_output_stream(f"{top}/{name}", compression=None)
                for s in sets:
                    out.write(s.tobytes())
                start = at + 8 * (np.cumsum(n) - n)
                at += 8 * int(n.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array([name] * len(n), pa.string()), pa.array(start)], ["cid", "n", "file", "start"])
        finally:
            if out is not None:
                out.close()

    with small_batches(spark):
        return written(mapped(_texts_of(cids, classes, texts), write, "cid long, n long, file string, start long"), "near-placed"), root


class _SetFiles:
    """Full sets by place; at most CACHE_BYTES of them are held, and few files are open."""

    def __init__(self, root: str):
        self.store, self.top = fs.FileSystem.from_uri(root)
        self.sets: dict[tuple[str, int], np.ndarray] = {}
        self.files: dict[str, pa.NativeFile] = {}
        self.held = 0

    def get(self, file: str, start: int, n: int) -> np.ndarray:
        if (file, start) not in self.sets:
            if self.held > CACHE_BYTES:
                self.sets.clear()
                self.held = 0
            if file not in self.files:
                if len(self.files) >= 64:
                    self.close()
                self.files[file] = self.store.open_input_file(f"{self.top}/{file}")
            self.sets[file, start] = np.frombuffer(self.files[file].read_at(8 * n, start), np.uint64)
            self.held += 8 * n
        return self.sets[file, start]

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()


def _block_rows(lists: DataFrame, main: DataFrame, classes: DataFrame, placed: DataFrame) -> DataFrame:
    """What travels for long lists: a class's sketch and the place of its full set, once per block that it meets."""
    rows = lists.join(main.withColumn("blocks", F.ceil(F.col("df") / BLOCK_CLASSES).cast("long")), "val")
    rows = rows.join(placed.join(classes.select("cid", "sketch"), "cid"), "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # Each row goes out once per block of the other kind; a class outside of the largest component is a query as well.
    sides = F.when(F.col("root") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    rows = rows.withColumn("other", F.explode(every)).withColumn("q", F.explode(sides))
    return rows.select("val", F.when(F.col("q"), F.col("other")).otherwise(F.col("own")).alias("m"), F.when(F.col("q"), F.col("own")).otherwise(F.col("other")).alias("k"), "q", "cid", "root", "n", "sketch", "file", "start")


def _block_links(lists: DataFrame, main: DataFrame, classes: DataFrame, texts: DataFrame, words: int, index: int, sketch: int, percent: int) -> DataFrame:
    """Links of long lists: each class outside of its list's largest component against all of the list.

    Members and queries are both dealt into blocks of a bounded number of classes, and a task holds the sketches of one
    block of each; full sets stay in the shared folder, whatever the number of blocks.  What the sketches have in common
    bounds the union's estimate; pairs that it lets through are compared on their full sets, unless
    links of the same task join them already.  A pair is compared only in the list of the smallest value that both have.
    """
    release(texts.sparkSession)
    placed, root = _placed_sets(lists.join(main, "val").select("cid"), classes, texts, words)
    release(texts.sparkSession)
    rows = _block_rows(lists, main, classes, placed)
    least = _least(percent, sketch) / sketch

    def run(key, both):
        val = np.array([key[0].as_py()], dtype=np.int64).view(np.uint64)[0]
        links: list[tuple[int, int]] = []
        members, queries = both.filter(pc.invert(both["q"])), both.filter(both["q"])
        if queries.num_rows and members.num_rows:
            low = [np.frombuffer(x.as_buffer(), np.uint64) for x in members["sketch"]]
            size, m_n, m_root, m_cid = np.array([len(x) for x in low]), *(members[c].to_numpy() for c in ("n", "root", "cid"))
            m_at = list(zip(members["file"].to_pylist(), members["start"].to_pylist(), m_n.tolist(), strict=True))
            values, owner = np.concatenate(low), np.repeat(np.arange(len(low)), size)
            padded = np.zeros((len(low), size.max()), dtype=np.uint64)
            padded[np.arange(size.max()) < size[:, None]] = values
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            there, up, files = set(m_cid.tolist()), {}, _SetFiles(root)

            def top(v):
                while v in up:
                    v = up[v]
                return v

            for x in queries.select(["cid", "root", "n", "sketch", "file", "start"]).to_batches(max_chunksize=256):
                for c, r, n, s, file, start in zip(*(x.column(i).to_pylist() for i in range(6)), strict=True):
                    s = np.frombuffer(s, np.uint64)
                    begin, end = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
                    used = np.flatnonzero(end - begin > (c in there))
                    if len(used) < least * len(s):
                        continue
                    # So many values have to be shared that a partner has one of the others, of which the rarest are looked up.
                    rare = used[np.argsort((end - begin)[used], kind="stable")][: len(used) - math.ceil(least * len(s)) + 1]
                    near = np.zeros(len(low), dtype=bool)
                    for i in rare:
                        near[owner[begin[i] : end[i]]] = True
                    near &= (m_root != r) & (100 * n >= percent * m_n) & (100 * m_n >= percent * n)
                    who = np.flatnonzero(near)
                    if not len(who):
                        continue
                    # Ranks in the union of the values that both have: those before in either sketch, less those before in both.
                    t = padded[who]
                    place = np.searchsorted(s, t)
                    both = (s[np.minimum(place, len(s) - 1)] == t) & (np.arange(t.shape[1]) < size[who, None])
                    rank = place + np.arange(t.shape[1]) - (np.cumsum(both, axis=1) - both)
                    union = size[who] + len(s) - both.sum(axis=1)
                    union = np.where((size[who] == sketch) | (len(s) == sketch), np.minimum(union, sketch), union)
                    again = (both & (place < index) & (t < val))[:, :index].any(axis=1)
                    who = who[~again & ((both & (rank < union[:, None])).sum(axis=1) >= least * union)]
                    for m in who:
                        a, b = top(r), top(int(m_root[m]))
                        if a == b:
                            continue
                        k = len(np.intersect1d(files.get(file, start, n), files.get(*m_at[m]), assume_unique=True))
                        if 100 * k >= percent * (n + int(m_n[m]) - k):
                            up[max(a, b)] = min(a, b)
                            links.append((min(c, int(m_cid[m])), max(c, int(m_cid[m]))))
            files.close()
        x = np.array(links, dtype=np.int64).reshape(-1, 2)
        trim()
        return pa.table({"a": x[:, 0], "b": x[:, 1]})

    with small_batches(texts.sparkSession):
        return written(rows.groupBy("val", "m", "k").applyInArrow(run, "a long, b long").distinct(), "near-block-links")


def near_groups(docs: DataFrame, *, words: int = WORDS, sketch: int = SKETCH, index: int = INDEX, short: int = SHORT, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows with locator, groups, locator names); groups: id, at, row, n, sig, component_id for every row of ``docs``;
    documents are linked at a similarity of ``percent`` hundredths or more."""
    rows, at = located(docs)
    with scratch(docs.sparkSession) as keep, small_batches(docs.sparkSession, 2000):
        return rows, keep(written(_grouped(rows, at, words, sketch, index, short, percent), "near-found")), at


def _grouped(rows: DataFrame, at: list[str], words: int, sketch: int, index: int, short: int, percent: int) -> DataFrame:
    """The groups, by way of staged tables."""
    texts = rows.select(F.col("doc_id").cast("long").alias("id"), F.col(at[0]).alias("at"), F.col(at[1]).alias("row"), "text")
    all_docs = written(document_sketches(texts, words, sketch), "near-sketches", compression="zstd")
    known = all_docs.filter("n > 0 and id is not null")
    classes = written(known.groupBy("sig").agg(F.min(F.struct("id", "at", "row")).alias("x"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("sig", F.col("x.id").alias("cid"), F.col("x.at").alias("at"), F.col("x.row").alias("row"), "n", "sketch"), "near-classes", compression="zstd")
    lists = _prune(_index(classes, index), index, percent)

    release(texts.sparkSession)
    # Step 1: the centre of each list against the others.
    centre = lists.groupBy("val").agg(F.min(F.struct((-F.col("central")).alias("o"), "cid", "n")).alias("p")).select("val", F.col("p.cid").alias("pivot"), F.col("p.n").alias("n_b"))
    star = lists.join(centre, "val").filter("cid != pivot").withColumnRenamed("n", "n_a").filter(_sized(percent))
    star = star.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    links = _verified(star, classes, texts, words, sketch, percent)

    # Step 2: what lists still hold apart.
    roots = components(links, "near-roots")
    release(texts.sparkSession)
    joined = written(lists.join(roots.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "near-lists")
    per_root = joined.groupBy("val", "root").agg(F.count(F.lit(1)).alias("k"))
    main = per_root.groupBy("val").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("df")).filter("roots > 1").select("val", "main", "df")
    main = written(main, "near-main")
    open_short = joined.drop("df").join(main.filter(F.col("df") <= short).select("val"), "val").select("val", "cid", "n", "root")
    left = open_short.select("val", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"))
    right = open_short.select("val", F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("r_b"))
    pairs = left.join(right, "val").filter("a < b and r_a != r_b").filter(_sized(percent)).select("a", "b").distinct()
    pairs = written(pairs.join(star, ["a", "b"], "left_anti"), "near-pairs")
    more = _verified(pairs, classes, texts, words, sketch, percent)
    long_lists = main.filter(F.col("df") > short)
    if not long_lists.isEmpty():
        more = more.unionByName(_block_links(joined.select("val", "cid", "root"), long_lists, classes, texts, words, index, sketch, percent))
    if not more.isEmpty():
        roots = components(links.unionByName(more), "near-roots")
    group = classes.select("sig", "cid").join(roots.withColumnRenamed("v", "cid"), "cid", "left").select("sig", F.coalesce("root", "cid").alias("root"))
    out = all_docs.select("id", "at", "row", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("sig")).alias("sig")).join(group, "sig", "left")
    return out.select("id", "at", "row", "n", "sig", F.coalesce("root", "id").alias("component_id"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the one with the smallest doc_id, and of rows
    that repeat both this doc_id and the set the first by file and row."""
    rows, found, at = near_groups(docs, **options)
    again = found.filter("id = component_id and n > 0").withColumn("k", F.row_number().over(Window.partitionBy("id", "sig").orderBy("at", "row"))).filter("k > 1").select("at", "row")
    dropped = found.filter("id != component_id").select("at", "row").unionByName(again)
    out = choose_places(rows, at, dropped, keep=False)
    return only(out, docs.columns)


def op7_minhash(spark, sf_dir):
    _, found, _ = near_groups(table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct r, doc_id, case when len(w) < 5 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] end as g
  from (select r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select r, any_value(doc_id) as doc_id, count(*) as n from s group by r),
p as (select a.r as x, b.r as y, count(*) as k from s a join s b on a.g = b.g and a.r < b.r group by a.r, b.r),
l as (select a.doc_id as a, b.doc_id as b from p join n a on a.r = x join n b on b.r = y where 100 * k >= 85 * (a.n + b.n - k)),
e as (select a, b from l union select b, a from l),
c as (select a as v, a as to_ from e union select c.v, e.b from c join e on e.a = c.to_),
m as (select v, min(to_) as low from c group by v)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(low, d.doc_id) as component_id, coalesce(low, d.doc_id) = d.doc_id as kept from d left join n using (r) left join m on m.v = d.doc_id
"""
