"""Mixing sources to target weights by weighted fair queueing (operator 3, DataFrame functions only).

Documents of a source are shuffled by hash.  Each copy of a document has a virtual finish time: the
source's words up to and with it, divided by the source's target.  The mix is the global range sort by finish
time, cut where its words reach the budget.

Running sums never gather a source in one task: words are summed per (source, hash bucket), the bucket sums are
accumulated, and only rows of one bucket are sorted together; buckets grow in number with the rows.  The shuffle's
hash is of doc_id and text, so rows with a null or repeated doc_id spread like any others.

Defined results: a null text has size 0 and is taken 0 times; null sources form one source, ordered last;
a source without words has target 0 but takes its turn in the order of weights; copies that tie in finish time are
taken or left together; rows of a source that tie in hash are ordered by doc_id and size; texts of any length are counted
whole; an empty table gives an empty result; rows that repeat a doc_id are documents of their own; extra columns are
kept by :func:`mix_documents` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import WORD, free_name, located, only, scratch, staged, table

BUCKET_ROWS, RANGE_ROWS = 512, 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most_epochs: int) -> DataFrame:
    """(no_source, src, source_size, target) from per-source sizes: one row per source, a small table.

    The budget is total * share[0] / share[1], split by weight; no target passes most_epochs * size, and
    what is over is shared anew by weight among the others.  Sources in ascending order of size / weight
    reach their limit first, so one ordered pass settles which do; all sums are whole numbers.
    """
    up, down = share
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("no_source", "src")) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", w).filter("source_size > 0").withColumn("cap", F.col("source_size") * most_epochs)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(every) * up)  # times down
    s = s.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)) * down)
    s = s.withColumn("capped", F.col("cap") * F.col("left_w") * down < F.col("w") * F.col("left"))
    s = s.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)) * down).withColumn("rest_w", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(every), F.lit(1)))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("rest")).cast("double") / (F.col("rest_w") * down).cast("double"))
    known = s.select("no_source", "src", "source_size", target.alias("target"))
    return known.unionByName(sizes.filter("source_size = 0").select("no_source", "src", "source_size", F.lit(0.0).alias("target")))


def _cut(rows: DataFrame, copies: int, budget: int, down: int) -> float:
    """The finish time at which the range-sorted mix is truncated: the largest up to which all words stay within budget / down.

    Copies are range-sorted by finish time; the ranges' words are added up in order, and only the range in which the
    budget ends is looked into row by row.  Copies that tie in finish time are taken or left together.
    """
    times = F.array(*[(F.col("cum") + k * F.col("source_size")) / F.col("target") for k in range(copies)])
    flat = rows.filter("size > 0").select("size", F.explode(times).alias("f"))
    ranges = max(1, rows.count() * copies // RANGE_ROWS)
    ordered = staged(flat.repartitionByRange(ranges, "f").withColumn("range", F.spark_partition_id()), "mix-order")
    sums = ordered.groupBy("range").agg(F.sum("size").alias("words"), F.max("f").alias("last"))
    upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))  # a row per range
    upto = staged(upto, "mix-ranges")
    cut = upto.filter(F.col("upto") * down <= budget).agg(F.max("last")).first()[0]
    over = upto.filter(F.col("upto") * down > budget).orderBy("range").first()
    if over is not None:
        inside = ordered.filter(F.col("range") == over["range"]).groupBy("f").agg(F.sum("size").alias("s"))
        run = inside.withColumn("run", F.sum("s").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)) + (over["upto"] - over["words"]))
        best = run.filter(F.col("run") * down <= budget).agg(F.max("f")).first()[0]
        cut = cut if best is None else best
    return -1.0 if cut is None else float(cut)


def mix_plan(docs: DataFrame, keep: list[str], *, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """keep + (size, source_size, target, finish array<double>, taken long): one light row per document.

    ``finish`` holds the finish times of the copies that the mix takes.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    rows = staged(docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col("doc_id").alias("id"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), size.alias("size"), key.alias("key")), "mix")
    n = rows.count()
    buckets = max(16, n // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long"))
    by = ["no_source", "src"]
    sums = staged(rows.groupBy(*by, "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    base = sums.withColumn("base", F.sum("words").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).drop("words")
    targets = source_targets(sums.groupBy(*by).agg(F.sum("words").alias("source_size")), weights, share, most_epochs)
    inside = Window.partitionBy(*by, "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumn("own", F.sum("size").over(inside)).join(base.join(targets, by), [*by, "bucket"]).withColumn("cum", F.col("base") + F.col("own"))
    timed = staged(timed.select(*[f"k_{c}" for c in keep], "size", "source_size", "target", "cum"), "mix-times")
    total = sums.agg(F.sum("words")).first()[0] or 0
    cut = _cut(timed, most_epochs, total * share[0], share[1])
    times = F.array(*[(F.col("cum") + k * F.col("source_size")) / F.col("target") for k in range(most_epochs)])
    finish = F.when(F.col("size") > 0, F.filter(times, lambda t: t <= cut)).otherwise(F.array().cast("array<double>"))
    out = timed.withColumn("finish", finish).withColumn("taken", F.col("size") * F.size("finish"))
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "size", "source_size", "target", "finish", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as taken, globally range-sorted by finish time."""
    rows, at = located(docs)
    time = free_name({c.lower() for c in rows.columns}, "finish")
    with scratch(docs.sparkSession) as keep:
        plan = keep(staged(mix_plan(rows, at, **options).filter("taken > 0").select(*at, "finish"), "mix-plan"))
    # The plan grows with the documents, so it is never broadcast.
    out = rows.join(plan.toDF(*at, time).hint("merge"), at).withColumn(time, F.explode(time))
    out = out.repartitionByRange(F.col(time), *[F.col(c) for c in at]).sortWithinPartitions(time, *at)
    return only(out, docs.columns)


def op3_mixing(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with recursive d as (
  select doc_id, source is null as no_source, coalesce(source, '') as src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as key
  from documents),
s as (select no_source, src, sum(size)::hugeint as source_size from d group by all),
n as (select *, [3, 1, 2][1 + ((row_number() over (order by no_source, src) - 1) % 3)::int]::hugeint as w from s),
r as (
  select 0 as step, no_source, src, source_size, w, false as capped from n where source_size > 0
  union all
  select step + 1, no_source, src, source_size, w, capped or 4 * source_size * left_w < w * left_b
  from (select *, sum(case when not capped then w else 0 end) over () as left_w,
               3 * sum(source_size) over () - 4 * coalesce(sum(case when capped then source_size end) over (), 0) as left_b from r)
  where step < (select count(*) from n where source_size > 0)),
f as (select * from r where step = (select max(step) from r)),
t as (
  select no_source, src, source_size,
         case when capped then (2 * source_size)::double
              else (w * (3 * sum(source_size) over () - 4 * coalesce(sum(case when capped then source_size end) over (), 0)))::double
                   / (2 * sum(case when not capped then w end) over ())::double end as target from f
  union all select no_source, src, source_size, 0.0 from s where source_size = 0),
c as (
  select d.*, source_size, target, sum(size) over (partition by no_source, src order by key, doc_id, size rows unbounded preceding) as cum
  from d join t using (no_source, src)),
e as (select size, (cum + k * source_size)::double / target as fin from c, (values (0), (1)) v(k) where size > 0),
z as (select coalesce(max(fin), -1) as cut from (select fin, sum(size) over (order by fin range unbounded preceding) as run from e) where 2 * run <= 3 * (select sum(size) from d))
select doc_id, size, source_size::bigint as source_size, target,
       case when size = 0 then 0 else size * ((cum::double / target <= cut)::int + ((cum + source_size)::double / target <= cut)::int) end::bigint as taken
from c, z
"""
