"""URL filters: rules first, then trust and distrust over the host link graph (operator 6, DataFrame functions only).

A rule (host, path, action) fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
Pages that no rule fits are judged by their host: personalised PageRank spreads trust from trusted seeds along links, and
distrust from blocked seeds against links (who links to a blocked host is suspect).  A host is a seed where at
least ``seed_share`` of its pages are allowed or blocked by rules; a host is blocked where its distrust is at least
``floor`` and over ``threshold`` of trust and distrust together.

Links are counted per (source, target) before any join, each round joins ranks to these edges and sums by target with
map-side combining, and rounds are staged, so a host with a third of all links is split by Spark's skew handling.

Defined results: a null url or one without ``://`` has empty host and path and is allowed; null html has no links; of
rules that fit and are equally long, block wins, then the later by code point; rows that repeat a page_id are judged
each; urls and html of any length are read whole; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(size, action, rule), else null.  ``rules`` is a literal, part of the plan."""
    if not rules:
        return F.lit(None).cast("struct<size:int,action:string,rule:string>")
    every = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(a == "block").alias("blocks"), F.lit(a).alias("action"), F.lit(h + p).alias("rule"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, a in rules])
    fits = F.filter(every, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["action"].alias("action"), best["rule"].alias("rule")))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from host to host, without links inside a host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
    return links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).filter("src != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, least_change: float = 1e-6, most_rounds: int = 500) -> DataFrame:
    """(kind, host, score): trust along ``edges``, distrust against them, from ``seeds`` (kind, host), each with weight 1.

    Rounds go on until all scores together change by less than ``least_change`` in one, or, where ``rounds`` is given, for so
    many; a walk that has not settled after ``most_rounds`` is an error.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    both = staged(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "url-edges")
    start = seeds.select("kind", "host", F.lit(1 - damping).alias("score"))
    if both.isEmpty():
        return start
    base = staged(start, "url-seeds")
    ranks = base.withColumn("score", F.lit(0.0)).limit(0)
    for k in range(1, (rounds or most_rounds) + 1):
        sent = ranks.withColumnRenamed("host", "src").join(both, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
        before, ranks = ranks, sent.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 0 or k == rounds:
            ranks = staged(ranks, "url-ranks")
            if rounds is None:
                moved = ranks.join(before.withColumnRenamed("score", "old"), ["kind", "host"], "left").agg(F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0]
                if (moved or 0.0) < least_change:
                    return ranks
    if rounds is None:
        raise RuntimeError(f"scores did not settle in {most_rounds} rounds")
    return ranks


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, *, seed_share: float = 0.5, threshold: float = 0.5, floor: float = 0.01, **walk) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_trust, host_distrust."""
    rules = RULES if rules is None else rules
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    per_host = judged.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r.action") == "allow").alias("trust"), F.count_if(F.col("r.action") == "block").alias("distrust"))
    seeds = per_host.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("n")).alias("share")) for k in ("trust", "distrust")])).alias("s")).filter(F.col("s.share") >= seed_share).select("s.kind", "host")
    scores = spread(host_edges(pages), seeds, **walk)
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    hosts = staged(scores.groupBy("host").agg(score("trust").alias("host_trust"), score("distrust").alias("host_distrust")), "url-hosts")
    trust, distrust = F.coalesce("host_trust", F.lit(0.0)), F.coalesce("host_distrust", F.lit(0.0))
    by_host = F.when((distrust >= floor) & (distrust > threshold * (trust + distrust)), "block").otherwise("allow")
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.action"), by_host).alias("verdict"), trust.alias("host_trust"), distrust.alias("host_distrust"))


def link_spread(spark, sf_dir):
    """The walk alone over a stated table of links, since ``pages`` has none between hosts: every row of ``lineitem`` is a link
    from host l_partkey to host 3 * l_suppkey + 1, both modulo 997; hosts 0 to 4 are trusted, 5 to 9 blocked; 24 rounds."""
    host = lambda c: F.concat(F.lit("h"), F.pmod(c, F.lit(997)))
    links = table(spark, sf_dir, "lineitem").select(host(F.col("l_partkey")).alias("src"), host(F.col("l_suppkey") * 3 + 1).alias("dst"))
    edges = links.filter("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    seeds = spark.range(10).select(F.when(F.col("id") < 5, "trust").otherwise("distrust").alias("kind"), F.concat(F.lit("h"), "id").alias("host"))
    return spread(edges, seeds, rounds=24).withColumn("score", F.round("score", 9))


def op6_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with recursive rules(h, p, a) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u as (select row_number() over () as i, page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
f as (select i, arg_max(h || p, (length(h || p), a = 'block', h || p)) as rule, arg_max(a, (length(h || p), a = 'block', h || p)) as act from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by i),
j as (select u.*, rule, act from u left join f using (i)),
c as (select host, count(*) as n, count(*) filter (where act = 'allow') as trust, count(*) filter (where act = 'block') as distrust from j where host != '' group by host),
seed as (select 'trust' as kind, host from c where trust / n >= 0.5 union all select 'distrust', host from c where distrust / n >= 0.5),
l as (select host as src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from u where html is not null),
e as (select src, dst, count(*) as n from l where src != '' and src != dst group by all),
b as (select 'trust' as kind, src, dst, n from e union all select 'distrust', dst, src, n from e),
w as (select kind, src, dst, n / sum(n) over (partition by kind, src) as w from b),
r as (select 1 as step, kind, host, 0.15::double as score from seed
      union all
      select step + 1, kind, host, sum(score) from (select step, r.kind, dst as host, score * w * 0.85 as score from r join w on w.kind = r.kind and w.src = r.host union all select s.step, seed.kind, seed.host, 0.15 from seed, (select distinct step from r) s)
      where step < 100 group by step, kind, host),
x as (select host, coalesce(sum(score) filter (where kind = 'trust'), 0) as t, coalesce(sum(score) filter (where kind = 'distrust'), 0) as d from r where step = (select max(step) from r) group by host)
select page_id, j.host, path, rule, coalesce(act, case when coalesce(d, 0) >= 0.01 and d > 0.5 * (t + d) then 'block' else 'allow' end) as verdict from j left join x on x.host = j.host
"""


LINK_SQL = """
with recursive e as (select 'h' || l_partkey % 997 as src, 'h' || (3 * l_suppkey + 1) % 997 as dst, count(*) as n from lineitem where l_partkey % 997 != (3 * l_suppkey + 1) % 997 group by all),
b as (select 'trust' as kind, src, dst, n from e union all select 'distrust', dst, src, n from e),
w as (select kind, src, dst, n / sum(n) over (partition by kind, src) as w from b),
seed as (select case when i < 5 then 'trust' else 'distrust' end as kind, 'h' || i as host from range(10) t(i)),
r as (select 1 as step, kind, host, 0.15::double as score from seed
      union all
      select step + 1, kind, host, sum(score) from (select step, r.kind, dst as host, score * w * 0.85 as score from r join w on w.kind = r.kind and w.src = r.host union all select s.step, seed.kind, seed.host, 0.15 from seed, (select distinct step from r) s)
      where step < 24 group by step, kind, host)
select kind, host, round(score, 9) as score from r where step = 24
"""
