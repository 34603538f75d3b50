"""Retrieval quality: precision, recall and reciprocal rank over distinct files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.chunk import sliding_chunks
from quarry.operators.keyword import analysed, build_index, keyword_search, words_of

AT, CANDIDATES = 5, 20


def first_paths(ranked: DataFrame, at: int = AT) -> DataFrame:
    """(query_id, rel_path, rank) of the first ``at`` distinct paths of ranked rows (query_id, rel_path, rank)."""
    first = ranked.groupBy("query_id", "rel_path").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= at)


def score_queries(ranked: DataFrame, relevant: DataFrame, at: int = AT) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank); ``relevant`` has query_id, rel_path; unanswered queries score 0."""
    hits = first_paths(ranked, at).join(relevant, ["query_id", "rel_path"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    n = relevant.groupBy("query_id").agg(F.countDistinct("rel_path").alias("n"))
    k = F.coalesce("hits", F.lit(0))
    return n.join(hits, "query_id", "left").select("query_id", (k / at).alias("precision"), (k / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def mean_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("queries"), F.avg("precision").alias("precision_at_5"), F.avg("recall").alias("recall_at_5"), F.avg("reciprocal_rank").alias("mrr"))


def benchmark(corpus: DataFrame, queries: DataFrame, *, stem: bool = True) -> DataFrame:
    """Means over a labelled fixture, with raw queries against a keyword index of the corpus's chunks."""
    chunks = sliding_chunks(corpus.withColumn("last_modified", F.lit(0).cast("long"))).withColumn("id", F.sha2(F.concat_ws(":", "rel_path", "ordinal"), 256)).withColumn("symbol_name", F.lit(None).cast("string"))
    terms = queries.select("query_id", F.explode(words_of("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    ranked = keyword_search(build_index(chunks, stem, terms=analysed(terms, stem)), terms, CANDIDATES, stem=stem).join(chunks.select("id", "rel_path"), "id")
    return mean_scores(score_queries(ranked, queries.select("query_id", F.explode("relevant").alias("rel_path"))))
