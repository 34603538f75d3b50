"""Labelled retrieval fixtures: a JSON document with a corpus and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "corpus array<struct<path string, content string>>, queries array<struct<id string, query string, relevant_paths array<string>>>"


def read_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(corpus (rel_path, content), queries (query_id, query, relevant)); every relevant path must be in the corpus, and
    every query must have one."""
    doc = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    corpus = doc.select(F.explode("corpus").alias("c")).select(F.col("c.path").alias("rel_path"), "c.content")
    queries = doc.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), "q.query", F.col("q.relevant_paths").alias("relevant"))
    return validate_fixture(corpus, queries)


def validate_fixture(corpus: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    if not queries.filter("coalesce(size(relevant), 0) <= 0 or trim(query) = ''").isEmpty():
        raise ValueError("a query has no text or no relevant path")
    named = queries.select(F.explode("relevant").alias("rel_path"))
    if not named.join(corpus, "rel_path", "left_anti").isEmpty():
        raise ValueError("a relevant path is not in the corpus")
    if not corpus.groupBy("rel_path").count().filter("count > 1").isEmpty() or not queries.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("paths and query ids must be unique")
    return corpus, queries
