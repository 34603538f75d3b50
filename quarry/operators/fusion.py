"""Fusion of semantic and keyword rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.relevance import adaptive_weights, normalised, rrf_term, similarity
from quarry.operators.keyword import top_k


def rrf_fuse(semantic: DataFrame, keyword: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, semantic_score, keyword_score): weighted reciprocal-rank fusion of two ranked lists.

    Inputs have query_id, id, rank and ``distance`` or ``score``.  A union grouped by id needs one shuffle where a full outer
    join needs two.  ``weights`` (query_id, w_semantic, w_keyword) default to 0.6 and 0.4.  A list that repeats an id adds
    each of its ranks.
    """
    none = F.lit(None).cast("float")
    s = semantic.select("query_id", "id", F.col("rank").alias("s_rank"), F.lit(None).cast("int").alias("k_rank"), similarity("distance").alias("semantic_score"), none.alias("keyword_score"))
    k = keyword.select("query_id", "id", F.lit(None).cast("int").alias("s_rank"), F.col("rank").alias("k_rank"), none.alias("semantic_score"), F.col("score").cast("float").alias("keyword_score"))
    both = s.unionByName(k)
    if weights is None:
        both = both.withColumns({"w_semantic": F.lit(0.6).cast("float"), "w_keyword": F.lit(0.4).cast("float")})
    else:
        both = both.join(weights, "query_id")
    part = lambda w, r: F.coalesce(rrf_term(F.col(w), r), F.lit(0.0).cast("float"))
    both = both.withColumns({"s_part": part("w_semantic", "s_rank"), "k_part": part("w_keyword", "k_rank")})
    return both.groupBy("query_id", "id").agg((F.sum("s_part").cast("float") + F.sum("k_part").cast("float")).cast("float").alias("score"), F.max("semantic_score").alias("semantic_score"), F.max("keyword_score").alias("keyword_score"))


def query_weights(queries: DataFrame) -> DataFrame:
    s, k = adaptive_weights("query")
    return queries.select("query_id", s.alias("w_semantic"), k.alias("w_keyword"))


def hydrate(ranked: DataFrame, chunks: DataFrame, keyword_docs: DataFrame | None = None) -> DataFrame:
    """Ranked ids with their chunk columns; where the chunk table lacks an id, the keyword index's copy serves, and ids
    in neither are dropped."""
    cols = [c for c in ("rel_path", "start_line", "end_line", "symbol_name", "symbol_type", "language", "content", "last_modified") if c in chunks.columns]
    out = ranked.join(chunks.select("id", F.struct(*cols).alias("c")), "id", "left")
    if keyword_docs is not None:
        missing = ranked.join(chunks.select("id"), "id", "left_anti").select("id").distinct()
        copy = F.struct(*[(F.col(c) if c in keyword_docs.columns and c not in ("symbol_type", "last_modified") else F.lit(0 if c == "last_modified" else None).cast(chunks.schema[c].dataType)).alias(c) for c in cols])
        out = out.join(keyword_docs.join(missing, "id", "left_semi").select("id", copy.alias("k")), "id", "left").withColumn("c", F.coalesce("c", "k")).drop("k")
    return out.filter("c is not null").select(*ranked.columns, "c.*")


def fused_top_k(semantic: DataFrame, keyword: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
    return top_k(rrf_fuse(semantic, keyword, weights), k)
