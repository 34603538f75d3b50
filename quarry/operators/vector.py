"""Exact nearest neighbours over chunk vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.relevance import squared_l2
from quarry.operators.keyword import top_k

MOST_QUERY_BYTES = 64 << 20


def check_dim(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The same rows; a vector of another width is an error when it is read."""
    ok = F.assert_true(F.size(vector) == dim, F.format_string("expected %d dimensions, got %d", F.lit(dim), F.size(vector)))
    return df.filter(ok.isNull())


def search_vector(chunks: DataFrame, query: list[float], k: int, *, filters: Column | None = None, vector: str = "vector", id_col: str = "id", dim: int | None = None) -> DataFrame:
    """The k nearest chunks of one query with ``distance``; the filter runs in the scan, before distances."""
    if dim is not None and len(query) != dim:
        raise ValueError(f"query has {len(query)} dimensions, the store {dim}")
    if k <= 0:
        return chunks.limit(0).withColumn("distance", F.lit(0.0).cast("float")).drop(vector)
    df = chunks if filters is None else chunks.filter(filters)
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    return df.withColumn("distance", squared_l2(vector, q)).drop(vector).orderBy("distance", id_col).limit(k)


def search_vectors(chunks: DataFrame, queries: DataFrame, k: int, *, filters: Column | None = None, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """(query_id, id, distance, rank): nearest chunks of many queries (query_id, vector).

    Queries, a stated set, travel with the task in blocks of bounded size; each Arrow batch of chunks is one matrix
    product and gives at most k rows per query, the first by distance and id, so neither all pairs nor vectors are shuffled.
    Rows without a vector are neither found nor searched for; a vector of another width than the queries' is an error.
    """
    asked = queries.filter("vector is not null").select("query_id", "vector")
    width = asked.agg(F.max(F.size("vector")), F.min(F.size("vector")), F.count(F.lit(1))).first()
    if width[2] and width[0] != width[1]:
        raise ValueError(f"queries have from {width[1]} to {width[0]} dimensions")
    blocks = -(-4 * (width[0] or 0) * width[2] // MOST_QUERY_BYTES) or 1
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = None
    for i in range(blocks):
        part = _block(chunks, asked if blocks == 1 else asked.filter(number == i), k, filters, vector, id_col, width[0] or 0)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, "distance", ascending=True)


def _block(chunks: DataFrame, queries: DataFrame, k: int, filters: Column | None, vector: str, id_col: str, dim: int) -> DataFrame:
    """(query_id, id, distance): per batch of chunks the nearest k for each query of one block."""
    rows = queries.toArrow()
    ids = rows["query_id"].combine_chunks()
    matrix = np.array(rows["vector"].to_pylist(), dtype=np.float32).reshape(rows.num_rows, dim)
    wide = matrix.astype(np.float64)
    own = (wide**2).sum(1)
    kinds = (queries.schema["query_id"].dataType.simpleString(), chunks.schema[id_col].dataType.simpleString())

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n or not len(matrix):
                continue
            x = b.column(1).flatten().to_numpy().astype(np.float32).astype(np.float64).reshape(n, -1)
            m = min(k, n)
            place = np.empty(n, dtype=np.int64)
            place[pc.sort_indices(b.column(0), null_placement="at_start").to_numpy()] = np.arange(n)
            size = (x**2).sum(1)
            rough = size[None, :] - 2 * (wide @ x.T)
            # Whatever may be as near as the k-th by its float32 distance is kept; exact distances, then ids, decide.
            error = (wide.shape[1] + 4) * 2.0**-50 * (size.max() + own)
            cut = np.partition(rough, m - 1, axis=1)[:, m - 1]
            most = np.maximum(cut + own + error, 0)
            cut = np.where(most < 3.4e38, cut + 2 * error + most * 2.0**-22 + 1e-44, np.inf)
            picked, near = [], []
            for i, q in enumerate(wide):
                at = np.flatnonzero(~(rough[i] > cut[i]))
                d = ((x[at] - q) ** 2).sum(1).astype(np.float32)
                best = np.lexsort((place[at], d))[:m]
                picked.append(at[best])
                near.append(d[best])
            owner, at, d = np.repeat(np.arange(len(matrix)), m), np.concatenate(picked), np.concatenate(near)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), b.column(0).take(pa.array(at)), pa.array(d)], ["query_id", "id", "distance"])

    df = chunks if filters is None else chunks.filter(filters)
    df = check_dim(df.filter(F.col(vector).isNotNull()), dim, vector) if dim else df.limit(0)
    return df.select(F.col(id_col).alias("id"), vector).mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, distance float")
