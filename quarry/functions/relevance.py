"""Scores and weights.  Scores are FLOAT; Spark divides to DOUBLE, so each quotient is rounded back, which gives the
correctly rounded float quotient and keeps ties exact."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import _c

# Fixed values.
RRF_K = 60
FLOAT_MAX = float(np.finfo(np.float32).max)
DAY, WEEK = 86_400, 604_800


def similarity(distance) -> Column:
    """1 / (1 + max(d, 0)); the largest float where that is not finite."""
    d = _c(distance)
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(FLOAT_MAX)).otherwise(1 / (1 + F.greatest(d, F.lit(0.0)))).cast("float")


def rrf_term(weight: float | Column, rank) -> Column:
    w = F.lit(weight).cast("float") if isinstance(weight, (int, float)) else weight
    return (w / (F.lit(RRF_K) + _c(rank))).cast("float")


def normalised(score, top) -> Column:
    """score / top within [0, 1]; 0 where top is not positive."""
    return F.when(_c(top) > 0, F.least(F.greatest((_c(score) / _c(top)).cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))).otherwise(F.lit(0.0).cast("float"))


def recency(score, modified, now: int) -> Column:
    s, age = _c(score), F.lit(now) - _c(modified)
    boosted = F.when(age < DAY, (s * F.lit(1.1).cast("float")).cast("float")).when(age < WEEK, (s * F.lit(1.03).cast("float")).cast("float")).otherwise(s)
    return F.when((s <= F.lit(0.3).cast("float")) | (_c(modified) <= 0) | (age < 0), s).otherwise(boosted)


def squared_l2(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x).cast("float")


def l2_normalised(v) -> Column:
    v = _c(v)
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def query_tokens(q) -> Column:
    """Identifier-like tokens: letters, digits, ``_`` and inner dots."""
    return F.filter(F.transform(F.regexp_extract_all(_c(q), F.lit(r"[A-Za-z0-9_.]+"), 0), lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), lambda t: t != "")


def is_identifier(t) -> Column:
    t = _c(t)
    snake = t.rlike(r"^[A-Za-z0-9]+(_[A-Za-z0-9]+)+$") & t.rlike("[A-Za-z]")
    camel = t.rlike(r"^[A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*$")
    dotted = t.rlike(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)+$") & t.rlike("[A-Za-z]")
    acronym = t.rlike(r"^[A-Z0-9_]*[A-Z][A-Z0-9_]*[A-Z][A-Z0-9_]*s?$")
    return snake | camel | dotted | acronym


def identifier_density(q) -> Column:
    t = query_tokens(q)
    return F.when(F.size(t) > 0, (F.size(F.filter(t, is_identifier)) / F.size(t)).cast("float"))


def adaptive_weights(q) -> tuple[Column, Column]:
    """(semantic, keyword): more weight on keywords the more of the query is identifiers."""
    d = identifier_density(q)
    pick = lambda a, b, c: F.when(d > F.lit(0.60).cast("float"), a).when(d < F.lit(0.25).cast("float"), b).otherwise(c).cast("float")
    return pick(0.4, 0.7, 0.6), pick(0.6, 0.3, 0.4)


def candidate_limit(top_k: int) -> int:
    return min(top_k * 4, max(200, top_k))


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over unmasked tokens; a zero row where all are masked."""
    m = mask[..., None].astype(np.float32)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1)


def bm25_idf(n, df) -> Column:
    return F.log1p((_c(n) - _c(df) + 0.5) / (_c(df) + 0.5))
