"""Secret detection: files that are never read, and text rules with an entropy check.

The rules are the well-known public families of credential formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import _c, file_name, let

# Public credential formats.
RULES = [
    r"\b(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b",
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    r"\bglpat-[A-Za-z0-9_-]{20,}",
    r"\bxox[abposr]-[A-Za-z0-9-]{10,}",
    r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}",
    r"\b[rs]k_live_[A-Za-z0-9]{16,}",
    r"\bAIza[A-Za-z0-9_-]{35}\b",
    r"\bnpm_[A-Za-z0-9]{36}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
]
ASSIGNED = r"""(?i)(?:secret|token|passwd|password|api_?key|access_?key|auth)\w*["']?\s*[:=]\s*["']([A-Za-z0-9+/=_-]{16,})["']"""
LEAST_ENTROPY = 3.5


def skip_file(p) -> Column:
    """Files that must not be read: ``.env*``, ``*.pem``, ``*.key``, ``credentials.json``."""
    n = F.lower(file_name(p))
    return n.startswith(".env") | n.endswith(".pem") | n.endswith(".key") | (n == "credentials.json")


def entropy(c) -> Column:
    """Shannon entropy in bits per character, over characters."""

    def bits(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars))
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return let(F.split(_c(c), ""), bits)


def matches_rule(c) -> Column:
    """Whether a text holds a credential of a known form."""
    rule = F.lit(False)
    for r in RULES:
        rule = rule | _c(c).rlike(r)
    return rule


def assigned_values(c) -> Column:
    """Values that a text assigns to names of secrets."""
    return F.regexp_extract_all(_c(c), F.lit(ASSIGNED), 1)


def contains_secret(c, least_entropy: float = LEAST_ENTROPY) -> Column:
    return matches_rule(c) | F.exists(assigned_values(c), lambda v: entropy(v) >= least_entropy)
