"""Token counts: by a byte-level BPE rank file where one is given, else by a documented approximation."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import _c

#: The public split pattern of the cl100k vocabulary, for rank files of that kind.
CL100K_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
_PIECES = re.compile(r"[^\W\d_]+|\d{1,3}|[^\w\s]|_|\s+(?=\s)|\n")


def approximate(text: str) -> int:
    """Pieces of words, numbers and marks; letters count one token for each six.  Not equal to any vocabulary's count."""
    return sum(-(-len(m) // 6) if m[:1].isalpha() else 1 for m in _PIECES.findall(text or ""))


@lru_cache(maxsize=4)
def counter(rank_file: str | None = None, pattern: str = CL100K_PATTERN) -> Callable[[str], int]:
    """A counting function; with a rank file (base64 bytes and rank per line) it is exact for that vocabulary."""
    if rank_file is None:
        return approximate
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text or ""))


def token_count(c, rank_file: str | None = None, pattern: str = CL100K_PATTERN) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        f = counter(rank_file, pattern)
        return texts.map(f, na_action="ignore")

    return count(_c(c))
