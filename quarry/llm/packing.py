"""Best-fit packing by sum of squares (operator 9).

Documents become ids (byte-level BPE, then id 0), those over the capacity are cut, and pieces are packed
by the sum-of-squares rule: each piece goes where the sum over all residual gaps of (open bins with that gap) squared
becomes smallest.  Pieces are dealt by hash into groups of a bounded number of rows that are packed independently, so no
task grows with the corpus, copies of one text included; what a group leaves open is a few bins.

Defined results: a null or empty text is the single id 0; a text over the capacity, of any length, is cut; of placements
that tie the smallest gap is taken, and pieces of one length go in the order of doc_id, piece, start and ids; rows that
repeat a doc_id are packed each (``keep_place`` tells them apart); an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import located, only, staged, table
from quarry.llm.hashing import trim

CAPACITY, GROUP_ROWS = 2048, 100_000
#: Outside of these characters, and where a special token's string occurs, the reference tokenizer itself runs.
_OTHER = re.compile("[^\u0000-ɏ‐-‧‰-⁞€]")
_END = "<|endoftext|>"
_loaded: dict[tuple[str, str, str], object] = {}


class Encoder:
    """ids of texts as ``tokenizers`` gives them with add_special_tokens=False.

    The same vocabulary as ranks encodes several times faster; it is used for texts of common characters, where
    both split words alike (tests hold one against the other), and ``tokenizers`` for the rest.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path, self.slow = json_path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if (not text.isascii() and _OTHER.search(text)) or _END in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def encoder(files: tuple[str, str, str] | None = None) -> Encoder:
    files = files or default_files()
    if files not in _loaded:
        _loaded[files] = Encoder(*files)
    return _loaded[files]


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or full pieces behind a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def document_pieces(docs: DataFrame, *, capacity: int = CAPACITY, files: tuple[str, str, str] | None = None, keep_ids: bool = False, keep_place: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, file, row][, ids array<int>]) for all documents; ``file`` is a hash of the
    input file's path, ``row`` the row in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text"]
    if keep_place:
        rows, at = located(docs)
        docs, columns = rows.select("doc_id", "text", F.xxhash64(at[0]).alias("file"), F.col(at[1]).alias("row")), ["doc_id", "text", "file", "row"]

    def pieces(batches):
        encode = encoder(files)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                owner, rows, ids = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                    for k, (s, n) in enumerate(cut_pieces(len(own), capacity)):
                        x = own[s : s + n]
                        owner.append(i)
                        rows.append((k, s, n, zlib.crc32(x.tobytes())))
                        if keep_ids:
                            ids.append(x.astype(np.int32))
                a = np.array(rows, dtype=np.int64).reshape(-1, 4)
                own = pa.array(owner, pa.int64())
                cols = [part.column(0).take(own), pa.array(a[:, 0].astype(np.int32)), *(pa.array(a[:, i]) for i in (1, 2, 3)), *(part.column(i).take(own) for i in (2, 3) if keep_place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *["file", "row"] * keep_place, *["ids"] * keep_ids]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names)

    def run(batches):
        try:
            yield from pieces(batches)
        finally:  # the vocabulary's tables would stay in the worker, beside whatever its executor does next
            _loaded.clear()
            trim()

    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", file long, row long" * keep_place + ", ids array<int>" * keep_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the given order.

    With N(g) open bins of gap g, a piece of length s changes the sum of squares by 2(N(g-s) - N(g)) + 2 in a
    bin of gap g > s, by 1 - 2N(s) where it fills a bin, by 2N(capacity-s) + 1 in a new bin; ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    top = capacity  # no open bin has a larger gap
    for i, s in enumerate(map(int, lengths)):
        best, gap = 2 * count[capacity - s] + 1 if s < capacity else 0, capacity
        if s < capacity:
            change = 2 * (count[: top + 1 - s] - count[s : top + 1]) + 2
            if len(change):
                change[0] = 1 - 2 * count[s]
                change[count[s : top + 1] == 0] = np.iinfo(np.int64).max
                g = int(change.argmin())
                if change[g] <= best:
                    gap = g + s
        if gap == capacity:
            at = len(used)
            used.append(0)
        else:
            at = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = at, used[at]
        used[at] += s
        left = capacity - used[at]
        if left:
            open_bins[left].append(at)
            count[left] += 1
    return bins, offsets


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Longest first; full pieces take sequences of their own without a search."""
    pieces = pieces.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    lengths = pieces["length"].to_numpy()
    full = int((lengths == capacity).sum())
    bins, offsets = sum_of_squares(lengths[full:], capacity)
    pieces["sequence_id"] = np.concatenate([np.arange(full), bins + full])
    pieces["offset"] = np.concatenate([np.zeros(full, dtype=np.int64), offsets])
    return pieces


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    rows, at = located(pieces)
    groups = max(1, -(-rows.count() // group_rows))
    names = pieces.columns
    # The row's number spreads pieces that are equal in all else.
    dealt = only(rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", at[1]), F.lit(groups))), [*names, "g"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(pdf, capacity)
        out["sequence_id"] += out["g"] * 2**32
        return out[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("g").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, files: tuple[str, str, str] | None = None, group_rows: int = GROUP_ROWS, keep_ids: bool = False, keep_place: bool = False) -> DataFrame:
    """Pieces of all documents with their places; with ``keep_ids`` also the ids themselves."""
    return pack(staged(document_pieces(docs, capacity=capacity, files=files, keep_ids=keep_ids, keep_place=keep_place), "pieces"), capacity=capacity, group_rows=group_rows)


def op9_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
