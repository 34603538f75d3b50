"""Removal of repeated substrings with suffix arrays (operator 8).

Every byte covered by a WINDOW-byte string that also starts earlier (smaller doc_id, or earlier in the document) goes.

1. Equal windows have equal minimizers (the smallest hash of their GRAM-byte grams), so texts are cut into segments:
   runs of windows with one minimizer.  A window reaches SIDE bytes beyond its minimizer on one side at least, so segments
   can share a window only if they share the minimizer with SIDE bytes to its left, or to its right.  Units of rows
   exchange hashes of both as sorted, packed arrays by hash range, and go on with segments that have one that occurs again.
2. Such segments, as digests and places without bytes, are collapsed: of equal segments only the first can hold a first
   window, all others go whole.  The collapse combines before its shuffle, so a passage of a third of all documents is
   a few rows.
3. The bytes of different segments of one minimizer are fetched by place and make one string; suffix arrays of many such
   strings are built by induced sorting; adjacent suffixes whose common prefix, computed in text order, reaches WINDOW
   bytes form the classes of equal windows, and all but the earliest window of a class go.
   Segments of a minimizer with more than MOST different ones are cut into single windows, which the collapse of step
   2 settles with no further limit.
4. Spans are merged per document and applied where the texts are scanned; texts are never shuffled.

Defined results: a null text is empty; null doc_ids come last; rows that tie in doc_id (repeated rows too) are ordered by
a hash of their file and by row; texts of any length are taken whole, in chunks that overlap by a window; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import grouped, located, make_dir, mapped, new_path, release, scratch, small_batches, table, written
from quarry.llm.hashing import ODD, binaries, mix, slices
from quarry.llm.suffixes import permuted_lcp, suffix_arrays

WINDOW, GRAM, UNIT_ROWS, SHARD_BYTES, CHUNK, MOST = 100, 32, 2048, 1 << 20, 1 << 18, 4096
#: A window has WINDOW - GRAM bytes beside its minimizer, so half of them on one side.
SIDE = (WINDOW - GRAM) // 2
_SEGMENT = "m long, sig binary, id long, file long, row long, pos long, len long, times int"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


class Segments(NamedTuple):
    """Segments of some texts, and one row (segment, hash) for each side of each place of a segment's minimizer."""

    text: np.ndarray
    m: np.ndarray
    start: np.ndarray
    end: np.ndarray
    times: np.ndarray  # places of the minimizer in the segment: 1, or 2 for any more
    of: np.ndarray
    key: np.ndarray


def _chunk(pieces: list[tuple[int, int, bytes]]) -> Segments | None:
    """Segments of (text, offset in it, bytes)."""
    data = b"".join(p for _, _, p in pieces)
    n, reach = len(data), WINDOW - GRAM + 1
    if n < WINDOW:
        return None
    sizes = np.array([len(p) for _, _, p in pieces])
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    eights = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    # The hash only brings equal grams together; unequal ones that agree by chance are told apart by the suffix array.
    total = eights[: n - GRAM + 1] * ODD[0]
    for k in range(1, GRAM // 8):
        total += eights[8 * k : n - GRAM + 1 + 8 * k] * ODD[k]
    grams = mix(total) | np.uint64(1)
    label = piece[: n - WINDOW + 1]
    whole = label == piece[WINDOW - 1 :]
    low = np.where(whole, _sliding_min(grams, reach), np.uint64(0))
    change = (low[1:] != low[:-1]) | (label[1:] != label[:-1])
    run = np.concatenate([[0], np.cumsum(change)])
    start = np.concatenate([[0], np.flatnonzero(change) + 1])
    end = np.append(start[1:], len(low)) + WINDOW - 1
    m = low[start]
    # A gram is a minimizer where some window around it has it as its smallest; such windows lie side by side.
    around = np.concatenate([np.zeros(reach - 1, np.uint64), low, np.zeros(reach - 1, np.uint64)])
    at = np.flatnonzero(~_sliding_min(~around, reach) == grams)
    of = run[np.minimum(np.maximum(at - reach + 1, 0), len(low) - 1)]
    while len(wrong := np.flatnonzero(m[of] != grams[at])):
        of[wrong] += 1
    times = np.bincount(of, minlength=len(m))
    left, right = at - SIDE >= start[of], at + GRAM + SIDE <= end[of]
    p, q = at[left], at[right]
    left_key = mix(grams[p - SIDE] * ODD[1] + grams[p - SIDE + GRAM] * ODD[2] + grams[p])
    right_key = mix(grams[q + SIDE] * ODD[3] + grams[q + GRAM] * ODD[4] + grams[q])
    kept = np.flatnonzero(m)
    number = np.cumsum(m != 0) - 1
    owner = piece[start[kept]]
    shift = np.array([o for _, o, _ in pieces]) - (np.cumsum(sizes) - sizes)
    text = np.array([i for i, _, _ in pieces])[owner]
    return Segments(text, m[kept], start[kept] + shift[owner], end[kept] + shift[owner], np.minimum(times[kept], 2), number[np.concatenate([of[left], of[right]])], np.concatenate([left_key, right_key]))


def segments(texts: list[bytes | None]) -> list[Segments]:
    """Segments of all texts, a chunk of bytes at a time; longer texts go in parts that overlap by a window less a byte."""
    out, held, size = [], [], 0
    for i, t in enumerate(texts):
        t = t or b""
        for lo in range(0, max(len(t) - WINDOW + 1, 0), CHUNK):
            held.append((i, lo, t[lo : lo + CHUNK + WINDOW - 1]))
            size += len(held[-1][2])
            if size >= CHUNK:
                out.append(_chunk(held))
                held, size = [], 0
    if held:
        out.append(_chunk(held))
    return [x for x in out if x is not None]


def _pack(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, a byte plane at a time."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    p = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(p.T).view("<u8").ravel(), dtype=np.uint64)


def _short(key: np.ndarray) -> np.ndarray:
    """The top 52 bits: chance agreement only lets a few needless segments through."""
    return key >> np.uint64(12)


def _write(store, path: str, data: bytes) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, path)


def _read(store, path: str) -> bytes:
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return b""
    with store.open_input_file(path) as f:
        return f.read()


def file_number(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path.encode()) - 2**63


def _units(batch: pa.RecordBatch):
    """(file number, unit, first row, last row) of a batch with columns at, row: slices of UNIT_ROWS rows of one file."""
    files, rows = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    lo = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or files[i] != files[lo] or rows[i] // UNIT_ROWS != rows[lo] // UNIT_ROWS:
            yield file_number(files[lo]), int(rows[lo]) // UNIT_ROWS, lo, i
            lo = i


def repeated_keys(texts: DataFrame, root: str, buckets: int) -> None:
    """Write, for every unit of ``texts`` (at, row, id, text), the short keys in it that occur again anywhere."""

    def ask(batches):
        unit_now, held = None, []

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            b = (keys * np.uint64(buckets)) >> np.uint64(52) if buckets < 4096 else keys // np.uint64(-(-(2**52) // buckets))
            cut = np.searchsorted(b, np.arange(buckets + 1))
            used = np.flatnonzero(cut[1:] > cut[:-1])
            packed = pa.array([_pack(keys[cut[k] : cut[k + 1]]) for k in used], pa.binary())
            again = pa.array([np.packbits(n[cut[k] : cut[k + 1]] > 1).tobytes() for k in used], pa.binary())
            place = [pa.array(np.full(len(used), x, dtype=np.int64)) for x in unit_now]
            return pa.RecordBatch.from_arrays([pa.array(used), *place, packed, again], ["bucket", "file", "unit", "keys", "again"])

        for b in batches:
            for file, unit, lo, hi in _units(b):
                if unit_now != (file, unit):
                    if held:
                        yield flush()
                    unit_now, held = (file, unit), []
                for part in slices(b.slice(lo, hi - lo)):
                    held += [_short(x.key) for x in segments(binaries(part.column(3)))]
        if held:
            yield flush()

    def match(key, t):
        parts = [_unpack(x) for x in t["keys"].to_pylist()]
        again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(t["again"].to_pylist(), parts, strict=True)]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        often = np.bincount(at, weights=np.concatenate(again) + 1.0) > 1
        keep = often[at]
        ends = np.cumsum([len(p) for p in parts])
        data = [_pack(p[keep[e - len(p) : e]]) if keep[e - len(p) : e].any() else b"" for p, e in zip(parts, ends, strict=True)]
        out = pa.table({"file": t["file"], "unit": t["unit"], "keys": pa.array(data, pa.binary())})
        return out.filter(pa.array([bool(x) for x in data], pa.bool_()))

    def write(key, t):
        store, top = fs.FileSystem.from_uri(root)
        keys = np.concatenate([_unpack(x) for x in t["keys"].to_pylist()])
        _write(store, f"{top}/keys-{key[0].as_py()}-{key[1].as_py()}", _pack(np.sort(keys)))
        return pa.table({"unit": [key[1].as_py()]})

    asked = texts.mapInArrow(ask, "bucket long, file long, unit long, keys binary, again binary")
    replied = written(grouped(asked, ["bucket"], match, "file long, unit long, keys binary"), "sub-replied")
    del asked
    release(texts.sparkSession)
    replied.groupBy("file", "unit").applyInArrow(write, "unit long").count()


def repeated_segments(texts: DataFrame, root: str) -> DataFrame:
    """Segments that have a key which occurs again: digests and places, without bytes."""

    def run(batches):
        store, top = fs.FileSystem.from_uri(root)
        unit_now, known = None, None
        for b in batches:
            for file, unit, lo, hi in _units(b):
                if unit_now != (file, unit):
                    data = _read(store, f"{top}/keys-{file}-{unit}")
                    unit_now, known = (file, unit), _unpack(data) if data else np.empty(0, np.uint64)
                if not len(known):
                    continue
                for part in slices(b.slice(lo, hi - lo)):
                    whole = binaries(part.column(3))
                    for x in segments(whole):
                        key = _short(x.key)
                        hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                        keep = np.unique(x.of[hit])
                        if not len(keep):
                            continue
                        text, start, end = x.text[keep], x.start[keep], x.end[keep]
                        sig = [xxhash.xxh3_128_digest(whole[i][a:z]) for i, a, z in zip(text.tolist(), start.tolist(), end.tolist(), strict=True)]
                        own = pa.array(text)
                        cols = [pa.array(x.m[keep].view(np.int64)), pa.array(sig, pa.binary()), part.column(2).take(own), pa.array(np.full(len(keep), file)), part.column(1).take(own)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(start), pa.array(end - start), pa.array(x.times[keep].astype(np.int32))], ["m", "sig", "id", "file", "row", "pos", "len", "times"])

    return mapped(texts, run, _SEGMENT)


def shard_spans(seg: list[bytes], shards: np.ndarray, place: list[np.ndarray], pos: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, start, end) inside of segments: windows that start earlier in the same shard.

    ``shards`` has the number of segments of each shard, ``place`` what orders their documents (last key first), ``pos`` is
    the segment's place in its document.
    """
    size = np.array([len(x) for x in seg])
    text = np.frombuffer(b"\0".join(seg) + b"\0", np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    closing = np.cumsum(shards) - 1
    symbols = text.astype(np.int64) + 2
    symbols[begin + size] = 1
    symbols[(begin + size)[closing]] = 0
    sa = suffix_arrays(symbols, np.add.reduceat(size + 1, closing - shards + 1))
    shared = permuted_lcp(text, sa, WINDOW)[sa] >= WINDOW
    owner = np.repeat(np.arange(len(seg)), size + 1)
    offset = np.arange(len(text)) - begin[owner]
    # A class of equal windows is a run in suffix order; a suffix with fewer bytes left than a window, as the first of
    # each shard, belongs to none.
    ok = (offset + WINDOW <= size[owner])[sa]
    link = shared & ok & np.concatenate([[False], ok[:-1]])
    group = np.cumsum(~link)
    many = np.flatnonzero(np.concatenate([link[1:], [False]]) | link)
    if not len(many):
        return []
    at, group = sa[many], group[many]
    o = owner[at]
    order = np.lexsort((pos[o] + offset[at], *(p[o] for p in place), group))
    at, group = at[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    # The parts of a long text overlap, so one window may be met twice; it is not later than itself.
    o = owner[at]
    full = np.stack([*(p[o] for p in place), pos[o] + offset[at]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    later = (full != full[:, head]).any(axis=0)
    gone = np.sort(at[later])
    if not len(gone):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(gone) > WINDOW) | (np.diff(owner[gone]) != 0)]))
    ends = np.concatenate([cut[1:], [len(gone)]]) - 1
    return [(int(owner[gone[a]]), int(offset[gone[a]]), int(offset[gone[b]]) + WINDOW) for a, b in zip(cut, ends, strict=True)]


def _shard_links(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Spans (file, row, start, end) from segments (k, m, id, file, row, pos, bytes), all of a minimizer's in one task."""

    def solve(held):
        seg = [r[6] for shard in held for r in shard]
        missing, ids, files, row, pos = (np.array(x, dtype=np.int64) for x in zip(*((r[2] is None, r[2] or 0, *r[3:6]) for shard in held for r in shard), strict=True))
        spans = shard_spans(seg, np.array([len(x) for x in held]), [row, files, ids, missing], pos)
        k = np.array([x[0] for x in spans], dtype=np.int64)
        start, end = (pos[k] + np.array([x[i] for x in spans], dtype=np.int64) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (files[k], row[k], start, end)], ["file", "row", "start", "end"])

    def run(batches):
        held, group, total = [], [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and r[1] != group[0][1]:
                    held.append(group)
                    group = []
                    if total >= shard_bytes:
                        yield solve(held)
                        held, total = [], 0
                group.append(r)
                total += len(r[6])
        if group:
            yield solve([*held, group])

    # Shards of like size come together, so that they can be sorted side by side.
    ordered = rows.select("k", "m", "id", "file", "row", "pos", "bytes").repartition("m").sortWithinPartitions("k", "m")
    return ordered.mapInArrow(run, "file long, row long, start long, end long")


def _fetched(texts: DataFrame, wanted: DataFrame, *, windows: bool) -> DataFrame:
    """(k, m, id, file, row, pos, bytes) of the wanted places (k, m, file, row, pos, len), or their single windows as segments."""
    root = new_path(texts.sparkSession, "substrings-wanted")
    make_dir(texts.sparkSession, root)

    def write(key, t):
        store, top = fs.FileSystem.from_uri(root)
        a = np.stack([t[c].to_numpy() for c in ("row", "pos", "len", "m", "k")])
        _write(store, f"{top}/{key[0].as_py()}-{key[1].as_py()}", a[:, np.lexsort((a[1], a[0]))].tobytes())
        return pa.table({"unit": [key[1].as_py()]})

    wanted.withColumn("unit", F.floor(F.col("row") / UNIT_ROWS)).groupBy("file", "unit").applyInArrow(write, "unit long").count()

    def run(batches):
        store, top = fs.FileSystem.from_uri(root)
        unit_now, known = None, None
        for b in batches:
            for file, unit, lo, hi in _units(b):
                if unit_now != (file, unit):
                    unit_now, known = (file, unit), np.frombuffer(_read(store, f"{top}/{file}-{unit}"), np.int64).reshape(5, -1)
                rows = b.column(1).slice(lo, hi - lo).to_numpy()
                own = known[:, (known[0] >= rows[0]) & (known[0] <= rows[-1])]
                for at in range(0, own.shape[1], 4096):
                    row, pos, size, m, k = own[:, at : at + 4096]
                    i = pa.array(np.searchsorted(rows, row) + lo)
                    used = {j: t.as_buffer().to_pybytes() for j in pc.unique(i).to_pylist() for t in [b.column(3)[j].cast(pa.binary())]}
                    if windows:
                        ends = [range(a, a + n - WINDOW + 1) for a, n in zip(pos.tolist(), size.tolist(), strict=True)]
                        n = [len(x) for x in ends]
                        sig = [xxhash.xxh3_128_digest(used[j][a : a + WINDOW]) for j, x in zip(i.to_pylist(), ends, strict=True) for a in x]
                        i, row, m = pa.array(np.repeat(i.to_numpy(), n)), np.repeat(row, n), np.repeat(m, n)
                        cols = [pa.array(m), pa.array(sig, pa.binary()), b.column(2).take(i), pa.array(np.full(len(row), file)), pa.array(row), pa.array(np.concatenate([np.array(x) for x in ends])), pa.array(np.full(len(row), WINDOW)), pa.array(np.ones(len(row), dtype=np.int32))]
                        yield pa.RecordBatch.from_arrays(cols, ["m", "sig", "id", "file", "row", "pos", "len", "times"])
                    else:
                        data = pa.array([used[j][a : a + n] for j, a, n in zip(i.to_pylist(), pos.tolist(), size.tolist(), strict=True)], pa.binary())
                        cols = [pa.array(k), pa.array(m), b.column(2).take(i), pa.array(np.full(len(row), file)), pa.array(row), pa.array(pos), data]
                        yield pa.RecordBatch.from_arrays(cols, ["k", "m", "id", "file", "row", "pos", "bytes"])

    return mapped(texts, run, _SEGMENT if windows else "k long, m long, id long, file long, row long, pos long, bytes binary")


def _collapsed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first of equal segments, spans of the others)."""
    order = F.struct(F.col("id").isNull().alias("n"), "id", "file", "row", "pos")
    firsts = found.groupBy("m", "sig").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len"), F.max("times").alias("times"))
    firsts = written(firsts, "sub-distinct", compression="zstd")
    copies = found.select("m", "sig", "file", "row", "pos", "len").join(firsts.filter("n > 1").select("m", "sig", "first"), ["m", "sig"])
    later = copies.filter("file != first.file or row != first.row or pos != first.pos")
    return firsts, later.select("file", "row", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end"))


def repeated_spans(texts: DataFrame, *, most: int = MOST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(file, row, start, end): spans to remove, not merged."""
    spark = texts.sparkSession
    root = new_path(spark, "substrings")
    make_dir(spark, root)
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    repeated_keys(texts, root, parts)
    found = written(repeated_segments(texts, root), "sub-segments", compression="zstd")
    firsts, spans = _collapsed(found)
    spans = written(spans, "sub-copies")
    release(spark)
    per_m = firsts.groupBy("m").agg(F.count(F.lit(1)).alias("k"), F.max("times").alias("t")).filter("k > 1 or t > 1").select("m", "k")
    wanted = written(firsts.select("m", "first.file", "first.row", "first.pos", "len").join(per_m, "m"), "sub-wanted")
    spans = spans.unionByName(_shard_links(_fetched(texts, wanted.filter(F.col("k") <= most), windows=False), shard_bytes))
    hot = wanted.filter(F.col("k") > most)
    if not hot.isEmpty():
        spans = spans.unionByName(_collapsed(written(_fetched(texts, hot, windows=True), "sub-windows", compression="zstd"))[1])
    return spans


def remove_repeats(docs: DataFrame, *, keep_text: bool = False, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also spans and kept bytes."""
    rows, at = located(docs)
    texts = rows.select(F.col(at[0]).alias("at"), F.col(at[1]).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    spark = docs.sparkSession
    root = new_path(spark, "spans")
    make_dir(spark, root)

    def write(key, t):
        """The merged spans of the rows of one unit, as one file: row, start, end."""
        store, top = fs.FileSystem.from_uri(root)
        r, a, z = (t[c].to_numpy() for c in ("row", "start", "end"))
        order = np.lexsort((a, r))
        r, a, z = r[order], a[order], z[order]
        # Ends may nest, so each span's reach is the farthest end so far in its row.
        base = (r - r[0]) * (1 << 34)
        reach = np.maximum.accumulate(base + z)
        cut = np.flatnonzero(np.concatenate([[True], (base[1:] + a[1:]) > reach[:-1]]))
        ends = np.concatenate([cut[1:], [len(a)]]) - 1
        _write(store, f"{top}/{key[0].as_py()}-{key[1].as_py()}", np.stack([r[cut], a[cut], reach[ends] - base[cut]]).astype(np.int64).tobytes())
        return pa.table({"n": [len(cut)]})

    with scratch(spark), small_batches(spark, 2000):
        spans = repeated_spans(texts, **options).distinct().withColumn("unit", F.floor(F.col("row") / UNIT_ROWS))
        spans.groupBy("file", "unit").applyInArrow(write, "n long").count()

    def run(batches):
        store, top = fs.FileSystem.from_uri(root)
        now, known = None, None
        for b in batches:
            for file, unit, lo, hi in _units(b):
                if now != (file, unit):
                    now, known = (file, unit), np.frombuffer(_read(store, f"{top}/{file}-{unit}"), np.int64).reshape(3, -1)
                for part in slices(b.slice(lo, hi - lo)):
                    out = []
                    for row, text in zip(part.column(1).to_pylist(), binaries(part.column(3)), strict=True):
                        text = text or b""
                        own = known[1:, np.searchsorted(known[0], row, "left") : np.searchsorted(known[0], row, "right")].T.tolist()
                        pieces, last = [], 0
                        for a, z in own:
                            pieces.append(text[last:a])
                            last = z
                        whole = b"".join([*pieces, text[last:]])
                        out.append((len(text), len(text) - len(whole), len(own), hashlib.sha256(whole).hexdigest(), own, whole))
                    cols = [part.column(2), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.string())]
                    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                    if keep_text:
                        cols += [pa.array([o[4] for o in out], pa.list_(pa.list_(pa.int64()))), pa.array([o[5] for o in out], pa.binary())]
                        names += ["spans", "kept"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * keep_text)


def op8_substrings(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select row_number() over (order by doc_id nulls last) as r, doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
w as (select r, p, md5(substr(h, 2 * p + 1, 200)) as x from (select r, h, unnest(range(0, length(h) // 2 - 99)) as p from d)),
g as (select r, p from (select r, p, row_number() over (partition by x order by r, p) as k from w) where k > 1),
f as (select r, p, case when p <= lag(p) over (partition by r order by p) + 100 then 0 else 1 end as new_ from g),
s as (select r, min(p) as a, max(p) + 100 as z from (select r, p, sum(new_) over (partition by r order by p rows unbounded preceding) as i from f) group by r, i),
k as (
  select r, a as at_, z, coalesce(lag(z) over (partition by r order by a), 0) as from_, a as to_ from s
  union all select r, null, null, coalesce(max(z), 0), null from d left join s using (r) group by r),
t as (select r, sum(coalesce(z - at_, 0)) as gone, count(at_) as n, string_agg(substr(h, 2 * from_ + 1, 2 * (coalesce(to_, length(h) // 2) - from_)), '' order by from_) as kept from k join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint as n_bytes, gone::bigint as n_removed, n::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from d join t using (r)
"""
