"""Language-model scores by a Katz backoff model (operator 10).

P(w | h) = d(c) c(hw) / c(h) for n-grams seen in training, else alpha(h) P(w | h without its first word): the recursion runs
from the highest order (a parameter) down to single words, token by token.  d are Good-Turing discounts (k = 5, from
the counts of counts of each order; counts above k keep all but TAIL of one count, so every context leaves mass),
and alpha(h) = what the discounted n-grams after h leave over, divided by the P(w | shorter h) of the words not seen after
h, so each context's distribution sums to one.  Single words are discounted as well, for the unknown word.

Texts become units of about a million tokens: a sorted vocabulary of 64-bit word hashes and token numbers into it.
Counts are tables by order and hash bucket.  For each order, units send the distinct n-grams of each bucket with their
training counts; the bucket adds them up and replies with the totals, with which unit is the first of those that have
the n-gram in training, and whether a held-out text has it.  What the order below tells is not asked: an n-gram with an
unseen part is unseen, and one with a part that occurs once, and in no held-out text, occurs once.
For the backoff weights, the first unit of each n-gram adds its discounted mass and its probability at the order below to
its context, units send these sums by context (only of contexts that held-out texts have: training texts never back
off), and get back the weights of the contexts they need.

So a frequent n-gram or context travels once per unit, no task holds more than one unit or bucket, and the units themselves
are never shuffled: replies go to one file per unit in the shared folder.

Defined results: a null or empty text is the end token alone; a null doc_id counts as an empty string for the
fold; an empty table gives an empty result; without training tokens every token has probability 1;
rows that repeat a doc_id, or a text, are scored each; a text of any length is scored whole, within one unit;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, grouped, make_dir, mapped, new_path, release, small_batches, table, written
from quarry.llm.hashing import ODD, binaries, mix, slices, word_hashes

ORDER, UNIT_TOKENS, BUCKET_TOKENS, K, TAIL = 3, 1_000_000, 2_000_000, 5, 0.01
FOLDS, HELD_OUT = 5, 1
#: Neither is the hash of a word in any likely text; the end is a token, the start only a context.
END, START = np.uint64(0xE4D0_0000_0000_0001), np.uint64(0x57A7_0000_0000_0001)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each as byte planes, which compress well where numbers are small or alike."""
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unzip(data: bytes, *kinds) -> list[np.ndarray]:
    """``kinds``: (dtype, length) of each array; a length of -1 takes the rest."""
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        n = (len(raw) - at) // size if n < 0 else n
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _rising(x: np.ndarray) -> np.ndarray:
    """Differences of a rising array."""
    return np.diff(x, prepend=x.dtype.type(0))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash space, so a sorted array falls into runs."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS


def units_of(docs: DataFrame, unit_tokens: int) -> DataFrame:
    """(unit, n, ids, lens, vocab, tokens): lens counts each text's tokens and its start, tokens are numbers into vocab."""

    def pack(number, ids, lens, words):
        vocab, tokens = np.unique(np.concatenate(words), return_inverse=True)
        unit = TaskContext.get().partitionId() * 2**24 + number
        data = (np.concatenate(lens).astype(np.int32).tobytes(), _zip(_rising(vocab)), _zip(tokens.astype(np.int32)))
        cols = [pa.array([unit]), pa.array([len(tokens)]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in data)]
        return pa.RecordBatch.from_arrays(cols, ["unit", "n", "ids", "lens", "vocab", "tokens"])

    def run(batches):
        number, size, ids, lens, words = 0, 0, [], [], []
        for part in (p for b in batches for p in slices(b, 128)):
            h, counts = word_hashes(binaries(part.column(1)))
            whole = np.empty(len(h) + 2 * len(counts), dtype=np.uint64)
            last = np.cumsum(counts + 2) - 1
            own = np.ones(len(whole), dtype=bool)
            for at, x in ((last, END), (last - counts - 1, START)):
                whole[at], own[at] = x, False
            whole[own] = h
            ids += part.column(0).to_pylist()
            lens.append(counts + 2)
            words.append(whole)
            size += len(whole)
            if size >= unit_tokens:
                yield pack(number, ids, lens, words)
                number, size, ids, lens, words = number + 1, 0, [], [], []
        if ids:
            yield pack(number, ids, lens, words)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), run, "unit long, n long, ids array<long>, lens binary, vocab binary, tokens binary")


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and the number of each entry's value."""
    order = np.argsort(h)
    rising = h[order]
    new = np.concatenate([np.ones(min(len(h), 1), dtype=bool), rising[1:] != rising[:-1]])
    number = np.empty(len(h), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return rising[new], order[new], number


class Level:
    """The n-grams of one order in a unit: per token the n-gram that ends there (``at``, -1: none), and per n-gram, in
    the order of hashes, its hash, a token where it ends, its training count in the unit, whether a held-out text has it
    (``held``), and what the buckets tell: ``count`` in all training texts, ``first`` (this unit speaks for it), ``held``."""

    def __init__(self, hashes, at, ends, trained, held):
        self.hashes, self.at, self.ends, self.trained, self.held = hashes, at, ends, trained, held
        self.asked = self.pre = self.suf = self.count = self.first = None


class Unit:
    def __init__(self, ids: list, lens: bytes, vocab: bytes, tokens: bytes):
        self.ids, self.lens = ids, np.frombuffer(lens, np.int32)
        vocab, self.tokens = np.cumsum(_unzip(vocab, (np.uint64, -1))[0], dtype=np.uint64), _unzip(tokens, (np.int32, -1))[0]
        self.owner = np.repeat(np.arange(len(ids), dtype=np.int32), self.lens)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.held = np.array([fold(i) == HELD_OUT for i in ids], dtype=bool)
        self.trains = ~self.held[self.owner]
        self.levels = [self._level(vocab, np.arange(len(self.tokens)), self.tokens, None)]
        self.levels[0].asked = np.ones(len(vocab), dtype=bool)

    @classmethod
    def each(cls, batches):
        """(unit, its contents) of batches of the units' table."""
        for b in batches:
            for i in range(b.num_rows):
                yield b["unit"][i].as_py(), cls(*(b[c][i].as_py() for c in ("ids", "lens", "vocab", "tokens")))

    def _level(self, hashes, where, inverse, ends) -> Level:
        n, trains = len(hashes), self.trains[where]
        at = np.full(len(self.tokens), -1, dtype=np.int32)
        at[where] = inverse
        return Level(hashes, at, ends, np.bincount(inverse[trains], minlength=n), np.bincount(inverse[~trains], minlength=n) > 0)

    def grow(self) -> Level:
        """The next order; the one below must be settled."""
        below, words = self.levels[-1], self.levels[0]
        where = np.flatnonzero(self.place >= len(self.levels))
        h = mix(below.hashes[below.at[where - 1]] * ODD[0] + words.hashes[self.tokens[where]])
        hashes, ends, inverse = _distinct(h)
        x = self._level(hashes, where, inverse, where[ends])
        x.pre, x.suf = below.at[x.ends - 1], below.at[x.ends]
        parts = [(below.count[p], below.held[p]) for p in (x.pre, x.suf)]
        known = np.zeros(len(hashes), dtype=bool)
        for count, held in parts:
            known |= (count == 0) | ((count == 1) & ~held)
        x.asked = ~known
        self.levels.append(x)
        return x

    def settle(self, told: tuple[np.ndarray, np.ndarray]) -> None:
        """Counts and flags of the highest order: as told for those asked, else known from the order below."""
        x, (count, flags) = self.levels[-1], told
        x.count, x.first = np.minimum(x.trained, 1), x.trained > 0
        x.count[x.asked], x.first[x.asked] = count, flags & 1 > 0
        x.held &= x.asked
        x.held[x.asked] = flags & 2 > 0

    def settled(self, store, top: str, unit: int, orders: int) -> Unit:
        for k in range(1, orders + 1):
            if k > 1:
                self.grow()
            self.settle(_load(store, f"{top}/c{k}-{unit}", np.int64, np.uint8))
        return self


def discounts(n: dict[int, int], k: int = K) -> np.ndarray:
    """d[r] for counts r = 0..k (d[0] unused); 1 - d is at least a little, so that every context leaves mass.

    Katz's form; where the counts of counts give no value between 0 and 1 (few data, or many copies), absolute
    discounting by n1 / (n1 + 2 n2) takes its place.
    """
    d = np.ones(k + 1)
    n1, n2 = n.get(1, 0), n.get(2, 0)
    flat = min(0.75, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    cut = (k + 1) * n.get(k + 1, 0) / n1 if n1 else 1.0
    for r in range(1, k + 1):
        x = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - cut) / (1 - cut) if n.get(r) and cut < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - flat / r
    return d


class Words:
    """Unigram probabilities from a word's training count; 0 is the unknown word, which takes what discounting leaves."""

    def __init__(self, total: int, types: int, n: dict[int, int]):
        self.total, self.types, self.d = total, types, discounts(n)
        left = sum(r * n.get(r, 0) * (1 - self.d[r]) for r in range(1, K + 1))
        self.unknown = left / total if total and left > 0 else 0.5 / (total + 0.5) if total else 1.0
        self.scale = 1.0 if left > 0 or not total else 1 - self.unknown

    def kept(self, c: np.ndarray) -> np.ndarray:
        """What discounting leaves of a count."""
        return self.scale * self.d[np.minimum(c, K) * (c <= K)] ** (c <= K) * c

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.kept(c) / self.total, self.unknown) if self.total else np.ones(len(c))


class Counts:
    """Discounts of one order above the first."""

    def __init__(self, n: dict[int, int]):
        self.d = discounts(n)

    def kept(self, c: np.ndarray) -> np.ndarray:
        """What discounting leaves of a count."""
        return np.where(c <= K, self.d[np.minimum(c, K)] * c, c - TAIL)


def _cuts(b: np.ndarray, buckets: int):
    """(bucket, start, end) of the runs of a sorted array of buckets."""
    cut = np.searchsorted(b, np.arange(buckets + 1))
    return [(int(k), int(cut[k]), int(cut[k + 1])) for k in np.flatnonzero(cut[1:] > cut[:-1])]


def _save(replies: DataFrame, root: str, name: str) -> None:
    """One file per unit: its replies (unit, order, bucket, data) by order and bucket."""

    def write(key, t):
        store, top = fs.FileSystem.from_uri(root)
        rows = sorted(zip(t["order"].to_pylist(), t["bucket"].to_pylist(), t["data"].to_pylist(), strict=True))
        part = f"{top}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(part, compression=None) as f:
            for *_, d in rows:
                f.write(len(d).to_bytes(8, "little") + d)
        store.move(part, f"{top}/{name}-{key[0].as_py()}")
        return pa.table({"unit": [key[0].as_py()]})

    replies.select("unit", "order", "bucket", "data").groupBy("unit").applyInArrow(write, "unit long").count()
    release(replies.sparkSession)


def _load(store, path: str, *kinds) -> tuple[np.ndarray, ...]:
    """Arrays of a unit's replies; a unit that asked nothing has no file, any other missing one shows as a wrong length."""
    data = b""
    if store.get_file_info(path).type != fs.FileType.NotFound:
        with store.open_input_file(path) as f:
            data = f.read()
    at, out = 0, [[np.empty(0, k)] for k in kinds]
    while at < len(data):
        n, rows = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little")
        for held, x in zip(out, _unzip(data[at + 16 : at + 8 + n], *((k, rows) for k in kinds)), strict=True):
            held.append(x)
        at += 8 + n
    return tuple(map(np.concatenate, out))


def _pack(*arrays: np.ndarray) -> bytes:
    return len(arrays[0]).to_bytes(8, "little") + _zip(*arrays)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return _unzip(data[8:], *((k, n) for k in kinds))


def katz_scores(docs: DataFrame, *, order: int = ORDER, unit_tokens: int = UNIT_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    with small_batches(spark, 2000):
        units = written(units_of(docs, unit_tokens), "katz-units", compression="none")
    tokens = units.agg(F.sum("n")).first()[0]
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not tokens:
        return spark.createDataFrame([], out_schema)
    root = new_path(spark, "katz-replies")
    make_dir(spark, root)
    buckets = max(12, -(-tokens // bucket_tokens))
    message = "order int, bucket long, unit long, kind int, data binary"

    def rows(order, unit, kind, parts):
        """Messages of one order: (bucket, data)."""
        n = len(parts)
        cols = [pa.array([order] * n, pa.int32()), pa.array([b for b, _ in parts], pa.int64()), pa.array([unit] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([d for _, d in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["order", "bucket", "unit", "kind", "data"])

    def dealt(hashes, *arrays):
        return [(k, _pack(_rising(hashes[a:z]), *(x[a:z] for x in arrays))) for k, a, z in _cuts(_bucket(hashes, buckets).astype(np.int64), buckets)]

    def ask(k):
        def run(batches):
            store, top = fs.FileSystem.from_uri(root)
            for unit, u in Unit.each(batches):
                x = u.settled(store, top, unit, k - 1).grow() if k > 1 else u.levels[0]
                yield rows(k, unit, 0, dealt(x.hashes[x.asked], x.trained[x.asked], x.held[x.asked].astype(np.uint8)))
                # N-grams that are known to occur once, here, are only counted.
                yield rows(k, unit, 1, [(0, int(np.count_nonzero(x.trained[~x.asked])).to_bytes(8, "little"))])

        return run

    def add(key, t):
        lone = sum(int.from_bytes(x, "little") for x, kind in zip(t["data"].to_pylist(), t["kind"].to_pylist(), strict=True) if kind)
        t = t.filter(pc.equal(t["kind"], 0)).sort_by("unit")
        parts = [_unpack(x, np.uint64, np.int64, np.uint8) for x in t["data"].to_pylist()]
        hashes, counts, held = (np.concatenate([np.empty(0, d), *x]) for d, x in zip((np.uint64, np.int64, np.uint8), ([np.cumsum(p[0], dtype=np.uint64) for p in parts], *([p[i] for p in parts] for i in (1, 2))), strict=True))
        uniq, at = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(uniq), dtype=np.int64)
        np.add.at(total, at, counts)
        anywhere = np.bincount(at[held > 0], minlength=len(uniq)) > 0
        having = np.flatnonzero(counts > 0)
        first = np.zeros(len(at), dtype=bool)
        first[having[np.unique(at[having], return_index=True)[1]]] = True
        flags = first.astype(np.uint8) | anywhere[at].astype(np.uint8) << 1
        ends = np.cumsum([len(p[0]) for p in parts])
        data = [_pack(total[at[z - len(p[0]) : z]], flags[z - len(p[0]) : z]) for p, z in zip(parts, ends, strict=True)]
        seen = total[(total > 0) & (uniq != START)]
        small = np.bincount(seen[seen <= K + 1], minlength=K + 2)[1 : K + 2].tolist()
        small[0] += lone
        n = len(data) + 1
        return pa.table({
            "unit": pa.array([*t["unit"].to_pylist(), None], pa.int64()), "order": pa.array([key[0].as_py()] * n, pa.int32()), "bucket": pa.array([key[1].as_py()] * n, pa.int64()),
            "data": pa.array([*data, b""], pa.binary()), "stats": pa.array([*[None] * len(data), [int(seen.sum()), len(seen) + lone, *small]], pa.list_(pa.int64())),
        })

    stats = []
    for k in range(1, order + 1):
        asked = units.mapInArrow(ask(k), message)
        added = written(grouped(asked, ["order", "bucket"], add, "unit long, order int, bucket long, data binary, stats array<long>"), "katz-counts", compression="none")
        del asked
        release(spark)
        stats.append([x or 0 for x in added.filter("unit is null").agg(*[F.sum(F.col("stats")[i]) for i in range(K + 3)]).first()])
        _save(added.filter("unit is not null"), root, f"c{k}")
        discard(added)
    counts_of = [{r: s[1 + r] for r in range(1, K + 2)} for s in stats]
    words, tables = Words(stats[0][0], stats[0][1], counts_of[0]), list(map(Counts, counts_of[1:]))
    tables.insert(0, words)

    def sums(batches):
        """Per context and order, what its n-grams that this unit speaks for add up to; and the contexts whose weight is needed."""
        store, top = fs.FileSystem.from_uri(root)
        for unit, u in Unit.each(batches):
            levels = u.settled(store, top, unit, order).levels
            for k in range(1, order):
                x, below = levels[k], levels[k - 1]
                g = np.flatnonzero(x.first & (x.count > 0) & below.held[x.pre])
                c, ctx, suf = x.count[g], x.pre[g], x.suf[g]
                # Of one context all are divided by the same counts, so the sums stay undivided: few different numbers, which pack well.
                left, mass = c - tables[k].kept(c), tables[k - 1].kept(below.count[suf])
                own = np.unique(ctx)
                n = len(below.hashes)
                yield rows(k, unit, 0, dealt(below.hashes[own], *(np.bincount(ctx, weights=v, minlength=n)[own] for v in (left, mass))))
                yield rows(k, unit, 1, dealt(below.hashes[_needed(u, k)]))

    def weigh(key, t):
        """Both sums of the contexts whose weight a unit needs."""
        kind = t["kind"].to_numpy()
        data = t["data"].to_pylist()
        parts = [_unpack(x, np.uint64, np.float64, np.float64) for x, i in zip(data, kind, strict=True) if not i]
        uniq, at = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.cumsum(p[0], dtype=np.uint64) for p in parts)]), return_inverse=True)
        both = [np.bincount(at, weights=np.concatenate([np.empty(0), *(p[i] for p in parts)]), minlength=len(uniq)) for i in (1, 2)]
        units, out = [], []
        for x, i, unit in zip(data, kind, t["unit"].to_pylist(), strict=True):
            if i:
                place = np.searchsorted(uniq, np.cumsum(_unpack(x, np.uint64)[0], dtype=np.uint64))
                units.append(unit)
                out.append(_pack(*(v[place] for v in both)))
        n = len(units)
        return pa.table({"unit": pa.array(units, pa.int64()), "order": pa.array([key[0].as_py()] * n, pa.int32()), "bucket": pa.array([key[1].as_py()] * n, pa.int64()), "data": pa.array(out, pa.binary())})

    if order > 1:
        summed = grouped(units.mapInArrow(sums, message), ["order", "bucket"], weigh, "unit long, order int, bucket long, data binary")
        summed = written(summed, "katz-sums", compression="none")
        release(spark)
        _save(summed, root, "w")
        discard(summed)

    def score(batches):
        store, top = fs.FileSystem.from_uri(root)
        for unit, u in Unit.each(batches):
            levels = u.settled(store, top, unit, order).levels
            (left, mass), used = _load(store, f"{top}/w-{unit}", np.float64, np.float64), 0
            c1 = levels[0].count
            p = words.p(c1)[u.tokens]
            for k in range(1, order):
                x, below = levels[k], levels[k - 1]
                needed, alpha = _needed(u, k), np.ones(len(below.hashes))
                own = slice(used, used + len(needed))
                used += len(needed)
                # What the context's own count and that of the context without its first word leave over.
                shorter = levels[k - 2].count[below.suf[needed]] if k > 1 else words.total
                alpha[needed] = left[own] / below.count[needed] / np.maximum(1 - mass[own] / shorter, 1e-12)
                t = np.flatnonzero(u.place >= k)
                c, ctx = x.count[x.at[t]], below.at[t - 1]
                p[t] = np.where(c > 0, tables[k].kept(c) / np.maximum(below.count[ctx], 1), alpha[ctx] * p[t])
            real = u.place > 0
            owner, docs, tokens = u.owner[real], len(u.ids), u.tokens[real]
            by_doc = lambda v: np.bincount(owner, weights=v, minlength=docs)  # noqa: B023, E731
            base = np.log10((c1 + 0.5) / (words.total + 0.5 * (words.types + 1)))
            cols = [pa.array(u.ids, pa.int64()), pa.array(u.held), pa.array(u.lens.astype(np.int64) - 1), pa.array(by_doc(c1[tokens] > 0).astype(np.int64)), pa.array(np.full(docs, words.total, dtype=np.int64)), pa.array(by_doc(base[tokens])), pa.array(by_doc(np.log10(p[real])))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return units.mapInArrow(score, out_schema)


def _needed(u: Unit, k: int) -> np.ndarray:
    """Contexts, seen in training, behind which the unit's held-out texts have an n-gram of order k + 1 that isn't."""
    x, below = u.levels[k], u.levels[k - 1]
    t = np.flatnonzero((u.place >= k) & ~u.trains)
    ctx = np.unique(below.at[t - 1][x.count[x.at[t]] == 0])
    return ctx[below.count[ctx] > 0]


def op10_katz(spark, sf_dir):
    out = katz_scores(table(spark, sf_dir, "documents"))
    # Sums of logarithms differ in their last bits with the order of addition; reruns and SQL agree to six places.
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         [' start'] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' end'] as w,
         xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
           lambda a, b: list_reduce([xor(a, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 5 = 1 as held_out
  from documents),
t as (select r, held_out, unnest(w) as w, generate_subscripts(w, 1) - 1 as i from d),
g as (select *, lag(w) over (partition by r order by i) as v, lag(w, 2) over (partition by r order by i) as u from t),
c1 as (select w, count(*) as c from g where not held_out group by w),
c2 as (select v, w, count(*) as c from g where not held_out and i >= 1 group by v, w),
c3 as (select u, v, w, count(*) as c from g where not held_out and i >= 2 group by u, v, w),
z as (select sum(c) as n, count(*) as types from c1 where w != ' start'),
nn as (
  select o, r, count(c) as n from (select unnest([1, 2, 3]) as o) cross join (select unnest([1, 2, 3, 4, 5, 6]) as r)
  left join (select 1 as o, c from c1 where w != ' start' union all select 2, c from c2 union all select 3, c from c3) x using (o) where c = r or c is null group by o, r),
na as (select o, coalesce(max(n) filter (where r = 1), 0) as n1, coalesce(max(n) filter (where r = 2), 0) as n2, coalesce(max(n) filter (where r = 6), 0) as n6 from nn group by o),
nf as (select o, case when n1 > 0 then least(0.75, greatest(0.1, n1 / (n1 + 2 * n2)))::double else 0.5 end as flat, case when n1 > 0 then 6 * n6 / n1 else 1.0 end as cut from na),
dr as (
  select f.o, k.r, f.flat, case when n.n > 0 and f.cut < 1 then ((k.r + 1) * coalesce(m.n, 0) / (k.r * n.n) - f.cut) / (1 - f.cut) else 0 end as x, coalesce(n.n, 0) as n
  from nf f cross join (select unnest([1, 2, 3, 4, 5]) as r) k left join nn n on n.o = f.o and n.r = k.r left join nn m on m.o = f.o and m.r = k.r + 1),
dd as (select o, r, n, case when x > 0 and x < 1 then x else 1 - flat / r end as d from dr),
lo as (select sum(r * n * (1 - d)) as mass from dd where o = 1),
un as (select case when mass > 0 then mass / n else 0.5 / (n + 0.5) end as unknown, case when mass > 0 then 1.0 else 1 - 0.5 / (n + 0.5) end as scale from lo, z),
p1 as (select c1.w, c1.c, scale * coalesce(d, 1) * c1.c / z.n as p from c1 cross join z cross join un left join dd on o = 1 and dd.r = c1.c where c1.w != ' start'),
k2 as (select c2.v, c2.w, c2.c, c1.c as h, coalesce(d, 1 - 0.01 / c2.c) as d from c2 join c1 on c1.w = c2.v left join dd on o = 2 and dd.r = c2.c),
k3 as (select c3.u, c3.v, c3.w, c3.c, c2.c as h, coalesce(d, 1 - 0.01 / c3.c) as d from c3 join c2 on c2.v = c3.u and c2.w = c3.v left join dd on o = 3 and dd.r = c3.c),
a2 as (select v, sum((1 - d) * k2.c / h) / greatest(1 - sum(p), 1e-12) as alpha from k2 join p1 using (w) group by v),
a3 as (select k3.u, k3.v, sum((1 - k3.d) * k3.c / k3.h) / greatest(1 - sum(k2.d * k2.c / k2.h), 1e-12) as alpha from k3 join k2 using (v, w) group by k3.u, k3.v),
s as (
  select g.r, p1.c is not null as known, (coalesce(p1.c, 0) + 0.5) / (n + 0.5 * (types + 1)) as b,
         coalesce(k3.d * k3.c / k3.h, coalesce(a3.alpha, 1) * coalesce(k2.d * k2.c / k2.h, coalesce(a2.alpha, 1) * coalesce(p1.p, unknown))) as p
  from g cross join z cross join un left join p1 on p1.w = g.w left join k2 on k2.v = g.v and k2.w = g.w left join k3 on k3.u = g.u and k3.v = g.v and k3.w = g.w
  left join a2 on a2.v = g.v left join a3 on a3.u = g.u and a3.v = g.v where g.i > 0)
select any_value(doc_id) as doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(*) filter (where known) as n_known, any_value(n)::bigint as train_tokens,
       round(sum(log10(b)), 6) as base_score, round(sum(log10(p)), 6) as score
from s join d using (r) cross join z group by r
"""
