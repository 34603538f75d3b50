import random

import pytest

from quarry.llm import minhash as N


def shingles(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """component of each row by all pairs; rows with a null id stand alone."""
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and find(i) != find(j):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted((i if i is not None else -1, len(shingles(t)), find(i) if i is not None else -1) for i, t in rows)


def got(df, **options):
    return sorted((-1 if r.id is None else r.id, r.n, -1 if r.component_id is None else r.component_id) for r in N.near_groups(df, **options)[1].collect())


def test_fixture(docs, none, rows):
    assert got(docs) == brute([r[:2] for r in rows])
    assert N.near_groups(none)[1].count() == 0 and N.near_dedup(none).count() == 0
    out = N.near_dedup(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    # One row of each set that is its group's representative, and every row without words.
    root = {i: c for i, _, c in brute([r[:2] for r in rows])}
    firsts = {(i, shingles(t)) for i, t, *_ in rows if i is not None and shingles(t) and root[i] == i}
    assert sorted(ids) == sorted([i for i, _ in firsts] + [r[0] for r in rows if r[0] is not None and not shingles(r[1])])


@pytest.mark.parametrize("short", [24, 2])
def test_chains(spark, short):
    """Near copies of near copies, around the threshold, in groups that are long for short=2."""
    rng = random.Random(5)
    rows = []
    for g in range(4):
        text = [f"g{g}x{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(25):
            own = list(text)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                text = own
            rows.append((rng.randrange(10**6), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, short=short) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Long lists dealt into several blocks: the links of all pairs, and rows whose size does not follow the documents'."""
    rng = random.Random(11)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for g in range(12):
        own = [f"g{g}x{rng.randrange(10**6)}" for _ in range(250 if g < 6 else 40)]
        for k in range(4):
            text = passage + own
            for _ in range(rng.randrange(6)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            rows.append((100 * k + g, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    travelled, block_rows = [], N._block_rows

    def spied(*args):
        out = block_rows(*args)
        travelled.extend(out.toPandas().drop(columns="file").itertuples(index=False))
        return out

    monkeypatch.setattr(N, "_block_rows", spied)
    monkeypatch.setattr(N, "BLOCK_CLASSES", 5)
    monkeypatch.setattr(N, "CACHE_BYTES", 4000)
    assert got(df, short=2) == brute(rows)
    assert len({(r.m, r.k) for r in travelled}) > 4
    assert max(r.n for r in travelled) > 300 and max(len(x) for r in travelled for x in r if isinstance(x, bytes | bytearray)) <= 8 * N.SKETCH
