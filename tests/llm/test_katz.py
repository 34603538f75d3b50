import collections
import glob
import math
import zlib

import duckdb
import pytest

from quarry.llm import katz as K


def discount_table(counts):
    """Katz's discounts for counts up to 5, absolute ones where they fall outside of (0, 1)."""
    n = collections.Counter(counts)
    flat = min(0.75, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    common = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        out[r] = x if 0 < x < 1 else 1 - flat / r
    return out


def direct(rows, order):
    """Scores by plain recursion over dictionaries; also the model, as a function of context and word."""
    toks = [(i, (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + ["end"]) for i, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in toks]
    seen = [collections.Counter() for _ in range(order + 1)]
    for (_, w), t in zip(toks, train, strict=True):
        if t:
            w = ["start", *w]
            for k in range(1, order + 1):
                seen[k].update(tuple(w[i - k + 1 : i + 1]) for i in range(k - 1, len(w)))
    starts = seen[1].pop(("start",), 0)
    tables = [None, *(discount_table(c.values()) for c in seen[1:])]
    n, v = sum(seen[1].values()), len(seen[1])
    kept = lambda k, c: tables[k][c] if c <= 5 else 1 - 0.01 / c if k > 1 else 1
    mass = sum((1 - kept(1, c)) * c for c in seen[1].values())
    unknown, scale = (mass / n, 1) if mass > 0 else (0.5 / (n + 0.5), 1 - 0.5 / (n + 0.5))
    count = lambda h: starts if h == ("start",) else seen[len(h)][h]
    after = collections.defaultdict(list)
    for k in range(2, order + 1):
        for g in seen[k]:
            after[g[:-1]].append(g[-1])
    alphas = {}

    def p(h, w):
        g = (*h, w)
        if not h:
            return scale * kept(1, seen[1][g]) * seen[1][g] / n if g in seen[1] else unknown
        if g in seen[len(g)]:
            return kept(len(g), seen[len(g)][g]) * seen[len(g)][g] / count(h)
        return (alpha(h) if count(h) else 1) * p(h[1:], w)

    def alpha(h):
        if h not in alphas:
            alphas[h] = (1 - sum(p(h, w) for w in after[h])) / (1 - sum(p(h[1:], w) for w in after[h]))
        return alphas[h]

    out = []
    for (i, w), t in zip(toks, train, strict=True):
        x = ["start", *w]
        s = sum(math.log10(p(tuple(x[max(0, j - order + 1) : j]), x[j])) for j in range(1, len(x)))
        b = sum(math.log10((seen[1][y,] + 0.5) / (n + 0.5 * (v + 1))) for y in w)
        out.append((-1 if i is None else i, not t, len(w), sum(seen[1][y,] > 0 for y in w), n, round(b, 6), round(s, 6)))
    return sorted(out), p, [w for w, in seen[1]], after


def scored(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in K.katz_scores(df, **options).collect())


@pytest.mark.parametrize(("size", "order"), [(1_000_000, 3), (300, 3), (300, 2), (2000, 4), (300, 1)])
def test_fixture(docs, rows, size, order):
    got, (want, *_) = scored(docs, order=order, unit_tokens=size, bucket_tokens=5000), direct([r[:2] for r in rows], order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-4 for g, w in zip(got, want, strict=True) for a, b in zip(g[5:], w[5:], strict=True))


def test_normalised(rows):
    """After any context, seen words, unseen ones and the unknown word share all of the mass."""
    _, p, words, after = direct([r[:2] for r in rows], 3)
    contexts = sorted(after, key=str)
    for h in [*contexts[:: max(1, len(contexts) // 60)], ("w1", "start"), ("never", "seen")]:
        assert abs(sum(p(h, w) for w in words) + p(h, "never seen") - 1) < 1e-9


def test_against_sql(spark, docs, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet({glob.glob(sf_dir + '/documents.parquet/*.parquet')}) where doc_id is not null")
    want = sorted(con.sql(K.SQL).fetchall())
    names = [x[0] for x in con.sql(K.SQL).description]
    got = K.katz_scores(docs.filter("doc_id is not null")).select(*names).collect()
    got = sorted((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got)
    assert [g[:5] for g in got] == [tuple(w[:5]) for w in want]
    assert all(abs(a - b) < 1e-5 for g, w in zip(got, want, strict=True) for a, b in zip(g[5:], w[5:], strict=True))


def test_empty(spark, none):
    assert K.katz_scores(none).count() == 0
    r = K.katz_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert r.n_tokens == 3


def test_discounts():
    d = K.discounts({1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 60})
    assert all(0 < x < 1 for x in d[1:]) and abs(d[1] - (2 * 400 / 1000 - 6 * 60 / 1000) / (1 - 6 * 60 / 1000)) < 1e-12
    assert all(0 < x < 1 for x in K.discounts({1: 3, 2: 9})[1:]) and all(0 < x < 1 for x in K.discounts({})[1:])
