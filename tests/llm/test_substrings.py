import hashlib
import random

import numpy as np
import pytest

from quarry.llm import substrings as S
from quarry.llm import suffixes


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((-1 if i is None else i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def got(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, **options).collect())


def plain(s):
    return sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_arrays(monkeypatch):
    """Many strings side by side, and one by one."""
    rng = np.random.default_rng(0)
    for few in (0, 12, 1000):
        monkeypatch.setattr(suffixes, "FEW", few)
        for _ in range(60):
            strings = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0) for _ in range(rng.integers(1, 30))]
            got = suffixes.suffix_arrays(np.concatenate(strings), np.array([len(x) for x in strings]))
            at = 0
            for s in strings:
                assert (got[at : at + len(s)] - at).tolist() == plain(s)
                at += len(s)


def test_recursion_with_many_names(monkeypatch):
    """A string of names is sorted by the same induction, however many names there are."""
    levels, real = [], suffixes._Strings.__init__

    def seen(self, s, lens):
        levels.append(int(s.max()) + 1)
        real(self, s, lens)

    monkeypatch.setattr(suffixes._Strings, "__init__", seen)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(6000))
    text = (text + text[:9000]).encode()
    got = suffixes.suffix_arrays(np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0), np.array([len(text) + 1]))
    assert got.tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])
    assert len(levels) >= 3 and levels[1] > 2048


def test_common_prefixes():
    text = np.frombuffer(b"abracadabra\0", np.uint8)
    sa = np.array(sorted(range(12), key=lambda i: bytes(text[i:])))
    lcp = suffixes.permuted_lcp(text, sa, 100)
    assert {bytes(text[i:i + 4]).decode(): int(lcp[i]) for i in (0, 1, 4)} == {"abra": 4, "brac": 3, "cada": 0}


def test_planted(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b = text(40), text(60)
    rows = [(1, a), (2, text(30) + a[:130] + text(20)), (3, b + b), (4, "x" * 450), (5, "yx" * 120 + "x" * 120), (6, a[20:] + b[:150]), (7, text(5)), (8, None), (9, ""), (10, b), (11, b[:99]), (12, "z" * 100), (13, "z" * 100), (None, a), (4, text(50)), (14, "ab" * 90 + a)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"most": 1, "shard_bytes": 500}):
        have = got(df, **options)
        assert [x for x in have if x[0] != 4] == [x for x in brute(rows) if x[0] != 4]
        assert [sum(y[2] for y in f if y[0] == 4) for f in (have, brute(rows))] == [449, 449]


def test_fixture(docs, none, rows):
    ids = [r[0] for r in rows]
    once = lambda xs: [x for x in xs if x[0] >= 0 and ids.count(x[0]) == 1]
    assert once(got(docs)) == once(brute([r[:2] for r in rows]))
    assert S.remove_repeats(none).count() == 0
    r = S.remove_repeats(docs, keep_text=True).filter("doc_id = 30").first()
    assert bytes(r.kept) == b"" and r.spans == [[0, r.n_bytes]]


@pytest.mark.parametrize("chunk", [1 << 18, 130])
def test_segments_cover_windows(monkeypatch, chunk):
    """Every window lies in just one segment, and equal windows in segments with one minimizer and a common key."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(6)
    passage = bytes(rng.choice(b"abc ") for _ in range(300))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(200)) + passage[:k] + b"z" * 120 for k in (100, 180, 300)] + [passage, b"q" * 400, b"x" * 99, None]
    of: dict[bytes, set] = {}
    keys: dict[bytes, list] = {}
    count: dict[tuple, int] = {}
    for x in S.segments(texts):
        own = [set(x.key[x.of == i].tolist()) for i in range(len(x.m))]
        for i, (t, m, a, z) in enumerate(zip(x.text, x.m, x.start, x.end, strict=True)):
            for p in range(a, z - 99):
                w = texts[t][p : p + 100]
                of.setdefault(w, set()).add(int(m))
                keys.setdefault(w, []).append(own[i])
                count[t, p] = count.get((t, p), 0) + 1
    assert set(count.values()) == {1} and len(count) == sum(max(len(t or b"") - 99, 0) for t in texts)
    assert all(len(m) == 1 for m in of.values()) and all(set.intersection(*k) for k in keys.values())
