import random

import numpy as np

from quarry.llm import hashing as H


def words(t):
    return (t or b"").translate(H._LOWER).split()


def test_words_and_shingles(monkeypatch):
    """Equal words, and only they, have equal hashes, wherever texts and pieces are cut."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aAbé漢") for _ in range(rng.randrange(1, 4))).encode()
    texts = [None, b"", b" \t\n", b"one", b"x" * 5000, b"  a  b\x0b\x0cc\r", *(rng.choice([b" ", b"\n \t"]).join(word() for _ in range(rng.randrange(300))) for _ in range(50))]
    for piece in (1 << 18, 64):
        monkeypatch.setattr(H, "PIECE", piece)
        got, counts = H.word_hashes(texts)
        flat = [w for t in texts for w in words(t)]
        assert counts.tolist() == [len(words(t)) for t in texts] and len(got) == len(flat)
        assert len(set(zip(flat, got.tolist(), strict=True))) == len(set(flat)) == len(set(got.tolist()))
        for t, s in zip(texts, H.shingles(texts, 5), strict=True):
            w = words(t)
            want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
            assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
    one = [H.shingles([t], 5)[0].tolist() for t in texts]
    assert one == [s.tolist() for s in H.shingles(texts, 5)]
