import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quarry.llm import packing as K


def test_encoder_equals_tokenizers(rows):
    slow, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), K.encoder()
    texts = [r[1] or "" for r in rows] + ["a<|endoftext|>b", "it's we'LL 12 345  \n\n x\u00a0y\u2028z", "\u0130\u01c5 ª²½ \x85\x1c x", "漢字かな 😀"]
    texts += [f"a{chr(c)}b 1{chr(c)}{chr(c)} x {chr(c)}" for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut():
    assert K.cut_pieces(1) == [(0, 1)] and K.cut_pieces(2048) == [(0, 2048)]
    assert K.cut_pieces(5000) == [(0, 904), (904, 2048), (2952, 2048)] and K.cut_pieces(4096) == [(0, 2048), (2048, 2048)]


def test_rule():
    """Every placement minimises the sum of squares over gaps."""
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 21, 200)
    bins, offsets = K.sum_of_squares(lengths, 20)
    used: dict[int, int] = {}

    def squares(u):
        gaps = np.bincount([20 - x for x in u.values() if x < 20], minlength=21)
        return int((gaps**2).sum())

    for s, b, o in zip(lengths, bins, offsets, strict=True):
        choices = [squares(used | {k: used[k] + s}) for k in used if used[k] + s <= 20 and used[k] < 20] + [squares(used | {-1: s})]
        assert used.get(b, 0) == o
        used[b] = o + s
        assert used[b] <= 20 and squares(used) == min(choices)


def test_pack(docs, none, rows):
    got = K.pack_documents(docs, group_rows=10).toPandas()
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        ids = [*slow.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(-1 if r[0] is None else r[0], i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(K.cut_pieces(len(ids)))]
    have = got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int)
    assert sorted(map(tuple, have.to_numpy().tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
    assert K.pack_documents(none).count() == 0
    whole = K.pack_documents(docs, keep_ids=True).filter("doc_id = 10").first()
    assert whole.ids == [*slow.encode(rows[10][1], add_special_tokens=False).ids, 0]
    assert K.pack_documents(docs).select("sequence_id").distinct().count() <= got.length.sum() / 2048 * 1.05 + 1
