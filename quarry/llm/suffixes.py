"""Suffix arrays of many strings at once, by induced sorting on numpy arrays.

Suffixes are classified as larger (L) or smaller (S) than the next; leftmost-smaller (LMS) substrings are sorted by
induction and named; strings whose names repeat are sorted recursively as strings of names; the order of the LMS suffixes
then induces the order of all suffixes.  Every level works this way, whatever the number of symbols or names.

Induction is one scan over each string's suffix array, in which each entry depends on those before.  So the strings are
scanned side by side: step t takes the t-th entry of all strings that are long enough, as one array.  Where only a
few strings are left, as for one very long one, the same scan runs over plain lists.
"""

from __future__ import annotations

import numpy as np

#: Below this number of strings, steps of arrays cost more than steps of single entries.
FEW = 12


class _Strings:
    """Symbols of strings one after the other; each ends with its only 0."""

    def __init__(self, s: np.ndarray, lens: np.ndarray):
        self.s, self.lens = s, lens
        self.end = np.cumsum(lens)
        self.start = self.end - lens
        self.owner = np.repeat(np.arange(len(lens)), lens)
        self.small = _types(s)
        self.is_lms = np.zeros(len(s), dtype=bool)
        self.is_lms[1:] = self.small[1:] & ~self.small[:-1]
        # A bucket for each symbol of each string; positions of buckets are places in the common suffix array.
        sigma = np.maximum.reduceat(s, self.start) + 1
        self.bucket = (np.cumsum(sigma) - sigma)[self.owner] + s
        self.tail = np.cumsum(np.bincount(self.bucket, minlength=int(sigma.sum())))
        self.head = np.concatenate([[0], self.tail[:-1]])
        # Whether a suffix is taken when the one behind it is met; two more entries for places before the first string.
        self.larger, self.smaller = np.zeros(len(s) + 2, dtype=bool), np.zeros(len(s) + 2, dtype=bool)
        self.larger[:-2], self.smaller[:-2] = ~self.small, self.small
        self.smaller[self.end - 1] = False
        by_length = np.argsort(-lens, kind="stable")
        self.first, self.last = self.start[by_length], self.end[by_length] - 1
        self.longer = len(lens) - np.searchsorted(np.sort(lens), np.arange(int(lens.max())), side="right")

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """Order of all suffixes from LMS positions, of which those of one bucket come in order."""
        sa = np.full(len(self.s), -1, dtype=np.int64)
        b = self.bucket[lms]
        order = np.argsort(b, kind="stable")
        b = b[order]
        upto = np.cumsum(np.bincount(b, minlength=len(self.tail)))
        sa[self.tail[b] - upto[b] + np.arange(len(b))] = lms[order]
        if len(self.lens) < FEW:
            return self._scan_lists(sa)
        head, tail = self.head.copy(), self.tail.copy()
        for t, m in enumerate(self.longer.tolist()):
            j = sa[self.first[:m] + t] - 1
            j = j[self.larger[j]]
            b = self.bucket[j]
            p = head[b]
            sa[p] = j
            head[b] = p + 1
        for t, m in enumerate(self.longer.tolist()):
            j = sa[self.last[:m] - t] - 1
            j = j[self.smaller[j]]
            b = self.bucket[j]
            p = tail[b] - 1
            sa[p] = j
            tail[b] = p
        return sa

    def _scan_lists(self, sa: np.ndarray) -> np.ndarray:
        """Both scans, entry by entry."""
        out, bucket, head, tail = sa.tolist(), self.bucket.tolist(), self.head.tolist(), self.tail.tolist()
        larger, smaller = self.larger.tolist(), self.smaller.tolist()
        for i in range(len(out)):
            j = out[i] - 1
            if larger[j]:
                b = bucket[j]
                out[head[b]] = j
                head[b] += 1
        for i in range(len(out) - 1, -1, -1):
            j = out[i] - 1
            if smaller[j]:
                b = bucket[j]
                tail[b] -= 1
                out[tail[b]] = j
        return np.array(out, dtype=np.int64)

    def sorted_lms(self) -> np.ndarray:
        """LMS suffixes of each string in order, string after string."""
        lms = np.flatnonzero(self.is_lms)
        order = self.induce(lms)
        order = order[self.is_lms[order]]
        length = np.zeros(len(self.s), dtype=np.int64)
        length[lms[:-1]] = np.diff(lms)
        length[self.end - 1] = 0
        a, b = order[:-1], order[1:]
        same = (length[a] == length[b]) & (length[a] > 0) & (self.owner[a] == self.owner[b])
        live, k = np.flatnonzero(same), 0
        while len(live):
            differ = self.s[a[live] + k] != self.s[b[live] + k]
            same[live[differ]] = False
            live = live[~differ]
            live = live[length[a[live]] > k]
            k += 1
        own = self.owner[order]
        names = np.concatenate([[0], np.cumsum(~same)])
        count = np.bincount(own, minlength=len(self.lens))
        opening = np.cumsum(count) - count
        names -= np.repeat(names[opening], count)
        again = names[np.cumsum(count) - 1] + 1 < count  # strings in which a name repeats
        if again.any():
            name = np.empty(len(self.s), dtype=np.int64)
            name[order] = names
            part = lms[again[self.owner[lms]]]
            order[again[own]] = part[suffix_arrays(name[part], count[again])]
        return order


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the 0 that ends a string is."""
    n = len(s)
    diff = np.empty(n, dtype=bool)
    diff[:-1] = s[:-1] != s[1:]
    diff[-1] = True
    where = np.where(diff, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]  # the next place where a symbol changes
    out = np.ones(n, dtype=bool)
    inner = nearest < n - 1
    out[inner] = s[nearest[inner]] < s[nearest[inner] + 1]
    return out


def suffix_arrays(s: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Suffixes (places in ``s``) of each string in order, string after string.

    ``s`` holds strings of ``lens`` symbols, two at least, one after the other; the last symbol of each is its only 0.
    """
    x = _Strings(np.asarray(s, dtype=np.int64), np.asarray(lens, dtype=np.int64))
    return x.induce(x.sorted_lms())


def permuted_lcp(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Per text position, the common prefix (at most ``most``) with the suffix before it in suffix order.

    Positions are compared in text order, eight symbols at a time, for as long as they agree.
    ``text`` is bytes, with at least ``most`` + 8 symbols behind the last suffix of interest or the end.
    """
    n = len(text)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(most + 16, dtype=np.uint8)])
    out = np.zeros(n, dtype=np.int32)
    live = np.flatnonzero(phi >= 0)
    eights = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    k = 0
    while len(live) and k < most:
        x = eights[live + k] ^ eights[phi[live] + k]
        whole = x == 0
        part = live[~whole]
        if len(part):
            low = x[~whole]
            low &= ~low + np.uint64(1)  # the lowest set bit tells the first byte that differs
            out[part] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[whole]
        k += 8
        out[live] = k
    return np.minimum(out, most)
