"""FM-index over word sequences: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

#: Symbol that ends every indexed sequence; queries never hold it.
END = 0
ONE = np.uint64(1)


class Wavelet:
    """Rank over a sequence of symbols: a plane of packed bits for every bit of a symbol, with
    a running count for each 64 bits, so about 1.5 bits a place and plane."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(symbols)
        pad = -n % 64 + 64
        order = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (order >> level) & 1
            packed = np.packbits(np.r_[bit, np.zeros(pad, bit.dtype)].astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32))
            ones = bit.astype(bool)
            self.zeros.append(n - int(ones.sum()))
            order = np.r_[order[~ones], order[ones]]
        self.base = np.zeros(sigma, np.int64)
        everything = np.arange(sigma)
        self.base = self.place(everything, np.zeros(sigma, np.int64))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at``, followed down the symbol's bits, ends."""
        at = at.copy()
        for k in range(self.levels):
            block = at >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((ONE << (at & 63).astype(np.uint64)) - ONE))
            bit = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` places."""
        return self.place(symbol, at) - self.base[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffixes ordered by at least ``depth`` symbols, by doubling; the ranks at each power of
    two below, and the common prefixes of neighbours, cut off at ``depth``."""
    n = len(text)
    rank = text.astype(np.int64)
    ranks, step = [], 1
    while True:
        ranks.append(rank.astype(np.int32))
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        done = key[order]
        new = np.r_[0, np.cumsum(done[1:] != done[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if step >= depth or (n and new[-1] == n - 1):
            break
    a, b = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            i, j = a + common, b + common
            ok = (i < n) & (j < n)
            same = ok & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)]) & (np.maximum(i, j) + (1 << k) <= n)
            common += same * (1 << k)
    return order, ranks, np.minimum(common, depth)


class FMIndex:
    """Index of sequences of 64-bit word hashes for matches of up to ``depth`` words.

    The suffixes are sorted to that depth only, which leaves every interval of a match of at
    most ``depth`` words where it is. ``owners`` are the sequences' documents; a match of
    ``depth`` words gives the smallest owner in its interval.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, depth: int):
        self.depth = depth
        size = np.array([len(s) for s in sequences])
        flat = np.concatenate(sequences) if len(sequences) else np.empty(0, np.uint64)
        self.alphabet, code = np.unique(flat, return_inverse=True)
        ends = np.cumsum(size + 1) - 1
        text = np.zeros(len(flat) + len(sequences), np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = code + 1
        self.n = n = len(text)
        order, _, common = suffix_order(text, depth)
        before = text[order - 1]  # the first suffix is preceded by the last end
        sigma = len(self.alphabet) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.wavelet = Wavelet(before, sigma)
        # common[i] with the suffix before; none before the first and after the last
        lcp = np.zeros(n + 1, np.uint8)
        lcp[1:n] = common
        self.lcp = lcp
        self.sparse = [lcp]
        k = 1
        while 2 * k <= n + 1:
            last = self.sparse[-1]
            self.sparse.append(np.minimum(last[:-k], last[k:]))
            k *= 2
        cut = np.flatnonzero(lcp[:n] < depth)
        owner = np.repeat(owners, size + 1)[order]
        least = np.minimum.reduceat(owner, cut) if n else owner
        self.least = np.repeat(least, np.diff(np.r_[cut, n]))
        starts = np.where(lcp[:n] < depth - 1, np.arange(n), 0)
        self.shorter_lo = np.maximum.accumulate(starts).astype(np.int32)
        bounds = np.r_[np.flatnonzero(lcp[:n] < depth - 1), n]
        self.shorter_hi = np.repeat(bounds[1:], np.diff(bounds)).astype(np.int32)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; 0 for words that the index lacks."""
        if not len(self.alphabet):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, at)

    def _left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest place <= ``at`` whose common prefix is below ``depth``."""
        at = at.copy()
        for k in range(len(self.sparse) - 1, -1, -1):
            low = at - (1 << k) + 1
            go = low >= 0
            go &= self.sparse[k][np.maximum(low, 0)] >= depth
            at = np.where(go, at - (1 << k), at)
        return np.maximum(at, 0)

    def _right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest place >= ``at`` whose common prefix is below ``depth``."""
        at = at.copy()
        for k in range(len(self.sparse) - 1, -1, -1):
            m = self.sparse[k]
            go = at < len(m)
            go &= m[np.minimum(at, len(m) - 1)] >= depth
            at = np.where(go, at + (1 << k), at)
        return np.minimum(at, self.n)

    def matches(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of all queries, one after another: the words that match from
        each place, at most ``depth``, and the smallest owner of a match of ``depth`` words
        (the largest integer where the match is shorter).

        All queries advance together from their ends. A word that does not extend a match
        moves its interval to the parent (the next shorter match that occurs elsewhere too).
        """
        size = np.array([len(q) for q in queries], np.int64)
        flat = self.codes(np.concatenate(queries)) if len(queries) else np.empty(0, np.int64)
        length = np.zeros(len(flat), np.int32)
        least = np.full(len(flat), np.iinfo(np.int64).max)
        if not self.n:
            return length, least
        order = np.argsort(-size, kind="stable")
        stop = np.cumsum(size)[order]
        sizes = size[order]
        q = len(order)
        lo, hi, have = np.zeros(q, np.int64), np.full(q, self.n), np.zeros(q, np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -back, "right"))
            at = stop[:live] - back
            symbol = flat[at]
            full = np.flatnonzero(have[:live] == self.depth)
            place = lo[full]
            lo[full], hi[full], have[full] = self.shorter_lo[place], self.shorter_hi[place], self.depth - 1
            lost = np.flatnonzero(symbol == END)
            lo[lost], hi[lost], have[lost] = 0, self.n, 0
            rest = np.flatnonzero(symbol != END)
            while len(rest):
                s = symbol[rest]
                a, b = self.step(s, lo[rest]), self.step(s, hi[rest])
                ok = b > a
                done = rest[ok]
                lo[done], hi[done] = a[ok], b[ok]
                have[done] += 1
                rest = rest[~ok]
                if not len(rest):
                    break
                d = np.maximum(self.lcp[lo[rest]], self.lcp[hi[rest]]).astype(np.int64)
                up = d > 0
                lo[rest[up]], hi[rest[up]] = self._left(lo[rest[up]], d[up]), self._right(hi[rest[up]], d[up])
                lo[rest[~up]], hi[rest[~up]] = 0, self.n
                have[rest] = d
            length[at] = have[:live]
            whole = np.flatnonzero(have[:live] == self.depth)
            least[at[whole]] = self.least[lo[whole]]
        return length, least
