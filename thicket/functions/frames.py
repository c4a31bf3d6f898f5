"""Order statistics of every prefix or suffix of a sequence, without a pass for each.

Values are replaced by ranks and held as a wavelet matrix: the k-th smallest value
of any stretch, and the sum of those below it, take one step per bit of a rank, for
all stretches at once.  n values take O(n log n) for medians and sums and
O(n log^2 n) for median deviations; a sequence is held whole by its task, about
20 bytes for each value and bit.
"""

from __future__ import annotations

import numpy as np


class Frames:
    """Stretches of one sequence that begin at its start or end at its end; null values do not count."""

    def __init__(self, values: np.ndarray, valid: np.ndarray, first: np.ndarray, last: np.ndarray):
        place = np.concatenate([[0], np.cumsum(valid)])
        self.v = values[valid].astype(float)
        self.l, self.r = place[first], place[last]
        self.n = self.r - self.l
        finite = np.isfinite(self.v)
        self.centre = float(np.rint(self.v[finite].mean())) if finite.any() else 0.0  # whole, so that whole numbers stay exact
        self.c = np.where(finite, self.v - self.centre, np.nan)  # keeps the digits of sums of squares
        order = np.argsort(self.v, kind="stable")
        self.ranked = self.v[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.levels = []
        own = np.where(finite, self.c, 0.0)[order].astype(np.longdouble)
        for bit in reversed(range(max(1, (len(order) - 1).bit_length()))):
            low = (rank >> bit) & 1 == 0
            self.levels.append((np.concatenate([[0], np.cumsum(low)]).astype(np.int32), np.concatenate([[0], np.cumsum(np.where(low, own[rank], 0))])))
            rank = np.concatenate([rank[low], rank[~low]])

    @classmethod
    def prefixes(cls, values, valid):
        """Up to each value and with it."""
        n = np.arange(len(values))
        return cls(values, valid, np.zeros_like(n), n + 1)

    @classmethod
    def suffixes(cls, values, valid, after: int = 0):
        """From each value on, or from the one ``after`` it."""
        n = np.arange(len(values))
        return cls(values, valid, n + after, np.full_like(n, len(values)))

    def kth(self, k: np.ndarray, sums: bool = False):
        """The k-th smallest value of each stretch, from 0, or the sum of the centred values below it; any number where there are too few."""
        if not len(self.v):
            return np.zeros(len(k))
        l, r, k = self.l, self.r, np.clip(k, 0, np.maximum(self.n - 1, 0))
        at, below = np.zeros(len(k), np.int64), np.zeros(len(k), np.longdouble)
        for count, total in self.levels:
            zl, zr = count[l], count[r]
            right = k >= zr - zl
            if sums:
                below += np.where(right, total[r] - total[l], 0)
            k = np.where(right, k - (zr - zl), k)
            l, r = np.where(right, count[-1] + l - zl, zl), np.where(right, count[-1] + r - zr, zr)
            at = 2 * at + right
        return below if sums else self.ranked[np.minimum(at, len(self.ranked) - 1)]

    def median(self) -> np.ndarray:
        return (self.kth((self.n - 1) // 2) + self.kth(self.n // 2)) / 2

    def _sum(self, x: np.ndarray) -> np.ndarray:
        """Sums in extended precision that start at the frame's own end, so that short suffixes keep their digits and ties of rounding stay ties."""
        x = x.astype(np.longdouble)
        ahead, back = np.concatenate([[0], np.cumsum(x)]), np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
        return np.where(self.l == 0, ahead[self.r], back[self.l])

    def total(self) -> np.ndarray:
        return self._sum(self.c)

    def mean(self) -> np.ndarray:
        return (self._sum(self.v) / np.maximum(self.n, 1)).astype(float)

    def _spread(self) -> np.ndarray:
        """Variance times the square of the count."""
        s = self.total()
        return np.maximum(0, self._sum(self.c * self.c) * self.n - s * s)

    def sse(self) -> np.ndarray:
        return (self._spread() / np.maximum(self.n, 1)).astype(float)

    def var(self) -> np.ndarray:
        return (self._spread() / np.maximum(self.n, 1) ** 2).astype(float)

    def ssme(self, median: np.ndarray) -> np.ndarray:
        m = median - self.centre
        return (self.n * m * m - 2 * m * self.total() + self._sum(self.c * self.c)).astype(float)

    def sme(self) -> np.ndarray:
        """Sum of the upper half less that of the lower."""
        half = self.kth(self.n // 2, sums=True)
        middle = np.where(self.n % 2 == 1, self.kth(self.n // 2) - self.centre, 0.0)
        return (self.total() - 2 * half - middle).astype(float)

    def mad(self, median: np.ndarray) -> np.ndarray:
        """Median distance to the median; 0 below two values."""

        def nearest(k):
            # The k values nearest to the median are neighbours in order: where they begin is found by halving.
            lo, hi = np.zeros_like(self.n), np.maximum(self.n - k, 0)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                on = (lo < hi) & (median - self.kth(mid) > self.kth(mid + k) - median)
                lo, hi = np.where(on, mid + 1, lo), np.where(on | (lo >= hi), hi, mid)
            return np.maximum(np.abs(self.kth(lo) - median), np.abs(self.kth(lo + k - 1) - median))

        return np.where(self.n < 2, 0.0, (nearest((self.n - 1) // 2 + 1) + nearest(self.n // 2 + 1)) / 2)
