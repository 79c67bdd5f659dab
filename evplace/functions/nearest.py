"""Distances of rows of matrices, and the nearest rows of some that come tile by tile."""

from __future__ import annotations

import numpy as np

METRICS = ("cosine", "euclidean", "cityblock")
#: Rows of references and of queries that are screened at once, groups of references for each that is wanted, whose least distances give the first limit, and pairs measured at once.
TILE, ROWS, GROUPS, MEASURED = 8192, 128, 8, 1 << 16


def measured(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row i of q and row i of r. They depend on the two rows' values alone, so copies of a row tie exactly."""
    if metric == "cosine":
        ii = lambda a, b: np.einsum("ij,ij->i", a, b)
        return 1 - ii(q, r) / np.maximum(np.sqrt(ii(q, q)) * np.sqrt(ii(r, r)), 1e-8)
    apart = q - r
    if metric == "euclidean":
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))
    return np.abs(apart, out=apart).sum(axis=1)


def between(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """[row of q, row of r] distances, for small blocks; as in measured(), copies of a row tie exactly."""
    if metric == "cosine":
        n = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, r)]
        return 1 - products(q, r) / np.maximum(np.outer(*n), 1e-8)
    out, columns = np.empty((len(q), len(r))), np.ascontiguousarray(r.T)
    for i, v in enumerate(q):
        apart = columns - v[:, None]
        out[i] = np.abs(apart, out=apart).sum(axis=0) if metric == "cityblock" else np.sqrt(np.multiply(apart, apart, out=apart).sum(axis=0))
    return out


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """[row of q, row of r] inner products, each summed in one order wherever its rows lie, which a matrix product does not promise."""
    return np.einsum("ik,jk->ij", q, r, optimize=False)


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """A bound on the k-th least of each row: the k-th of the least of GROUPS x k groups of columns, or of all if there are fewer."""
    groups = GROUPS * k
    if s.shape[1] > 2 * groups:
        s = s[:, : s.shape[1] // groups * groups].reshape(len(s), -1, groups).min(axis=1)
    return np.partition(s, k - 1, axis=1)[:, k - 1]


class Nearest:
    """The k nearest of all references added so far for each row of ``q``, ties to the smaller id; NaN is farthest.

    References are screened in single precision, with a bound on its error; those that may be among the nearest are measured in double. So no result
    depends on tiles, and a tile costs a product and a comparison a pair. Memory: k rows for each query, and a tile.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str = "cosine"):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.q, self.k, self.metric = q, k, metric
        self.d, self.ids, self.has = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), bool)
        self.centre = None

    def add(self, r: np.ndarray, ids: np.ndarray) -> None:
        if not len(r) or not len(self.q) or not self.k:
            return
        if r.shape[1] != self.q.shape[1]:
            raise ValueError("vectors of unequal lengths")
        with np.errstate(all="ignore"):
            if self.centre is None:
                middle = r[:TILE].mean(axis=0)
                self.centre = middle if self.metric != "cosine" and np.isfinite(middle).all() else np.zeros(r.shape[1])
                self.low = self._low(self.q)
            for at in range(0, len(r), TILE):
                self._tile(r[at : at + TILE], ids[at : at + TILE])

    def _low(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows in single precision, a number of each that the screen needs, and a length, by which the error is bounded."""
        if self.metric == "cosine":
            n = np.sqrt(np.einsum("ij,ij->i", x, x))
            return (x / np.where(n > 0, n, 1)[:, None]).astype(np.float32), n, float(n[n > 0].min(initial=np.inf)) if np.isfinite(n).all() and n.max(initial=0) < 1e15 else np.nan
        low = (x - self.centre).astype(np.float32)
        wide = low.astype(np.float64)
        each = np.einsum("ij,ij->i", wide, wide) if self.metric == "euclidean" else np.abs(wide).sum(axis=1)
        most = (np.sqrt(each) if self.metric == "euclidean" else each).max(initial=0)
        # what centring loses in double precision counts as length too
        return low, each.astype(np.float32), float(most + 1e-7 * np.abs(x).max(initial=0)) if most < 1e15 and np.abs(x).max(initial=0) < 1e15 else np.nan

    def _slack(self, length: float) -> float:
        unit, own = (self.q.shape[1] + 8) * 2.0**-23, self.low[2]
        if not np.isfinite(length + own) and not (self.metric == "cosine" and length + own == np.inf):
            return np.inf
        if self.metric == "cosine":
            return unit if length * own >= 1e-8 else np.inf
        return unit * ((length + own) ** 2 if self.metric == "euclidean" else length + own)

    def _base(self, lo: int):
        """What the screen leaves out of distances (squared ones, if Euclidean): the same for all references of a query, so limits are less by it."""
        return 1.0 if self.metric == "cosine" else self.low[1][lo : lo + ROWS].astype(np.float64) if self.metric == "euclidean" else 0.0

    def _tile(self, r: np.ndarray, ids: np.ndarray) -> None:
        low, each, length = self._low(r)
        slack, columns = self._slack(length), np.ascontiguousarray(low.T)
        # scaled by a power of two, which rounds nothing: products need no pass of their own for it
        factor = np.float32({"cosine": -1, "euclidean": -2, "cityblock": 1}[self.metric])
        buffer, ones = (np.empty_like(columns), np.ones(len(columns), np.float32)) if self.metric == "cityblock" else (None, None)
        for lo in range(0, len(self.q), ROWS):
            q = self.low[0][lo : lo + ROWS] * factor
            if self.metric == "cityblock":
                s = np.empty((len(q), len(r)), np.float32)
                for i, v in enumerate(q):
                    np.subtract(columns, v[:, None], out=buffer)
                    np.matmul(ones, np.abs(buffer, out=buffer), out=s[i])
            else:
                s = q @ columns
                if self.metric == "euclidean":
                    s += each
            last, base = self.d[lo : lo + ROWS, -1], self._base(lo)
            limit = np.where(self.has[lo : lo + ROWS, -1], last * last if self.metric == "euclidean" else last, np.inf)
            limit = limit * (1 + 1e-12) + slack - base
            if np.isfinite(slack) and not np.isfinite(limit).all() and s.shape[1] > self.k:
                limit = np.fmin(limit, _kth(s, self.k).astype(np.float64) + 2 * slack)
            near = s <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None] if np.isfinite(slack) else np.ones(s.shape, bool)
            near[np.isnan(limit)] = True
            i, j = np.divmod(np.flatnonzero(near), len(r))
            if len(i):
                d = np.concatenate([measured(self.q[lo + i[a : a + MEASURED]], r[j[a : a + MEASURED]], self.metric) for a in range(0, len(i), MEASURED)])
                self._merge(lo + i, ids[j], d)

    def _merge(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        some = np.unique(i)
        i, d = np.concatenate([np.repeat(some, self.k), i]), np.concatenate([self.d[some].ravel(), d])
        ids, has = np.concatenate([self.ids[some].ravel(), ids]), np.concatenate([self.has[some].ravel(), np.ones(len(ids), bool)])
        order = np.lexsort((ids, d, ~has, i))
        start = np.searchsorted(i[order], some)
        best = order[start[:, None] + np.arange(self.k)]
        self.d[some], self.ids[some], self.has[some] = d[best], ids[best], has[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of q, id and distance of what was found, nearest first."""
        i, j = np.nonzero(self.has)
        return i, self.ids[i, j], self.d[i, j]
