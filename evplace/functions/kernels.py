"""Small numpy helpers for keypoint matching and depth maps."""

from __future__ import annotations

import numpy as np


#: Distances that one batched product makes, at most: few enough to stay in a core's cache. Samples that consensus() draws for each iteration.
AT_ONCE, DRAWS = 1 << 18, 4


def match_stacks(a: np.ndarray, b: np.ndarray, kind: str = "mutual", ratio: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pair, i, j, distance of the matches in stacks of descriptors, [pair, keypoint, value]: one batched product for all pairs.

    mutual: rows that are each other's nearest; ratio: each row of a with its nearest of b, where that is under ``ratio``
    times the second nearest. Ties go to the lowest index.
    """
    d = (a * a).sum(2)[:, :, None] + (b * b).sum(2)[:, None, :] - 2 * (a @ b.transpose(0, 2, 1))
    d = np.sqrt(np.maximum(d, 0, out=d), out=d)
    to_b = d.argmin(axis=2)
    first = np.take_along_axis(d, to_b[:, :, None], axis=2)[:, :, 0]
    if kind == "mutual":
        good = np.take_along_axis(d.argmin(axis=1), to_b, axis=1) == np.arange(a.shape[1])
    else:
        np.put_along_axis(d, to_b[:, :, None], np.inf, axis=2)
        good = first < ratio * d.min(axis=2)
    pair, i = np.nonzero(good)
    return pair, i, to_b[pair, i], first[pair, i]


def match_lists(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, kind: str = "mutual", ratio: float = 0.8) -> tuple[np.ndarray, ...]:
    """pair, row of a, row of b, distance: matches of pairs whose descriptors lie end to end, with n + 1 offsets on each side.

    Pairs of one shape are stacked, at most AT_ONCE distances together. A pair without descriptors on a side, or for ratio with
    under two on the other, has no matches.
    """
    na, nb = np.diff(a_ends), np.diff(b_ends)
    able = np.flatnonzero((na > 0) & (nb > (kind != "mutual")))
    out = []
    for x, y in np.unique(np.stack([na[able], nb[able]], axis=1), axis=0).tolist():
        same = able[(na[able] == x) & (nb[able] == y)]
        most = max(1, AT_ONCE // (x * y))
        for at in range(0, len(same), most):
            g = same[at : at + most]
            rows_a, rows_b = a_ends[g][:, None] + np.arange(x), b_ends[g][:, None] + np.arange(y)
            pair, i, j, d = match_stacks(a[rows_a], b[rows_b], kind, ratio)
            out.append((g[pair], rows_a[pair, i], rows_b[pair, j], d))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest_pairs(a: np.ndarray, a2: np.ndarray, b: np.ndarray, b2: np.ndarray, kind: str = "mutual", ratio: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b that match, as in match_stacks(), for one pair of sides with their squared lengths; one product in their own precision."""
    if not len(a) or len(b) < (1 if kind == "mutual" else 2):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    d = a @ b.T
    d *= -2
    d += b2
    d += a2[:, None]
    to_b, rows = d.argmin(axis=1), np.arange(len(a))
    if kind == "mutual":
        i = np.flatnonzero(d.argmin(axis=0)[to_b] == rows)
    else:
        first = d[rows, to_b]
        d[rows, to_b] = np.inf
        i = np.flatnonzero(np.sqrt(np.maximum(first, 0)) < ratio * np.sqrt(np.maximum(d.min(axis=1), 0)))
    return i, to_b[i]


def homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies of many four-point samples at once, [sample, 3, 3], by direct linear solution; NaN where there is none."""
    n = len(src)
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    top = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=-1)
    low = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], axis=-1)
    a, b = np.concatenate([top, low], axis=1), np.concatenate([u, v], axis=1)
    out = np.full((n, 9), np.nan)
    fine = np.abs(np.linalg.det(a)) > 1e-6
    if fine.any():
        out[fine, :8] = np.linalg.solve(a[fine], b[fine][..., None])[..., 0]
        out[fine, 8] = 1
    return out.reshape(n, 3, 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def four_of(n: np.ndarray, keys: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """[item, round, 4] different numbers under n[item] (at least 4), by the item's key and the number of the round alone."""
    base = _mixed(keys[:, None] + rounds[None, :].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((*base.shape, 4), np.int64)
    for k in range(4):
        left = n[:, None] - k
        pick = (_mixed(base + np.uint64(k + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * left
        pick = np.minimum(pick.astype(np.int64), left - 1)
        for taken in np.moveaxis(np.sort(out[..., :k], axis=-1), -1, 0):  # past those that are out
            pick += pick >= taken
        out[..., k] = pick
    return out


def plausible(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Samples [.., 4, 2] of which no three points are in line on either side and all triples turn the same way on both, or all the other way."""
    turn = lambda p, i, j, k: (p[..., j, 0] - p[..., i, 0]) * (p[..., k, 1] - p[..., i, 1]) - (p[..., j, 1] - p[..., i, 1]) * (p[..., k, 0] - p[..., i, 0])
    triples = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))
    sign = np.stack([np.sign(turn(src, *t)) * np.sign(turn(dst, *t)) for t in triples], axis=-1)
    return (np.abs(sign.sum(axis=-1)) == 4)


def refitted(src: np.ndarray, dst: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Least-squares homographies, [item, 3, 3], of the points that are ``inside`` [item, point], by direct linear solution in normalised coordinates."""
    n = np.maximum(inside.sum(axis=1), 1)[:, None]

    def normal(p):
        middle = (p * inside[..., None]).sum(axis=1) / n
        away = np.where(inside[..., None], p - middle[:, None], 0)
        size = np.sqrt((away**2).sum(axis=2)).sum(axis=1) / n[:, 0]
        scale = np.sqrt(2) / np.maximum(size, 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = scale
        t[:, :2, 2] = -scale[:, None] * middle
        t[:, 2, 2] = 1
        return away * scale[:, None, None], t

    (s, ts), (d, td) = normal(src), normal(dst)
    x, y, u, v = s[..., 0], s[..., 1], d[..., 0], d[..., 1]
    one, zero = inside.astype(np.float64), np.zeros_like(x)
    top = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=-1)
    low = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], axis=-1)
    a = np.concatenate([top, low], axis=1)
    h = np.linalg.eigh(np.swapaxes(a, 1, 2) @ a)[1][:, :, 0].reshape(-1, 3, 3)
    return np.linalg.inv(td) @ h @ ts


def _near(h: np.ndarray, src: np.ndarray, dst: np.ndarray, real: np.ndarray, thresh: float) -> np.ndarray:
    """[item, homography, point]: does h [item, homography, 3, 3] bring the point within ``thresh``?"""
    x, y = src[:, None, :, 0], src[:, None, :, 1]
    row = lambda r: h[:, :, r, 0, None] * x + h[:, :, r, 1, None] * y + h[:, :, r, 2, None]
    with np.errstate(all="ignore"):
        z = row(2)
        return (((row(0) / z - dst[:, None, :, 0]) ** 2 + (row(1) / z - dst[:, None, :, 1]) ** 2) < thresh * thresh) & real[:, None, :]


def consensus(src: np.ndarray, dst: np.ndarray, ends: np.ndarray, keys: np.ndarray, thresh: float = 5.0, iterations: int = 100, sure: float = 0.999) -> np.ndarray:
    """For each pair whose matches lie end to end, with n + 1 offsets, the most matches within ``thresh`` of one homography; 0 for under four.

    Pairs are sampled in step. Samples that no homography can give, seven of eight that hold chance matches, are left out unsolved, so DRAWS are drawn for each of
    ``iterations``. The best one of a pair is fitted again to all that it brings near, as long as that grows. A pair stops once its samples are
    drawn, or once one of near matches only has come up with a chance of ``sure``. Samples depend on a pair's own key.
    """
    draws, step = DRAWS * iterations, 10 * DRAWS
    n = np.diff(ends)
    best = np.zeros(len(n), np.int64)
    order = np.flatnonzero(n >= 4)
    order = order[np.argsort(n[order], kind="stable")]  # of like sizes together
    at = 0
    while at < len(order):
        most = max(1, AT_ONCE // (10 * int(n[order[min(at + 63, len(order) - 1)]])))
        some, at = order[at : at + most], at + most
        size = n[some]
        place = np.minimum(np.arange(size.max()), size[:, None] - 1) + ends[some][:, None]
        s, d, real = src[place], dst[place], np.arange(size.max()) < size[:, None]
        found, inside, need, done = np.zeros(len(some), np.int64), np.zeros(real.shape, bool), np.full(len(some), float(draws)), 0
        while done < draws and (go := np.flatnonzero(need > done)).size:
            rounds = np.arange(done, min(done + step, draws))
            pick = four_of(size[go], keys[some[go]], rounds)
            ps, pd_ = (np.take_along_axis(x[go][:, None], pick[..., None], axis=2) for x in (s, d))
            h = np.full((*pick.shape[:2], 3, 3), np.nan)
            fine = plausible(ps, pd_)
            if fine.any():
                h[fine] = homographies(ps[fine], pd_[fine])
            near = _near(h, s[go], d[go], real[go], thresh)
            count = near.sum(axis=2)
            top = count.argmax(axis=1)
            better = np.flatnonzero(count[np.arange(len(go)), top] > found[go])
            found[go[better]], inside[go[better]] = count[better, top[better]], near[better, top[better]]
            grown = go[better][found[go[better]] >= 4]
            for _ in range(4):
                if not len(grown):
                    break
                again = _near(refitted(s[grown], d[grown], inside[grown])[:, None], s[grown], d[grown], real[grown], thresh)[:, 0]
                more = again.sum(axis=1) > found[grown]
                grown = grown[more]
                found[grown], inside[grown] = again[more].sum(axis=1), again[more]
            done = int(rounds[-1]) + 1
            chance = np.clip((found / size) ** 4, 1e-12, 1 - 1e-12)
            need = np.minimum(draws, np.log(1 - sure) / np.log1p(-chance))
        best[some] = found
    return best


def homography_inliers(src: np.ndarray, dst: np.ndarray, thresh: float = 5.0, iterations: int = 100, seed: int = 0) -> int:
    """consensus() of one pair."""
    return int(consensus(src, dst, np.array([0, len(src)]), np.array([seed], np.uint64), thresh, iterations)[0])


def box_means(a: np.ndarray, win: int) -> np.ndarray:
    """Means over windows of ``win`` of a stack of maps [map, h, w], mirrored at the edges, by integral images."""
    r = win // 2
    c = np.pad(np.pad(a, ((0, 0), (r, r), (r, r)), mode="symmetric").cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    return (c[:, win:, win:] - c[:, :-win, win:] - c[:, win:, :-win] + c[:, :-win, :-win]) / (win * win)


def masked_ssim_errors(a: np.ndarray, b: np.ndarray, win: int = 7, least: int = 100) -> np.ndarray:
    """1 - mean structural similarity where both maps of a pair are positive, for stacks [pair, h, w]; 1 where that is under ``least`` cells.

    Each map is scaled by the 1st and 99th percentile of those cells and cut to 0..1. Windows of ``win``, mirrored
    at the edges, sample covariance, a data range of 1.
    """
    mask = (a > 0) & (b > 0)
    cells = mask.sum(axis=(1, 2))
    out = np.ones(len(a))
    some = np.flatnonzero(cells >= least)
    if not len(some):
        return out
    mask, cells = mask[some], cells[some]

    def scaled(m):
        ordered = np.sort(np.where(mask, m, np.inf).reshape(len(m), -1), axis=1)

        def percentile(q):
            at = q * (cells - 1)
            low = np.floor(at).astype(np.int64)
            x, y = (ordered[np.arange(len(m)), i] for i in (low, np.minimum(low + 1, cells - 1)))
            return (x + (y - x) * (at - low))[:, None, None]

        lo, hi = percentile(0.01), percentile(0.99)
        return np.clip((m - lo) / np.maximum(hi - lo, 1e-12), 0, 1)

    x, y = scaled(a[some].astype(np.float64)), scaled(b[some].astype(np.float64))
    n = win * win
    mx, my = box_means(x, win), box_means(y, win)
    vx, vy, vxy = ((box_means(p * q, win) - mp * mq) * n / (n - 1) for p, q, mp, mq in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = 0.01**2, 0.03**2
    ssim = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
    out[some] = 1 - np.where(mask, ssim, 0).sum(axis=(1, 2)) / cells
    return out


def area_weights(size: int, out: int) -> np.ndarray:
    """Share of each input cell in each output cell along an axis."""
    edges = np.arange(out + 1) * size / out
    cells = np.arange(size)
    overlap = np.minimum(edges[1:, None], cells[None, :] + 1) - np.maximum(edges[:-1, None], cells[None, :])
    overlap = np.maximum(overlap, 0)
    return overlap / overlap.sum(axis=1, keepdims=True)


def area_downsample(m: np.ndarray, out: tuple[int, int] = (28, 28)) -> np.ndarray:
    """Maps [.., h, w] scaled by area; an axis has one matrix of weights."""
    return area_weights(m.shape[-2], out[0]) @ m @ area_weights(m.shape[-1], out[1]).T
