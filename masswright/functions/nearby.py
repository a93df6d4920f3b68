"""Searches among the points of one task, by halving them until few are left."""

from __future__ import annotations

import numpy as np

#: Rows that are searched for together in the end.
BLOCK = 64


def _halves(pos: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows on both sides of the median of the longest axis; one part if all are at one place."""
    x = pos[rows]
    extent = x.max(axis=0) - x.min(axis=0)
    axis = int(np.argmax(extent))
    if not extent[axis] > 0:
        return [rows]
    order = np.argpartition(x[:, axis], len(rows) // 2)
    return [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def nearest(pos: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` near positions of every row and their distances, padded by -1 and infinity, and a distance below which none is missing.

    The row itself is among them.  What a block of rows leaves out is farther from its box
    than the sites that it keeps, so the time grows with the rows, not with their square.
    """
    dim = pos.shape[1]
    near, gaps, full = np.full((len(rows), k), -1), np.full((len(rows), k), np.inf), np.full(len(rows), np.inf)
    todo = [(np.arange(len(rows)), np.arange(len(pos)), np.inf)]
    own_pos = pos[rows]
    while todo:
        own, others, seen = todo.pop()
        if not len(own):
            continue
        x, y = own_pos[own], pos[others]
        lo, hi = x.min(axis=0), x.max(axis=0)
        gap = np.zeros(len(others))
        for d in range(dim):
            g = np.maximum(0.0, np.maximum(lo[d] - y[:, d], y[:, d] - hi[d]))
            gap += g * g
        keep = 2 * int((gap == 0).sum()) + 8 * k
        if keep < len(others):
            order = np.argpartition(gap, keep)
            seen = min(seen, float(np.sqrt(gap[order[keep]])))
            others = np.sort(others[order[:keep]])
            y = pos[others]
        if len(own) > BLOCK:
            parts = _halves(own_pos, own)
            if len(parts) == 1:
                parts = np.array_split(own, len(own) // BLOCK + 1)
            todo += [(part, others, seen) for part in parts]
            continue
        square = np.zeros((len(own), len(others)))
        for d in range(dim):
            g = x[:, d, None] - y[:, d]
            square += g * g
        m = min(k, len(others))
        at = np.sort(np.argpartition(square, m - 1, axis=1)[:, :m], axis=1) if m < len(others) else np.tile(np.arange(m), (len(own), 1))
        found = np.take_along_axis(square, at, axis=1)
        near[own, :m], gaps[own, :m] = others[at], np.sqrt(found)
        full[own] = np.minimum(seen, np.sqrt(found.max(axis=1)) if m < len(others) else np.inf)
    return near, gaps, full


def best_sites(pos: np.ndarray, sites: np.ndarray, weights: np.ndarray, brute, slack: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """What ``brute(pos, sites, weights)`` gives, index and cost of the best site of every position, the first of equal ones.

    Positions are halved; a site stays with a half if it may beat, somewhere in its box, the
    site that is best at the box's centre.  The difference of two costs is linear in the
    position, so its least value is at a corner.
    """
    best, cost = np.zeros(len(pos), np.int64), np.full(len(pos), np.nan)
    real = np.isfinite(pos).all(axis=1)
    odd = np.flatnonzero(~real & ~np.isnan(pos).any(axis=1))
    if len(odd):
        best[odd], cost[odd] = brute(pos[odd], sites, weights)
    size = max(float(np.abs(pos[real]).max(initial=0.0)), float(np.abs(sites).max(initial=0.0)))
    slack *= 1.0 + 4 * pos.shape[1] * size * size + float(np.abs(weights).max(initial=0.0))
    square = (sites * sites).sum(axis=1) - weights
    todo = [(np.flatnonzero(real), np.arange(len(sites)))]
    while todo:
        rows, left = todo.pop()
        if not len(rows):
            continue
        x = pos[rows]
        lo, hi = x.min(axis=0), x.max(axis=0)
        if len(left) > 1:
            p = sites[left]
            middle = (lo + hi) / 2
            rival = left[np.argmin(square[left] - 2 * p @ middle)]
            step = p - sites[rival]
            least = square[left] - square[rival] - 2 * np.where(step > 0, step * hi, step * lo).sum(axis=1)
            left = left[least <= slack]
        parts = _halves(pos, rows) if len(left) > 4 and len(rows) > BLOCK else [rows]
        if len(parts) == 1:
            at, cost[rows] = brute(x, sites[left], weights[left])
            best[rows] = left[at]
        else:
            todo += [(part, left) for part in parts]
    return best, cost
