"""Many convex polygons at once in NumPy: the kernels of two-dimensional cells that run inside Spark tasks.

A polygon is a ring of vertices, counter-clockwise, and a label for every edge, the one from
a vertex to the next; rings are padded to one length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import polytopes


@dataclass
class Rings:
    """Vertices (N, M, 2), how many of them count, and the edges' labels (N, M)."""

    vertices: np.ndarray
    n: np.ndarray
    labels: np.ndarray

    def valid(self) -> np.ndarray:
        return np.arange(self.labels.shape[1]) < self.n[:, None]

    def radii(self, rows: np.ndarray) -> np.ndarray:
        """Greatest distances of the vertices of some polygons from the origin."""
        x = self.vertices[rows]
        square = x[:, :, 0] ** 2 + x[:, :, 1] ** 2
        return np.sqrt(np.where(np.arange(square.shape[1]) < self.n[rows, None], square, 0.0).max(axis=1))

    def clip(self, rows: np.ndarray, normals: np.ndarray, offsets: np.ndarray, labels: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Cuts some polygons by half planes of unit normals, in place; returns which of ``rows`` lost something.

        A vertex within the tolerance of a line is not beyond it; slack is its absolute part.
        """
        x, n = self.vertices[rows], self.n[rows]
        slots = np.arange(x.shape[1])
        side = x[:, :, 0] * normals[:, :1] + x[:, :, 1] * normals[:, 1:] - offsets[:, None]
        valid = slots < n[:, None]
        size = np.where(valid, np.abs(x).max(axis=2), 0.0).max(axis=1)
        scale = (polytopes.EPS * (np.abs(offsets) + size) + slack)[:, None]
        cut = ((side > scale) & valid).any(axis=1)
        if not cut.any():
            return cut
        x, n, side, scale, valid, old = x[cut], n[cut], side[cut], scale[cut], valid[cut], self.labels[rows[cut]]
        new = labels[cut, None]
        at = np.where(slots + 1 < n[:, None], slots + 1, 0)
        out = side > scale
        next_side = np.take_along_axis(side, at, axis=1)
        leaves, enters = valid & ~out & (next_side > scale), valid & out & (next_side <= scale)
        on = np.abs(side) <= scale
        made = (leaves & ~on) | (enters & (np.abs(next_side) > scale))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(made, side / (side - next_side), 0.0)[:, :, None]
        point = x + t * (np.take_along_axis(x, at[:, :, None], axis=1) - x)
        k, m = old.shape
        kept = np.stack([valid & ~out, made], axis=2).reshape(k, 2 * m)
        points = np.stack([x, point], axis=2).reshape(k, 2 * m, 2)
        named = np.stack([np.where(leaves & on, new, old), np.where(leaves, new, old)], axis=2).reshape(k, 2 * m)
        count = kept.sum(axis=1)
        most = int(count.max())
        if most > m:
            self.vertices = np.pad(self.vertices, ((0, 0), (0, most - m), (0, 0)))
            self.labels = np.pad(self.labels, ((0, 0), (0, most - m)))
        r, c = np.nonzero(kept)
        place = (np.cumsum(kept, axis=1) - 1)[r, c]
        rows = rows[cut]
        self.vertices[rows[r], place], self.labels[rows[r], place], self.n[rows] = points[r, c], named[r, c], count
        return cut


def boxes(lo: np.ndarray, hi: np.ndarray, labels=(polytopes.BOUNDARY,) * 4) -> Rings:
    """Rectangles; labels are those of the low and high sides of axis 0, then of axis 1."""
    x = np.stack([lo, np.stack([hi[:, 0], lo[:, 1]], axis=1), hi, np.stack([lo[:, 0], hi[:, 1]], axis=1)], axis=1)
    return Rings(x.astype(float), np.full(len(x), 4), np.tile(np.array([labels[2], labels[1], labels[3], labels[0]], np.int64), (len(x), 1)))


@dataclass
class Nodes:
    """Quadrature nodes (T, Q, 2) and weights (T, Q), Q of them for each of T parts; ``of`` is a part's polygon, or its edge."""

    of: np.ndarray
    x: np.ndarray
    w: np.ndarray


def _simplex_nodes(of: np.ndarray, corners: np.ndarray, measure: np.ndarray, degree: int) -> Nodes:
    nodes, weights = polytopes._grundmann_moeller(degree, corners.shape[1] - 1)
    return Nodes(of, np.einsum("qk,tkd->tqd", nodes, corners), measure[:, None] * weights)


def _edges(rings: Rings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polygon, slot, start and end of every edge of the polygons with an inside."""
    k, i = np.nonzero(rings.valid() & (rings.n > 2)[:, None])
    return k, i, rings.vertices[k, i], rings.vertices[k, np.where(i + 1 < rings.n[k], i + 1, 0)]


def inside_nodes(rings: Rings, degree: int) -> Nodes:
    """Nodes over the polygons' insides, exact for polynomials of total degree at most ``degree``."""
    k, i, a, b = _edges(rings)
    inner = (i > 0) & (i + 1 < rings.n[k])
    k, corners = k[inner], np.stack([rings.vertices[k[inner], 0], a[inner], b[inner]], axis=1)
    e, f = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    return _simplex_nodes(k, corners, np.abs(e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]) / 2, degree)


def edge_nodes(rings: Rings, degree: int) -> tuple[np.ndarray, np.ndarray, Nodes]:
    """Polygon and label of every edge that has a label, and nodes over these edges."""
    k, i, a, b = _edges(rings)
    own = rings.labels[k, i] >= 0
    k, i, a, b = k[own], i[own], a[own], b[own]
    return k, rings.labels[k, i], _simplex_nodes(np.arange(len(k)), np.stack([a, b], axis=1), np.sqrt(((b - a) ** 2).sum(axis=1)), degree)


def disk_nodes(rings: Rings, radii: np.ndarray, degree: int) -> tuple[list[Nodes], Nodes, tuple[np.ndarray, np.ndarray, Nodes]]:
    """What polytopes.disk_part gives, of polygons in disks around the origin: nodes inside, over the arcs, and over the labelled edges' stretches."""
    line, turn = np.polynomial.legendre.leggauss(degree // 2 + 2), np.polynomial.legendre.leggauss(14 + 2 * degree)
    k, i, a, b = _edges(rings)
    d, r = b - a, radii[k]
    square, middle = (d * d).sum(axis=1), (a * d).sum(axis=1)
    disc = middle * middle - square * ((a * a).sum(axis=1) - r * r)
    met = (square > 0) & (disc > 0)
    root, below = np.sqrt(np.where(met, disc, 0.0)), np.where(met, square, 1.0)
    ends = [np.zeros(len(k)), *[np.where(met, np.clip((s * root - middle) / below, 0.0, 1.0), 0.0) for s in (-1, 1)], np.ones(len(k))]
    s, t = np.stack(ends[:-1], axis=1), np.stack(ends[1:], axis=1)
    e, c = np.nonzero(t > s)
    p, q = a[e] + s[e, c, None] * d[e], a[e] + t[e, c, None] * d[e]
    k, label, r = k[e], rings.labels[k[e], i[e]], r[e]
    cross, half = p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0], (p + q) / 2
    within = (half * half).sum(axis=1) <= r * r
    triangles = _simplex_nodes(k[within], np.stack([np.zeros_like(p), p, q], axis=1)[within], cross[within] / 2, degree)
    out, r = ~within, r[~within]
    angle, start = np.arctan2(cross[out], (p[out] * q[out]).sum(axis=1)), np.arctan2(p[out, 1], p[out, 0])
    theta = start[:, None] + angle[:, None] * (1 + turn[0]) / 2
    ring, ring_weights = np.stack([np.cos(theta), np.sin(theta)], axis=2), turn[1] / 2 * angle[:, None]
    rho, rho_weights = r[:, None] * (1 + line[0]) / 2, line[1] / 2 * r[:, None]
    T, Q = len(r), len(line[0]) * len(turn[0])
    sectors = Nodes(k[out], (rho[:, :, None, None] * ring[:, None]).reshape(T, Q, 2), ((rho_weights * rho)[:, :, None] * ring_weights[:, None]).reshape(T, Q))
    arcs = Nodes(k[out], r[:, None, None] * ring, ring_weights * r[:, None])
    own = within & (label >= 0)
    p, q = p[own], q[own]
    x = (1 - line[0])[:, None] / 2 * p[:, None] + (1 + line[0])[:, None] / 2 * q[:, None]
    stretch = Nodes(np.arange(len(p)), x, line[1] / 2 * np.sqrt(((q - p) ** 2).sum(axis=1))[:, None])
    return [triangles, sectors], arcs, (k[own], label[own], stretch)
