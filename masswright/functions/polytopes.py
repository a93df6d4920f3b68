"""Convex cells in NumPy: the small per-cell kernels that run inside Spark tasks.

A cell is its vertices (n x d) and, for each, the sorted cuts it lies on; cuts are planes
``normal . x <= offset`` with ids: a neighbour's id, BOUNDARY, or INFINITE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np

BOUNDARY, INFINITE = -1, -2
EPS = 1e-12


@dataclass
class Polytope:
    normals: np.ndarray
    offsets: np.ndarray
    ids: list[int]
    vertices: np.ndarray
    on: list[frozenset[int]]

    @property
    def dim(self) -> int:
        return self.normals.shape[1]

    @property
    def closed(self) -> bool:
        used = frozenset().union(*self.on) if self.on else frozenset()
        return all(self.ids[k] != INFINITE for k in used)

    @property
    def empty(self) -> bool:
        return len(self.vertices) <= self.dim


def parallelepiped(origin, axes, cut_id: int = BOUNDARY) -> Polytope:
    """From an origin and d axis vectors (rows): 2d planes and 2**d vertices."""
    origin, axes = np.asarray(origin, float), np.asarray(axes, float)
    d = len(origin)
    inner = np.linalg.inv(axes)  # columns are normals of the faces
    normals, offsets = [], []
    for k in range(d):
        n = inner[:, k]
        low = float(n @ origin)
        normals += [-n, n]
        offsets += [-low, low + 1.0]
    corners = [[(c >> k) & 1 for k in range(d)] for c in range(1 << d)]
    vertices = origin + np.array(corners, float) @ axes
    on = [frozenset(2 * k + bit for k, bit in enumerate(c)) for c in corners]
    return Polytope(np.array(normals), np.array(offsets), [cut_id] * (2 * d), vertices, on)


def box(lo, hi, cut_id: int = BOUNDARY) -> Polytope:
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    return parallelepiped(lo, np.diag(hi - lo), cut_id)


def unbounded(dim: int, size: float = 1e9) -> Polytope:
    """A huge box with INFINITE cuts: open until they are all cut off."""
    return box([-size] * dim, [size] * dim, INFINITE)


def edges(cell: Polytope) -> list[tuple[int, int]]:
    """Pairs of vertices that share at least dim - 1 cuts."""
    n, d = len(cell.on), cell.dim
    return [(i, j) for i, j in combinations(range(n), 2) if len(cell.on[i] & cell.on[j]) >= d - 1]


def clip(cell: Polytope, normal, offset: float, cut_id: int) -> Polytope:
    """The part of the cell with normal . x <= offset."""
    normal = np.asarray(normal, float)
    if not len(cell.vertices):
        return cell
    side = cell.vertices @ normal - offset
    scale = EPS * (1.0 + abs(offset) + float(np.abs(cell.vertices).max()) * float(np.abs(normal).max()))
    out = side > scale
    if not out.any():
        return cell
    normals, offsets, ids = np.vstack([cell.normals, normal]), np.append(cell.offsets, offset), [*cell.ids, cut_id]
    new = len(cell.ids)
    if out.all():
        return Polytope(normals, offsets, ids, np.zeros((0, cell.dim)), [])
    points, on = [], []
    for i in np.flatnonzero(~out):
        points.append(cell.vertices[i])
        on.append(cell.on[i] | {new} if abs(side[i]) <= scale else cell.on[i])
    for i, j in edges(cell):
        if out[i] == out[j]:
            continue
        if out[i]:
            i, j = j, i
        if abs(side[i]) <= scale:
            continue
        t = side[i] / (side[i] - side[j])
        points.append(cell.vertices[i] + t * (cell.vertices[j] - cell.vertices[i]))
        on.append((cell.on[i] & cell.on[j]) | {new})
    return Polytope(normals, offsets, ids, np.array(points), on)


def ring(cell: Polytope) -> np.ndarray:
    """Indices of a polygon's vertices, counter-clockwise."""
    c = cell.vertices.mean(axis=0)
    return np.argsort(np.arctan2(cell.vertices[:, 1] - c[1], cell.vertices[:, 0] - c[0]), kind="stable")


def facets(cell: Polytope) -> list[tuple[int, np.ndarray]]:
    """(cut, vertex indices) of every facet."""
    out = []
    for k in sorted(frozenset().union(*cell.on)) if cell.on else []:
        members = np.array([i for i, s in enumerate(cell.on) if k in s])
        if len(members) >= cell.dim:
            out.append((k, members))
    return out


def _fan(cell: Polytope, members: tuple[int, ...], used: frozenset[int], dim: int) -> list[tuple[int, ...]]:
    """Simplices of the face of dimension ``dim`` that has these vertices and lies on the used cuts: an apex joined to the faces without it."""
    if dim == 0:
        return [members[:1]]
    apex, found, seen = members[0], [], set()
    for k in sorted(frozenset().union(*[cell.on[i] for i in members]) - used):
        face = tuple(i for i in members if k in cell.on[i])
        if apex in face or len(face) < dim or face in seen or len(face) == len(members):
            continue
        seen.add(face)
        found += [(apex, *s) for s in _fan(cell, face, used | {k}, dim - 1)]
    return found


def simplices(cell: Polytope) -> list[np.ndarray]:
    """Vertex index sets of a triangulation: fans over faces of falling dimension."""
    if cell.empty:
        return []
    return [np.array(s) for s in _fan(cell, tuple(range(len(cell.vertices))), frozenset(), cell.dim) if len(s) == cell.dim + 1]


def simplex_volume(points: np.ndarray) -> float:
    """Volume of a simplex, also of lower dimension than its space."""
    e = points[1:] - points[0]
    k = len(e)
    if k == points.shape[1]:
        return abs(float(np.linalg.det(e))) / factorial(k)
    return float(np.sqrt(max(0.0, np.linalg.det(e @ e.T)))) / factorial(k)


def measure(cell: Polytope) -> float:
    if cell.empty:
        return 0.0
    if not cell.closed:
        return float(np.finfo(float).max)
    if cell.dim == 2:
        x, y = cell.vertices[ring(cell)].T
        return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2
    return sum(simplex_volume(cell.vertices[s]) for s in simplices(cell))


def centroid(cell: Polytope) -> np.ndarray:
    parts = [(simplex_volume(cell.vertices[s]), cell.vertices[s].mean(axis=0)) for s in simplices(cell)]
    return sum(v * c for v, c in parts) / sum(v for v, _ in parts)


def facet_simplices(cell: Polytope, members: np.ndarray, cut: int) -> list[np.ndarray]:
    """Simplices of dimension dim - 1 that make up a facet."""
    fans = _fan(cell, tuple(members.tolist()), frozenset([cut]), cell.dim - 1)
    return [cell.vertices[list(s)] for s in fans if len(s) == cell.dim]


def _grundmann_moeller(degree: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Barycentric nodes and weights (summing to 1) exact up to ``degree`` on k-simplices."""
    s = max(0, (degree - 1 + 1) // 2)
    nodes, weights = [], []
    for i in range(s + 1):
        w = (-1) ** i * 2.0 ** (-2 * s) * (k + 2 * s + 1 - 2 * i) ** (2 * s + 1) / (factorial(i) * factorial(k + 2 * s + 1 - i)) * factorial(k)
        for beta in _compositions(s - i, k + 1):
            nodes.append([(2 * b + 1) / (k + 2 * s + 1 - 2 * i) for b in beta])
            weights.append(w)
    return np.array(nodes), np.array(weights)


def _compositions(total: int, parts: int):
    if parts == 1:
        yield (total,)
        return
    for first in range(total + 1):
        for rest in _compositions(total - first, parts - 1):
            yield (first, *rest)


def integrate(simplex: np.ndarray, f: Callable[[np.ndarray], np.ndarray], degree: int) -> float:
    """Integral over a simplex of a polynomial of total degree at most ``degree``; f maps (n, d) to (n,)."""
    k = len(simplex) - 1
    if k == 0:
        return float(f(simplex)[0])
    nodes, weights = _grundmann_moeller(degree, k)
    return float(weights @ f(nodes @ simplex)) * simplex_volume(simplex)


def quadrature(parts: list[np.ndarray], degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights over simplices of one dimension, exact for polynomials of total degree at most ``degree``."""
    if not parts:
        return np.zeros((0, 1)), np.zeros(0)
    k = len(parts[0]) - 1
    if k == 0:
        return np.concatenate(parts), np.ones(len(parts))
    nodes, weights = _grundmann_moeller(degree, k)
    return np.concatenate([nodes @ p for p in parts]), np.concatenate([weights * simplex_volume(p) for p in parts])


@dataclass
class DiskPart:
    """Quadrature (nodes, weights) over the part of a polygon in a disk, over the circle's arcs in the polygon, and over every edge's stretch in the disk."""

    inside: tuple[np.ndarray, np.ndarray]
    arcs: tuple[np.ndarray, np.ndarray]
    edges: list[tuple[np.ndarray, np.ndarray]]


def disk_part(points: np.ndarray, center: np.ndarray, radius: float, degree: int) -> DiskPart:
    """The part of a counter-clockwise polygon inside a disk, for polynomials of total degree at most ``degree``.

    The polygon is the signed sum of the triangles from the centre to its edges; of each,
    the stretch of the edge inside the disk gives a triangle and the rest a sector.
    Sectors are integrated in polar coordinates, to rounding.
    """
    line = np.polynomial.legendre.leggauss(degree // 2 + 2)
    turn = np.polynomial.legendre.leggauss(14 + 2 * degree)
    tri, tri_weights = _grundmann_moeller(degree, 2)
    nodes, weights, arc_nodes, arc_weights, edges = [np.zeros((0, 2))], [np.zeros(0)], [np.zeros((0, 2))], [np.zeros(0)], []
    for a, b in zip(points - center, np.roll(points, -1, axis=0) - center, strict=True):
        d = b - a
        square, middle = float(d @ d), float(a @ d)
        disc = middle * middle - square * (float(a @ a) - radius * radius)
        cuts = [0.0, 1.0]
        if square > 0 and disc > 0:
            cuts += [t for t in ((-middle - disc**0.5) / square, (-middle + disc**0.5) / square) if 0 < t < 1]
        cuts.sort()
        kept = (np.zeros((0, 2)), np.zeros(0))
        for s, t in zip(cuts[:-1], cuts[1:], strict=True):
            p, q = a + s * d, a + t * d
            cross = float(p[0] * q[1] - p[1] * q[0])
            half = (p + q) / 2
            if half @ half <= radius * radius:
                nodes.append(tri @ np.stack([np.zeros(2), p, q]))
                weights.append(tri_weights * cross / 2)
                kept = (np.outer((1 - line[0]) / 2, p) + np.outer((1 + line[0]) / 2, q) + center, line[1] / 2 * np.linalg.norm(q - p))
                continue
            angle, start = np.arctan2(cross, p @ q), np.arctan2(p[1], p[0])
            theta = start + angle * (1 + turn[0]) / 2
            ring, ring_weights = np.stack([np.cos(theta), np.sin(theta)], axis=1), turn[1] / 2 * angle
            rho, rho_weights = radius * (1 + line[0]) / 2, line[1] / 2 * radius
            nodes.append((rho[:, None, None] * ring).reshape(-1, 2))
            weights.append(np.outer(rho_weights * rho, ring_weights).ravel())
            arc_nodes.append(radius * ring)
            arc_weights.append(ring_weights * radius)
        edges.append(kept)
    return DiskPart((np.concatenate(nodes) + center, np.concatenate(weights)), (np.concatenate(arc_nodes) + center, np.concatenate(arc_weights)), edges)


def shoelace_gradient(vertices: np.ndarray) -> np.ndarray:
    """Gradient of a counter-clockwise polygon's area with respect to its vertices."""
    before, after = np.roll(vertices, 1, axis=0), np.roll(vertices, -1, axis=0)
    return np.stack([after[:, 1] - before[:, 1], before[:, 0] - after[:, 0]], axis=1) / 2


def frame_gradient(origin, axes, d_vertices, d_normals, d_offsets) -> tuple[np.ndarray, np.ndarray]:
    """Pulls gradients on a parallelepiped's vertices, normals and offsets back to its origin and axes."""
    origin, axes = np.asarray(origin, float), np.asarray(axes, float)
    d = len(origin)
    inner = np.linalg.inv(axes)
    corners = np.array([[(c >> k) & 1 for k in range(d)] for c in range(1 << d)], float)
    g_origin, g_axes = d_vertices.sum(axis=0), corners.T @ d_vertices
    g_inner = np.zeros((d, d))
    for k in range(d):
        swing = d_offsets[2 * k + 1] - d_offsets[2 * k]
        g_inner[:, k] = d_normals[2 * k + 1] - d_normals[2 * k] + swing * origin
        g_origin = g_origin + swing * inner[:, k]
    return g_origin, g_axes - inner.T @ g_inner @ inner.T
