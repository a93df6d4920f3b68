"""Cells and polygons as columns: arrays of coordinates, cuts as structs (normal, offset)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays


def axis_values(points: Column, d: int) -> Column:
    return F.transform(points, lambda p: F.get(p, F.lit(d)))


def box_corners(sizes: list[Column]) -> Column:
    """The 2**d corners of a box from the origin; bit k of a corner's place says whether it is at the far end of axis k."""
    corners = [[size if c >> k & 1 else F.lit(0.0) for k, size in enumerate(sizes)] for c in range(1 << len(sizes))]
    return F.array(*[F.array(*corner) for corner in corners])


def box_cuts(sizes: list[Column]) -> Column:
    """The 2d cuts of a box from the origin."""
    cuts = []
    for k, size in enumerate(sizes):
        for sign, offset in ((-1.0, F.lit(0.0)), (1.0, size)):
            normal = F.array(*[F.lit(sign if j == k else 0.0) for j in range(len(sizes))])
            cuts.append(F.struct(normal.alias("normal"), offset.alias("offset")))
    return F.array(*cuts)


def contains(cuts: Column, point: Column) -> Column:
    """Whether no cut has the point outside; points on a cut are inside."""
    return F.forall(cuts, lambda c: arrays.dot(c["normal"], point) <= c["offset"])


def plane_gaps(points: Column, normal: Column, offset: Column) -> Column:
    """normal . x - offset of every point."""
    return F.transform(points, lambda p: arrays.dot(p, normal) - offset)


def _around(values: Column, i: Column) -> Column:
    return F.get(values, F.pmod(i, F.size(values)))


def polygon_facets(xs: Column, ys: Column) -> Column:
    """The length of every side of a polygon; side k goes from corner k to the next."""

    def length(k: Column) -> Column:
        dx, dy = _around(xs, k + 1) - F.get(xs, k), _around(ys, k + 1) - F.get(ys, k)
        return F.sqrt(dx * dx + dy * dy)

    return F.transform(F.sequence(F.lit(0), F.size(xs) - 1), length)


def fan_areas(xs: Column, ys: Column) -> Column:
    """Areas of the triangles that fan out from a polygon's first corner."""

    def area(k: Column) -> Column:
        side = lambda i: [F.get(xs, i) - F.get(xs, F.lit(0)), F.get(ys, i) - F.get(ys, F.lit(0))]
        return F.abs(arrays.determinant([side(k), side(k + 1)])) / 2

    return F.transform(F.sequence(F.lit(1), F.size(xs) - 2), area)


def shoelace_gradient(xs: Column, ys: Column) -> Column:
    """The gradient of a counter-clockwise polygon's area: a struct (dx, dy) for every corner."""

    def corner(k: Column) -> Column:
        dx = (_around(ys, k + 1) - _around(ys, k - 1)) / 2
        dy = (_around(xs, k - 1) - _around(xs, k + 1)) / 2
        return F.struct(dx.alias("dx"), dy.alias("dy"))

    return F.transform(F.sequence(F.lit(0), F.size(xs) - 1), corner)


def multi_index(place: Column, shape: list[int]) -> list[Column]:
    """The row-major index of a place in a product of ranges."""
    out, rest = [], place
    for size in reversed(shape):
        out.append(rest % size)
        rest = F.floor(rest / size)
    return out[::-1]
