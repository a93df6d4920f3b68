"""Column helpers for small vectors, matrices and polygons held in ``array<double>``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column | float) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


def zip_op(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, op)


def add(a: Column, b: Column) -> Column:
    return zip_op(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return zip_op(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * _double(k))


def fold(a: Column, start: float, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, F.lit(float(start)), lambda s, x: op(s, x.cast("double")))


def total(a: Column) -> Column:
    return fold(a, 0.0, lambda s, x: s + x)


def product(a: Column) -> Column:
    return fold(a, 1.0, lambda s, x: s * x)


def dot(a: Column, b: Column) -> Column:
    return total(zip_op(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm2(a: Column) -> Column:
    """Squared Euclidean norm."""
    return dot(a, a)


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x / length)


def floors(a: Column) -> Column:
    return F.transform(a, lambda x: F.floor(x).cast("double"))


def ceils(a: Column) -> Column:
    return F.transform(a, lambda x: F.ceil(x).cast("double"))


def with_value_at(a: Column, k: int, value: Column | float) -> Column:
    return F.transform(a, lambda x, i: F.when(i == k, _double(value)).otherwise(x))


def with_pushed_value(a: Column, value: Column | float) -> Column:
    return F.concat(a, F.array(_double(value)))


def without_index(a: Column, k: int) -> Column:
    return F.filter(a, lambda x, i: i != k)


def repeated(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def arg_max(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def all_equal(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)


Matrix = Sequence[Sequence[Column]]


def minor(m: Matrix, row: int, col: int) -> list[list[Column]]:
    return [[v for j, v in enumerate(r) if j != col] for i, r in enumerate(m) if i != row]


def determinant(m: Matrix) -> Column:
    """Expanded along the first row; for the small fixed sizes of geometry."""
    if len(m) == 1:
        return m[0][0]
    terms = [(1 if j % 2 == 0 else -1) * m[0][j] * determinant(minor(m, 0, j)) for j in range(len(m))]
    return reduce(lambda a, b: a + b, terms)


def solve(m: Matrix, rhs: Sequence[Column]) -> list[Column]:
    """By determinants; null where the matrix is singular."""
    d = determinant(m)
    replaced = [[[rhs[i] if j == k else v for j, v in enumerate(r)] for i, r in enumerate(m)] for k in range(len(m))]
    return [F.when(d != 0, determinant(r) / d) for r in replaced]


def inverse(m: Matrix) -> list[list[Column]]:
    d, n = determinant(m), len(m)
    if n == 1:
        return [[F.when(d != 0, 1 / d)]]
    return [[F.when(d != 0, (1 if (i + j) % 2 == 0 else -1) * determinant(minor(m, j, i)) / d) for j in range(n)] for i in range(n)]


def horner(coeffs: Column, x: Column) -> Column:
    """Value of a polynomial with ascending coefficients."""
    return F.aggregate(F.reverse(coeffs), F.lit(0.0), lambda s, c: s * x + c)


def grid_exponents(order: int, dim: int) -> list[tuple[int, ...]]:
    """Exponents of the tensor basis, last axis fastest."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(dim):
        out = [e + (k,) for e in out for k in range(order + 1)]
    return out


def piece_integral(coeffs: Column, lo: Column, hi: Column, order: int, dim: int) -> Column:
    """Integral over a box of a polynomial in the tensor basis."""
    terms = []
    for k, powers in enumerate(grid_exponents(order, dim)):
        term = F.get(coeffs, F.lit(k))
        for axis, e in enumerate(powers):
            a, b = F.get(lo, F.lit(axis)), F.get(hi, F.lit(axis))
            term = term * (F.pow(b, F.lit(float(e + 1))) - F.pow(a, F.lit(float(e + 1)))) / (e + 1)
        terms.append(term)
    return reduce(lambda a, b: a + b, terms)


def polynomial_value(coeffs: Column, point: Column, order: int, dim: int) -> Column:
    terms = []
    for k, powers in enumerate(grid_exponents(order, dim)):
        term = F.get(coeffs, F.lit(k))
        for axis, e in enumerate(powers):
            term = term * F.pow(F.get(point, F.lit(axis)), F.lit(float(e))) if e else term
        terms.append(term)
    return reduce(lambda a, b: a + b, terms)


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed area of a polygon, positive if counter-clockwise."""
    n = F.size(xs)
    crosses = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(xs, i) * F.get(ys, F.pmod(i + 1, n)) - F.get(xs, F.pmod(i + 1, n)) * F.get(ys, i),
    )
    return total(crosses) / 2
