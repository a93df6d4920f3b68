"""Truncated Taylor jets, dense polynomials and small solvers (driver- and task-side helpers)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np


class Jet:
    """A multivariate Taylor polynomial truncated at a total order: {exponents: coefficient}."""

    def __init__(self, terms: dict[tuple[int, ...], float], dim: int, order: int):
        self.dim, self.order = dim, order
        self.terms = {e: float(c) for e, c in terms.items() if sum(e) <= order}

    @classmethod
    def constant(cls, value: float, dim: int, order: int) -> Jet:
        return cls({(0,) * dim: value}, dim, order)

    @classmethod
    def variable(cls, k: int, dim: int, order: int, at: float = 0.0) -> Jet:
        return cls({(0,) * dim: at, tuple(int(i == k) for i in range(dim)): 1.0}, dim, order)

    def _lift(self, other) -> Jet:
        return other if isinstance(other, Jet) else Jet.constant(other, self.dim, self.order)

    @property
    def value(self) -> float:
        return self.terms.get((0,) * self.dim, 0.0)

    def coefficient(self, *exponents: int) -> float:
        return self.terms.get(tuple(exponents), 0.0)

    def derivative(self, *axes: int) -> float:
        """The partial derivative at the expansion point along the given axes."""
        e = tuple(axes.count(k) for k in range(self.dim))
        return self.coefficient(*e) * float(np.prod([np.prod(np.arange(1, n + 1)) for n in e]))

    def __add__(self, other) -> Jet:
        out = dict(self.terms)
        for e, c in self._lift(other).terms.items():
            out[e] = out.get(e, 0.0) + c
        return Jet(out, self.dim, self.order)

    __radd__ = __add__

    def __neg__(self) -> Jet:
        return Jet({e: -c for e, c in self.terms.items()}, self.dim, self.order)

    def __sub__(self, other) -> Jet:
        return self + (-self._lift(other))

    def __rsub__(self, other) -> Jet:
        return self._lift(other) - self

    def __mul__(self, other) -> Jet:
        out: dict[tuple[int, ...], float] = {}
        for (e, a), (f, b) in product(self.terms.items(), self._lift(other).terms.items()):
            if sum(e) + sum(f) <= self.order:
                k = tuple(x + y for x, y in zip(e, f, strict=True))
                out[k] = out.get(k, 0.0) + a * b
        return Jet(out, self.dim, self.order)

    __rmul__ = __mul__

    def compose(self, series: Sequence[float]) -> Jet:
        """sum of series[k] * (self - value) ** k: a function's Taylor series at self.value."""
        shift, out = self - self.value, Jet.constant(0.0, self.dim, self.order)
        for c in reversed(series[: self.order + 1]):
            out = out * shift + c
        return out

    def reciprocal(self) -> Jet:
        return self.compose([(-1) ** k / self.value ** (k + 1) for k in range(self.order + 1)])

    def __truediv__(self, other) -> Jet:
        return self * self._lift(other).reciprocal()

    def __rtruediv__(self, other) -> Jet:
        return self._lift(other) / self

    def sqrt(self) -> Jet:
        series, c = [], self.value**0.5
        for k in range(self.order + 1):
            series.append(c)
            c *= (0.5 - k) / (k + 1) / self.value
        return self.compose(series)

    def __pow__(self, n: int) -> Jet:
        out = Jet.constant(1.0, self.dim, self.order)
        for _ in range(n):
            out = out * self
        return out

    def __lt__(self, other) -> bool:
        return self.value < self._lift(other).value

    def __call__(self, *x: float) -> float:
        return sum(c * float(np.prod([v**k for v, k in zip(x, e, strict=True)])) for e, c in self.terms.items())


class DensePolynomial:
    """A polynomial of total order as full tensors: tensors[k] has k axes of the dimension."""

    def __init__(self, tensors: Sequence[np.ndarray], dim: int):
        self.tensors, self.dim = [np.asarray(t, float).reshape((dim,) * k) for k, t in enumerate(tensors)], dim

    @staticmethod
    def size_for(dim: int, order: int) -> int:
        return sum(dim**k for k in range(order + 1))

    def truncate(self, order: int) -> DensePolynomial:
        return DensePolynomial(self.tensors[: order + 1], self.dim)

    def __call__(self, x) -> float:
        x, total = np.asarray(x, float), 0.0
        for t in self.tensors:
            for _ in range(t.ndim):
                t = t @ x
            total += float(t)
        return total

    def gradient(self, x) -> np.ndarray:
        x, out = np.asarray(x, float), np.zeros(self.dim)
        for t in self.tensors[1:]:
            for axis in range(t.ndim):
                g = np.moveaxis(t, axis, 0)
                for _ in range(t.ndim - 1):
                    g = g @ x
                out += g
        return out

    def hessian(self, x, step: float = 1e-6) -> np.ndarray:
        eye = np.eye(self.dim) * step
        return np.stack([(self.gradient(x + e) - self.gradient(x - e)) / (2 * step) for e in eye])

    def argmin(self, start=None, tol: float = 1e-10, iterations: int = 100) -> np.ndarray:
        """Newton's method with halving, gradient steps where the Hessian is not positive."""
        x = np.zeros(self.dim) if start is None else np.asarray(start, float)
        for _ in range(iterations):
            g = self.gradient(x)
            if np.linalg.norm(g) < tol:
                break
            h = self.hessian(x)
            step = -np.linalg.solve(h, g) if np.linalg.eigvalsh((h + h.T) / 2)[0] > 1e-12 else -g
            t = 1.0
            while self(x + t * step) > self(x) and t > 1e-12:
                t /= 2
            x = x + t * step
        return x


def bisect_largest_inside(f: Callable[[float], bool], lo: float, hi: float, steps: int = 60) -> float:
    """The largest t in [lo, hi] up to which f holds, for f true at lo."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return lo


def minimize_lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x, iterations: int = 50, tol: float = 1e-7, history: int = 15, on_step: Callable | None = None) -> np.ndarray:
    """Two-loop L-BFGS with backtracking; loss returns value and gradient."""
    x = np.asarray(x, float)
    value, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(iterations):
        if np.abs(g).max() < tol:
            break
        d, alphas = -g.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s.ravel() @ d.ravel() / (s.ravel() @ y.ravel()))
            d -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            d *= (s.ravel() @ y.ravel()) / (y.ravel() @ y.ravel())
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d += (a - y.ravel() @ d.ravel() / (s.ravel() @ y.ravel())) * s
        t, slope = 1.0, float(d.ravel() @ g.ravel())
        while True:
            new = x + t * d
            new_value, new_g = loss(new)
            if new_value <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        if (new_g - g).ravel() @ (new - x).ravel() > 1e-14:
            pairs = [*pairs, (new - x, new_g - g)][-history:]
        x, value, g = new, new_value, new_g
        if on_step:
            on_step(k, x, value)
    return x


def minimize_sgd(loss: Callable, x, rate: float = 0.01, steps: int = 2000) -> np.ndarray:
    x = np.asarray(x, float)
    for _ in range(steps):
        x = x - rate * loss(x)[1]
    return x


def conjugate_gradient(rows, cols, vals, rhs, tol: float = 1e-11, iterations: int | None = None) -> np.ndarray:
    """Jacobi-preconditioned conjugate gradients on a symmetric matrix of triplets; repeated entries add up."""
    rows, cols, vals, rhs = np.asarray(rows), np.asarray(cols), np.asarray(vals, float), np.asarray(rhs, float)
    n = len(rhs)
    diag = np.zeros(n)
    on = rows == cols
    np.add.at(diag, rows[on], vals[on])
    diag = np.where(diag == 0, 1.0, diag)

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, vals * x[cols], n)

    x = np.zeros(n)
    r = rhs.copy()
    z = r / diag
    p, rz = z.copy(), float(r @ z)
    goal = tol * max(1e-300, float(np.linalg.norm(rhs)))
    for _ in range(iterations or 10 * n + 100):
        if np.linalg.norm(r) <= goal:
            break
        q = times(p)
        a = rz / float(p @ q)
        x += a * p
        r -= a * q
        z = r / diag
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    return x
