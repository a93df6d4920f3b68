"""Measures as DataFrames: normalisation, mass, evaluation, grids and splines.

Point masses are rows (batch_id, dirac_id, x or pos, mass).  Grids are rows (batch_id,
idx, lo, hi, coeffs) with coefficients in the tensor basis of monomials, last axis
fastest.  One-dimensional affine densities are rows (batch_id, piece, x0, x1, y0, y1).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masswright.functions import arrays
from masswright.session import ship_package

from .running import ordered, ranges_of


def checked_total(value: Column, what: str) -> Column:
    """A positive total, or an error in the job."""
    return F.when(value > 0, value).otherwise(F.raise_error(F.lit(f"{what}: total mass is not positive")).cast("double"))


def normalize_diracs(diracs: DataFrame, mass: float | None = 1.0, weight: str | None = "mass", batch: str = "batch_id") -> DataFrame:
    """Masses that add up to ``mass`` in every batch; equal ones if there are no weights; unchanged if mass is None."""
    if mass is None:
        return diracs.withColumn("mass", F.col(weight).cast("double") if weight else F.lit(1.0))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    whole = F.sum(w).over(Window.partitionBy(batch))
    return diracs.withColumn("mass", w * F.lit(float(mass)) / checked_total(whole, "point masses"))


def uniform_pieces(batches: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """The uniform density on [lo, hi] for every batch_id of ``batches``."""
    return batches.select("batch_id", F.lit(0).cast("long").alias("piece"), F.lit(float(lo)).alias("x0"), F.lit(float(hi)).alias("x1"), F.lit(1.0).alias("y0"), F.lit(1.0).alias("y1"))


def affine_pieces(knots: DataFrame) -> DataFrame:
    """Pieces of the affine interpolation of knots (batch_id, i, x, y)."""
    w = Window.partitionBy("batch_id").orderBy("i")
    return (
        knots.select("batch_id", F.col("i").cast("long").alias("piece"), F.col("x").cast("double").alias("x0"), F.lead("x").over(w).cast("double").alias("x1"), F.col("y").cast("double").alias("y0"), F.lead("y").over(w).cast("double").alias("y1"))
        .where("x1 is not null")
    )


def constant_pieces(knots: DataFrame) -> DataFrame:
    """Pieces of a step density: y holds from each knot to the next; the last y is not used."""
    return affine_pieces(knots).withColumn("y1", F.col("y0"))


def histogram_1d(points: DataFrame, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Step density of points (batch_id, x) on equal bins; points outside count in the end bins."""
    width = (hi - lo) / bins
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / width))).cast("long")
    counts = points.groupBy("batch_id", k.alias("piece")).agg(F.count(F.lit(1)).cast("double").alias("y0"))
    return counts.select("batch_id", "piece", (F.lit(lo) + F.col("piece") * width).alias("x0"), (F.lit(lo) + (F.col("piece") + 1) * width).alias("x1"), "y0", F.col("y0").alias("y1"))


def histogram_grid(points: DataFrame, shape: Sequence[int], lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Constant grid from points (batch_id, pos): the number of points per box."""
    steps = [(b - a) / n for a, b, n in zip(lo, hi, shape, strict=True)]
    idx = F.array(*[F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.get("pos", F.lit(d)) - lo[d]) / steps[d]))).cast("int") for d, n in enumerate(shape)])
    counts = points.groupBy("batch_id", idx.alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return grid_boxes(counts, [[a + i * s for i in range(n + 1)] for a, s, n in zip(lo, steps, shape, strict=True)]).select("batch_id", "idx", "lo", "hi", F.array("n").alias("coeffs"))


def grid_boxes(cells: DataFrame, knots: Sequence[Sequence[float]]) -> DataFrame:
    """Adds lo and hi of each grid cell from its idx and the knots of every axis."""
    lists = [F.array(*[F.lit(float(x)) for x in axis]) for axis in knots]
    lo = F.array(*[F.get(k, F.get("idx", F.lit(d))) for d, k in enumerate(lists)])
    hi = F.array(*[F.get(k, F.get("idx", F.lit(d)) + 1) for d, k in enumerate(lists)])
    return cells.withColumn("lo", lo).withColumn("hi", hi)


def polynomial_grid(spark: SparkSession, values, knots: Sequence[Sequence[float]] | None = None, batch_id: int = 0) -> DataFrame:
    """A grid from nested values[axis 0]...[axis d-1][coefficients]; default knots divide [0, 1] evenly."""
    v = np.asarray(values, float)
    shape = v.shape[:-1]
    knots = knots or [np.linspace(0, 1, n + 1).tolist() for n in shape]
    rows = [(batch_id, [int(i) for i in idx], v[idx].tolist()) for idx in np.ndindex(*shape)]
    cells = spark.createDataFrame(rows, "batch_id long, idx array<int>, coeffs array<double>")
    return grid_boxes(cells, knots).select("batch_id", "idx", "lo", "hi", "coeffs")


def grid_order(n_coeffs: int, dim: int) -> int:
    """The order k with (k + 1) ** dim coefficients."""
    for k in range(8):
        if (k + 1) ** dim == n_coeffs:
            return k
    raise IndexError(f"{n_coeffs} is no number of coefficients in dimension {dim}")


def n_coeffs_for(order: int, dim: int) -> int:
    return (order + 1) ** dim


def grid_mass(grid: DataFrame, order: int, dim: int) -> DataFrame:
    return grid.groupBy("batch_id").agg(F.sum(arrays.piece_integral(F.col("coeffs"), F.col("lo"), F.col("hi"), order, dim)).alias("mass"))


def normalize_grid(grid: DataFrame, order: int, dim: int, mass: float = 1.0) -> DataFrame:
    """Coefficients scaled so that every batch has the given mass."""
    whole = F.sum(arrays.piece_integral(F.col("coeffs"), F.col("lo"), F.col("hi"), order, dim)).over(Window.partitionBy("batch_id"))
    factor = F.lit(float(mass)) / checked_total(whole, "grid")
    return grid.withColumn("factor", factor).withColumn("coeffs", F.transform("coeffs", lambda c: c * F.col("factor"))).drop("factor")


def evaluate_grid(points: DataFrame, grid: DataFrame, knots: Sequence[Sequence[float]], order: int) -> DataFrame:
    """Density at points (batch_id, pos): each point finds its cell by index, an equi-join; outside it is 0.

    ``knots`` are the grid's, per axis.  Cells hold their lower bounds.
    """
    dim = len(knots)

    def index(d: int, axis: Sequence[float]) -> Column:
        below = F.filter(F.array(*[F.lit(float(x)) for x in axis]), lambda k: k <= F.get("pos", F.lit(d)))
        return (F.size(below) - 1).cast("int")

    idx = F.array(*[index(d, axis) for d, axis in enumerate(knots)])
    found = points.withColumn("idx", idx).join(grid.select("batch_id", "idx", "coeffs"), ["batch_id", "idx"], "left")
    value = F.coalesce(arrays.polynomial_value(F.col("coeffs"), F.col("pos"), order, dim), F.lit(0.0))
    return found.withColumn("density", value).drop("idx", "coeffs")


def grid_domain(grid: DataFrame, dim: int) -> DataFrame:
    """Bounding box of every batch's grid."""
    lo = [F.min(F.get("lo", F.lit(d))) for d in range(dim)]
    hi = [F.max(F.get("hi", F.lit(d))) for d in range(dim)]
    return grid.groupBy("batch_id").agg(F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))


def image_grid(pixels: DataFrame, lo: Sequence[float], hi: Sequence[float], shape: Sequence[int]) -> tuple[DataFrame, list[list[float]]]:
    """The step density of an image on the box [lo, hi], and its knots: pixels are rows (batch_id, idx, value).

    Pixels that are missing or null have the value 0, and those outside the shape are left out.
    """
    knots = [[a + (b - a) * k / n for k in range(n + 1)] for a, b, n in zip(lo, hi, shape, strict=True)]
    inside = [(F.get("idx", F.lit(d)) >= 0) & (F.get("idx", F.lit(d)) < n) for d, n in enumerate(shape)]
    rows = pixels.where(F.col("value").isNotNull())
    for c in inside:
        rows = rows.where(c)
    rows = rows.select("batch_id", F.transform("idx", lambda i: i.cast("int")).alias("idx"), F.array(F.col("value").cast("double")).alias("coeffs"))
    return grid_boxes(rows, knots).select("batch_id", "idx", "lo", "hi", "coeffs"), knots


PIECE_SCHEMA = "batch_id long, piece_id long, lo array<double>, hi array<double>, normals array<array<double>>, offsets array<double>, coeffs array<double>"


def convex_pieces(polyhedra: DataFrame, dim: int) -> DataFrame:
    """Pieces of a density from convex polyhedra (batch_id, piece_id, points, normals, coefficient).

    A polyhedron is what lies behind all its planes, each given by a point and an outward
    normal; coefficients are constant and may be negative, and null stands for 1.  Adds
    the bounding boxes that the spatial join needs.  An empty polyhedron has no row, an
    unbounded one raises.
    """
    ship_package(polyhedra.sparkSession)

    def work(batches):
        import pyarrow as pa

        from masswright.functions import polytopes

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cell = polytopes.unbounded(dim)
                offsets = [float(np.dot(p, n)) for p, n in zip(r["points"], r["normals"], strict=True)]
                for n, o in zip(r["normals"], offsets, strict=True):
                    cell = polytopes.clip(cell, n, o, polytopes.BOUNDARY)
                if cell.empty:
                    continue
                if not cell.closed:
                    raise ValueError(f"polyhedron {r['piece_id']} is not bounded")
                coefficient = 1.0 if r["coefficient"] is None else float(r["coefficient"])
                out.append((r["batch_id"], r["piece_id"], cell.vertices.min(axis=0).tolist(), cell.vertices.max(axis=0).tolist(), r["normals"], offsets, [coefficient]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.float64())]
            names = ["batch_id", "piece_id", "lo", "hi", "normals", "offsets", "coeffs"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    rows = polyhedra.select(F.col("batch_id").cast("long"), F.col("piece_id").cast("long"), "points", "normals", F.col("coefficient").cast("double"))
    return rows.mapInArrow(work, PIECE_SCHEMA)


def mesh_pieces(vertices: DataFrame, elements: DataFrame, dim: int) -> DataFrame:
    """Pieces of the affine interpolation on a mesh of simplices, with coefficients of order 1.

    ``vertices`` are (batch_id, vertex_id, pos, value), ``elements`` (batch_id, element_id,
    vertex_ids of dim + 1).  Elements without volume are left out, as are those that name
    a vertex that is not there.
    """
    corners = elements.select("batch_id", F.col("element_id").alias("piece_id"), F.posexplode("vertex_ids").alias("k", "vertex_id"))
    corners = corners.join(vertices.select("batch_id", "vertex_id", "pos", "value"), ["batch_id", "vertex_id"])
    rows = corners.groupBy("batch_id", "piece_id").agg(F.sort_array(F.collect_list(F.struct("k", "pos", F.col("value").cast("double").alias("value")))).alias("c")).where(F.size("c") == dim + 1)
    p = [[F.get(F.get("c", F.lit(k))["pos"], F.lit(d)).cast("double") for d in range(dim)] for k in range(dim + 1)]
    ones = [[F.lit(1.0), *p[k]] for k in range(dim + 1)]
    rows = rows.withColumn("volume", arrays.determinant(ones)).where("volume != 0")
    # A corner's barycentric coordinate is affine, 1 there and 0 at the others; the element is where none is negative.
    bary = [arrays.solve(ones, [F.lit(float(j == k)) for j in range(dim + 1)]) for k in range(dim + 1)]
    affine = arrays.solve(ones, [F.get("c", F.lit(k))["value"] for k in range(dim + 1)])
    basis = {e: k for k, e in enumerate(arrays.grid_exponents(1, dim))}
    coeffs = [F.lit(0.0)] * len(basis)
    coeffs[basis[(0,) * dim]] = affine[0]
    for d in range(dim):
        coeffs[basis[tuple(int(i == d) for i in range(dim))]] = affine[d + 1]
    return rows.select(
        F.col("batch_id").cast("long"),
        F.col("piece_id").cast("long"),
        F.array(*[F.least(*[p[k][d] for k in range(dim + 1)]) for d in range(dim)]).alias("lo"),
        F.array(*[F.greatest(*[p[k][d] for k in range(dim + 1)]) for d in range(dim)]).alias("hi"),
        F.array(*[F.array(*[-b[d + 1] for d in range(dim)]) for b in bary]).alias("normals"),
        F.array(*[b[0] for b in bary]).alias("offsets"),
        F.array(*coeffs).alias("coeffs"),
    )


def spline_c0(knots: DataFrame) -> DataFrame:
    """Linear interpolation of (batch_id, i, x, y) as coefficients in the global monomial basis."""
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return affine_pieces(knots).select("batch_id", "piece", "x0", "x1", F.array(F.col("y0") - slope * F.col("x0"), slope).alias("coeffs"))


def natural_slopes(x, y):
    """Knot slopes of the natural cubic spline (second derivative 0 at the ends)."""
    d = np.diff(y) / np.diff(x)
    system, share = slope_system(x)
    rhs = np.zeros(len(x))
    rhs[0], rhs[-1] = 3 * d[0], 3 * d[-1]
    rhs[1:-1] = 3 * (share[1:-1] * d[:-1] + (1 - share[1:-1]) * d[1:])
    return solve_tridiagonal(*system, rhs)


def solve_tridiagonal(lower, diag, upper, rhs):
    """Row i is lower[i] x[i-1] + diag[i] x[i] + upper[i] x[i+1] = rhs[i]."""
    n = len(diag)
    c, d = np.zeros(n), np.zeros(n)
    for i in range(n):
        pivot = diag[i] - (lower[i] * c[i - 1] if i else 0.0)
        c[i] = upper[i] / pivot
        d[i] = (rhs[i] - (lower[i] * d[i - 1] if i else 0.0)) / pivot
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def transposed(lower, diag, upper):
    """The three diagonals of the transposed matrix, for solve_tridiagonal."""
    return np.concatenate([[0.0], upper[:-1]]), diag, np.concatenate([lower[1:], [0.0]])


def slope_system(x):
    """Diagonals of the natural slopes' system, and the share of the interval before in each inner row's right side."""
    n, h = len(x), np.diff(x)
    lower, upper, share = np.zeros(n), np.zeros(n), np.zeros(n)
    share[1:-1] = h[1:] / (h[:-1] + h[1:])
    lower[1:-1], upper[1:-1] = share[1:-1], 1 - share[1:-1]
    upper[0], lower[-1] = 1.0, 1.0
    return (lower, np.full(n, 2.0), upper), share


def cubic_gradients(x, gradients):
    """Gradients with respect to the values of a natural cubic spline, from those of its coefficients (as cubic_coefficients has them).

    The coefficients are linear in the values, so this is the transposed map: through the
    monomials, the pieces' slopes, one transposed tridiagonal solve, and the differences.
    """
    x, g = np.asarray(x, float), np.asarray(gradients, float).reshape(-1, 4)
    n = len(x)
    d_y, d_slope = np.zeros(n), np.zeros(n)
    if n == 1:
        return d_y
    t, h = x[:-1], np.diff(x)
    d_b = g[:, 1] - t * g[:, 0]
    d_c = g[:, 2] - 2 * t * g[:, 1] + t**2 * g[:, 0]
    d_d = g[:, 3] - 3 * t * g[:, 2] + 3 * t**2 * g[:, 1] - t**3 * g[:, 0]
    d_y[:-1] += g[:, 0]
    d_slope[:-1] += d_b - 2 * d_c / h + d_d / h**2
    d_slope[1:] += d_d / h**2 - d_c / h
    d_step = 3 * d_c / h - 2 * d_d / h**2
    system, share = slope_system(x)
    u = solve_tridiagonal(*transposed(*system), d_slope)
    before = share.copy()
    before[-1], after = 1.0, 1 - share
    after[-1] = 0.0
    d_step += 3 * (after * u)[:-1] + 3 * (before * u)[1:]
    d_y[1:] += d_step / h
    d_y[:-1] -= d_step / h
    return d_y


def cubic_coefficients(x, y):
    """Rows of global monomial coefficients, one per interval, of the natural cubic spline."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) == 1:
        return np.zeros((0, 4))
    m, h = natural_slopes(x, y), np.diff(x)
    a, b = y[:-1], m[:-1]
    d1 = np.diff(y) / h
    c, d = (3 * d1 - 2 * m[:-1] - m[1:]) / h, (m[:-1] + m[1:] - 2 * d1) / h**2
    t = x[:-1]
    return np.stack([a - b * t + c * t**2 - d * t**3, b - 2 * c * t + 3 * d * t**2, c - 3 * d * t, d], axis=1)


def spline_c1(knots: DataFrame) -> DataFrame:
    """Natural cubic interpolation of (batch_id, i, x, y): four coefficients per piece, global basis.

    A spline's slopes depend on all of its knots, so a batch's knots meet in one group.
    """
    ship_package(knots.sparkSession)

    def fit(table):
        import pyarrow as pa

        table = table.sort_by("i")
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        rows = cubic_coefficients(x, y)
        n = len(rows)
        return pa.table({"batch_id": table.column("batch_id").slice(0, n), "piece": table.column("i").slice(0, n), "x0": x[:n], "x1": x[1:], "coeffs": pa.array(rows.tolist(), pa.list_(pa.float64()))})

    src = knots.selectExpr("batch_id", "cast(i as bigint) i", "cast(x as double) x", "cast(y as double) y")
    return src.groupBy("batch_id").applyInArrow(fit, "batch_id long, piece long, x0 double, x1 double, coeffs array<double>")


def spline_c1_gradients(knots: DataFrame, gradients: DataFrame) -> DataFrame:
    """Gradients (batch_id, i, d_y) with respect to the values of spline_c1's knots, from those of its coefficients.

    ``gradients`` are (batch_id, piece, coeffs) with four numbers; pieces without a row, and
    null numbers, have gradient 0.  As in spline_c1, a batch's knots meet in one group.
    """
    ship_package(knots.sparkSession)

    def pull(table):
        import pyarrow as pa

        table = table.sort_by("i")
        pieces = [[0.0 if v is None else v for v in r or [0.0] * 4] for r in table.column("coeffs").to_pylist()]
        d_y = cubic_gradients(table.column("x").to_numpy(), pieces[:-1])
        return pa.table({"batch_id": table.column("batch_id"), "i": table.column("i"), "d_y": pa.array(d_y)})

    src = knots.selectExpr("batch_id", "cast(i as bigint) i", "cast(x as double) x")
    rows = src.join(gradients.select("batch_id", F.col("piece").cast("long").alias("i"), "coeffs"), ["batch_id", "i"], "left")
    return rows.groupBy("batch_id").applyInArrow(pull, "batch_id long, i long, d_y double")


def spline_grid(spark: SparkSession, values, knots: Sequence[Sequence[float]] | None = None, continuity: int = 1, batch_id: int = 0) -> DataFrame:
    """A spline through sample values, as a polynomial grid of order 2 * continuity + 1.

    Works axis by axis: each line of samples along the axis becomes coefficients.  Default
    knots are 0, 1, 2, ...
    """
    if continuity not in (0, 1):
        raise ValueError("continuity is 0 or 1")
    v = np.asarray(values, float)
    dim, k = v.ndim, 2 * continuity + 2
    knots = [np.asarray(a, float) for a in (knots or [range(n) for n in v.shape])]
    c = v[..., None]
    for axis in range(dim):
        x = knots[axis]
        lines = np.moveaxis(c, axis, 0)
        flat = lines.reshape(len(x), -1)
        if continuity:
            out = np.stack([cubic_coefficients(x, flat[:, j]) for j in range(flat.shape[1])], axis=1)
        else:
            s = np.diff(flat, axis=0) / np.diff(x)[:, None]
            out = np.stack([flat[:-1] - s * x[:-1, None], s], axis=-1)
        out = out.reshape(len(x) - 1, *lines.shape[1:], k)
        c = np.moveaxis(out, 0, axis).reshape(*[n if a != axis else n - 1 for a, n in enumerate(c.shape[:-1])], c.shape[-1] * k)
    return polynomial_grid(spark, c, [a.tolist() for a in knots], batch_id)


def linspace(spark: SparkSession, a: float, b: float, n: int) -> DataFrame:
    step = (b - a) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(a)) + F.col("id") * step).alias("x"))


def cdf(pieces: DataFrame, ranges: int | None = None) -> DataFrame:
    """Normalised pieces with positive mass and their cumulative mass c0 to c1 in each batch."""
    mass = (F.col("y0") + F.col("y1")) / 2 * (F.col("x1") - F.col("x0"))
    rows = ordered(pieces.withColumn("piece_mass", mass), ["x0", "piece"], ranges).with_columns(totals={"z": F.col("piece_mass")})
    # One predicate: a separate filter on piece_mass would run first and leave nothing to check in an empty density.
    rows = rows.where(F.when(checked_total(F.col("z"), "density") > 0, F.col("piece_mass") > 0))
    rows = rows.with_columns(upto={"c1": F.col("piece_mass")}, under={"c0": F.col("piece_mass")}, last="is_end").result()
    c1 = F.when(F.col("is_end"), 1.0).otherwise(F.col("c1") / F.col("z"))
    return rows.select("batch_id", "piece", "x0", "x1", (F.col("y0") / F.col("z")).alias("y0"), (F.col("y1") / F.col("z")).alias("y1"), (F.col("c0") / F.col("z")).alias("c0"), c1.alias("c1"), "z")


def inverse_cdf(t: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Where an affine piece has gathered the mass t: no cancellation as the slope goes to 0."""
    s = (y1 - y0) / (x1 - x0)
    root = F.sqrt(F.greatest(F.lit(0.0), y0 * y0 + 2 * s * t))
    return F.when(t <= 0, x0).otherwise(F.least(x1, x0 + 2 * t / (y0 + root)))


def quantiles(pieces: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Positions with the given cumulative mass: probabilities are (batch_id, q) rows, 0 < q <= 1."""
    ranges = ranges_of(pieces, probabilities)
    c = cdf(pieces, ranges)
    marks = c.select("batch_id", F.col("c1").alias("q"), F.struct("x0", "x1", "y0", "y1", "c0").alias("p"), F.lit(None).cast("double").alias("wanted"))
    asked = probabilities.select("batch_id", "q", F.lit(None).cast(marks.schema["p"].dataType).alias("p"), F.col("q").alias("wanted"))
    both = marks.unionByName(asked).withColumns({"down": -F.col("q"), "is_asked": F.col("wanted").isNotNull()})
    both = ordered(both, ["down", "is_asked"], ranges).with_columns(filled={"p": F.col("p")}).result().where("wanted is not null")
    x = inverse_cdf(F.col("wanted") - F.col("p.c0"), F.col("p.x0"), F.col("p.x1"), F.col("p.y0"), F.col("p.y1"))
    return both.select("batch_id", F.col("wanted").alias("q"), x.alias("x"))
