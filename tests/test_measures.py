import numpy as np
import pytest
from pyspark.sql import functions as F

from masswright.functions import arrays
from masswright.operators import measures
from masswright.schema import AxisSystem, parse_axis, parse_dtype


def test_grid_masses(spark):
    grid = measures.polynomial_grid(spark, [[[1.0], [2.0]], [[3.0], [4.0]]])
    mass = {tuple(r["idx"]): r["m"] for r in grid.select("idx", arrays.piece_integral(F.col("coeffs"), F.col("lo"), F.col("hi"), 0, 2).alias("m")).collect()}
    assert mass[0, 0] == 0.25 and mass[0, 1] == 0.5
    assert measures.grid_mass(grid, 0, 2).first()["mass"] == 2.5
    assert measures.grid_mass(measures.normalize_grid(grid, 0, 2), 0, 2).first()["mass"] == pytest.approx(1)
    assert measures.grid_mass(measures.polynomial_grid(spark, [[[0.0, 1.0, 0.0, 0.0]]]), 1, 2).first()["mass"] == 0.5


def test_orders():
    assert measures.grid_order(4, 2) == 1 and measures.grid_order(27, 3) == 2 and measures.n_coeffs_for(3, 2) == 16
    with pytest.raises(IndexError):
        measures.grid_order(5, 2)


def test_cubic_spline_closed_form(spark):
    c = measures.cubic_coefficients([0, 1, 2], [1, 2, 1])
    assert c[0].tolist() == pytest.approx([1, 1.5, 0, -0.5]) and c[1].tolist() == pytest.approx([0, 4.5, -3, 0.5])
    grid = measures.spline_grid(spark, [1.0, 2.0, 1.0])
    points = spark.createDataFrame([(0, i, [x]) for i, x in enumerate((0.0, 0.5, 1.0, 1.5))], "batch_id long, point_id long, pos array<double>")
    got = measures.evaluate_grid(points, grid, [[0, 1, 2]], 3).orderBy("point_id").toPandas().density
    assert got.tolist() == pytest.approx([1, 1 + 0.75 - 0.0625, 2, 4.5 * 1.5 - 3 * 2.25 + 0.5 * 3.375])
    knots = spark.createDataFrame([(0, i, float(i), y) for i, y in enumerate((1.0, 2.0, 1.0))], "batch_id long, i long, x double, y double")
    rows = measures.spline_c1(knots).orderBy("piece").collect()
    assert rows[1]["coeffs"] == pytest.approx([0, 4.5, -3, 0.5])


def test_tensor_spline_interpolates(spark):
    x, y = np.arange(4.0), np.arange(5.0)
    values = x[:, None] ** 3 + y[None, :] ** 3
    grid = measures.spline_grid(spark, values)
    assert grid.count() == 12 and len(grid.first()["coeffs"]) == 16
    points = spark.createDataFrame([(0, int(5 * i + j), [float(i), float(j)]) for i in range(3) for j in range(4)], "batch_id long, point_id long, pos array<double>")
    got = measures.evaluate_grid(points, grid, [x.tolist(), y.tolist()], 3).toPandas()
    for r in got.itertuples():
        assert r.density == pytest.approx(values[int(r.pos[0]), int(r.pos[1])])
    flat = measures.spline_grid(spark, values, continuity=0)
    got = measures.evaluate_grid(spark.createDataFrame([(0, 0, [0.5, 0.5])], "batch_id long, point_id long, pos array<double>"), flat, [x.tolist(), y.tolist()], 1).first()["density"]
    assert got == pytest.approx(1.0)


def test_null_weights_raise(spark):
    rows = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0)], "batch_id long, dirac_id long, mass double")
    with pytest.raises(Exception, match="not positive"):
        measures.normalize_diracs(rows).collect()


def test_tridiagonal():
    rng = np.random.default_rng(0)
    a, b, c, r = rng.random(6), 4 + rng.random(6), rng.random(6), rng.random(6)
    m = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
    assert measures.solve_tridiagonal(a, b, c, r) == pytest.approx(np.linalg.solve(m, r))


def test_small_matrices(spark):
    one = spark.range(1)
    m = [[F.lit(float(v)) for v in row] for row in ((4, -1, 2), (0, 3, 1), (5, 2, -2))]
    row = one.select(arrays.determinant(m).alias("d"), F.array(*arrays.solve(m, [F.lit(8.0), F.lit(9.0), F.lit(3.0)])).alias("x"), F.array(*[v for r in arrays.inverse(m) for v in r]).alias("i")).first()
    assert row["d"] == -67 and row["x"] == pytest.approx([1, 2, 3])
    assert np.array(row["i"]).reshape(3, 3) == pytest.approx(np.linalg.inv([[4, -1, 2], [0, 3, 1], [5, 2, -2]]))
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(-2.0))
    row = one.select(arrays.dot(a, b).alias("dot"), arrays.norm(a).alias("n"), arrays.normalized(a).alias("u"), arrays.without_index(a, 0).alias("w"), arrays.arg_max(b).alias("k"), arrays.horner(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(2.0)).alias("h"), arrays.all_equal(a, a).alias("e"), arrays.all_equal(a, b).alias("f")).first()
    assert (row["dot"], row["n"], row["u"], row["w"], row["k"], row["h"], row["e"], row["f"]) == (-5, 5, [0.6, 0.8], [4.0], 0, 17, True, False)


def test_axis_expressions():
    e = parse_axis("rows + 5 + 2*fill[rows,cols] + 4*cols")
    assert e.offset == 5 and [(t.coefficient, t.name) for t in e.terms] == [(1, "rows"), (2, "fill"), (4, "cols")]
    s = AxisSystem({"a": "nb_points, dim", "b": "nb_points"})
    assert s.solve({"a": (5, 3), "b": (5,)}) == {"nb_points": 5, "dim": 3}
    with pytest.raises(ValueError, match="nb_points"):
        s.solve({"a": (5, 3), "b": (7,)})
    assert AxisSystem({"v": "2*n + 1"}).solve({"v": (7,)}) == {"n": 3}


def test_dtypes():
    assert parse_dtype("float32").simpleString() == "float" and parse_dtype(int).simpleString() == "bigint" and parse_dtype(np.uint8).simpleString() == "bigint"
    with pytest.raises(ValueError):
        parse_dtype("complex64")


def test_gradients_of_spline_values(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.random(7) + 0.2)
    g = rng.random((6, 4))
    base = [float((measures.cubic_coefficients(x, np.eye(7)[k]) * g).sum()) for k in range(7)]  # the map is linear
    assert measures.cubic_gradients(x, g) == pytest.approx(base)
    lower, diag, upper, right = rng.random(6), 3 + rng.random(6), rng.random(6), rng.random(6)
    m = np.diag(diag) + np.diag(lower[1:], -1) + np.diag(upper[:-1], 1)
    assert measures.solve_tridiagonal(*measures.transposed(lower, diag, upper), right) == pytest.approx(np.linalg.solve(m.T, right))
    knots = spark.createDataFrame([(0, i, float(v), 1.0) for i, v in enumerate(x)] + [(1, 0, 0.0, 1.0), (2, 5, 0.0, 1.0), (2, 6, 2.0, 3.0)], "batch_id long, i long, x double, y double")
    pulls = spark.createDataFrame([(0, k, g[k].tolist()) for k in range(6) if k != 3] + [(0, 3, None), (2, 5, [0.0, 1.0, 0.0, None])], "batch_id long, piece long, coeffs array<double>")
    got = {(r.batch_id, r.i): r.d_y for r in measures.spline_c1_gradients(knots, pulls).collect()}
    g[3] = 0.0
    assert [got[0, i] for i in range(7)] == pytest.approx(measures.cubic_gradients(x, g))
    assert got[1, 0] == 0.0 and [got[2, 5], got[2, 6]] == pytest.approx([-0.5, 0.5])
    assert measures.spline_c1_gradients(knots.limit(0), pulls).count() == 0
