"""One-dimensional plans: known values, gradients against finite differences, invariants."""

import numpy as np
import pytest

from masswright.operators import measures, ot1d, running
from masswright.plans.ot_plan import distance, ot_plan


def diracs(spark, xs, ws=None):
    ws = ws or [1.0] * len(xs)
    return spark.createDataFrame([(0, i, float(x), float(w)) for i, (x, w) in enumerate(zip(xs, ws, strict=True))], "batch_id long, dirac_id long, x double, mass double")


def knots(spark, xs, ys):
    return spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], "batch_id long, i long, x double, y double")


def plan(spark, xs, kx, ky, ws=None):
    return ot1d.plan_1d(diracs(spark, xs, ws), measures.affine_pieces(knots(spark, kx, ky)))


TEN = np.linspace(0.05, 0.95, 10).tolist()


@pytest.mark.parametrize(
    ("xs", "kx", "ky", "want", "barycenters"),
    [
        ([0], [0, 1], [1, 1], 1 / 3, [0.5]),
        ([0.5], [0, 1], [1, 1], 1 / 12, [0.5]),
        ([0], [0, 1], [0, 2], 1 / 2, [2 / 3]),
        ([0.5], [0, 1], [0, 2], 1 / 12, [2 / 3]),
        ([0.5], [0, 1], [0, 1], 1 / 12, [2 / 3]),
        ([0, 1], [0, 1], [1, 1], 1 / 12, [0.25, 0.75]),
        (TEN, [0, 1], [1, 1], 1 / 1200, TEN),
        (TEN, [0, 1], [0, 2], 0.0340592810032143, None),
        (TEN, [0, 1, 2], [1, 0, 2], 0.687784685123882, [0.07924893, 0.26071154, 0.50809014, 1.07027284, 1.41500988, 1.56880983, 1.68848313, 1.79009379, 1.87999671, 1.96150543]),
        ([0.5], [0, 0.5, 0.6, 1], [1, 1, 1, 1], 1 / 12, [0.5]),
    ],
)
def test_known_values(spark, xs, kx, ky, want, barycenters):
    rows = plan(spark, xs, kx, ky).orderBy("x").toPandas()
    assert rows.cost.sum() == pytest.approx(want, abs=1e-8)
    if barycenters:
        assert rows.barycenter.tolist() == pytest.approx(barycenters, abs=1e-7)


def test_potentials(spark):
    rows = plan(spark, TEN, [0, 1, 2], [1, 0, 2]).orderBy("x").toPandas()
    want = [0, -0.01266799, -0.04617689, -0.12293134, -0.30617689, -0.50617689, -0.71266799, -0.92099196, -1.12832397, -1.33271486]
    assert rows.potential.tolist() == pytest.approx(want, abs=1e-7)


X, W, KX, KY = [0.1, 0.7, 0.4], [1.0, 2.0, 3.0], [0.0, 0.5, 1.5], [1.0, 2.0, 0.5]


def cost(spark, x=X, w=W, kx=KX, ky=KY):
    return plan(spark, x, kx, ky, w).toPandas().cost.sum()


def slope(f, v, k, h=1e-5):
    up, down = list(v), list(v)
    up[k] += h
    down[k] -= h
    return (f(up) - f(down)) / (2 * h)


def test_dirac_gradients(spark):
    rows = ot1d.dirac_gradients(plan(spark, X, KX, KY, W)).orderBy("dirac_id").toPandas()
    assert rows.d_position.tolist() == pytest.approx([-0.01368546, -0.27407407, -0.1455738], abs=1e-7)
    assert rows.d_mass.tolist() == pytest.approx([0.01059133, -0.01911827, 0.00921507], abs=1e-7)


def test_knot_gradients(spark):
    rows = ot1d.knot_gradients(diracs(spark, X, W), knots(spark, KX, KY)).orderBy("i").toPandas()
    for k in range(3):
        assert rows.d_y[k] == pytest.approx(slope(lambda v: cost(spark, ky=v), KY, k), abs=1e-6)
        assert rows.d_x[k] == pytest.approx(slope(lambda v: cost(spark, kx=v), KX, k), abs=1e-6)


def test_barycenter_upstream(spark):
    """Loss sum(g_i b_i): gradients with respect to masses against finite differences."""
    g = [0.3, -0.7, 1.1]

    def loss(w):
        rows = plan(spark, X, KX, KY, w).orderBy("dirac_id").toPandas()
        return float((rows.barycenter * g).sum())

    up = spark.createDataFrame([(0, i, v) for i, v in enumerate(g)], "batch_id long, dirac_id long, gb double")
    rows = ot1d.dirac_gradients(plan(spark, X, KX, KY, W).join(up, ["batch_id", "dirac_id"]), 0.0, "gb").orderBy("dirac_id").toPandas()
    assert rows.d_mass.tolist() == pytest.approx([slope(loss, W, k) for k in range(3)], abs=1e-6)


def test_errors(spark):
    with pytest.raises(Exception, match="not positive"):
        plan(spark, [0.1, 0.2], [0, 1], [1, 1], [1.0, 0.0]).collect()
    with pytest.raises(Exception, match="not positive"):
        plan(spark, [0.1], [0, 1], [0, 0]).collect()


def test_discrete_coupling(spark):
    a, b = [0.3, 0.1, 0.7], [0.2, 0.9]
    flow = ot1d.discrete_coupling(diracs(spark, a), diracs(spark, b)).toPandas()
    q = (np.arange(6) + 0.5) / 6
    want = np.mean([(np.sort(a)[int(t * 3)] - np.sort(b)[int(t * 2)]) ** 2 for t in q])
    assert flow.cost.sum() == pytest.approx(want)
    assert flow.flow.sum() == pytest.approx(1)


def test_dispatcher(spark):
    d, k = diracs(spark, TEN), measures.affine_pieces(knots(spark, [0, 1], [0, 2]))
    assert distance(d, k) == pytest.approx(distance(k, d))
    assert ot_plan(d, k).count() == 10
    assert distance(d, d) == pytest.approx(0)
    two = k.withColumn("batch_id", k.batch_id + 1).union(k)
    assert ot_plan(d, two).select("batch_id").distinct().count() == 2
    with pytest.raises(ValueError, match="batch"):
        distance(d, two)


def test_plans_of_split_batches_equal_whole_ones(spark, monkeypatch):
    """Batches cut into ranges of a few rows, with ties at their ends."""
    rng = np.random.default_rng(3)
    points = [(b, i, float(x), float(w)) for b, n in ((0, 40), (1, 3), (2, 25)) for i, (x, w) in enumerate(zip(np.round(rng.random(n) * 3, 1), rng.integers(1, 4, n), strict=True))]
    df = spark.createDataFrame(points, "batch_id long, dirac_id long, x double, mass double")
    pieces = measures.affine_pieces(spark.createDataFrame([(b, i, float(i) / 4, float(rng.random() + 0.1)) for b in range(3) for i in range(13)], "batch_id long, i long, x double, y double"))
    other = df.selectExpr("batch_id", "dirac_id", "2 - x * x / 3 x", "mass + 1 mass")
    asked = spark.createDataFrame([(b, k / 8) for b in range(3) for k in range(1, 9)], "batch_id long, q double")

    def results():
        plan = ot1d.plan_1d(df, pieces)
        coupled = ot1d.discrete_coupling(df, other).groupBy("batch_id", "a.dirac_id", "b.dirac_id").sum("flow", "cost")
        found = [ot1d.dirac_gradients(plan.withColumn("up", plan.x * 0.5), 0.7, "up"), coupled, measures.cdf(pieces), measures.quantiles(pieces, asked)]
        return [sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()), key=repr) for f in found]

    whole = results()
    monkeypatch.setattr(running, "RANGE_ROWS", 7)
    split = results()
    assert [len(x) for x in split] == [len(x) for x in whole] and len(whole[0]) == 68
    for a, b in zip(split, whole, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=1e-8)
    assert ot1d.plan_1d(df.limit(0), pieces.limit(0)).count() == 0
