"""Steps whose work must grow no faster than their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from masswright.functions import nearby, polygons, polytopes
from masswright.operators import measures, power

from .test_power import sites
from .test_torus_and_balls import moments, polygon


def places(kind, n, dim=2):
    rng = np.random.default_rng(5)
    x = rng.random((n, dim))
    return np.concatenate([x[: n // 2] * 1e-3, np.repeat(x[: n // 20], 10, axis=0)]) if kind == "clustered" else x


@pytest.mark.parametrize("kind", ["even", "clustered"])
@pytest.mark.parametrize("dim", [2, 3])
def test_nearest_leaves_none_out(kind, dim):
    x = places(kind, 2000, dim)
    rows = np.arange(0, 2000, 2)
    near, gaps, full = nearby.nearest(x, rows, 12)
    away = np.sqrt(((x[rows, None] - x) ** 2).sum(axis=2))
    for t, r in enumerate(rows):
        found = near[t][near[t] >= 0]
        assert len(set(found.tolist())) == len(found) and gaps[t, : len(found)] == pytest.approx(away[t, found])
        assert set(np.flatnonzero(away[t] < full[t] * (1 - 1e-12)).tolist()) <= set(found.tolist())
    assert kind == "clustered" or np.median(full) > 0
    assert np.isinf(nearby.nearest(x[:9], np.arange(9), 12)[2]).all()


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_best_sites_equal_all_pairs_in_few(kind):
    rng = np.random.default_rng(8)
    p, x = places(kind, 3000), np.concatenate([places("even", 5000) * 1.4 - 0.2, [[np.nan, 0.5], [np.inf, 0.5]], np.full((500, 2), 0.25)])
    w = rng.integers(0, 3, len(p)) * 1e-4
    pairs = []

    def brute(a, b, c):
        pairs.append(len(a) * len(b))
        return power._best_sites(a, b, c)

    best, cost = nearby.best_sites(x, p, w, brute)
    want, least = power._best_sites(x, p, w)
    real = np.isfinite(least)
    assert best[real].tolist() == want[real].tolist() and cost[real].tolist() == least[real].tolist()
    assert np.isnan(cost[5000]) and np.isinf(cost[5001])
    assert kind == "clustered" or sum(pairs) < len(x) * len(p) / 20


@pytest.mark.parametrize("spread", [1e-5, 1e-2])  # with the second, most sites have no cell
def test_cells_of_a_tile_meet_near_sites(spread):
    rng = np.random.default_rng(2)
    pos, weights = rng.random((300, 2)), rng.integers(0, 7, 300) * spread
    own = np.arange(300)
    n, vertices, n_cuts, cuts = power._flat_cells(pos, weights, own, np.zeros((300, 2)), np.ones((300, 2)))
    for k, points in enumerate(np.split(vertices, np.cumsum(n)[:-1])):
        want = polygon(pos, weights, k)
        if len(want) < 3:
            assert len(points) < 3
            continue
        assert moments(points)[0] == pytest.approx(moments(want)[0], abs=1e-12) and moments(points)[1] == pytest.approx(moments(want)[1], abs=1e-9)
    assert len(cuts) == n_cuts.sum()
    boxes = np.zeros((300, 3)), np.ones((300, 3))
    n, vertices, _, _ = power._flat_cells(np.column_stack([pos, np.full(300, 0.5)]), weights, own, *boxes)
    assert (n > 3).sum() == (np.array([len(polygon(pos, weights, k)) for k in own]) > 2).sum()  # prisms over the polygons


@pytest.mark.parametrize("radius", [0.2, 0.9, 3.0])
def test_disk_nodes_equal_disk_part(radius):
    rings = polygons.boxes(np.array([[-0.5, -0.25], [0.3, 0.2]]), np.array([[1.0, 0.5], [1.0, 1.5]]), [0, 1, 2, 3])
    parts, arcs, (k, label, edges) = polygons.disk_nodes(rings, np.full(2, radius), 4)
    for i in range(2):
        want = polytopes.disk_part(rings.vertices[i], np.zeros(2), radius, 4)
        f = lambda x: x[..., 0] ** 2 * x[..., 1] + 1
        assert sum((p.w * f(p.x))[p.of == i].sum() for p in parts) == pytest.approx(want.inside[1] @ f(want.inside[0]), abs=1e-13)
        assert (arcs.w * f(arcs.x))[arcs.of == i].sum() == pytest.approx(want.arcs[1] @ f(want.arcs[0]), abs=1e-13)
        got = {int(c): w for c, w in zip(label[k == i], (edges.w * f(edges.x)).sum(axis=1)[k == i], strict=True)}
        for e, c in zip(want.edges, rings.labels[i], strict=True):
            assert got.get(int(c), 0.0) == pytest.approx(e[1] @ f(e[0]) if len(e[1]) else 0.0, abs=1e-13)


def test_cells_of_one_box_are_not_moved_to_it(spark):
    """All cells have the key of the only box, so a shuffle by it would put them in one task."""
    cells = power.cells(sites(spark, np.array([[0.2, 0.3], [0.7, 0.6]])), [0.0, 0.0], [1.0, 1.0])
    joined = power._cells_by_box(cells, measures.polynomial_grid(spark, [[[1.0]]]), [[0.0, 1.0]] * 2, None)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_newton_matrix_takes_the_integrals_once(spark):
    rng = np.random.default_rng(4)
    table = sites(spark, rng.random((12, 2)), np.full(12, 0.02))
    sums = power.cell_integrals(power.cells(table, [0.0, 0.0], [1.0, 1.0]), measures.polynomial_grid(spark, [[[1.0]]]), [[0.0, 1.0]] * 2, 0, balls=True)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = power.matrix_terms(sums.mapInArrow(count, sums.schema), table).groupBy("batch_id").agg(F.count("val")).collect()
    assert rows and seen.value == sums.count()
