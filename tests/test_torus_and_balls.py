"""Diagrams on tori, cells cut by balls, derivatives and partial plans, against polygons cut by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from masswright.functions import polytopes
from masswright.operators import measures, power, solver

from .test_power import sites


def polygon(pos, weights, k, periodic=(False, False)):
    """The cell of site k of the unit square: half planes of all sites' images, one after the other."""
    lo, hi = [pos[k][d] - 0.5 if periodic[d] else 0.0 for d in (0, 1)], [pos[k][d] + 0.5 if periodic[d] else 1.0 for d in (0, 1)]
    points = [(lo[0], lo[1]), (hi[0], lo[1]), (hi[0], hi[1]), (lo[0], hi[1])]
    steps = [(-1, 0, 1) if p else (0,) for p in periodic]
    for j in range(len(pos)):
        for s in ((a, b) for a in steps[0] for b in steps[1]):
            q = pos[j] + np.array(s)
            if j == k or not points:
                continue
            n = q - pos[k]
            o = (q @ q - pos[k] @ pos[k] + weights[k] - weights[j]) / 2
            gap, out = [n @ p - o for p in points], []
            for i in range(len(points)):
                a, b, p, r = gap[i - 1], gap[i], np.array(points[i - 1]), np.array(points[i])
                if a * b < 0:
                    out.append(tuple(p + a / (a - b) * (r - p)))
                if b <= 0:
                    out.append(tuple(r))
            points = out
    return np.array(points)


def moments(points):
    """Area and centroid of a polygon."""
    x, y = points.T
    cross = x * np.roll(y, -1) - y * np.roll(x, -1)
    area = cross.sum() / 2
    return area, np.array([((x + np.roll(x, -1)) * cross).sum(), ((y + np.roll(y, -1)) * cross).sum()]) / (6 * area)


def run(spark, pos, weights, periodic, balls=False, density=(((1.0,),),), order=0):
    table = sites(spark, pos, weights)
    cells = power.cells(table, [0.0, 0.0], [1.0, 1.0], list(periodic))
    grid = measures.polynomial_grid(spark, density)
    knots = [np.linspace(0, 1, len(density) + 1).tolist(), np.linspace(0, 1, len(density[0]) + 1).tolist()]
    return table, power.cell_integrals(cells, grid, knots, order, list(periodic), balls)


@pytest.mark.parametrize("periodic", [(True, True), (True, False)])
def test_cells_of_a_torus(spark, periodic, monkeypatch):
    monkeypatch.setattr(power, "SITES_PER_TILE", 4)
    rng = np.random.default_rng(3)
    pos, weights = rng.random((90, 2)), rng.random(90) * 1e-3
    pos[60:] = 0.97 + 0.02 * pos[60:]  # crowded at a corner
    _, sums = run(spark, pos, weights, periodic, density=(((0.5,), (1.5,)), ((1.0,), (1.0,)), ((2.0,), (0.0,))))
    rows = sums.collect()
    assert sum(r.mass for r in rows) == pytest.approx(1.0)
    _, sums = run(spark, pos, weights, periodic)
    rows = sums.collect()
    got = {r.site_id: r for r in rows if r.neighbor is None}
    for k in range(90):
        points = polygon(pos, weights, k, periodic)
        if len(points) < 3:
            assert k not in got
            continue
        area, centre = moments(points)
        assert got[k].mass == pytest.approx(area, abs=1e-12) and np.array(got[k].first) / area == pytest.approx(centre, abs=1e-9)
    facets = {(r.site_id, r.neighbor, tuple(r.shift)): r.facet for r in rows if r.neighbor is not None}
    assert any(any(s) for _, _, s in facets)
    for (i, j, s), f in facets.items():
        assert facets[j, i, tuple(-x for x in s)] == pytest.approx(f, abs=1e-9)


def test_one_site_of_a_torus_meets_itself(spark):
    table = spark.createDataFrame([(0, 5, [2.3, -0.4], 0.0)], "batch_id long, site_id long, pos array<double>, weight double")
    cell = power.cells(table, [0.0, 0.0], [1.0, 2.0], [True, True]).first()
    assert cell.is_closed and sorted(cell.cut_ids) == [5] * 4 and sorted(map(tuple, cell.cut_shifts)) == [(-1.0, 0.0), (0.0, -2.0), (0.0, 2.0), (1.0, 0.0)]
    assert np.array(cell.vertices).min(axis=0) == pytest.approx([-0.2, 0.6]) and np.array(cell.vertices).max(axis=0) == pytest.approx([0.8, 2.6])
    assert power.cells(table.limit(0), [0.0, 0.0], [1.0, 2.0], [True, True]).count() == 0


def test_many_batches_and_equal_places(spark, monkeypatch):
    from masswright.operators import regions

    rows = [(b, i, [0.25 + 0.5 * (i % 2), 0.5], 0.0) for b in range(6) for i in range(4)] + [(6, 0, [0.3, 0.3], None), (None, 1, [0.1, 0.1], 0.0)]
    table = spark.createDataFrame(rows, "batch_id long, site_id long, pos array<double>, weight double")
    for leaves in (4096, 3):
        monkeypatch.setattr(regions, "MAX_LEAVES", leaves)
        got = {(r.batch_id, r.site_id): r.vertices for r in power.cells(table, [0.0, 0.0], [1.0, 1.0]).collect()}
        assert len(got) == 25
        for b in range(6):
            assert [len(got[b, i]) for i in range(4)] == [4, 4, 0, 0] and np.array(got[b, 0]).max(axis=0) == pytest.approx([0.5, 1.0])


@pytest.mark.parametrize("periodic", [(False, False), (True, True)])
def test_derivatives_of_centroids_and_masses(spark, periodic):
    rng = np.random.default_rng(6)
    n = 9
    pos, weights = rng.random((n, 2)), rng.random(n) * 0.01
    table, sums = run(spark, pos, weights, periodic)
    found = {(r.row, r.row_axis, r.col, r.col_axis): r.val for r in power.centroid_jacobian(sums, table, 2).collect()}
    terms = {(r.row, r.col): r.val for r in power.matrix_terms(sums, table).collect()}

    def state(p, w):
        out = np.zeros((n, 3))
        for k in range(n):
            out[k, 2], out[k, :2] = moments(polygon(p, w, k, periodic))
        return out

    eps = 1e-6
    for j in range(n):
        for b in range(3):
            dp, dw = np.zeros((n, 2)), np.zeros(n)
            if b < 2:
                dp[j, b] = eps
            else:
                dw[j] = eps
            change = (state(pos + dp, weights + dw) - state(pos - dp, weights - dw)) / (2 * eps)
            for i in range(n):
                for a in range(3):
                    assert found.get((i, a, j, b), 0.0) == pytest.approx(change[i, a], abs=2e-5), (i, a, j, b)
                if b == 2:
                    assert terms.get((i, j), 0.0) == pytest.approx(change[i, 2], abs=2e-5)


def test_derivatives_in_three_dimensions(spark):
    """Two sites, whose facet is the middle plane x = 0.5 of the cube."""
    table = spark.createDataFrame([(0, 0, [0.25, 0.5, 0.5], 0.0), (0, 1, [0.75, 0.5, 0.5], 0.0)], "batch_id long, site_id long, pos array<double>, weight double")
    sums = power.cell_integrals(power.cells(table, [0.0] * 3, [1.0] * 3), measures.polynomial_grid(spark, [[[[1.0]]]]), [[0.0, 1.0]] * 3, 0)
    got = {(r.row, r.row_axis, r.col, r.col_axis): r.val for r in power.centroid_jacobian(sums, table, 3).collect()}
    assert got[0, 3, 0, 3] == pytest.approx(1.0) and got[0, 3, 1, 3] == pytest.approx(-1.0)
    assert got[0, 3, 0, 0] == pytest.approx(0.5) and got[0, 3, 1, 0] == pytest.approx(0.5)  # the plane is half-way
    assert got[0, 0, 0, 0] == pytest.approx(0.25)  # and so is the centroid of its half
    assert got[0, 1, 0, 1] == pytest.approx(1 / 12 / 0.5 / 0.5) and got[0, 1, 1, 1] == pytest.approx(-got[0, 1, 0, 1])  # the plane tilts about its middle


def test_cells_cut_by_balls(spark):
    rng = np.random.default_rng(9)
    n = 14
    pos, weights = rng.random((n, 2)), 0.005 + rng.random(n) * 0.04
    pos[3], weights[3], weights[5] = [-0.1, 0.5], 0.05, -0.01  # outside the box, and no ball at all
    table, sums = run(spark, pos, weights, (False, False), True)
    rows = sums.collect()
    got = {r.site_id: r for r in rows if r.neighbor is None}
    x = (np.arange(2000) + 0.5) / 2000
    grid = np.stack(np.meshgrid(x, x, indexing="ij"), axis=-1).reshape(-1, 2)
    cost = np.stack([((grid - p) ** 2).sum(axis=1) - w for p, w in zip(pos, weights, strict=True)])
    owner = np.where(cost.min(axis=0) <= 0, cost.argmin(axis=0), -1)
    for k in range(n):
        own = grid[owner == k]
        assert (got[k].mass if k in got else 0.0) == pytest.approx(len(own) / 4e6, abs=3e-5)
        if len(own) > 4000:
            assert np.array(got[k].first) / got[k].mass == pytest.approx(own.mean(axis=0), abs=1e-3)
            assert got[k].second / got[k].mass == pytest.approx((own**2).sum(axis=1).mean(), abs=1e-3)
    assert 5 not in got and got[3].mass > 0
    # The matrix holds the derivatives of the masses, arcs included.
    terms = {(r.row, r.col): r.val for r in power.matrix_terms(sums, table).collect()}
    eps, j = 1e-5, 7
    up, down = ({r.site_id: r.mass for r in run(spark, pos, weights + e * np.eye(n)[j], (False, False), True)[1].where("neighbor is null").collect()} for e in (eps, -eps))
    for i in got:
        assert terms.get((i, j), 0.0) == pytest.approx((up[i] - down[i]) / (2 * eps), abs=1e-4)


def test_disk_parts_integrate_polynomials():
    square = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]])
    quarter = polytopes.disk_part(square, np.zeros(2), 1.0, 4)
    (x, w), (on, arc) = quarter.inside, quarter.arcs
    assert w.sum() == pytest.approx(np.pi / 4) and arc.sum() == pytest.approx(np.pi / 2) and np.hypot(*on.T) == pytest.approx(np.ones(len(on)))
    assert w @ x[:, 0] == pytest.approx(1 / 3) and w @ (x[:, 0] ** 2 * x[:, 1] ** 2) == pytest.approx(np.pi / 96)
    assert [e[1].sum() for e in quarter.edges] == pytest.approx([1.0, 0.0, 0.0, 1.0])
    away = polytopes.disk_part(square, np.array([3.0, 1.0]), 1.2, 2)  # the centre is outside: a segment of the circle
    assert away.inside[1].sum() == pytest.approx(1.2**2 * np.arccos(1 / 1.2) - np.sqrt(1.2**2 - 1))
    assert polytopes.disk_part(square, np.array([9.0, 9.0]), 1.0, 2).inside[1].sum() == pytest.approx(0.0, abs=1e-12)


def test_partial_plans_take_the_nearest_mass(spark):
    pos = np.array([[0.2, 0.2], [0.3, 0.25], [0.8, 0.7], [0.75, 0.1]])
    want = {0: 0.08, 1: 0.1, 2: 0.05, 3: 0.1}
    grid = measures.polynomial_grid(spark, [[[1.0]]])
    plan = solver.newton(sites(spark, pos), want, grid, [[0.0, 1.0]] * 2, tol=1e-9, normalize=False)
    rows = {r.site_id: r for r in plan.rows.collect()}
    assert plan.error < 1e-9 and all(rows[i].mass == pytest.approx(m, rel=1e-8) for i, m in want.items())
    assert rows[2].weight == pytest.approx(0.05 / np.pi)  # a whole disk of its own
    # The dual value agrees: no other choice of the mass is cheaper.
    x = (np.arange(1500) + 0.5) / 1500
    points = np.stack(np.meshgrid(x, x, indexing="ij"), axis=-1).reshape(-1, 2)
    cost = np.min([((points - p) ** 2).sum(axis=1) - rows[i].weight for i, p in enumerate(pos)], axis=0)
    assert plan.distance == pytest.approx(sum(m * rows[i].weight for i, m in want.items()) + np.minimum(cost, 0).mean(), abs=1e-5)
    with pytest.raises(ValueError, match="more than"):
        solver.newton(sites(spark, pos), dict.fromkeys(range(4), 1.0), grid, [[0.0, 1.0]] * 2, normalize=False)


def test_plans_on_a_torus_do_not_see_the_edge(spark):
    pos = np.random.default_rng(1).random((6, 2))
    grid = measures.polynomial_grid(spark, [[[1.0]]])
    knots = [[0.0, 1.0]] * 2
    plans = [solver.newton(sites(spark, pos + move), dict.fromkeys(range(6), 1.0), grid, knots, tol=1e-9, periodic=[True, True]) for move in (0.0, 0.37)]
    one, two = ({r.site_id: r.weight for r in p.rows.collect()} for p in plans)
    assert plans[0].error < 1e-9 and plans[0].distance == pytest.approx(plans[1].distance) and one == pytest.approx(two, abs=1e-8)


def test_images_of_pixels(spark):
    """Masses and mean targets of an image's pixels, against the nearest sites of many samples."""
    rng = np.random.default_rng(2)
    pos, values = rng.random((25, 2)), rng.random((4, 3))
    pixels = spark.createDataFrame([(0, [i, j], float(values[i, j])) for i in range(4) for j in range(3) if (i, j) != (1, 1)] + [(0, [4, 0], 9.0), (0, [1, 1], None)], "batch_id long, idx array<long>, value double")
    grid, knots = measures.image_grid(pixels, [0.0, 0.0], [1.0, 1.0], [4, 3])
    assert grid.count() == 11 and knots[0] == [0.0, 0.25, 0.5, 0.75, 1.0]
    x = (np.arange(1200) + 0.5) / 1200
    points = np.stack(np.meshgrid(x, x, indexing="ij"), axis=-1).reshape(-1, 2)
    for periodic in ([False, False], [True, True]):
        images = np.concatenate([pos + [a, b] for a in (-1, 0, 1) for b in (-1, 0, 1)]) if periodic[0] else pos
        nearest = images[np.concatenate([((p[:, None] - images) ** 2).sum(axis=2).argmin(axis=1) for p in np.array_split(points, 200)])]
        cells = power.cells(sites(spark, pos), [0.0, 0.0], [1.0, 1.0], periodic)
        got = {tuple(r.idx): r for r in power.image_integrals(cells, grid, knots, periodic=periodic).collect()}
        assert len(got) == 11
        for (i, j), r in got.items():
            own = (points[:, 0] * 4 // 1 == i) & (points[:, 1] * 3 // 1 == j)
            assert r.mass == pytest.approx(values[i, j] / 12) and np.array(r.target) / r.mass == pytest.approx(nearest[own].mean(axis=0), abs=2e-3)


def test_meshes_and_polyhedra_are_densities(spark):
    rng = np.random.default_rng(8)
    pos = rng.random((12, 2))
    cells = power.cells(sites(spark, pos), [0.0, 0.0], [1.0, 1.0])
    # Two triangles of the square with the values of 1 + x + 2 y, an element without volume and one without its vertex.
    corners = [(0, [0.0, 0.0], 1.0), (1, [1.0, 0.0], 2.0), (2, [1.0, 1.0], 4.0), (3, [0.0, 1.0], 3.0)]
    vertices = spark.createDataFrame([(0, *c) for c in corners], "batch_id long, vertex_id long, pos array<double>, value double")
    elements = spark.createDataFrame([(0, 0, [0, 1, 2]), (0, 1, [0, 3, 2]), (0, 2, [0, 1, 1]), (0, 3, [0, 1, 9])], "batch_id long, element_id long, vertex_ids array<long>")
    mesh = power.piece_integrals(cells, measures.mesh_pieces(vertices, elements, 2), 2, order=1, tiles=5)
    grid = measures.polynomial_grid(spark, [[[1.0, 2.0, 1.0, 0.0]]])  # 1, y, x, xy
    same = power.cell_integrals(cells, grid, [[0.0, 1.0]] * 2, 1)
    got, want = ({(r.site_id, r.neighbor): (r.mass, *r.first, r.second, r.facet, *r.facet_second) for r in t.collect() if r.neighbor is None or r.facet > 1e-9} for t in (mesh, same))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert sum(v[0] for v in got.values()) == pytest.approx(2.5)
    # A triangle within the square, an empty piece, and one that is open.
    third = 2 * np.pi / 3
    planes = [([0.5 + 0.2 * np.cos(k * third), 0.5 + 0.2 * np.sin(k * third)], [np.cos(k * third), np.sin(k * third)]) for k in range(3)]
    triangle = ([[float(x) for x in p] for p, _ in planes], [[float(x) for x in n] for _, n in planes])
    schema = "batch_id long, piece_id long, points array<array<double>>, normals array<array<double>>, coefficient double"
    table = spark.createDataFrame([(0, 0, *triangle, None), (0, 1, [[0.0, 0.0], [1.0, 0.0], *triangle[0]], [[1.0, 0.0], [-1.0, 0.0], *triangle[1]], 5.0)], schema)
    pieces = measures.convex_pieces(table, 2)
    assert pieces.count() == 1
    sums = power.piece_integrals(cells, pieces, 2)
    assert sums.agg(F.sum("mass")).first()[0] == pytest.approx(3 * np.sqrt(3) * 0.04)
    with pytest.raises(Exception, match="not bounded"):
        measures.convex_pieces(spark.createDataFrame([(0, 7, [[0.0, 0.0]], [[1.0, 0.0]], 1.0)], schema), 2).collect()
