"""Continuous diagrams, Newton plans and trees against brute force and finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from masswright.functions import polytopes
from masswright.functions.jets import DensePolynomial, Jet, bisect_largest_inside, conjugate_gradient, minimize_lbfgs, minimize_sgd
from masswright.operators import linear, measures, power, regions, solver
from masswright.plans import ot_plan
from masswright.session import shared_path


def sites(spark, pos, weights=None):
    weights = np.zeros(len(pos)) if weights is None else weights
    return spark.createDataFrame([(0, i, p.tolist(), float(w)) for i, (p, w) in enumerate(zip(pos, weights, strict=True))], "batch_id long, site_id long, pos array<double>, weight double")


def brute_cell(pos, weights, k):
    """The polygon of site k in the unit square: cut by every other site, whatever its distance."""
    points = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    for j in range(len(pos)):
        if j == k or not points:
            continue
        n = pos[j] - pos[k]
        o = (pos[j] @ pos[j] - pos[k] @ pos[k] + weights[k] - weights[j]) / 2
        gap, out = [n @ p - o for p in points], []
        for i in range(len(points)):
            a, b, p, q = gap[i - 1], gap[i], np.array(points[i - 1]), np.array(points[i])
            if a * b < 0:
                out.append(tuple(p + a / (a - b) * (q - p)))
            if b <= 0:
                out.append(tuple(q))
        points = out
    x, y = np.array(points).T if points else np.zeros((2, 1))
    return abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


@pytest.mark.parametrize("kind", ["uniform", "clustered", "weighted"])
def test_cells_of_many_tiles_equal_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    n = 600
    pos, weights = rng.random((n, 2)), np.zeros(n)
    if kind == "clustered":
        pos[: n // 3] = 0.3 + 0.001 * rng.random((n // 3, 2))
    if kind == "weighted":
        weights = rng.random(n) * 0.002
    grid = measures.polynomial_grid(spark, [[[1.0]]])
    sums = power.cell_integrals(power.cells(sites(spark, pos, weights), [0.0, 0.0], [1.0, 1.0]), grid, [[0.0, 1.0]] * 2, 0)
    got = {r.site_id: r.mass for r in sums.where("neighbor is null").collect()}
    assert sum(got.values()) == pytest.approx(1)
    for k in range(0, n, 7):
        assert got.get(k, 0.0) == pytest.approx(brute_cell(pos, weights, k), abs=1e-9), k


def best(points, pos, weights, ids):
    cost = ((points[:, None] - pos) ** 2).sum(axis=2) - weights
    k = np.array([min(np.flatnonzero(c == c.min()), key=lambda j: ids[j]) for c in cost])
    return ids[k], cost.min(axis=1)


@pytest.mark.parametrize("kind", ["uniform", "clustered", "weighted"])
@pytest.mark.parametrize("n", [50, 1000, 1100, 5000])
def test_every_row_goes_to_its_best_site(spark, monkeypatch, n, kind):
    if n == 5000:
        monkeypatch.setattr(power, "POINTS_PER_TASK", 60)
        monkeypatch.setattr(regions, "SAMPLE_ROWS", 1500)
    rng = np.random.default_rng(n)
    pos, weights = rng.random((n, 2)), np.zeros(n)
    points = 1.4 * rng.random((900, 2)) - 0.2
    if kind == "clustered":
        pos[: n // 2], points[:300] = 0.3 + 1e-4 * rng.random((n // 2, 2)), 0.3 + 1e-4 * rng.random((300, 2))
        pos[-9:] = pos[0]  # equal places: the smaller id
    if kind == "weighted":
        weights = 0.05 * pos[:, 0] + rng.random(n) * 0.002
        weights[7] = 0.3
    ids = rng.permutation(n)
    points[10:20] = points[0]  # equal rows, and equal ids below
    rows = [(0, i % 400, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame([*rows, (0, 990, None), (0, 991, [0.1]), (0, 992, [0.1, None]), (5, 999, [0.0, 0.0]), (None, 998, [0.0, 0.0])], "batch_id long, point_id long, pos array<double>")
    df = df.withColumn("_region", F.lit("x")).withColumn("best", F.lit(1))
    table = spark.createDataFrame([(0, int(i), p.tolist(), float(w)) for i, p, w in zip(ids, pos, weights, strict=True)] + [(None, 1, [0.0, 0.0], 9.0), (0, 2, None, 9.0)], "batch_id long, site_id long, pos array<double>, weight double")
    got = power.assign(df, table)
    assert got.columns == [*df.columns, "site_id", "cost"]
    site, cost = best(points, pos, weights, ids)
    want = [(r[1], tuple(r[2]), int(s), float(c)) for r, s, c in zip(rows, site, cost, strict=True)]
    found = got.collect()
    assert sorted((r.point_id, tuple(r.pos), r.site_id, r.cost) for r in found if r.point_id < 900) == sorted(want)
    assert sorted((r.point_id, r.site_id, r.cost) for r in found if r.point_id >= 900) == [(990, None, None), (991, None, None), (992, None, None)]


@pytest.mark.parametrize("leaves", [4096, 8])
def test_batches_have_sites_of_their_own(spark, monkeypatch, leaves):
    monkeypatch.setattr(power, "SITES_IN_TASK", 20)
    monkeypatch.setattr(regions, "MAX_LEAVES", leaves)  # 8: more batches than leaves
    rng = np.random.default_rng(8)
    pos, points = rng.random((30, 12, 3)), rng.random((30, 25, 3))
    table = spark.createDataFrame([(b, i, p.tolist(), None) for b in range(30) for i, p in enumerate(pos[b])], "batch_id int, site_id int, pos array<double>, weight double")
    df = spark.createDataFrame([(b, i, p.tolist()) for b in range(30) for i, p in enumerate(points[b])] + [(77, 0, [0.0] * 3)], "batch_id int, point_id int, pos array<double>")
    got = {(r.batch_id, r.point_id): (r.site_id, r.cost) for r in power.assign(df, table).collect()}
    assert len(got) == 750
    for b in range(30):
        site, cost = best(points[b], pos[b], np.zeros(12), np.arange(12))
        assert [got[b, i] for i in range(25)] == list(zip(site.tolist(), cost.tolist(), strict=True))
    assert power.assign(df, table.limit(0)).count() == 0 and power.assign(df.limit(0), table).count() == 0


def test_few_leaves_are_searched(spark):
    rng = np.random.default_rng(5)
    pos = rng.random((20_000, 2))
    weights = 3.0 * pos[:, 0] - 1.0 * pos[:, 1] + 1e-6 * rng.random(20_000)  # an affine bound is tight, a constant one is not
    table = regions.plain_sites(sites(spark, pos - np.array([1.5, -0.5]), weights))
    tree = regions.build_tree(table)
    located, bounds = regions.stage_leaves(table, tree)
    assert bounds.n.sum() == 20_000 and bounds.n.max() <= 64
    box = np.arange(0, tree.leaves, 9)
    # Such weights shift the plane: the best site of x is that nearest to x plus half the slope.
    lo, hi = bounds.lo[box] - np.array([1.5, -0.5]), bounds.hi[box] - np.array([1.5, -0.5])
    rows, found = regions.near_leaves(bounds, box, lo, hi)
    assert len(found) < 40 * len(box) < tree.leaves * len(box) / 10


def test_newton_gives_every_site_its_mass_and_gradients_fit_differences(spark):
    rng = np.random.default_rng(5)
    pos = rng.random((4, 2))
    grid, knots = measures.polynomial_grid(spark, [[[1.0]]]), [[0.0, 1.0]] * 2
    want = dict(enumerate((np.arange(4) + 2.0) / 14))
    plan = solver.newton(sites(spark, pos), want, grid, knots, tol=1e-9)
    rows = {r.site_id: r for r in plan.rows.collect()}
    assert plan.error < 1e-9 and [rows[k].mass for k in range(4)] == pytest.approx(list(want.values()))
    gradient = {r.site_id: r.d_position for r in solver.plan_gradients(sites(spark, pos), plan).collect()}
    start, h = {k: rows[k].weight for k in rows}, 1e-4
    ends = []
    for sign in (1, -1):
        moved = pos.copy()
        moved[2] += sign * h * np.array([0.6, -0.8])
        ends.append(solver.newton(sites(spark, moved), want, grid, knots, tol=1e-9, start=start).distance)
    assert (ends[0] - ends[1]) / (2 * h) == pytest.approx(np.array(gradient[2]) @ [0.6, -0.8], abs=1e-5)
    with pytest.raises(ValueError, match="mass"):
        solver.newton(sites(spark, pos), {**want, 0: 0.0}, grid, knots)


def test_plan_of_two_sites_in_closed_form(spark):
    """Masses 3 and 1 on a density of mass 2: the cells of the unit square meet at x = 3/4."""
    two = spark.createDataFrame([(0, [0.25, 0.5], 3.0), (1, [0.75, 0.5], 1.0)], "site_id long, pos array<double>, mass double")
    rows, distances = ot_plan.semi_discrete_plan(two, measures.polynomial_grid(spark, [[[2.0]]]), [[0.0, 1.0]] * 2, tol=1e-9)
    distance = distances.first().distance
    a, b = rows.orderBy("site_id").collect()
    assert [a.mass, b.mass] == pytest.approx([0.75, 0.25])
    assert a.barycenter == pytest.approx([0.375, 0.5]) and b.barycenter == pytest.approx([0.875, 0.5])
    moments = [(0.5**3 + 0.25**3) / 3 + 0.75 / 12, 0.25**3 / 3 + 0.25 / 12]
    assert [a.second_moment, b.second_moment] == pytest.approx(moments) and distance == pytest.approx(sum(moments))
    assert b.offset - a.offset == pytest.approx(0.75 * 0.5)


def test_quantisation_never_gets_worse(spark):
    pos = np.random.default_rng(6).random((3, 2)) * 0.3
    table = sites(spark, pos).withColumn("mass", F.lit(1.0))
    moved, way = solver.lloyd(table, measures.polynomial_grid(spark, [[[1.0]]]), [[0.0, 1.0]] * 2, 2)
    seen = [r.distance for r in way.orderBy("step").collect()]
    assert moved.count() == 3 and all(b <= a + 1e-6 for a, b in zip(seen[:-1], seen[1:], strict=True)) and seen[-1] < seen[0]


def test_batches_of_plans_equal_plans_alone(spark):
    rng = np.random.default_rng(12)
    pos = rng.random((2, 4, 2))
    rows = [(b, i, p.tolist(), 1.0 + i) for b in range(2) for i, p in enumerate(pos[b])]
    table = spark.createDataFrame(rows, "batch_id long, site_id long, pos array<double>, mass double")
    grid, knots = measures.polynomial_grid(spark, [[[1.0], [3.0]]]), [[0.0, 1.0], [0.0, 0.5, 1.0]]
    together, distances = ot_plan.semi_discrete_plan(table, grid, knots)
    got = {(r.batch_id, r.site_id): r for r in together.collect()}
    assert [got[b, i].mass for b in range(2) for i in range(4)] == pytest.approx([(1 + i) / 10 for _ in range(2) for i in range(4)], rel=1e-5)
    assert distances.count() == 2
    with pytest.raises(ValueError, match="period"):
        ot_plan.semi_discrete_plan(table, grid, knots, metric=ot_plan.PeriodicMetric((2.0, None)))


def test_metrics_and_masses_of_plans(spark):
    """A torus in one axis, and a plan of less mass than the density's, through the same door."""
    table = spark.createDataFrame([(0, [0.05, 0.3], 1.0), (1, [0.4, 0.6], 2.0), (2, [0.9, 0.5], 2.0)], "site_id long, pos array<double>, mass double")
    grid, knots = measures.polynomial_grid(spark, [[[1.0]]]), [[0.0, 1.0]] * 2
    torus, near = ot_plan.semi_discrete_plan(table, grid, knots, metric=ot_plan.PeriodicMetric((1.0, None)))
    assert {r.site_id: r.mass for r in torus.collect()} == pytest.approx({0: 0.2, 1: 0.4, 2: 0.4}, rel=1e-5)
    some, cheap = ot_plan.semi_discrete_plan(table, grid, knots, site_mass=0.1)
    assert some.agg(F.sum("mass")).first()[0] == pytest.approx(0.1, rel=1e-5) and cheap.first().distance < near.first().distance


@pytest.mark.parametrize("task", [50_000, 0])
def test_systems_of_all_batches_are_solved(spark, monkeypatch, task):
    """In a task each, and as jobs with a coarse level."""
    monkeypatch.setattr(linear, "TASK_UNKNOWNS", task)
    rng = np.random.default_rng(1)
    entries, right, want, groups = [], [], {}, []
    for b, n in ((0, 12), (5, 5), (6, 1)):
        m = np.zeros((n, n))
        for i in range(n - 1):
            v = rng.random() + 0.1
            m[np.ix_([i, i + 1], [i, i + 1])] += [[v, -v], [-v, v]]
        m += np.eye(n) * (0.0 if b == 0 else 0.01)  # batch 0 is singular
        x = rng.random(n)
        x -= x.mean() if b == 0 else 0.0
        right += [(b, 100 + i, float(v)) for i, v in enumerate(m @ x)]
        entries += [(b, 100 + i, 100 + j, float(m[i, j] / 2)) for i in range(n) for j in range(n) if m[i, j] for _ in range(2)]
        groups += [(b, 100 + i, i // 3) for i in range(n)]
        want |= {(b, 100 + i): v for i, v in enumerate(x)}
    matrix = spark.createDataFrame([*entries, (0, 999, 100, 5.0), (0, 100, 999, 5.0)], "batch_id long, row long, col long, val double")
    rhs = spark.createDataFrame([*right, (7, 1, 0.0)], "batch_id long, row long, val double")
    found = linear.solve_spd(matrix, rhs, spark.createDataFrame(groups, "batch_id long, row long, group long"), tol=1e-10)
    got = {(r.batch_id, r.row): r.val for r in found.collect()}
    assert got.pop((7, 1)) == 0.0
    shift = np.mean([v for (b, _), v in got.items() if b == 0])
    assert {k: v - (shift if k[0] == 0 else 0.0) for k, v in got.items()} == pytest.approx(want, abs=1e-7)


def test_tree_nodes_hold_their_points(spark):
    rng = np.random.default_rng(7)
    pos = np.concatenate([rng.random((200, 2)), np.full((50, 2), 0.5)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pos)], "point_id long, pos array<double>")
    rows, nodes = power.spatial_tree(df, 2, leaf=30)
    known = {r.node: r for r in nodes.collect()}
    sizes = {}
    for r in rows.collect():
        node = r.node
        while node:
            assert all(a <= x <= b for a, x, b in zip(known[node].lo, r.pos, known[node].hi, strict=True))
            sizes[node] = sizes.get(node, 0) + 1
            node //= 2
    assert sizes == {k: v.n for k, v in known.items()} and rows.count() == 250
    assert all(v.n <= 30 or v.lo == v.hi for v in known.values() if v.split is None)


def test_nodes_split_across_their_leading_axis(spark):
    rng = np.random.default_rng(3)
    clouds = {k: rng.normal(size=(60, 3)) @ np.diag(rng.random(3) + [0.1, 2.0, 0.5]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 5 for k in (1, 4)}
    rows = [(k, i, p.tolist()) for k, cloud in clouds.items() for i, p in enumerate(cloud)] + [(30, i, [2.0, 2.0, 2.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "node long, point_id long, pos array<double>").withColumn("axis", F.lit(1))
    axes = {r.node: r for r in power.principal_axes(df, 3).collect()}
    for k, cloud in clouds.items():
        m = np.cov(cloud.T, bias=True)
        assert np.array(axes[k].covariance).reshape(3, 3) == pytest.approx(m) and axes[k].spread == pytest.approx(np.linalg.eigvalsh(m)[-1])
        assert m @ axes[k].axis == pytest.approx(axes[k].spread * np.array(axes[k].axis)) and axes[k].axis[0] > 0
    assert axes[30].spread == 0.0 and axes[30].axis == [1.0, 0.0, 0.0]
    got = {(r.node // 2 if r.node != 30 else 30, r.point_id): r.node for r in power.split_by_axes(df, 3).collect()}
    assert len(got) == 124 and {v for (k, _), v in got.items() if k == 30} == {30}
    for k, cloud in clouds.items():
        side = (cloud - cloud.mean(axis=0)) @ axes[k].axis > 0
        assert [got[k, i] for i in range(60)] == [2 * k + int(b) for b in side]


def test_polytopes_in_three_dimensions():
    cube = polytopes.clip(polytopes.box([0.0] * 3, [1.0] * 3), [1.0, 1.0, 1.0], 1.0, 5)
    assert polytopes.measure(cube) == pytest.approx(1 / 6)
    assert polytopes.centroid(cube) == pytest.approx([0.25] * 3)
    assert sum(polytopes.integrate(cube.vertices[s], lambda x: x[:, 0] * x[:, 1] ** 2, 3) for s in polytopes.simplices(cube)) == pytest.approx(2 / 720)
    faces = {cube.ids[k]: sum(polytopes.simplex_volume(p) for p in polytopes.facet_simplices(cube, m, k)) for k, m in polytopes.facets(cube)}
    assert faces[5] == pytest.approx(3**0.5 / 2)
    assert not polytopes.unbounded(2).closed and polytopes.measure(polytopes.unbounded(2)) > 1e300
    assert polytopes.disk_part(np.array([[-2.0, -2.0], [2.0, -2.0], [2.0, 2.0], [-2.0, 2.0]]), np.zeros(2), 1.0, 2).inside[1].sum() == pytest.approx(np.pi)


def test_frame_and_polygon_gradients_fit_differences():
    rng = np.random.default_rng(8)
    origin, axes, h = rng.random(2), np.eye(2) + 0.3 * rng.random((2, 2)), 1e-6
    up = [rng.random((4, 2)), rng.random((4, 2)), rng.random(4)]

    def loss(o, a):
        c = polytopes.parallelepiped(o, a)
        return sum(float((u * x).sum()) for u, x in zip(up, (c.vertices, c.normals, c.offsets), strict=True))

    g_origin, g_axes = polytopes.frame_gradient(origin, axes, *up)
    for k in range(2):
        e = np.eye(2)[k] * h
        assert (loss(origin + e, axes) - loss(origin - e, axes)) / (2 * h) == pytest.approx(g_origin[k], abs=1e-6)
        for j in range(2):
            step = np.zeros((2, 2))
            step[k, j] = h
            assert (loss(origin, axes + step) - loss(origin, axes - step)) / (2 * h) == pytest.approx(g_axes[k, j], abs=1e-6)
    square = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0]])
    assert polytopes.shoelace_gradient(square)[2] == pytest.approx([0.5, 1.0])


def test_jets_and_small_solvers():
    x, y = Jet.variable(0, 2, 3, 1.5), Jet.variable(1, 2, 3, -0.5)
    f = (x * x + 2 * y).sqrt() / (1 + y * y) - x**3
    g = lambda a, b: (a * a + 2 * b) ** 0.5 / (1 + b * b) - a**3
    h = 1e-4
    assert f.value == pytest.approx(g(1.5, -0.5))
    assert f.derivative(0) == pytest.approx((g(1.5 + h, -0.5) - g(1.5 - h, -0.5)) / (2 * h), abs=1e-5)
    assert f.derivative(0, 1) == pytest.approx((g(1.5 + h, -0.5 + h) - g(1.5 + h, -0.5 - h) - g(1.5 - h, -0.5 + h) + g(1.5 - h, -0.5 - h)) / (4 * h * h), abs=1e-4)
    bowl = DensePolynomial([[1.0], [2.0, -1.0], [[2.0, 0.5], [0.5, 1.0]]], 2)
    at = bowl.argmin()
    assert np.abs(bowl.gradient(at)).max() < 1e-8 and DensePolynomial.size_for(2, 2) == 7
    quadratic = lambda v: (float(v @ v - v.sum()), 2 * v - 1)
    assert minimize_lbfgs(quadratic, np.zeros(3)) == pytest.approx([0.5] * 3)
    assert minimize_sgd(quadratic, np.zeros(3), 0.1, 200) == pytest.approx([0.5] * 3)
    assert bisect_largest_inside(lambda t: t * t <= 2, 0.0, 2.0) == pytest.approx(2**0.5)
    m = np.random.default_rng(9).random((5, 5))
    m = m @ m.T + np.eye(5)
    i, j = np.nonzero(m)
    assert m @ conjugate_gradient(i, j, m[i, j], np.arange(5.0)) == pytest.approx(np.arange(5.0))


def test_histogram_and_box(spark):
    df = spark.createDataFrame([([0.0, 3.0],), ([1.0, 2.0],), ([1.0, 5.0],), ([0.25, 4.0],)], "pos array<double>")
    assert [tuple(r) for r in power.axis_histogram(df, 0, 4).orderBy("bin").collect()] == [(0, 1, 1), (1, 1, 2), (3, 2, 4)]
    assert tuple(power.bounding_box(df, 2).first()) == (4, [0.0, 2.0], [1.0, 5.0])
    assert power.axis_histogram(df.where(F.lit(False)), 0).count() == 0


def test_images_of_sites_under_affine_maps(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pos, weights = rng.random((9, 2)), rng.random(9) * 0.02
    maps = [[[0.0, -1.0, 1.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [[-0.5, 0.2, 1.0], [0.1, 0.8, 0.1], [0.0, 0.0, 1.0]]]
    places = np.stack([pos, *[pos @ np.array(m)[:2, :2].T + np.array(m)[:2, 2] for m in maps]], axis=1)
    lattice = (np.stack(np.meshgrid(*[np.arange(60)] * 2), axis=-1).reshape(-1, 2) + 0.5) / 60
    cost = ((lattice[:, None, None] - places) ** 2).sum(axis=-1) - weights[:, None]
    best = cost.reshape(len(lattice), -1).argmin(axis=1)
    rows = sites(spark, pos, weights).withColumn("site_id", F.col("site_id") - 4)
    points = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(lattice)] + [(0, len(lattice), None)], "batch_id long, point_id long, pos array<double>")
    for in_task in (1024, 5):
        monkeypatch.setattr(power, "SITES_IN_TASK", in_task)
        found = {r["point_id"]: r for r in power.assign_images(points, rows, maps).collect()}
        assert found.pop(len(lattice))["site_id"] is None
        assert [(found[i]["site_id"] + 4) * 3 + found[i]["image"] for i in range(len(lattice))] == best.tolist()
        assert np.allclose([found[i]["cost"] for i in range(len(lattice))], cost.reshape(len(lattice), -1).min(axis=1))
    grid = measures.polynomial_grid(spark, [[[1.0]]], [[0.0, 1.0], [0.0, 1.0]])
    masses = np.zeros(27)
    for r in power.image_cell_integrals(rows, maps, grid, [[0.0, 1.0], [0.0, 1.0]]).collect():
        masses[(r["site_id"] + 4) * 3 + r["image"]] = r["mass"]
    assert masses.sum() == pytest.approx(1) and np.allclose(masses, np.bincount(best, minlength=27) / len(lattice), atol=0.01)
    assert ot_plan.nearest_sites(points.withColumn("image", F.lit("mine")), rows).where("image <> 0").isEmpty()
    assert power.assign_images(points, rows.limit(0), maps).isEmpty() and power.assign_images(points.limit(0), rows, maps).isEmpty()
    with pytest.raises(ValueError, match="not supported"):
        ot_plan.semi_discrete_plan(rows, grid, [[0.0, 1.0], [0.0, 1.0]], metric=ot_plan.Norm2(tuple(maps)))
    with pytest.raises(ValueError, match="affine"):
        power.transform_sites(rows, [[[1.0, 0.0], [0.0, 2.0]]])


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_path(session("spark://a:7077", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert shared_path(session("local[4]", None), "x").startswith("/tmp/")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_path(session("spark://a:7077", None), "x")
