"""Power diagrams: discrete assignment, cells, integrals, Newton systems, spatial trees.

Sites are rows (batch_id, site_id, pos, weight).  A point belongs to the site with the
least ||x - p||**2 - w; a cell is what is left of the domain after every other site's
bisector has cut it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masswright.functions import arrays, nearby, polygons, polytopes
from masswright.functions import cells as cells_of
from masswright.session import ship_package, stage_table

from . import regions

#: So many sites at most travel with every task of assign.
SITES_IN_TASK = 1024
#: Points of a region that meet in one task of assign.
POINTS_PER_TASK = 100_000
#: Distances held at a time.
DISTANCES = 2_000_000
SITES_PER_TILE = 64
#: So many near sites are tried first for a cell; cells that may meet more get four times as many.
NEAR_SITES = 24
#: Pairs of a polygon and a piece that are integrated at a time.
PAIRS = 2000


def _best_sites(pos: np.ndarray, site_pos: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and cost of the best site of every position; the first of equal ones."""
    best, least = np.zeros(len(pos), np.int64), np.zeros(len(pos))
    step = max(1, DISTANCES // max(1, len(weights)))
    for a in range(0, len(pos), step):
        x = pos[a : a + step]
        cost = np.zeros((len(x), len(weights)))
        for d in range(pos.shape[1]):
            gap = x[:, d, None] - site_pos[:, d]
            cost += gap * gap
        cost -= weights
        at = np.argmin(cost, axis=1)
        best[a : a + step], least[a : a + step] = at, cost[np.arange(len(x)), at]
    return best, least


def _with_site(columns: list, names: list[str], ids: np.ndarray, costs: np.ndarray):
    import pyarrow as pa

    lost = np.isnan(costs)  # a position that is null, or not of the sites' dimension
    return pa.RecordBatch.from_arrays([*columns, pa.array(ids, mask=lost), pa.array(costs, mask=lost)], names=[*names, "site_id", "cost"])


def assign(points: DataFrame, sites: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds site_id and cost of the best site to ``points`` (batch_id, pos, any others); ties go to the smaller id.

    Every row has its result, rows with equal ids or values too.  Up to SITES_IN_TASK
    sites travel with the tasks, and nothing is shuffled.  More sites are put in the leaves
    of a bounded tree: points go by leaf to tasks of at most POINTS_PER_TASK, which get
    the sites of the leaves that may hold a best site of the region's points
    (regions.near_leaves); a point meets these instead of all sites.

    Points of a batch without sites are left out; a null position, or one of another
    dimension, gets a null site.  Null weights are 0; sites without batch or position are
    left out.  ``keys`` is not needed any more.
    """
    ship_package(points.sparkSession)
    sites = regions.plain_sites(sites)
    out = T.StructType([*points.schema.fields, T.StructField("site_id", T.LongType()), T.StructField("cost", T.DoubleType())])
    few = sites.limit(SITES_IN_TASK + 1).collect()
    if len(few) <= SITES_IN_TASK:
        return points.mapInArrow(_assign_here(few, points.columns), out)
    tree = regions.build_tree(sites)
    if tree is None:
        # More batches than leaves: each batch is a region.
        here, near = points.where("batch_id is not null").withColumn("_leaf", F.col("batch_id").cast("long")), sites.withColumn("_leaf", F.col("batch_id"))
    else:
        here = stage_table(regions.add_leaf(points, tree), "points-by-leaf")
        located, bounds = regions.stage_leaves(sites, tree)
        axes = [F.get("pos", F.lit(d)).cast("double") for d in range(tree.dim)]
        real = reduce(lambda a, b: a & b, [a.isNotNull() & ~F.isnan(a) for a in axes])
        boxes = here.groupBy("_leaf").agg(F.array(*[F.min(F.when(real, a)) for a in axes]).alias("lo"), F.array(*[F.max(F.when(real, a)) for a in axes]).alias("hi")).collect()
        # A region of undefined positions alone has any box.
        leaf = np.array([r["_leaf"] for r in boxes], np.int64)
        lo, hi = (np.nan_to_num(np.array([r[c] for r in boxes], float).reshape(len(leaf), tree.dim)) for c in ("lo", "hi"))
        region, found = regions.near_leaves(bounds, leaf, lo, hi)
        pairs = points.sparkSession.createDataFrame(pd.DataFrame({"_region": leaf[region], "_leaf": found}), "_region long, _leaf long")
        near = located.join(pairs, "_leaf").drop("_leaf").withColumnRenamed("_region", "_leaf")
    shares = stage_table(here.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / POINTS_PER_TASK).alias("_shares")), "point-shares")
    here = here.join(shares, "_leaf").withColumn("_share", F.pmod(F.monotonically_increasing_id(), "_shares")).drop("_shares")
    near = near.join(shares, "_leaf").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares").withColumnsRenamed({"_leaf": "_to", "_share": "_part"})
    names = points.columns

    def work(points, near):
        import pyarrow as pa
        import pyarrow.compute as pc

        order = near.sort_by("site_id")
        dim = pc.max(pc.list_value_length(order.column("pos"))).as_py() or 0
        best, cost = np.zeros(points.num_rows, np.int64), np.full(points.num_rows, np.nan)
        ids = order.column("site_id").to_numpy()
        if len(ids) and points.num_rows:
            best, cost = nearby.best_sites(regions.positions(points.column("pos"), dim), regions.positions(order.column("pos"), dim), order.column("weight").to_numpy(), _best_sites)
            best = ids[best]
        columns = [points.column(c).combine_chunks() for c in names]
        table = pa.Table.from_batches([_with_site(columns, names, best, cost)])
        return table if len(ids) else table.slice(0, 0)

    return here.groupBy("_leaf", "_share").cogroup(near.groupBy("_to", "_part")).applyInArrow(work, out)


def _assign_here(sites: list, names: list[str]):
    """A task's function for a few sites of any batches."""
    batches = {}
    for s in sorted(sites, key=lambda s: (s["batch_id"], s["site_id"])):
        batches.setdefault(s["batch_id"], []).append(s)
    known = {b: (np.array([s["site_id"] for s in rows]), np.array([s["pos"] for s in rows], float), np.array([s["weight"] for s in rows])) for b, rows in batches.items()}

    def work(tables: Iterator) -> Iterator:
        import pyarrow as pa

        at, pos_at = names.index("batch_id"), names.index("pos")
        for table in tables:
            ids = table.column(at)
            batch = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            kept, best, cost = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64), np.full(len(batch), np.nan)
            for b in np.unique(batch).tolist():
                if b not in known:
                    continue
                rows = (batch == b) & ids.is_valid().to_numpy(zero_copy_only=False)
                site_ids, pos, weights = known[b]
                own = table.column(pos_at).filter(pa.array(rows))
                k, cost[rows] = _best_sites(regions.positions(own, pos.shape[1]), pos, weights)
                best[rows], kept[rows] = site_ids[k], True
            yield _with_site(table.columns, names, best, cost).filter(pa.array(kept))

    return work


def axis_histogram(points: DataFrame, axis: int, bins: int = 256) -> DataFrame:
    """Counts of equal bins between an axis' extremes, and the running count from which a node's median bin is read."""
    x = F.get("pos", F.lit(axis))
    ends = points.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    place = F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    rows = points.join(F.broadcast(ends)).select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0)))).cast("long").alias("bin"))
    counts = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("below", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def bounding_box(points: DataFrame, dim: int) -> DataFrame:
    """One row: n, and arrays lo and hi."""
    axes = [F.get("pos", F.lit(d)) for d in range(dim)]
    return points.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(a) for a in axes]).alias("lo"), F.array(*[F.max(a) for a in axes]).alias("hi"))


def assigned_sums(assigned: DataFrame, sites: DataFrame, dim: int, mass: str | None = None) -> DataFrame:
    """Per site: mass, barycenter, second moment about the site; empty cells have mass 0 and no barycenter."""
    m = F.col(mass).cast("double") if mass else F.lit(1.0)
    sums = assigned.groupBy("batch_id", "site_id").agg(F.sum(m).alias("cell_mass"), *[F.sum(m * F.get("pos", F.lit(d))).alias(f"first_{d}") for d in range(dim)], F.sum(m * F.col("cost")).alias("cost"))
    rows = sites.join(sums, ["batch_id", "site_id"], "left")
    return rows.select(
        "batch_id",
        "site_id",
        F.coalesce("cell_mass", F.lit(0.0)).alias("cell_mass"),
        *[(F.col(f"first_{d}") / F.col("cell_mass")).alias(f"barycenter_{d}") for d in range(dim)],
        F.coalesce(F.col("cost") + F.col("weight") * F.col("cell_mass"), F.lit(0.0)).alias("second_moment"),
    )


def dual_value(assigned: DataFrame, sites: DataFrame, site_mass: Column, mass: str | None = None) -> DataFrame:
    """sum of site mass * weight plus the points' mass-weighted least costs, both masses normalised."""
    m = F.col(mass).cast("double") if mass else F.lit(1.0)
    points = assigned.groupBy("batch_id").agg((F.sum(m * F.col("cost")) / F.sum(m)).alias("points"))
    held = sites.withColumn("site_mass", site_mass).groupBy("batch_id").agg((F.sum(F.col("site_mass") * F.col("weight")) / F.sum("site_mass")).alias("sites"))
    return points.join(held, "batch_id").select("batch_id", (F.col("points") + F.col("sites")).alias("dual"))


def bisectors(pairs: DataFrame) -> DataFrame:
    """Adds normal and offset of the cut that site 1 makes in the cell of site 0, for (pos0, weight0, pos1, weight1)."""
    d = arrays.subtract(F.col("pos1"), F.col("pos0"))
    offset = arrays.dot(F.col("pos0"), d) + (arrays.norm2(d) + F.col("weight0") - F.col("weight1")) / 2
    return pairs.withColumn("normal", d).withColumn("offset", offset)


CELL_SCHEMA = (
    "batch_id long, site_id long, pos array<double>, weight double, is_closed boolean, vertices array<array<double>>, "
    "cut_normals array<array<double>>, cut_offsets array<double>, cut_ids array<long>, cut_shifts array<array<double>>"
)


def _sides(pos: np.ndarray, lo: list[float], hi: list[float], periodic: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The box that every site's cell starts from: on periodic axes half-way to the site's own images."""
    half = (np.array(hi) - np.array(lo)) / 2
    return np.where(periodic, pos - half, lo), np.where(periodic, pos + half, hi)


def _side_label(d: int, up: int) -> int:
    return -10 - 2 * d - up


def _flat_cells(pos: np.ndarray, weights: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the rows ``own`` within boxes against all rows: numbers of vertices, vertices, numbers of cuts, cuts as rows or sides.

    A cell meets its nearest sites first, and more only while a farther one may still cut it.
    """
    dim, top = pos.shape[1], float(weights.max(initial=0.0))
    flat = dim == 2
    if flat:
        cells = polygons.boxes(low - pos[own], high - pos[own], [_side_label(d, up) for d in range(2) for up in (0, 1)])
        slack = 1e-15 * (1.0 + np.abs(pos[own]).max(axis=1, initial=0.0))  # rounding of the positions
    else:
        cells = [polytopes.box(a, b) for a, b in zip(low, high, strict=True)]
        for c in cells:
            c.ids[:] = [_side_label(d, up) for d in range(dim) for up in (0, 1)]
    k, todo = NEAR_SITES, np.arange(len(own))
    while len(todo):
        near, gaps, full = nearby.nearest(pos, own[todo], k)
        grow = _clip_polygons if flat else _clip_polytopes
        radius, empty = grow(cells, todo, near, gaps, pos, weights, own, *([slack] if flat else []))
        reach = radius + np.sqrt(np.maximum(0.0, radius * radius - weights[own[todo]] + top))
        todo = todo[~empty & (reach >= full)] if k < len(pos) else todo[:0]
        k *= 4
    if flat:
        valid = cells.valid()
        return cells.n, (cells.vertices + pos[own, None])[valid], cells.n, cells.labels[valid]
    used = [[c.ids[i] for i in sorted(frozenset().union(*c.on))] if c.on else [] for c in cells]
    return np.array([len(c.vertices) for c in cells]), np.concatenate([np.zeros((0, dim)), *[c.vertices for c in cells]]), np.array([len(u) for u in used]), np.array(sum(used, []), np.int64)


def _clip_polygons(rings, todo, near, gaps, pos, weights, own, slack) -> tuple[np.ndarray, np.ndarray]:
    """Cuts polygons around their sites by near sites, the strongest ones first; their radii and whether they are empty."""
    w, theirs = weights[own[todo]], weights[near]
    order = np.argsort(gaps * gaps - theirs, axis=1, kind="stable")
    near, gaps, theirs = (np.take_along_axis(x, order, axis=1) for x in (near, gaps, theirs))
    radius = rings.radii(todo)
    for c in range(near.shape[1]):
        g = gaps[:, c]
        room = radius * radius - w + theirs[:, c]
        far = (g > radius) & ((g - radius) ** 2 >= room)
        at = np.flatnonzero((near[:, c] >= 0) & (g > 0) & (rings.n[todo] > 2) & ~far)
        if not len(at):
            continue
        j, g = near[at, c], g[at]
        cut = rings.clip(todo[at], (pos[j] - pos[own[todo[at]]]) / g[:, None], (g + (w[at] - theirs[at, c]) / g) / 2, j, slack[todo[at]])
        radius[at[cut]] = rings.radii(todo[at[cut]])
    return radius, rings.n[todo] <= 2


def _clip_polytopes(cells, todo, near, gaps, pos, weights, own) -> tuple[np.ndarray, np.ndarray]:
    """_clip_polygons in any dimension, one cell after the other, nearest sites first."""
    radius = np.zeros(len(todo))
    order = np.argsort(gaps, axis=1, kind="stable")
    top = float(weights.max())
    for t, i in enumerate(todo.tolist()):
        cell, p, w = cells[i], pos[own[i]], weights[own[i]]
        for c in order[t].tolist():
            j, gap = int(near[t, c]), gaps[t, c]
            if j < 0 or cell.empty:
                break
            r = np.linalg.norm(cell.vertices - p, axis=1).max()
            if gap > r and (gap - r) ** 2 >= r * r - w + top:
                break
            if gap == 0.0:  # the table holds one site of a place
                continue
            d = pos[j] - p
            cell = polytopes.clip(cell, d, float(p @ d) + (float(d @ d) + w - weights[j]) / 2, j)
        cells[i] = cell
        radius[t] = np.linalg.norm(cell.vertices - p, axis=1).max(initial=0.0)
    return radius, np.array([cells[i].empty for i in todo.tolist()])


def _image_shifts(lo: list[float], hi: list[float], periodic: list[bool]) -> np.ndarray:
    """Shifts of a site's images that can cut cells of sites in the box; the first is zero."""
    steps = [(0, -1, 1) if p else (0,) for p in periodic]
    return np.array(list(product(*steps)), float) * (np.array(hi) - np.array(lo))


def cells(sites: DataFrame, lo: list[float], hi: list[float], periodic: list[bool] | None = None) -> DataFrame:
    """Cells of all sites in the box [lo, hi], one row a site.

    Sites are tiled by the leaves of a bounded tree.  A tile's task first sees the sites of
    the tiles next to it.  What may still cut a cell is known from its radius and the
    leaves' boxes and heaviest sites: a cell is final if its task has seen all such leaves,
    and the others are done again with exactly the leaves that they lack.

    On ``periodic`` axes the box is a torus: positions are moved into it, and a site meets
    the images of all sites, its own too.  Cells are given around their site and may reach
    over the box; cut_shifts says by how much a cut's site was moved.

    cut_ids are sites, or polytopes.BOUNDARY.  Of sites at one place the heaviest, then the
    one with the smaller id, has the cell; the others, like all cells without points, have
    no vertices.  Null weights are 0; sites without batch or position are left out.
    """
    spark = sites.sparkSession
    ship_package(spark)
    dim, lo, hi = len(lo), [float(x) for x in lo], [float(x) for x in hi]
    periodic = periodic or [False] * dim
    src = regions.plain_sites(sites)
    if any(periodic):
        moved = [F.lit(a) + F.pmod(F.get("pos", F.lit(d)) - F.lit(a), F.lit(b - a)) if p else F.get("pos", F.lit(d)) for d, (a, b, p) in enumerate(zip(lo, hi, periodic, strict=True))]
        src = src.withColumn("pos", F.array(*moved))
    lead = src.groupBy("batch_id", "pos").agg(F.max(F.struct("weight", (-F.col("site_id")).alias("id"))).alias("lead"))
    marked = src.join(lead, ["batch_id", "pos"]).withColumn("leads", F.col("lead") == F.struct(F.col("weight"), (-F.col("site_id")).alias("id"))).drop("lead")
    marked = stage_table(marked.select(*src.columns, "leads"), "cell-places")
    kinds = {"vertices": "array<array<double>>", "cut_normals": "array<array<double>>", "cut_offsets": "array<double>", "cut_ids": "array<long>", "cut_shifts": "array<array<double>>"}
    hidden = marked.where("not leads").select(*src.columns, F.lit(True).alias("is_closed"), *[F.array().cast(t).alias(n) for n, t in kinds.items()])
    leading = marked.where("leads").drop("leads")
    shifts = _image_shifts(lo, hi, periodic)
    most = leading.groupBy("batch_id").count().agg(F.max("count")).first()[0] or 0
    tree = regions.build_tree(leading, SITES_PER_TILE) if most > SITES_PER_TILE else None
    if tree is None:
        # Small batches, or more batches than leaves: a batch is a tile, and all its images are seen at once.
        located, bounds, pairs = leading.withColumn("_leaf", F.col("batch_id")), None, None
        seen = located.withColumn("_tile", F.col("_leaf")).withColumn("_image", F.explode(F.array(*[F.lit(k) for k in range(len(shifts))])))
    else:
        located, bounds = regions.stage_leaves(leading, tree)
        pairs = regions.tiles_around(bounds, shifts, 4**dim)
        seen = located.join(spark.createDataFrame(pairs, "_tile long, _leaf long, _image int"), "_leaf")

    def work(table):
        import pyarrow as pa

        pos = regions.positions(table.column("pos"), dim)
        image, weights, ids, batch = (table.column(c).to_numpy() for c in ("_image", "weight", "site_id", "batch_id"))
        tile, leaf = int(table.column("_tile")[0].as_py()), table.column("_leaf").to_numpy()
        own = np.flatnonzero((leaf == tile) & (image == 0) & table.column("_todo").to_numpy(zero_copy_only=False))
        pos = pos + shifts[image]
        low, high = _sides(pos[own], lo, hi, periodic)
        n, vertices, n_cuts, cut = _flat_cells(pos, weights, own, low, high)
        # Cuts are rows, or sides of the box: the boundary, or half-way to an image of the site itself.
        of = np.repeat(np.arange(len(own)), n_cuts)
        side, k, j = cut < 0, own[of], np.maximum(cut, 0)
        d, up = np.divmod(np.where(side, -10 - cut, 0), 2)
        out = (2.0 * up - 1.0)[:, None] * np.eye(dim)[d]
        normals = np.where(side[:, None], out, pos[j] - pos[k])
        middle = (pos[k] * normals).sum(axis=1) + ((normals * normals).sum(axis=1) + weights[k] - weights[j]) / 2
        offsets = np.where(side, np.where(up == 1, high[of, d], -low[of, d]), middle)
        itself = side & np.array(periodic)[d]
        cut_ids = np.where(side, np.where(itself, ids[k], polytopes.BOUNDARY), ids[j])
        moved = np.where(side[:, None], np.where(itself, np.array(hi)[d] - np.array(lo)[d], 0.0)[:, None] * out, shifts[image[j]])
        rows = more = images = np.zeros(0, np.int64)
        if bounds is not None and len(own):
            radius, owner = np.full(len(own), -1.0), np.repeat(np.arange(len(own)), n)
            np.maximum.at(radius, owner, np.sqrt(((vertices - pos[own[owner]]) ** 2).sum(axis=1)))
            real = np.flatnonzero(n)
            rows, more, images = regions.leaves_in_reach(bounds, shifts, int(batch[own[0]]), pos[own[real]], radius[real], radius[real] ** 2 - weights[own[real]])
            new = ~np.isin(more * len(shifts) + images, np.unique(leaf * len(shifts) + image))
            rows, more, images = real[rows[new]], more[new], images[new]
        lacks = np.bincount(rows, minlength=len(own))
        order = np.argsort(rows, kind="stable")

        def lists(values, counts):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))

        def vectors(x):
            return lists(np.ascontiguousarray(x).ravel(), np.full(len(x), dim))

        columns = [pa.array(batch[own]), pa.array(ids[own]), vectors(pos[own]), pa.array(weights[own]), pa.array(np.ones(len(own), bool)), lists(vectors(vertices), n)]
        columns += [lists(vectors(normals), n_cuts), lists(offsets, n_cuts), lists(cut_ids, n_cuts), lists(vectors(moved), n_cuts)]
        return pa.table([*columns, pa.array(np.full(len(own), tile)), lists(more[order], lacks), lists(images[order], lacks)], names=fields)

    schema = f"{CELL_SCHEMA}, _tile long, _more array<long>, _images array<long>"
    fields = [x.strip().split(" ")[0] for x in schema.split(", ")]
    columns = fields[:10]
    made = stage_table(seen.withColumn("_todo", F.lit(True)).groupBy("_tile").applyInArrow(work, schema), "cells")
    done = made.where("size(_more) = 0").select(*columns).unionByName(hidden.select(*columns))
    open_cells = made.where("size(_more) > 0")
    if bounds is None or open_cells.isEmpty():
        return done
    lacking = open_cells.select("_tile", F.explode(F.arrays_zip("_more", "_images")).alias("x")).select("_tile", F.col("x._more").alias("_leaf"), F.col("x._images").cast("int").alias("_image"))
    before = spark.createDataFrame(pairs, "_tile long, _leaf long, _image int").join(open_cells.select("_tile").distinct(), "_tile")
    wanted = open_cells.select("batch_id", "site_id").withColumn("_todo", F.lit(True))
    again = located.join(lacking.unionByName(before).distinct(), "_leaf").join(wanted, ["batch_id", "site_id"], "left").withColumn("_todo", F.coalesce("_todo", F.lit(False)))
    # A cell only shrinks, so it lacks nothing now.
    return done.unionByName(stage_table(again.groupBy("_tile").applyInArrow(work, schema), "cells").select(*columns))


def boundary_distances(assigned: DataFrame, diagram: DataFrame) -> DataFrame:
    """Adds to points (batch_id, site_id, pos) the distance to the boundary of their cell.

    It is negative outside the cell, and null where the diagram lacks the cell.  The join
    is outer since an inner one checks site_id for null first, which runs the assignment twice.
    """
    # Unit normals are made once a cell, not once a point.
    unit = F.zip_with("cut_normals", "cut_offsets", lambda n, o: F.struct(arrays.normalized(n).alias("normal"), (o / arrays.norm(n)).alias("offset")))
    cuts = diagram.select("batch_id", "site_id", unit.alias("cuts"))
    gaps = F.transform("cuts", lambda c: c["offset"] - arrays.dot(c["normal"], F.col("pos")))
    return assigned.join(cuts, ["batch_id", "site_id"], "left").withColumn("distance", F.array_min(gaps)).drop("cuts")


def _cells_by_box(diagram: DataFrame, grid: DataFrame, knots: list[list[float]], periodic: list[bool] | None) -> DataFrame:
    """Pairs of a cell and a grid box that its bounding box covers; the boxes repeat along periodic axes, moved by turn."""
    dim = len(knots)
    at, periodic = F.col("vertices"), periodic or [False] * dim
    rows = diagram.where(F.size("vertices") > dim).withColumn("all_idx", F.array(F.array().cast("array<int>")))
    for d, axis in enumerate(knots):
        period = axis[-1] - axis[0]
        repeated = [x + k * period for k in (-1, 0, 1) for x in axis[:-1]][1:] if periodic[d] else axis[1:-1]
        inner = F.array(*[F.lit(float(x)) for x in repeated]).cast("array<double>")
        rows = rows.withColumn("low", F.array_min(cells_of.axis_values(at, d))).withColumn("high", F.array_max(cells_of.axis_values(at, d)))
        a, b = F.size(F.filter(inner, lambda k: k <= F.col("low"))), F.size(F.filter(inner, lambda k: k < F.col("high")))
        rows = rows.withColumn("span", F.sequence(F.least(a, b), F.greatest(a, b))).withColumn("all_idx", F.flatten(F.transform("all_idx", lambda e: F.transform("span", lambda i: F.concat(e, F.array(i)))))).drop("span", "low", "high")
    rows = rows.withColumn("place", F.explode("all_idx")).drop("all_idx", "vertices")
    sizes = [len(axis) - 1 for axis in knots]
    at_place = [F.get("place", F.lit(d)) for d in range(dim)]
    turns = [F.floor(x / n) - 1 if p else F.lit(0) for x, n, p in zip(at_place, sizes, periodic, strict=True)]
    rows = rows.withColumn("idx", F.array(*[F.pmod(x, F.lit(n)).cast("int") for x, n in zip(at_place, sizes, strict=True)]))
    rows = rows.withColumn("turn", F.array(*[(t * F.lit(axis[-1] - axis[0])).cast("double") for t, axis in zip(turns, knots, strict=True)]))
    no_cuts = [F.array().cast("array<array<double>>").alias("piece_normals"), F.array().cast("array<double>").alias("piece_offsets")]
    # Once written, the grid's size is known: a small one is broadcast, so that cells of few boxes do not meet in few tasks.
    boxes = stage_table(grid.select("batch_id", "idx", "lo", "hi", "coeffs"), "grid-boxes")
    return rows.join(boxes, ["batch_id", "idx"]).select("*", *no_cuts)


def cell_integrals(diagram: DataFrame, grid: DataFrame, knots: list[list[float]], order: int, periodic: list[bool] | None = None, balls: bool = False) -> DataFrame:
    """Integrals of a polynomial grid over cells: one row per site and one per facet with a neighbour.

    Cells are matched to the grid boxes that their bounding box covers by explicit
    indices, an equi-join; each box is clipped by the cell's cuts.  On ``periodic`` axes
    the grid repeats with the period of its knots.  Site rows have neighbor null, mass,
    first (vector), second (integral of ||x||**2) and arc; facet rows have neighbor, shift
    (by which it was moved), facet, and facet_first and facet_second, the integrals of x
    and of its products of coordinates, row by row.

    With ``balls`` (two dimensions) every cell is cut by the ball around its site whose
    squared radius is the weight, as partial transport asks: what is farther costs more
    than it is worth.  arc is then the integral over the circle's arcs within the cell.
    Cells with a weight of 0 or less have no mass.
    """
    ship_package(diagram.sparkSession)
    dim = len(knots)
    if balls and dim != 2:
        raise ValueError("balls cut cells in two dimensions only")
    return _sum_parts(_integrate(_cells_by_box(diagram, grid, knots, periodic), dim, order, balls), dim)


def _integrate(joined: DataFrame, dim: int, order: int, balls: bool) -> DataFrame:
    """Integrals over every pair of a cell and a piece (idx): its box lo to hi moved by turn, its own cuts, and coeffs in the tensor basis.

    pos in the result is the site as seen from the piece, moved back by turn.
    """
    exponents = arrays.grid_exponents(order, dim)
    degree = order * dim + 2

    def work_flat(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                yield _integrate_flat(batch.slice(at, PAIRS), names, exponents, degree, balls)

    def work(batches):
        import pyarrow as pa

        zero = [0.0] * dim
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for k in range(batch.num_rows):
                turn, pos, coeffs = np.array(rows["turn"][k]), np.array(rows["pos"][k]), np.array(rows["coeffs"][k])
                part = polytopes.box(np.array(rows["lo"][k]) + turn, np.array(rows["hi"][k]) + turn)
                for n, o in zip(rows["piece_normals"][k], rows["piece_offsets"][k], strict=True):
                    part = polytopes.clip(part, n, o, polytopes.BOUNDARY)
                cuts = list(zip(rows["cut_normals"][k], rows["cut_offsets"][k], rows["cut_ids"][k], strict=True))
                for c, (n, o, i) in enumerate(cuts):
                    part = polytopes.clip(part, n, o, c if i >= 0 else polytopes.BOUNDARY)
                if part.empty:
                    continue

                def density(x, coeffs=coeffs, turn=turn):
                    x = x - turn
                    return sum(c * np.prod([x[:, d] ** e for d, e in enumerate(powers)], axis=0) for c, powers in zip(coeffs, exponents, strict=True))

                arc = 0.0
                x, w = polytopes.quadrature([part.vertices[s] for s in polytopes.simplices(part)], degree)
                faces = [(part.ids[c], polytopes.quadrature(polytopes.facet_simplices(part, members, c), degree)) for c, members in polytopes.facets(part) if part.ids[c] >= 0]
                if len(w):
                    m = w * density(x)
                    out.append((rows["batch_id"][k], rows["site_id"][k], (pos - turn).tolist(), rows["idx"][k], None, None, float(m.sum()), (m @ x).tolist(), float(m @ (x * x).sum(axis=1)), arc, 0.0, zero, zero * dim))
                for c, (x, w) in faces:
                    if len(w):
                        m = w * density(x)
                        products = (x.T * m) @ x
                        out.append((rows["batch_id"][k], rows["site_id"][k], (pos - turn).tolist(), rows["idx"][k], cuts[c][2], rows["cut_shifts"][k][c], 0.0, zero, 0.0, 0.0, float(m.sum()), (m @ x).tolist(), products.ravel().tolist()))
            vector = pa.list_(pa.float64())
            kinds = [pa.int64(), pa.int64(), vector, pa.list_(pa.int32()), pa.int64(), vector, pa.float64(), vector, pa.float64(), pa.float64(), pa.float64(), vector, vector]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    schema = "batch_id long, site_id long, pos array<double>, idx array<int>, neighbor long, shift array<double>, mass double, first array<double>, second double, arc double, facet double, facet_first array<double>, facet_second array<double>"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return joined.select("batch_id", "site_id", "pos", "idx", "weight", "lo", "hi", "turn", "coeffs", "piece_normals", "piece_offsets", "cut_normals", "cut_offsets", "cut_ids", "cut_shifts").mapInArrow(work_flat if dim == 2 else work, schema)


def _padded(column, dim: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of lists of numbers, or of vectors, as rows of one length, and the lists' lengths."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    values = (values.flatten() if dim else values).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0)), *([dim] if dim else [])), values.dtype)
    out[np.arange(out.shape[1]) < n[:, None]] = values.reshape(-1, dim) if dim else values
    return out, n


def _integrate_flat(batch, names: list[str], exponents: list, degree: int, balls: bool):
    """_integrate in two dimensions for all rows of a batch at once, in coordinates around the sites."""
    import pyarrow as pa

    pos, lo, hi, turn, coeffs = (_padded(batch.column(c))[0] for c in ("pos", "lo", "hi", "turn", "coeffs"))
    weight = batch.column("weight").to_numpy()
    slack = 1e-15 * (1.0 + np.abs(pos).max(axis=1, initial=0.0))
    rings = polygons.boxes(lo + turn - pos, hi + turn - pos)
    if balls:
        rings.n[weight <= 0] = 0
    ids = _padded(batch.column("cut_ids"))[0]
    for kind in ("piece", "cut"):
        normals, n = _padded(batch.column(f"{kind}_normals"), 2)
        offsets = _padded(batch.column(f"{kind}_offsets"))[0]
        for c in range(normals.shape[1]):
            at = np.flatnonzero((n > c) & (rings.n > 2))
            size = np.sqrt((normals[at, c] ** 2).sum(axis=1))
            at, size = at[size > 0], size[size > 0]
            if len(at):
                labels = np.where(ids[at, c] >= 0, c, polytopes.BOUNDARY) if kind == "cut" else np.full(len(at), polytopes.BOUNDARY)
                rings.clip(at, normals[at, c] / size[:, None], (offsets[at, c] - (normals[at, c] * pos[at]).sum(axis=1)) / size, labels, slack[at])

    N = batch.num_rows
    center = pos - turn

    def weighed(nodes, of):
        """Nodes with the density in their weights, around the origin of the grid."""
        x = nodes.x + center[of, None]
        density = sum(coeffs[of, c, None] * np.prod([x[:, :, d] ** e for d, e in enumerate(powers)], axis=0) for c, powers in enumerate(exponents))
        return nodes.x + pos[of, None], nodes.w * density

    def total(of, x, n):
        return np.bincount(of, weights=x, minlength=n)

    arc = np.zeros(N)
    if balls:
        inside, arcs, (k, label, edges) = polygons.disk_nodes(rings, np.sqrt(np.maximum(weight, 0.0)), degree)
        arc = total(arcs.of, weighed(arcs, arcs.of)[1].sum(axis=1), N)
    else:
        inside, (k, label, edges) = [polygons.inside_nodes(rings, degree)], polygons.edge_nodes(rings, degree)
    sums = np.zeros((4, N))
    for nodes in inside:
        x, m = weighed(nodes, nodes.of)
        for i, f in enumerate((1.0, x[:, :, 0], x[:, :, 1], (x * x).sum(axis=2))):
            sums[i] += total(nodes.of, (m * f).sum(axis=1), N)
    x, m = weighed(edges, k)
    facet = np.stack([(m * f).sum(axis=1) for f in (1.0, x[:, :, 0], x[:, :, 1], x[:, :, 0] ** 2, x[:, :, 0] * x[:, :, 1], x[:, :, 1] ** 2)])
    own = np.flatnonzero(rings.n > 2)
    a, b, at = len(own), len(k), np.concatenate([own, k])

    def column(first, second):
        return pa.array(np.concatenate([first, second]))

    def vector(first, second, n):
        return pa.ListArray.from_arrays(pa.array(np.arange(a + b + 1) * n, pa.int32()), pa.array(np.concatenate([first, second]).ravel()))

    cut_shifts = _padded(batch.column("cut_shifts"), 2)[0]
    shift = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(a), np.arange(b + 1) * 2]), pa.int32(), mask=np.arange(a + b + 1) < a), pa.array((cut_shifts[k, label] if b else np.zeros((0, 2))).ravel()))
    columns = [batch.column("batch_id").take(pa.array(at)), batch.column("site_id").take(pa.array(at)), vector(center[own], center[k], 2), batch.column("idx").take(pa.array(at))]
    columns += [pa.array(np.concatenate([np.zeros(a, np.int64), ids[k, label] if b else np.zeros(0, np.int64)]), mask=np.arange(a + b) < a), shift]
    columns += [column(sums[0, own], np.zeros(b)), vector(sums[1:3, own].T, np.zeros((b, 2)), 2), column(sums[3, own], np.zeros(b)), column(arc[own], np.zeros(b))]
    columns += [column(np.zeros(a), facet[0]), vector(np.zeros((a, 2)), facet[1:3].T, 2), vector(np.zeros((a, 4)), facet[[3, 4, 4, 5]].T, 4)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _sum_parts(parts: DataFrame, dim: int) -> DataFrame:
    def vector(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.get(name, F.lit(d))) for d in range(n)]).alias(name)

    numbers = {c: F.sum(c).alias(c) for c in ("mass", "second", "arc", "facet")}
    return parts.groupBy("batch_id", "site_id", "neighbor", "shift").agg(numbers["mass"], vector("first", dim), numbers["second"], numbers["arc"], numbers["facet"], vector("facet_first", dim), vector("facet_second", dim * dim))


def image_integrals(diagram: DataFrame, grid: DataFrame, knots: list[list[float]], order: int = 0, periodic: list[bool] | None = None, balls: bool = False) -> DataFrame:
    """What the plan's map does to every box of the grid: batch_id, idx, mass, target.

    mass is the density's in the box, as far as cells (and balls) cover it, and target the
    integral of the site that each point goes to, so that target / mass is the mean place
    in the box's image.  On periodic axes sites are taken next to the box.  Boxes that no
    cell meets have no row.
    """
    ship_package(diagram.sparkSession)
    dim = len(knots)
    joined = _cells_by_box(diagram, grid, knots, periodic)
    parts = _integrate(joined, dim, order, balls).where("neighbor is null")
    target = [F.sum(F.col("mass") * F.get("pos", F.lit(d))) for d in range(dim)]
    return parts.groupBy("batch_id", "idx").agg(F.sum("mass").alias("mass"), F.array(*target).alias("target"))


def piece_integrals(diagram: DataFrame, pieces: DataFrame, dim: int, order: int = 0, balls: bool = False, tiles: int = 32) -> DataFrame:
    """The integrals of cell_integrals over densities made of convex pieces (measures.convex_pieces, measures.mesh_pieces).

    Pieces may overlap and have coefficients of any sign, so that an obstacle is a piece of
    its own.  Cells and pieces meet in the tiles of a grid of ``tiles`` an axis over each
    batch's pieces that both boxes cover; a pair that shares several is kept in the one
    that holds the lower corner of the common box.
    """
    ship_package(diagram.sparkSession)
    if balls and dim != 2:
        raise ValueError("balls cut cells in two dimensions only")
    at = F.col("vertices")
    rows = diagram.where(F.size("vertices") > dim)
    for name, f in (("low", F.array_min), ("high", F.array_max)):
        rows = rows.withColumn(name, F.array(*[f(cells_of.axis_values(at, d)) for d in range(dim)]))
    pieces = stage_table(pieces, "pieces")  # a small table of known size is broadcast
    ends = pieces.groupBy("batch_id").agg(*[f(F.get(c, F.lit(d))).alias(f"{n}{d}") for d in range(dim) for f, c, n in ((F.min, "lo", "a"), (F.max, "hi", "b"))])

    def place(x: Column, d: int) -> Column:
        width = F.col(f"b{d}") - F.col(f"a{d}")
        return F.least(F.lit(tiles - 1), F.greatest(F.lit(0), F.floor((x - F.col(f"a{d}")) / F.when(width > 0, width).otherwise(1.0) * tiles))).cast("int")

    def spread(table: DataFrame, low: str, high: str) -> DataFrame:
        table = table.join(ends, "batch_id")
        for d in range(dim):
            table = table.withColumn(f"t{d}", F.explode(F.sequence(place(F.get(low, F.lit(d)), d), place(F.get(high, F.lit(d)), d))))
        return table

    tile = [f"t{d}" for d in range(dim)]
    left = spread(rows.select("batch_id", "site_id", "pos", "weight", "low", "high", "cut_normals", "cut_offsets", "cut_ids", "cut_shifts"), "low", "high")
    right = spread(pieces.select("batch_id", "lo", "hi", "coeffs", F.col("normals").alias("piece_normals"), F.col("offsets").alias("piece_offsets")), "lo", "hi").drop(*[f"{n}{d}" for n in "ab" for d in range(dim)])
    joined = left.join(right, ["batch_id", *tile])
    for d in range(dim):
        corner = F.greatest(F.get("low", F.lit(d)), F.get("lo", F.lit(d)))
        joined = joined.where((corner <= F.least(F.get("high", F.lit(d)), F.get("hi", F.lit(d)))) & (F.col(f"t{d}") == place(corner, d)))
    joined = joined.withColumn("turn", F.array(*[F.lit(0.0)] * dim)).withColumn("idx", F.array().cast("array<int>"))
    return _sum_parts(_integrate(joined, dim, order, balls), dim)


def _facets(integrals: DataFrame, sites: DataFrame) -> DataFrame:
    """Facet rows with both sites' positions, the neighbour's moved by its shift, and their distance."""
    p = sites.select("batch_id", F.col("site_id").alias("row"), F.col("pos").alias("pos0"))
    q = sites.select("batch_id", F.col("site_id").alias("col"), F.col("pos").alias("pos1"))
    rows = integrals.where("neighbor is not null").withColumnsRenamed({"site_id": "row", "neighbor": "col"})
    rows = rows.join(p, ["batch_id", "row"]).join(q, ["batch_id", "col"]).withColumn("pos1", arrays.add(F.col("pos1"), F.col("shift")))
    return rows.withColumn("apart", arrays.norm(arrays.subtract(F.col("pos1"), F.col("pos0"))))


def matrix_terms(integrals: DataFrame, sites: DataFrame) -> DataFrame:
    """Newton's matrix, the derivatives of masses by weights, as (batch_id, row, col, val) triplets without the gauge.

    Off the diagonal it is -facet / (2 distance); rows sum to zero but for cells cut by
    balls, which grow by arc / (2 radius).  Facets between images of one site cancel.
    ``sites`` are those of the diagram, with positions inside a periodic box.
    """
    # Every row gives its triplets at once: to take the integrals twice is to compute them twice.
    p = sites.select("batch_id", F.col("site_id").alias("row"), F.col("pos").alias("pos0"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    q = sites.select("batch_id", F.col("site_id").alias("col"), F.col("pos").alias("pos1"))
    rows = integrals.where("neighbor != site_id or arc > 0").withColumnsRenamed({"site_id": "row", "neighbor": "col"})
    rows = rows.join(p, ["batch_id", "row"]).join(q, ["batch_id", "col"], "left")
    val = -F.col("facet") / (2 * arrays.norm(arrays.subtract(arrays.add(F.col("pos1"), F.col("shift")), F.col("pos0"))))
    terms = [F.struct(F.col(c).alias("col"), x.alias("val")) for c, x in (("col", val), ("row", -val), ("row", F.col("arc") / (2 * F.sqrt("weight"))))]
    each = F.when(F.col("col").isNull(), F.array(terms[2])).otherwise(F.array(*terms[:2]))
    return sum_triplets(rows.select("batch_id", "row", F.explode(each).alias("t")).select("batch_id", "row", "t.*"))


def centroid_jacobian(integrals: DataFrame, sites: DataFrame, dim: int) -> DataFrame:
    """Derivatives of all cells' centroids and masses by all sites' positions and weights, as triplets.

    Rows and columns are (site, axis): axes 0 to dim - 1 are the centroid's and the
    position's coordinates, axis dim the mass and the weight.  Only neighbours meet, so the
    matrix has a block per facet and one per site.  A site's facet moves, in the direction
    of its normal, by (x - p) / distance as the site moves and by 1 / (2 distance) as its
    weight grows, and the other way for its neighbour; facet moments give the rest.

    Returns batch_id, row, row_axis, col, col_axis, val; integrals are those of whole cells
    (without balls), ``sites`` those of the diagram.  Cells without mass have no rows.
    """
    integrals = stage_table(integrals, "integrals")  # read twice
    whole = integrals.where("neighbor is null and mass > 0").select("batch_id", F.col("site_id").alias("row"), F.col("mass").alias("cell_mass"), F.transform("first", lambda x: x / F.col("mass")).alias("centroid"))
    rows = _facets(integrals, sites).join(whole, ["batch_id", "row"])
    moment = [F.get("facet_first", F.lit(d)) for d in range(dim)]
    terms = []
    for sign, site, pos in ((1.0, "row", "pos0"), (-1.0, "col", "pos1")):
        for b in range(dim + 1):
            p = F.get(pos, F.lit(b))
            # Integrals over the facet of the normal speed, and of the speed times each coordinate.
            grown = F.col("facet") / 2 if b == dim else moment[b] - p * F.col("facet")
            grown = sign * grown / F.col("apart")
            for a in range(dim + 1):
                if a == dim:
                    value = grown
                else:
                    carried = moment[a] / 2 if b == dim else F.get("facet_second", F.lit(a * dim + b)) - p * moment[a]
                    value = (sign * carried / F.col("apart") - F.get("centroid", F.lit(a)) * grown) / F.col("cell_mass")
                terms.append(F.struct(F.col("row").alias("row"), F.lit(a).alias("row_axis"), F.col(site).alias("col"), F.lit(b).alias("col_axis"), value.alias("val")))
    each = rows.select("batch_id", F.explode(F.array(*terms)).alias("t")).select("batch_id", "t.*")
    return each.groupBy("batch_id", "row", "row_axis", "col", "col_axis").agg(F.sum("val").alias("val"))


def sum_triplets(terms: DataFrame) -> DataFrame:
    return terms.groupBy("batch_id", "row", "col").agg(F.sum("val").alias("val"))


def spatial_tree(points: DataFrame, dim: int, leaf: int = 30, max_depth: int = 30) -> tuple[DataFrame, DataFrame]:
    """A binary tree by approximate medians of the longest axis: (points with node, nodes).

    One grouped aggregation and one join a level; where the median is the largest value,
    the middle of the extent splits.  Nodes with at most ``leaf`` points, of one place or at
    the last level stay leaves.  Nodes are (node, n, lo, hi, axis, split).
    """
    axes = [F.get("pos", F.lit(d)) for d in range(dim)]
    rows, nodes = points.withColumn("node", F.lit(1).cast("long")), None
    for depth in range(max_depth + 1):
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(a) for a in axes]).alias("lo"), F.array(*[F.max(a) for a in axes]).alias("hi"), F.array(*[F.percentile_approx(a, 0.5, 10_000) for a in axes]).alias("mid"))
        extent = arrays.subtract(F.col("hi"), F.col("lo"))
        stats = stats.withColumn("axis", arrays.arg_max(extent))
        low, high, mid = (F.get(c, F.col("axis")) for c in ("lo", "hi", "mid"))
        split = F.when((F.col("n") > leaf) & (low < high) & F.lit(depth < max_depth), F.when(mid < high, mid).otherwise((low + high) / 2))
        stats = stage_table(stats.withColumn("split", split).drop("mid"), "tree-level")
        nodes = stats if nodes is None else nodes.unionByName(stats.join(nodes.select("node"), "node", "left_anti"))
        if stats.where("split is not null").isEmpty():
            break
        side = F.when(F.col("split").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (F.get("pos", F.col("axis")) > F.col("split")).cast("long"))
        rows = stage_table(rows.join(stats.select("node", "axis", "split"), "node").withColumn("node", side).select(*points.columns, "node"), "tree-rows")
    return rows, nodes


def principal_axes(points: DataFrame, dim: int) -> DataFrame:
    """Mean, covariance and leading axis of every node's points (node, pos): node, n, mean, covariance, axis, spread.

    Covariances are grouped sums about the node's mean, row by row; the axis is the
    eigenvector of the largest eigenvalue (spread), its first coordinate that is not zero
    positive.  Points of one place have spread 0 and the first axis.
    """
    ship_package(points.sparkSession)
    x = [F.get("pos", F.lit(d)).cast("double") for d in range(dim)]
    pairs = [(i, j) for i in range(dim) for j in range(dim)]
    rows = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("covariance"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            m = np.array(batch.column("covariance").to_pylist(), float).reshape(-1, dim, dim)
            values, vectors = np.linalg.eigh((m + m.transpose(0, 2, 1)) / 2)
            axis = vectors[:, :, -1]
            spread = np.maximum(values[:, -1], 0.0)
            flat = spread <= 1e-14 * np.maximum(1.0, np.abs(np.array(batch.column("mean").to_pylist(), float).reshape(-1, dim)).max(axis=1)) ** 2
            axis[flat], spread[flat] = np.eye(dim)[0], 0.0
            first = axis[np.arange(len(axis)), np.argmax(np.abs(axis) > 1e-12, axis=1)]
            axis = axis * np.where(first < 0, -1.0, 1.0)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(axis.tolist(), pa.list_(pa.float64())), pa.array(spread)], names=[*batch.schema.names, "axis", "spread"])

    out = T.StructType([*rows.schema.fields, T.StructField("axis", T.ArrayType(T.DoubleType())), T.StructField("spread", T.DoubleType())])
    return rows.mapInArrow(work, out)


def split_by_axes(points: DataFrame, dim: int) -> DataFrame:
    """Points (node, pos, any others) with the child of their node: 2 node behind the mean along the leading axis, 2 node + 1 beyond it.

    Nodes whose points are all at one place are not split.  A node's mean and axis go to
    its points by a join on the node.
    """
    axes = principal_axes(points.select("node", "pos"), dim).select("node", F.struct("mean", "axis", "spread").alias("_split"))
    along = arrays.dot(F.col("_split.axis"), arrays.subtract(F.col("pos"), F.col("_split.mean")))
    child = F.when(F.col("_split.spread") > 0, F.col("node") * 2 + (along > 0).cast("long")).otherwise(F.col("node"))
    return points.join(axes, "node").withColumn("node", child).select(*points.columns)


def weight_bound(points: DataFrame, dim: int) -> DataFrame:
    """Sums of the normal equations for an affine fit of weights: per node, products of (1, pos) and with weight."""
    v = [F.lit(1.0), *[F.get("pos", F.lit(d)) for d in range(dim)]]
    sums = [F.sum(v[i] * v[j]).alias(f"s{i}{j}") for i in range(dim + 1) for j in range(i, dim + 1)]
    return points.groupBy("node").agg(*sums, *[F.sum(v[i] * F.col("weight")).alias(f"r{i}") for i in range(dim + 1)])


def replicate(sites: DataFrame, shifts: list[list[float]]) -> DataFrame:
    """Sites and their copies at every shift (periodic domains): image is 0 for the originals."""
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in [[0.0] * len(shifts[0]), *shifts]])
    rows = sites.select("*", F.posexplode(moves).alias("image", "shift"))
    return rows.withColumn("pos", arrays.add(F.col("pos"), F.col("shift"))).drop("shift")


def transform_sites(sites: DataFrame, transformations: list[list[list[float]]]) -> DataFrame:
    """Sites (batch_id, site_id, pos, weight) and their images under affine maps; image is 0 for the originals.

    A map is a square matrix of one row more than there are axes, which acts on (pos, 1);
    its last row must be 0, ..., 0, 1.  A null position stays null, others must have the
    maps' number of axes.  Other columns are kept, but for one named image, which is
    replaced; no maps give the originals alone, no sites no rows.
    """
    dim = len(transformations[0]) - 1 if transformations else 0
    for m in transformations:
        if len(m) != dim + 1 or any(len(row) != dim + 1 for row in m) or list(m[-1]) != [0.0] * dim + [1.0]:
            raise ValueError("a transformation must be an affine map's square matrix, all of one size")
    x = [F.get("pos", F.lit(d)) for d in range(dim)]

    def moved(m) -> Column:
        return F.array(*[reduce(lambda a, b: a + b, [F.lit(float(row[d])) * x[d] for d in range(dim)]) + F.lit(float(row[dim])) for row in m[:-1]])

    places = F.array(F.transform("pos", lambda v: v.cast("double")), *[F.when(F.col("pos").isNotNull(), moved(m)) for m in transformations])
    return sites.select(*[c for c in sites.columns if c not in ("pos", "image")], F.posexplode(places).alias("image", "pos"))


def _image_ids(sites: DataFrame, transformations: list[list[list[float]]]) -> DataFrame:
    """Images as sites of their own, numbered by site, then image; ids too large for that raise an overflow."""
    n = len(transformations) + 1
    key = F.try_add(F.try_multiply(F.col("site_id").cast("long"), F.lit(n).cast("long")), F.col("image").cast("long"))
    rows = transform_sites(sites.select("batch_id", "site_id", "pos", "weight"), transformations)
    known = F.when(F.col("site_id").isNotNull() & key.isNull(), F.raise_error(F.lit("a site's id is too large for its images")).cast("long")).otherwise(key)
    return rows.select("batch_id", known.alias("site_id"), "pos", "weight")


def _image_columns(n: int) -> dict[str, Column]:
    image = F.pmod(F.col("site_id"), F.lit(n).cast("long"))
    return {"image": image.cast("int"), "site_id": F.call_function("div", F.col("site_id") - image, F.lit(n).cast("long"))}


def assign_images(points: DataFrame, sites: DataFrame, transformations: list[list[list[float]]]) -> DataFrame:
    """assign under a metric with transformations: a site is as near as the nearest of it and its images.

    Adds site_id, cost and image (0: the site itself); ties go to the smaller id, then
    image.  Null positions get a null site and image.  A column of points named image is replaced.
    """
    found = assign(points.drop("image"), _image_ids(sites, transformations))
    return found.withColumns(_image_columns(len(transformations) + 1))


def image_cell_integrals(sites: DataFrame, transformations: list[list[list[float]]], grid: DataFrame, knots: list[list[float]], order: int = 0) -> DataFrame:
    """Integrals over the cells of sites and of their images, which share the grid's box.

    Returns batch_id, site_id, image, mass, first and second: a site's mass is the sum over
    its images.  Cells without mass have no row.
    """
    lo, hi = [float(k[0]) for k in knots], [float(k[-1]) for k in knots]
    sums = cell_integrals(cells(_image_ids(sites, transformations), lo, hi), grid, knots, order)
    own = sums.where("neighbor is null and mass <> 0").withColumns(_image_columns(len(transformations) + 1))
    return own.select("batch_id", "site_id", "image", "mass", "first", "second")
