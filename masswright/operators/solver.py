"""Weights of plans, for all batches at once: Newton steps, centring, Lloyd steps.

Weights, masses and facets are tables; a step solves the batches' linear systems as Spark
jobs (linear.solve_spd), and every batch has a step length of its own.  Only whether any
batch is left comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masswright.functions import arrays
from masswright.session import stage_table

from . import linear, power, regions

#: Groups of sites in the coarse level of a step's system.
COARSE_SITES = 256
#: The least step that is tried.
LEAST_STEP = 1e-6


@dataclass
class Plans:
    """Rows (batch_id, site_id, pos, weight, mass, barycenter, second, error), distances (batch_id, distance, error), and the steps taken."""

    rows: DataFrame
    distances: DataFrame
    iterations: int


@dataclass
class PlanResult:
    """Rows of one batch, and its squared distance."""

    rows: DataFrame
    distance: float
    iterations: int
    error: float


def centered_weights(sites: DataFrame, lo: list[float], hi: list[float], shrink: float = 0.9) -> DataFrame:
    """Weights whose cells are the Voronoi cells of the sites (batch_id, site_id, pos) moved into a cube inside the domain.

    With q = a p + b, cells of q under no weights are cells of p under |p|**2 - |q|**2 / a.
    """
    dim, axes = len(lo), [F.get("pos", F.lit(d)) for d in range(len(lo))]
    ends = sites.groupBy("batch_id").agg(*[f(x).alias(f"{n}{d}") for d, x in enumerate(axes) for f, n in ((F.min, "a"), (F.max, "b"))])
    extent = F.greatest(*[F.col(f"b{d}") - F.col(f"a{d}") for d in range(dim)], F.lit(0.0))
    room = shrink * min(b - a for a, b in zip(lo, hi, strict=True))
    ends = ends.withColumn("scale", F.when(extent > 0, F.lit(room) / extent).otherwise(1.0))
    q = F.array(*[F.lit((lo[d] + hi[d]) / 2) + F.col("scale") * (axes[d] - (F.col(f"a{d}") + F.col(f"b{d}")) / 2) for d in range(dim)])
    rows = sites.join(ends, "batch_id").select("batch_id", "site_id", (arrays.norm2(F.col("pos")) - arrays.norm2(q) / F.col("scale")).alias("weight"))
    return rows.join(rows.groupBy("batch_id").agg(F.avg("weight").alias("mean")), "batch_id").select("batch_id", "site_id", (F.col("weight") - F.col("mean")).alias("weight"))


def ball_weights(sites: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """Equal weights, a batch, whose balls have the wanted mass on average and all reach the domain; sites have want and total."""
    outside = [F.greatest(F.lit(0.0), F.lit(lo[d]) - F.get("pos", F.lit(d)), F.get("pos", F.lit(d)) - F.lit(hi[d])) for d in range(len(lo))]
    volume = 1.0
    for a, b in zip(lo, hi, strict=True):
        volume *= b - a
    away = F.max(sum((x * x for x in outside[1:]), outside[0] * outside[0]))
    rows = sites.groupBy("batch_id").agg((F.avg("want") / F.max("total") * F.lit(volume)).alias("area"), away.alias("away"))
    return rows.select("batch_id", F.greatest(F.col("area") / F.pi(), 1.1 * F.col("away") + 1e-3 * F.col("area")).alias("weight"))


def _stats(state: DataFrame) -> DataFrame:
    return state.groupBy("batch_id").agg(F.max(F.abs(F.col("mass") / F.col("want") - 1)).alias("error"), F.min("mass").alias("least"))


def solve_plans(
    sites: DataFrame,
    grid: DataFrame,
    knots: list[list[float]],
    order: int = 0,
    tol: float = 1e-6,
    max_iterations: int = 100,
    periodic: list[bool] | None = None,
    normalize: bool = True,
    start: DataFrame | None = None,
) -> Plans:
    """Weights that give every site (batch_id, site_id, pos, mass) its mass of its batch's density.

    Masses are normalised to the grid's, unless ``normalize`` is off.  Batches whose masses
    then add up to less are transported partially: cells are cut by balls whose squared
    radius is the weight, so that the nearest part of the density is taken and the rest
    stays; weights have no free constant then, and are centred otherwise.  Axes may be
    ``periodic``; positions are moved into the box.

    Starts from zero weights or ``start`` (batch_id, site_id, weight), from centred ones in
    batches with empty cells, and from equal balls for partial plans; a step that empties a
    cell or does not lower a batch's error is halved.  A mass that is null or not positive,
    and masses of more than the grid's, raise ValueError, cells that are empty from the
    start RuntimeError.  Batches without a grid are left out; no sites give no rows.  Ids
    must be unique in their batch.
    """
    lo, hi = [float(k[0]) for k in knots], [float(k[-1]) for k in knots]
    total = grid.groupBy("batch_id").agg(F.sum(arrays.piece_integral(F.col("coeffs"), F.col("lo"), F.col("hi"), order, len(knots))).alias("total"))
    moved = [F.lit(a) + F.pmod(F.get("pos", F.lit(d)).cast("double") - F.lit(a), F.lit(b - a)) if periodic and periodic[d] else F.get("pos", F.lit(d)).cast("double") for d, (a, b) in enumerate(zip(lo, hi, strict=True))]
    rows = sites.select(F.col("batch_id").cast("long"), F.col("site_id").cast("long"), F.array(*moved).alias("pos"), F.col("mass").cast("double").alias("want"))
    sums = rows.groupBy("batch_id").agg(F.sum("want").alias("wanted"), F.max(F.coalesce(F.col("want") <= 0, F.lit(True))).alias("bad"))
    sums = stage_table(sums.join(total, "batch_id"), "plan-masses")
    if not sums.where("bad").isEmpty():
        raise ValueError("a site's mass is not positive")
    wanted = F.col("total") if normalize else F.col("wanted")
    if not sums.where(wanted > F.col("total") * (1 + 1e-9)).isEmpty():
        raise ValueError("the sites' masses are more than the density's")
    scale = F.col("total") / F.col("wanted") if normalize else F.lit(1.0)
    short = F.lit(False) if normalize else F.col("wanted") < F.col("total") * (1 - 1e-9)
    rows = stage_table(rows.join(sums.drop("bad"), "batch_id").select("batch_id", "site_id", "pos", (F.col("want") * scale).alias("want"), "total", short.alias("short")), "plan-sites")
    parts = [(part.drop("short"), partial) for part, partial in ((rows.where("not short"), False), (rows.where("short"), True)) if not part.isEmpty()]
    found = [_solve(part, grid, knots, order, tol, max_iterations, periodic, partial, start) for part, partial in parts or [(rows.drop("short"), False)]]
    out = found[0]
    for more in found[1:]:
        out = Plans(out.rows.unionByName(more.rows), out.distances.unionByName(more.distances), max(out.iterations, more.iterations))
    return out


def _solve(rows: DataFrame, grid: DataFrame, knots, order: int, tol: float, max_iterations: int, periodic, partial: bool, start: DataFrame | None) -> Plans:
    lo, hi = [float(k[0]) for k in knots], [float(k[-1]) for k in knots]
    key, dim = ["batch_id", "site_id"], len(knots)
    zero = F.array(*[F.lit(0.0)] * dim)

    def evaluate(weighted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Staged rows with mass, first and second, and the facets' sums."""
        weighted = stage_table(weighted.select(*key, "pos", "want", "weight"), "plan-weights")
        sums = stage_table(power.cell_integrals(power.cells(weighted, lo, hi, periodic), grid, knots, order, periodic, balls=partial), "plan-sums")
        own = sums.where("neighbor is null").select(*key, "mass", "first", "second")
        state = weighted.join(own, key, "left").withColumns({"mass": F.coalesce("mass", F.lit(0.0)), "first": F.coalesce("first", zero), "second": F.coalesce("second", F.lit(0.0))})
        return stage_table(state, "plan-state"), sums

    if start is not None:
        weighted = rows.join(start.select(*key, "weight"), key, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    elif partial:
        weighted = rows.join(ball_weights(rows, lo, hi), "batch_id")
    else:
        weighted = rows.withColumn("weight", F.lit(0.0))
    state, sums = evaluate(weighted)
    empty = stage_table(_stats(state).where("least <= 0").select("batch_id"), "plan-empty")
    if not partial and not empty.isEmpty():
        again = rows.join(empty, "batch_id", "left_semi")
        late, late_sums = evaluate(again.join(centered_weights(again, lo, hi), key))
        state, sums = (x.join(empty, "batch_id", "left_anti").unionByName(y) for x, y in ((state, late), (sums, late_sums)))
        empty = _stats(late).where("least <= 0").select("batch_id")
    if not empty.isEmpty():
        raise RuntimeError("cells are empty from the start")

    finished, done = [], 0
    while True:
        stats = stage_table(_stats(state), "plan-errors")
        over = stats.where(F.col("error") > tol).select("batch_id", F.col("error").alias("old"), F.lit(1.0).alias("t"))
        finished.append(state.join(over.select("batch_id"), "batch_id", "left_anti"))
        if done == max_iterations or over.isEmpty():
            finished.append(state.join(over.select("batch_id"), "batch_id", "left_semi"))
            break
        done += 1
        state, sums = state.join(over.select("batch_id"), "batch_id", "left_semi"), sums.join(over.select("batch_id"), "batch_id", "left_semi")
        matrix = power.matrix_terms(sums, state)
        rhs = state.select("batch_id", F.col("site_id").alias("row"), (F.col("want") - F.col("mass")).alias("val"))
        step = stage_table(linear.solve_spd(matrix, rhs, _coarse_groups(state)).select("batch_id", F.col("row").alias("site_id"), F.col("val").alias("step")), "plan-step")
        pending, taken = over, []
        while True:
            trial = state.select(*key, "pos", "want", "weight").join(step, key).join(pending, "batch_id")
            found, found_sums = evaluate(trial.withColumn("weight", F.col("weight") + F.col("t") * F.col("step")))
            judged = _stats(found).join(pending, "batch_id").withColumn("good", (F.col("least") > 0) & (F.col("error") < F.col("old")) | (F.col("t") < LEAST_STEP))
            judged = stage_table(judged.select("batch_id", "old", "t", "good"), "plan-judged")
            pending = judged.where("not good").select("batch_id", "old", (F.col("t") / 2).alias("t"))
            if pending.isEmpty():
                taken.append((found, found_sums))
                break
            good = judged.where("good").select("batch_id")
            taken.append(tuple(x.join(good, "batch_id", "left_semi") for x in (found, found_sums)))
        state, sums = taken[0]
        for more, more_sums in taken[1:]:
            state, sums = state.unionByName(more), sums.unionByName(more_sums)
        if len(taken) > 1:
            state, sums = stage_table(state, "plan-state"), stage_table(sums, "plan-sums")

    state = finished[0]
    for more in finished[1:]:
        state = state.unionByName(more)
    cost = F.col("second") - 2 * arrays.dot(F.col("pos"), F.col("first")) + arrays.norm2(F.col("pos")) * F.col("mass")
    wrong = F.abs(F.col("mass") / F.col("want") - 1)
    whole = state.groupBy("batch_id").agg(F.sum(cost).alias("distance"), F.max(wrong).alias("error"), F.avg("weight").alias("mean"))
    weight: Column = F.col("weight") if partial else F.col("weight") - F.col("mean")
    barycenter = F.when(F.col("mass") > 0, F.transform("first", lambda x: x / F.col("mass")))
    rows = state.join(whole.select("batch_id", "mean"), "batch_id").select(*key, "pos", weight.alias("weight"), "mass", barycenter.alias("barycenter"), "second", wrong.alias("error"))
    return Plans(stage_table(rows, "plan-rows"), stage_table(whole.select("batch_id", "distance", "error"), "plan-distances"), done)


def _coarse_groups(state: DataFrame) -> DataFrame | None:
    """Sites (batch_id, row) grouped by the leaves of a tree of about COARSE_SITES leaves a batch; none with many batches."""
    sizes = state.groupBy("batch_id").count().agg(F.max("count"), F.count(F.lit(1))).first()
    if sizes[0] is None or sizes[0] <= linear.TASK_UNKNOWNS or sizes[1] * COARSE_SITES > regions.MAX_LEAVES:
        return None  # every batch is solved in a task, or too many for one tree
    tree = regions.build_tree(state.select("batch_id", "site_id", "pos", "weight"), max(1, sizes[0] // COARSE_SITES))
    rows = regions.add_leaf(state.select("batch_id", "site_id", "pos"), tree)
    return rows.select("batch_id", F.col("site_id").alias("row"), F.col("_leaf").alias("group"))


def newton(sites: DataFrame, masses: dict[int, float], grid: DataFrame, knots: list[list[float]], order: int = 0, tol: float = 1e-6, max_iterations: int = 100, start: dict[int, float] | None = None, periodic: list[bool] | None = None, normalize: bool = True) -> PlanResult:
    """solve_plans for one batch of sites (site_id, pos) with their masses at hand."""
    spark = sites.sparkSession
    wanted = spark.createDataFrame([(i, float(m)) for i, m in masses.items()], "site_id long, mass double")
    batch = F.lit(0).cast("long").alias("batch_id")
    rows = sites.select("site_id", "pos").join(wanted, "site_id", "left").select(batch, "site_id", "pos", "mass")
    first = spark.createDataFrame([(0, i, float(w)) for i, w in start.items()], "batch_id long, site_id long, weight double") if start else None
    plans = solve_plans(rows, grid, knots, order, tol, max_iterations, periodic, normalize, first)
    whole = plans.distances.first()
    return PlanResult(plans.rows, whole["distance"], plans.iterations, whole["error"])


def plan_gradients(sites: DataFrame, result: PlanResult) -> DataFrame:
    """Gradients of the distance at the optimum: 2 m (y - b) for positions, the weight for masses."""
    rows = result.rows.join(sites.select("site_id").distinct(), "site_id", "left_semi")
    pull = arrays.scale(arrays.subtract(F.col("pos"), F.col("barycenter")), 2 * F.col("mass"))
    return rows.select("site_id", pull.alias("d_position"), F.col("weight").alias("d_mass"))


def lloyd(sites: DataFrame, grid: DataFrame, knots: list[list[float]], steps: int, tau: float = 1.0, order: int = 0, tol: float = 1e-3, periodic: list[bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Optimal quantisation: move every site (batch_id, site_id, pos, mass) towards its barycenter.

    Returns the moved sites and the distances on the way (step, batch_id, distance).  A
    step starts from the weights of the one before it.
    """
    seen, start = [], None
    for k in range(steps):
        plan = solve_plans(sites, grid, knots, order, tol, periodic=periodic, start=start)
        seen.append(plan.distances.select(F.lit(k).alias("step"), "batch_id", "distance"))
        pos = arrays.add(arrays.scale(F.col("pos"), 1 - tau), arrays.scale(F.col("barycenter"), tau))
        moved = plan.rows.select("batch_id", "site_id", pos.alias("pos"))
        sites = stage_table(moved.join(sites.select("batch_id", "site_id", "mass"), ["batch_id", "site_id"]), "lloyd-sites")
    way = seen[0]
    for more in seen[1:]:
        way = way.unionByName(more)
    return sites, way


def lloyd_discrete(points: DataFrame, sites: DataFrame, dim: int, steps: int) -> DataFrame:
    """Lloyd steps on a point cloud: sites move to the barycenters of their points; sites without points stay."""
    for _ in range(steps):
        sums = power.assigned_sums(power.assign(points, sites, ["point_id"]), sites, dim)
        moved = sites.join(sums, ["batch_id", "site_id"])
        pos = F.array(*[F.coalesce(f"barycenter_{d}", F.get("pos", F.lit(d))) for d in range(dim)])
        sites = stage_table(moved.select("batch_id", "site_id", pos.alias("pos"), "weight"), "lloyd-sites")
    return sites
