"""Entry points for plans: one-dimensional ones between any two measures, and semi-discrete ones in more dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masswright.functions import arrays
from masswright.operators import measures, ot1d, power, solver


def is_discrete(measure: DataFrame) -> bool:
    return "dirac_id" in measure.columns


def _same_batches(f: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A measure with one batch is repeated for every batch of the other; else batches must agree."""
    a, b = f.select("batch_id").distinct(), g.select("batch_id").distinct()
    n, m = a.count(), b.count()
    if n == 1 and m > 1:
        return f.drop("batch_id").join(F.broadcast(b) if m < 10_000 else b).select(*f.columns), g
    if m == 1 and n > 1:
        return f, g.drop("batch_id").join(F.broadcast(a) if n < 10_000 else a).select(*g.columns)
    if n != m or a.join(b, "batch_id").count() != n:
        raise ValueError("the measures' batches differ")
    return f, g


def ot_plan(f: DataFrame, g: DataFrame) -> DataFrame:
    """Plan rows between points (batch_id, dirac_id, x, mass) and a density of affine pieces, in either order.

    Two point measures give their coupling; two densities are not supported.
    """
    f, g = _same_batches(f, g)
    if is_discrete(f) and is_discrete(g):
        return ot1d.discrete_coupling(f, g)
    if not is_discrete(f) and not is_discrete(g):
        raise ValueError("one of the measures must be discrete")
    return ot1d.plan_1d(f, g) if is_discrete(f) else ot1d.plan_1d(g, f)


def distances(f: DataFrame, g: DataFrame) -> DataFrame:
    return ot1d.distances(ot_plan(f, g))


def distance(f: DataFrame, g: DataFrame) -> float:
    """The squared distance of a single batch."""
    rows = distances(f, g).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one batch is expected, not {len(rows)} or more")
    return rows[0]["distance"]


def barycenters(f: DataFrame, g: DataFrame) -> DataFrame:
    return ot_plan(f, g).select("batch_id", "dirac_id", "barycenter")


@dataclass(frozen=True)
class Norm2:
    """The squared Euclidean distance to a site, or to the nearest of it and its images under affine maps (see power.transform_sites)."""

    transformations: tuple = ()


@dataclass(frozen=True)
class PeriodicMetric:
    """The squared Euclidean distance to the nearest image; an axis without a period is not periodic."""

    period: tuple[float | None, ...]

    def axes(self, knots: list[list[float]]) -> list[bool]:
        """Which axes are periodic; their period must be the length of the density's box."""
        for p, k in zip(self.period, knots, strict=True):
            if p is not None and abs(k[-1] - k[0] - p) > 1e-12 * abs(p):
                raise ValueError(f"the period {p} is not the density's length {k[-1] - k[0]}")
        return [p is not None for p in self.period]


def nearest_sites(points: DataFrame, sites: DataFrame, metric: Norm2 = Norm2()) -> DataFrame:  # noqa: B008
    """Points (batch_id, pos, any others) with the site_id, cost and image that are best under the metric."""
    return power.assign_images(points, sites, list(metric.transformations))


def semi_discrete_plan(
    sites: DataFrame,
    grid: DataFrame,
    knots: list[list[float]],
    order: int = 0,
    tol: float = 1e-6,
    metric: Norm2 | PeriodicMetric = Norm2(),  # noqa: B008
    site_mass: float | None = 1.0,
    density_mass: float | None = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Plans between batches of sites (batch_id, site_id, pos, mass) and grid densities of any dimension.

    Sites without batch_id are batch 0; one batch of sites or of densities is repeated for
    all of the other's.  Masses are normalised to ``site_mass`` and ``density_mass`` a
    batch, or kept as they are with None.  Where the sites have less, the plan is partial:
    only their mass is transported, from where it costs least (two dimensions only); more
    mass than the density's raises ValueError, as do masses that are not positive.

    Returns one row per site (batch_id, site_id, pos, weight, mass, barycenter,
    second_moment of its cell about the site, offset) and the squared distances (batch_id,
    distance, error).  The Brenier potential at x is the largest x . pos - offset, and its
    gradient there is that site's pos.  Site ids must be unique in a batch.  Weights are
    not solved for under transformations, which raise ValueError.
    """
    if isinstance(metric, Norm2) and metric.transformations:
        raise ValueError("plans of a metric with transformations are not supported")
    if "batch_id" not in sites.columns:
        sites = sites.withColumn("batch_id", F.lit(0).cast("long"))
    dim, key = len(knots), ["batch_id", "site_id"]
    sites, grid = _same_batches(sites.select("batch_id", "site_id", "pos", "mass"), grid)
    if site_mass is not None:
        whole = sites.groupBy("batch_id").agg(F.sum("mass").alias("whole"))
        sites = sites.join(whole, "batch_id").select(*key, "pos", F.when(F.col("whole") > 0, F.col("mass") / F.col("whole") * float(site_mass)).alias("mass"))
    if density_mass is not None:
        grid = measures.normalize_grid(grid, order, dim)
        grid = grid.withColumn("coeffs", arrays.scale(F.col("coeffs"), float(density_mass)))
    periodic = metric.axes(knots) if isinstance(metric, PeriodicMetric) else None
    plans = solver.solve_plans(sites, grid, knots, order, tol, periodic=periodic, normalize=False)
    pos, b = F.col("pos"), F.col("barycenter")
    square = arrays.norm2(pos)
    moment = F.col("second") + F.col("mass") * (square - 2 * arrays.dot(pos, b))
    rows = plans.rows.select(*key, "pos", "weight", "mass", "barycenter", moment.alias("second_moment"), ((square - F.col("weight")) / 2).alias("offset"))
    return rows, plans.distances
