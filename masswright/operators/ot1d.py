"""One-dimensional optimal transport as windows and grouped sums.

Cumulative masses of the points and of the density's pieces are merged on one axis; every
gap between neighbouring marks belongs to one point and one piece, found by carrying the
marks backwards.  That replaces the range join of mass intervals, and costs one shuffle by
batch.  On each gap, moments are closed forms of an affine density.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import cdf, inverse_cdf
from .running import ordered, ranges_of


def order_diracs(diracs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Points (batch_id, dirac_id, x, mass) with normalised mass m and cumulative mass q0 to q1.

    Ties in x are broken by dirac_id.  A mass that is not positive raises.
    """
    mass = F.col("mass").cast("double")
    mass = F.when(mass > 0, mass).otherwise(F.raise_error(F.lit("a point's mass is not positive")).cast("double"))
    rows = ordered(diracs.withColumn("mass", mass), ["x", "dirac_id"], ranges).with_columns(totals={"w": F.col("mass")}, upto={"q1": F.col("mass")}, under={"q0": F.col("mass")}, last="is_end").result()
    q1 = F.when(F.col("is_end"), 1.0).otherwise(F.col("q1") / F.col("w"))
    return rows.withColumns({"m": F.col("mass") / F.col("w"), "q0": F.col("q0") / F.col("w"), "q1": q1}).drop("is_end")


def couple(diracs: DataFrame, pieces: DataFrame, ranges: int | None = None) -> DataFrame:
    """Gaps of the merged cumulative masses: each has its point (d), its piece (p) and bounds l to r."""
    ranges = ranges_of(diracs, pieces) if ranges is None else ranges
    points = order_diracs(diracs, ranges)
    parts = cdf(pieces, ranges)
    d = F.struct("dirac_id", "x", "m", "mass", "w")
    p = F.struct("piece", "x0", "x1", "y0", "y1", "c0", "z")
    left = points.select("batch_id", F.col("q1").alias("q"), d.alias("d"))
    right = parts.select("batch_id", F.col("c1").alias("q"), p.alias("p"))
    marks = left.unionByName(right, allowMissingColumns=True)
    rows = ordered(marks.withColumns({"down": -F.col("q"), "late": F.col("d").isNull()}), ["down", "late"], ranges)
    rows = rows.with_columns(after={"from": F.col("q")}, filled={"d": F.col("d"), "p": F.col("p")}).result().drop("down", "late")
    gaps = rows.withColumn("from", F.coalesce("from", F.lit(0.0))).where("q > `from`")

    def at(q: Column) -> Column:
        return inverse_cdf(q - F.col("p.c0"), F.col("p.x0"), F.col("p.x1"), F.col("p.y0"), F.col("p.y1"))

    return gaps.withColumn("l", at(F.col("from"))).withColumn("r", at(F.col("q")))


def _moments() -> dict[str, Column]:
    """Mass, first moment and second moment about the point of a gap's density."""
    x0, y0, p, left, right = F.col("p.x0"), F.col("p.y0"), F.col("d.x"), F.col("l"), F.col("r")
    s = (F.col("p.y1") - y0) / (F.col("p.x1") - x0)
    u, v = left - x0, right - x0
    a, b = left - p, right - p
    return {
        "mass": F.col("q") - F.col("from"),
        "first": (F.col("q") - F.col("from")) * x0 + y0 * (v * v - u * u) / 2 + s * (v**3 - u**3) / 3,
        "second": (y0 + s * (p - x0)) * (b**3 - a**3) / 3 + s * (b**4 - a**4) / 4,
    }


def plan_1d(diracs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The plan's rows: batch_id, dirac_id, x, mass, m, barycenter, potential, cut_lo, cut_hi, cost.

    ``mass`` is as given, ``m`` normalised; the first potential of a batch is 0.
    """
    k = _moments()
    ranges = ranges_of(diracs, pieces)
    grouped = (
        couple(diracs, pieces, ranges)
        .groupBy("batch_id", F.col("d.dirac_id").alias("dirac_id"))
        .agg(
            F.first("d").alias("d"),
            F.min("l").alias("cut_lo"),
            F.max("r").alias("cut_hi"),
            F.sum(k["first"]).alias("first"),
            F.sum(k["second"]).alias("cost"),
        )
    )
    rows = grouped.select("batch_id", "dirac_id", F.col("d.x").alias("x"), F.col("d.mass").alias("mass"), F.col("d.m").alias("m"), F.col("d.w").alias("w"), (F.col("first") / F.col("d.m")).alias("barycenter"), "cut_lo", "cut_hi", "cost")
    rows = ordered(rows, ["x", "dirac_id"], ranges).with_columns(before={"x_before": F.col("x")})
    jump = F.coalesce((F.col("x") - F.col("cut_lo")) ** 2 - (F.col("x_before") - F.col("cut_lo")) ** 2, F.lit(0.0))
    return rows.with_columns(upto={"potential": jump}).result().drop("x_before")


def distances(plan: DataFrame) -> DataFrame:
    """Squared 2-Wasserstein distance of every batch."""
    return plan.groupBy("batch_id").agg(F.sum("cost").alias("distance"))


def with_upstream(plan: DataFrame, distance_gradient: float = 1.0, barycenter_gradient: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds beta (upstream gradient of the barycenter over m) and phi, its potential."""
    beta = F.col(barycenter_gradient) / F.col("m") if barycenter_gradient else F.lit(0.0)
    rows = plan.withColumn("g", F.lit(float(distance_gradient))).withColumn("beta", beta)
    rows = ordered(rows, ["x", "dirac_id"], ranges).with_columns(before={"beta_before": F.col("beta")})
    jump = F.coalesce(F.col("cut_lo") * (F.col("beta") - F.col("beta_before")), F.lit(0.0))
    return rows.with_columns(upto={"phi": jump}).result().drop("beta_before")


def dirac_gradients(plan: DataFrame, distance_gradient: float = 1.0, barycenter_gradient: str | None = None) -> DataFrame:
    """Adds d_position and d_mass: gradients of the loss with respect to x and the unnormalised mass."""
    ranges = ranges_of(plan)
    rows = with_upstream(plan, distance_gradient, barycenter_gradient, ranges)
    level = F.col("g") * F.col("potential") + F.col("phi")
    pulled = F.col("beta") * F.col("m") * F.col("barycenter")
    rows = ordered(rows, ["x", "dirac_id"], ranges).with_columns(totals={"mean_level": F.col("m") * level, "pull": pulled}).result()
    d_mass = (level - F.col("mean_level") + F.col("pull")) / F.col("w") - pulled / F.col("mass")
    return rows.withColumns({"d_position": 2 * F.col("g") * F.col("m") * (F.col("x") - F.col("barycenter")), "d_mass": d_mass}).drop("mean_level", "pull")


def knot_gradients(diracs: DataFrame, knots: DataFrame, distance_gradient: float = 1.0) -> DataFrame:
    """Gradients of the distance with respect to the knots (batch_id, i, x, y) of an affine density.

    At fixed masses the distance changes by the integral of the dual potential
    (x - p)**2 - psi against the change of the normalised density; a moving end knot adds
    the value at the end.  Returns batch_id, i, d_y, d_x.
    """
    from .measures import affine_pieces

    pieces = affine_pieces(knots)
    psi = plan_1d(diracs, pieces).select("batch_id", "dirac_id", "potential")
    gaps = couple(diracs, pieces).withColumn("dirac_id", F.col("d.dirac_id")).join(psi, ["batch_id", "dirac_id"])
    x0, h, p, left, right = F.col("p.x0"), F.col("p.x1") - F.col("p.x0"), F.col("d.x"), F.col("l"), F.col("r")
    a, b = left - p, right - p
    # Integrals over the gap of f and f * (x - x0) / h for f = (x - p)**2 - psi, and of 1 and (x - x0) / h.
    f0 = (b**3 - a**3) / 3 - F.col("potential") * (right - left)
    f1 = ((b**4 - a**4) / 4 + (p - x0) * (b**3 - a**3) / 3 - F.col("potential") * ((right - x0) ** 2 - (left - x0) ** 2) / 2) / h
    y0, y1 = F.col("p.y0"), F.col("p.y1")
    sums = gaps.groupBy("batch_id", F.col("p.piece").alias("piece")).agg(
        F.first("p.z").alias("z"),
        F.sum(f0 - f1).alias("low"),
        F.sum(f1).alias("high"),
        F.sum(y0 * (f0 - f1) + y1 * f1).alias("mean_part"),
        F.max_by((right - p) ** 2 - F.col("potential"), right).alias("f_right"),
        F.min_by((left - p) ** 2 - F.col("potential"), left).alias("f_left"),
    )
    rows = pieces.join(sums, ["batch_id", "piece"], "left")
    whole = Window.partitionBy("batch_id")
    rows = rows.withColumn("z", F.max("z").over(whole)).withColumn("mean", F.sum("mean_part").over(whole))
    width, slope = F.col("x1") - F.col("x0"), (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0))
    order = whole.orderBy("piece")
    rows = rows.withColumn("is_first", F.lag("piece").over(order).isNull()).withColumn("is_last", F.lead("piece").over(order).isNull())
    first, last = F.col("is_first"), F.col("is_last")
    g = F.lit(float(distance_gradient))
    at_low = F.struct(
        F.col("piece").alias("i"),
        (g * (low - F.col("mean") * width / 2) / F.col("z")).alias("d_y"),
        (g * (-slope * (low - F.col("mean") * width / 2) - F.when(first, F.col("y0") * (F.coalesce("f_left", F.lit(0.0)) - F.col("mean"))).otherwise(0.0)) / F.col("z")).alias("d_x"),
    )
    at_high = F.struct(
        (F.col("piece") + 1).alias("i"),
        (g * (high - F.col("mean") * width / 2) / F.col("z")).alias("d_y"),
        (g * (-slope * (high - F.col("mean") * width / 2) + F.when(last, F.col("y1") * (F.coalesce("f_right", F.lit(0.0)) - F.col("mean"))).otherwise(0.0)) / F.col("z")).alias("d_x"),
    )
    ends = rows.select("batch_id", F.explode(F.array(at_low, at_high)).alias("e"))
    return ends.groupBy("batch_id", F.col("e.i").alias("i")).agg(F.sum("e.d_y").alias("d_y"), F.sum("e.d_x").alias("d_x"))


def discrete_coupling(left: DataFrame, right: DataFrame) -> DataFrame:
    """Monotone coupling of two point measures: batch_id, a (left point), b (right point), flow, cost."""
    d = F.struct("dirac_id", "x")
    ranges = ranges_of(left, right)
    marks = (
        order_diracs(left, ranges).select("batch_id", F.col("q1").alias("q"), d.alias("a"))
        .unionByName(order_diracs(right, ranges).select("batch_id", F.col("q1").alias("q"), d.alias("b")), allowMissingColumns=True)
    )
    rows = ordered(marks.withColumns({"down": -F.col("q"), "late": F.col("a").isNull()}), ["down", "late"], ranges)
    rows = rows.with_columns(after={"from": F.col("q")}, filled={"a": F.col("a"), "b": F.col("b")}).result()
    gaps = rows.select("batch_id", (F.col("q") - F.coalesce("from", F.lit(0.0))).alias("flow"), "a", "b")
    return gaps.where("flow > 0").withColumn("cost", F.col("flow") * (F.col("a.x") - F.col("b.x")) ** 2)


def project(points: DataFrame, angles: DataFrame) -> DataFrame:
    """One-dimensional measures of points (point_id, px, py) along every angle (batch_id, theta).

    Angles are a bounded set chosen by the caller and are broadcast.
    """
    x = F.col("px") * F.cos("theta") + F.col("py") * F.sin("theta")
    return points.join(F.broadcast(angles)).select("batch_id", F.col("point_id").alias("dirac_id"), x.alias("x"), F.lit(1.0).alias("mass"))


def disk_sinogram(samples: DataFrame, center: tuple[float, float], radius: float, density: float) -> DataFrame:
    """Adds to y of samples (batch_id, theta, i, x, y) the chord length of a disk seen along theta, times its density."""
    off = F.col("x") - (F.lit(center[0]) * F.cos("theta") + F.lit(center[1]) * F.sin("theta"))
    return samples.withColumn("y", F.col("y") + 2 * density * F.sqrt(F.greatest(F.lit(0.0), F.lit(radius) ** 2 - off**2)))


def l2_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of squared differences of (batch_id, i, value) on common indices, and the gradient's scale 2 / n."""
    both = left.join(right.withColumnRenamed("value", "other"), ["batch_id", "i"])
    return both.groupBy("batch_id").agg(F.sum((F.col("value") - F.col("other")) ** 2).alias("l2"), F.count(F.lit(1)).alias("n"))
