"""Symmetric positive (semi-)definite systems held as triplets, solved for all batches at once.

A batch of bounded size is solved by conjugate gradients within one task.  Larger ones run
the same iteration as Spark jobs: a product is a join of the triplets with the vector and a
grouped sum, dot products are grouped sums, and every iteration's vectors are written, so a
lost executor costs one of them.  Its preconditioner has two levels: the diagonal, and a
coarse system of the sums over groups of unknowns, which a task solves for each batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masswright.functions.jets import conjugate_gradient
from masswright.session import ship_package, stage_table

#: Unknowns and entries of a batch that is solved in one task.
TASK_UNKNOWNS = 50_000
TASK_ENTRIES = 2_000_000
#: Groups of a batch in the coarse system.
MAX_GROUPS = 512


def solve_spd(matrix: DataFrame, rhs: DataFrame, groups: DataFrame | None = None, tol: float = 1e-10, max_iterations: int = 2000) -> DataFrame:
    """Solutions (batch_id, row, val) of the systems ``matrix`` (batch_id, row, col, val) with ``rhs`` (batch_id, row, val).

    Repeated entries add up; rows of ``rhs`` are the unknowns, and entries outside them are
    left out.  A singular system whose null space holds constants is solved up to a
    constant if its right side sums to zero.  ``groups`` (batch_id, row, group), at most
    MAX_GROUPS a batch, names the unknowns that the coarse level adds up; without it the
    diagonal alone preconditions.  Residuals end below ``tol`` times the right side's norm,
    else RuntimeError is raised.  A zero right side gives zeros; empty tables give none.
    """
    ship_package(matrix.sparkSession)
    matrix = stage_table(matrix.join(rhs.select("batch_id", "row"), ["batch_id", "row"], "left_semi").join(rhs.select("batch_id", F.col("row").alias("col")), ["batch_id", "col"], "left_semi").groupBy("batch_id", "row", "col").agg(F.sum("val").alias("val")), "spd-matrix")
    rhs = stage_table(rhs.groupBy("batch_id", "row").agg(F.sum("val").alias("val")), "spd-rhs")
    sizes = rhs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).join(matrix.groupBy("batch_id").agg(F.count(F.lit(1)).alias("entries")), "batch_id", "left")
    large = (F.col("n") > TASK_UNKNOWNS) | (F.coalesce("entries", F.lit(0)) > TASK_ENTRIES)
    sizes = stage_table(sizes.select("batch_id", large.alias("large")), "spd-sizes")
    few, many = sizes.where("not large").select("batch_id"), sizes.where("large").select("batch_id")
    out = _solve_in_tasks(matrix.join(few, "batch_id"), rhs.join(few, "batch_id"), tol, max_iterations)
    if many.isEmpty():
        return out
    return out.unionByName(_solve_by_jobs(stage_table(matrix.join(many, "batch_id"), "spd-large"), rhs.join(many, "batch_id"), groups, tol, max_iterations))


def _solve_in_tasks(matrix: DataFrame, rhs: DataFrame, tol: float, max_iterations: int) -> DataFrame:
    def work(entries, right):
        import pyarrow as pa

        ids = right.column("row").to_numpy()
        order = np.argsort(ids)
        places = order[np.searchsorted(ids, np.stack([entries.column(c).to_numpy() for c in ("row", "col")]), sorter=order)] if entries.num_rows else np.zeros((2, 0), int)
        x = conjugate_gradient(places[0], places[1], entries.column("val").to_numpy(), right.column("val").to_numpy(), tol, max_iterations)
        return pa.table({"batch_id": right.column("batch_id"), "row": right.column("row"), "val": pa.array(x)})

    keyed = matrix.withColumnRenamed("batch_id", "of")
    return keyed.groupBy("of").cogroup(rhs.groupBy("batch_id")).applyInArrow(work, "batch_id long, row long, val double")


def _solve_by_jobs(matrix: DataFrame, rhs: DataFrame, groups: DataFrame | None, tol: float, max_iterations: int) -> DataFrame:
    key = ["batch_id", "row"]
    diagonal = matrix.where("row = col").select("batch_id", "row", F.col("val").alias("diag"))
    group = groups.select("batch_id", "row", F.col("group").cast("long").alias("group")) if groups is not None else rhs.select("batch_id", "row", F.lit(0).cast("long").alias("group"))
    zero = F.lit(0.0)
    base = rhs.join(diagonal, key, "left").join(group, key, "left")
    diag = F.when(F.col("diag") != 0, F.col("diag")).otherwise(1.0)
    base = stage_table(base.select(*key, zero.alias("x"), F.col("val").alias("r"), zero.alias("p"), zero.alias("q"), diag.alias("diag"), F.coalesce("group", F.lit(0)).alias("group")), "spd-vectors")
    coarse = None
    if groups is not None:
        known = base.select(*key, "group")
        rows = matrix.join(known, key).join(known.select("batch_id", F.col("row").alias("col"), F.col("group").alias("other")), ["batch_id", "col"])
        coarse = stage_table(rows.groupBy("batch_id", "group", "other").agg(F.sum("val").alias("val")), "spd-coarse")
    goal = stage_table(base.groupBy("batch_id").agg((F.sum(F.col("r") * F.col("r")) * tol * tol).alias("goal")), "spd-goal")

    def coarse_solve(entries, sums):
        import pyarrow as pa

        names = sums.column("group").to_numpy()
        order = np.argsort(names)
        m = np.zeros((len(names), len(names)))
        if entries.num_rows:
            i, j = (order[np.searchsorted(names, entries.column(c).to_numpy(), sorter=order)] for c in ("group", "other"))
            np.add.at(m, (i, j), entries.column("val").to_numpy())
        e = np.linalg.lstsq(m, sums.column("total").to_numpy(), rcond=1e-12)[0]
        return pa.table({"batch_id": sums.column("batch_id"), "group": sums.column("group"), "lift": pa.array(e)})

    def scalars(vectors: DataFrame) -> DataFrame:
        """Staged (batch_id, group, lift, rz, rr) of residuals r."""
        sums = stage_table(vectors.groupBy("batch_id", "group").agg(F.sum("r").alias("total"), F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("fine"), F.sum(F.col("r") * F.col("r")).alias("rr")), "spd-sums")
        lifts = coarse.withColumnRenamed("batch_id", "of").groupBy("of").cogroup(sums.groupBy("batch_id")).applyInArrow(coarse_solve, "batch_id long, group long, lift double") if coarse is not None else sums.select("batch_id", "group", zero.alias("lift"))
        rows = sums.join(lifts, ["batch_id", "group"])
        whole = rows.groupBy("batch_id").agg(F.sum(F.col("fine") + F.col("lift") * F.col("total")).alias("rz"), F.sum("rr").alias("rr"))
        return stage_table(rows.select("batch_id", "group", "lift").join(whole, "batch_id"), "spd-scalars")

    def turn(vectors: DataFrame, now: DataFrame, before: DataFrame | None) -> DataFrame:
        """New search directions z + beta * p."""
        rows = vectors.join(now, ["batch_id", "group"])
        beta = zero
        if before is not None:
            rows = rows.join(before.select("batch_id", F.col("rz").alias("rz_before")).distinct(), "batch_id")
            beta = F.when(F.col("rz_before") > 0, F.col("rz") / F.col("rz_before")).otherwise(0.0)
        return rows.select(*key, "x", "r", (F.col("r") / F.col("diag") + F.col("lift") + beta * F.col("p")).alias("p"), "diag", "group")

    now = scalars(base)
    vectors = turn(base, now, None)
    for _ in range(max_iterations):
        if now.select("batch_id", "rr").distinct().join(goal, "batch_id").where("rr > goal").isEmpty():
            return vectors.select(*key, F.col("x").alias("val"))
        vectors = stage_table(vectors, "spd-directions")
        product = matrix.join(vectors.select("batch_id", F.col("row").alias("col"), "p"), ["batch_id", "col"]).groupBy(*key).agg(F.sum(F.col("val") * F.col("p")).alias("q"))
        moved = stage_table(vectors.join(product, key, "left").withColumn("q", F.coalesce("q", zero)), "spd-products")
        steps = moved.groupBy("batch_id").agg(F.sum(F.col("p") * F.col("q")).alias("pq")).join(now.select("batch_id", "rz").distinct(), "batch_id")
        steps = steps.select("batch_id", F.when(F.col("pq") > 0, F.col("rz") / F.col("pq")).otherwise(0.0).alias("a"))
        moved = moved.join(steps, "batch_id").select(*key, (F.col("x") + F.col("a") * F.col("p")).alias("x"), (F.col("r") - F.col("a") * F.col("q")).alias("r"), "p", "diag", "group")
        before, now = now, scalars(moved)
        vectors = turn(moved, now, before)
    raise RuntimeError("the residual is above its goal after the last iteration")
