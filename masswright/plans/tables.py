"""The star-schema tables as measures: the fixed mapping that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_diracs(spark: SparkSession, sf_dir: str, mass: str = "1.0", batch: str = "l_suppkey") -> DataFrame:
    """One-dimensional points: a batch per supplier, x = quantity / 50."""
    order = f"row_number() over (partition by {batch} order by l_quantity, l_orderkey, l_linenumber, l_extendedprice, l_partkey)"
    return table(spark, sf_dir, "lineitem").selectExpr(f"cast({batch} as bigint) batch_id", f"cast({order} as bigint) dirac_id", "l_quantity / 50.0D x", f"cast({mass} as double) mass")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional points (quantity / 50, 10 * discount)."""
    return table(spark, sf_dir, "lineitem").selectExpr("0L batch_id", "cast(l_orderkey as bigint) * 10 + l_linenumber point_id", "array(l_quantity / 50.0D, l_discount * 10.0D) pos")


def part_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the whole part table, one per size: (size / 50, last three digits of the size's total price), weights 0, 0.01, 0.02."""
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.sum(F.round(F.col("p_retailprice") * 10).cast("long")).alias("total"))
    return rows.selectExpr("0L batch_id", "cast(p_size as bigint) site_id", "array(p_size / 50.0D, total % 1000 / 1000.0D) pos", "0.01D * (p_size % 3) weight")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site a part, spread evenly over the unit square by two irrational steps of the key; weights 0 to 6e-5 by size."""
    place = [f"pmod(p_partkey * {step}D, 1.0D)" for step in (0.7548776662466927, 0.5698402909980532)]
    return table(spark, sf_dir, "part").selectExpr("0L batch_id", "cast(p_partkey as bigint) site_id", f"array({', '.join(place)}) pos", "0.00001D * (p_size % 7) weight")


def part_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sites with squared radii of 0.25 to 0.55 of a site's share of the square as weights."""
    rows = part_points(spark, sf_dir)
    n = rows.count()
    return rows.withColumn("weight", F.col("weight") * F.lit(5000.0 / max(n, 1)) + F.lit(0.25 / max(n, 1)))


def event_values(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).selectExpr("0L batch_id", "cast(event_id as bigint) dirac_id", "value x", "1.0D mass")


def rounded(c, digits: int = 6):
    """Rounding with a shift that keeps exact decimal halves off the edge, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(3.3e-8), digits) + F.lit(0.0)
