"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masswright.session import shared_path, stage_table

__all__ = ["bucket_bits", "read_table", "shared_path", "stage_table", "text_or_empty"]

def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_bits(rows: int, rows_per_bucket: int) -> int:
    """The least k with rows <= 2**k * rows_per_bucket."""
    k = 0
    while rows > rows_per_bucket << k:
        k += 1
    return k
