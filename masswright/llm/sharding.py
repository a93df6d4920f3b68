"""Sharding by proportional stratified interleaving.

Every row gets a rank in a seeded shuffle of its own source; the fractional rank
(rank - 1/2) / rows of the source spreads each source evenly over (0, 1).  Sorting by the
fractional rank and cutting into equal runs gives shards that all match the mixture, with
row counts at most one apart.

Ranks are computed in two levels so that no source, however large, meets in one task: the
shuffle key is cut into ranges of a bounded number of rows, the ranges are counted, and a
row's rank is the rows in earlier ranges plus its place in its own.  The text itself is
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, shared_path, stage_table, text_or_empty

#: The shuffle key has this many bits (15 hex digits of an MD5).
KEY_BITS = 60


def _running_offsets(counts: DataFrame, over: list[str], order: str) -> DataFrame:
    before = Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def interleave_shards(
    docs: DataFrame,
    n_shards: int = 16,
    seed: str = "interleave-1",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """Assign every row of ``docs`` a shard and a gapless slot in it.

    Returns one row per input row: doc_id, source, size (UTF-8 bytes plus 1), text_crc32,
    frac (fractional rank), shard and slot.  Null texts have size 1 and the checksum of
    the empty string; null sources form a source of their own; rows with equal ids are
    ordered by checksum and size, and rows equal in all of these are interchangeable.
    An empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 15), 16, 10)
    base = stage_table(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            key.cast("long").alias("key"),
        ),
        "shard-rows",
    ).withColumn("stratum", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))))
    n = base.count()
    bits = bucket_bits(n, rows_per_bucket)

    base = base.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    counts = base.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    offsets = _running_offsets(counts, ["stratum"], "range").withColumn("n_source", F.sum("n").over(Window.partitionBy("stratum"))).drop("n")
    within = Window.partitionBy("stratum", "range").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = (
        base.join(offsets, ["stratum", "range"])
        .withColumn("rank", F.col("before") + F.row_number().over(within))
        .withColumn("frac", (F.col("rank") - F.lit(0.5)) / F.col("n_source"))
        .select("doc_id", "source", "stratum", "size", "text_crc32", "frac")
    )

    ranked = stage_table(ranked, "shard-ranks").withColumn("range", F.floor(F.col("frac") * F.lit(float(1 << bits))).cast("long"))
    counts = ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    offsets = _running_offsets(counts, [], "range").drop("n")
    within = Window.partitionBy("range").orderBy("frac", "stratum", "doc_id", "text_crc32", "size")
    placed = ranked.join(offsets, "range").withColumn("position", F.col("before") + F.row_number().over(within) - 1)
    return (
        placed.withColumn("shard", F.expr(f"cast((position * {n_shards}) div {max(n, 1)} as int)"))
        .withColumn("slot", F.expr(f"position - ((cast(shard as bigint) * {max(n, 1)} + {n_shards - 1}) div {n_shards})"))
        .select("doc_id", "source", "size", "text_crc32", "frac", "shard", "slot")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str | None = None) -> str:
    """Write ``docs`` partitioned by shard, each shard in slot order; returns the path.

    ``assigned`` comes from interleave_shards; ids must be unique in both.
    """
    path = path or shared_path(docs.sparkSession, "shards")
    rows = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
