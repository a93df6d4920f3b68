"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source queues its documents in a seeded shuffle, up to ``max_repeats`` times over.  A
queued copy's virtual finish time is the source's words up to its end, divided by the
source's target.  Copies are served in the order of their finish times, all sources
together, until the budget is spent.

Positions in the queues come from ranges of the shuffle key: ranges are summed, and a row's
place is what earlier ranges hold plus its place in its own.  The global order is cut the
same way: finish times are summed by range, the range in which the budget ends is summed
again in finer ranges, and only the last, of a bounded number of copies, is sorted.  Texts
are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, stage_table, text_or_empty

#: The shuffle key has this many bits (15 hex digits of an MD5).
KEY_BITS = 60
#: Finish times are summed in so many ranges at a time.
RANGES = 4096
#: Equal rows are told apart in runs of this length.
RUN = 10_000


def source_targets(totals: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Adds rank, weight and target to ``totals`` (source, source_size), one row a source.

    Weights are 1, 2, 3, repeating, over sources by code point, null last.  Targets share
    the sum of all sizes by weight and stop at ``max_repeats`` times their source's size,
    the rest sharing what is over.  With sources by cap per weight, the capped ones come
    first, and one is capped if its cap is no more than its share of what those before it
    leave; so two running sums replace the rounds of sharing.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    rows = totals.withColumn("rank", rank.cast("long")).withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    rows = (
        rows.withColumn("budget", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("weights"))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    )
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())["level"]
    rows = rows.withColumn("level", level)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", "rank", target.alias("target"))


def queue_documents(docs: DataFrame, seed: str = "mixture-1", max_repeats: int = 3, rows_per_bucket: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, rank of the source, and its queue's words before it (start)."""
    text = text_or_empty()
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.cast("long").alias("size"), F.md5(text.cast("binary")).alias("digest"))
    # Equal rows stand together in the queue, as one unit of n rows.
    units = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest"))
    units = stage_table(units.withColumn("key", F.conv(F.substring(key, 1, 15), 16, 10).cast("long")), "mix-units")
    targets = source_targets(units.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), max_repeats)

    bits = bucket_bits(units.count(), rows_per_bucket)
    units = units.withColumn("range", F.shiftright("key", KEY_BITS - bits)).withColumn("no_source", F.col("source").isNull()).withColumn("queue", F.coalesce("source", F.lit("")))
    sums = units.groupBy("no_source", "queue", "range").agg(F.sum(F.col("n") * F.col("size")).alias("held"))
    earlier = Window.partitionBy("no_source", "queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    targets = targets.withColumn("no_source", F.col("source").isNull()).withColumn("queue", F.coalesce("source", F.lit(""))).drop("source")
    sums = sums.join(targets, ["no_source", "queue"])
    within = Window.partitionBy("no_source", "queue", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.join(sums, ["no_source", "queue", "range"]).withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(within), F.lit(0)))
    placed = stage_table(placed.select("doc_id", "size", "source_size", "target", "rank", "start", "n"), "mix-queue")
    if placed.where("n > 1").isEmpty():
        return placed.drop("n")
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))).repartition("rank", "start", "run")
    each = runs.withColumn("k", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)))
    return each.withColumn("start", F.col("start") + F.col("k") * F.col("size")).drop("run", "k", "n")


def _cut(queue: DataFrame, budget: int, max_repeats: int, rows_per_bucket: int) -> tuple[float, int, int, int] | None:
    """The copy in which the budget ends: its finish time, source rank, end in its queue, and words taken of it."""
    copies = queue.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(k).cast("long") for k in range(max_repeats)])))
    copies = copies.withColumn("end", F.col("turn") * F.col("source_size") + F.col("start") + F.col("size")).withColumn("finish", F.try_divide("end", "target"))
    low, high = 0.0, copies.agg(F.max("finish")).first()[0]
    if high is None or not budget:
        return None
    spent, inside = 0, copies
    while True:
        width = (high - low) / RANGES
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("finish") - F.lit(low)) / F.lit(width)))
        sums = sorted(tuple(r) for r in inside.groupBy(place.alias("place")).agg(F.sum("size"), F.count(F.lit(1)), F.min("finish"), F.max("finish")).collect())
        for _, held, n, first, last in sums:
            if spent + held >= budget:
                break
            spent += held
        inside = copies.where(F.col("finish").between(first, last))
        if n <= rows_per_bucket or not first < last:
            break
        low, high = first, last
    served = Window.orderBy("finish", "rank", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = inside.select("finish", "rank", "end", "size", (F.sum("size").over(served) + spent).alias("upto"))
    at = rows.where(F.col("upto") >= budget).orderBy("upto").first()
    return at["finish"], at["rank"], at["end"], at["size"] - (at["upto"] - budget)


def mix_documents(docs: DataFrame, seed: str = "mixture-1", max_repeats: int = 3, rows_per_bucket: int = 20_000) -> DataFrame:
    """Words that a mixture takes from every row of ``docs`` (doc_id, text, source).

    Returns doc_id, size (words of the text), source_size, target (its source's words in
    the mixture) and taken (words the mixture takes, repeats counted, at most
    ``max_repeats`` times the size).  The budget is the sum of all sizes and is spent to
    the word: the one copy in which it ends gives its first words only.

    A null text has size 0, a null source is a source of its own, the last.  Rows without
    words are taken 0 times.  The shuffle depends on doc_id and text alone, so reruns
    agree; rows equal in doc_id, source and text stand together and are interchangeable.
    Ties of finish times go to the first source.  An empty table gives an empty result.
    Other columns are ignored.  One row per source meets in one task.
    """
    queue = queue_documents(docs, seed, max_repeats, rows_per_bucket)
    budget = queue.agg(F.sum("size")).first()[0] or 0
    at = _cut(queue, budget, max_repeats, rows_per_bucket)
    taken: Column = F.lit(0).cast("long")
    if at:
        finish, rank, end, part = at
        here = F.struct(F.lit(finish).alias("finish"), F.lit(rank).cast("long").alias("rank"), F.lit(end).cast("long").alias("end"))
        for turn in range(max_repeats):
            own_end = F.lit(turn).cast("long") * F.col("source_size") + F.col("start") + F.col("size")
            own = F.struct(F.try_divide(own_end, "target").alias("finish"), F.col("rank"), own_end.alias("end"))
            taken = taken + F.when((F.col("size") == 0) | (own > here), 0).when(own < here, F.col("size")).otherwise(F.lit(part).cast("long"))
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
