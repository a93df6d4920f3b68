"""Interaction of document filters, as an incidence matrix product.

Every document is its mask: one bit for each filter that it fails.  What a filter does at a
step of an order depends on the mask alone, so the outcomes of all 120 orders of five
filters are products of mask histograms (one row each for all, good and toxic documents of
a part) with fixed integer matrices of 32 masks by 600 steps.

Texts are read once and never shuffled; equal texts are found by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masswright.session import ship_package

from .common import stage_table, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts multiplied at a time; each has 600 rows.
PARTS_AT_ONCE = 50


def outcome_matrices() -> dict[str, np.ndarray]:
    """Integer matrices of 2**5 masks by 600 steps: which masks are kept, removed, redundant or unique there; and filter_at, 600 by 5."""
    masks = np.arange(1 << len(FILTERS))[:, None]
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    earlier = (np.cumsum(bits, axis=1) - bits).ravel()
    bits = bits.ravel()
    fails, gone = (masks & bits) != 0, (masks & earlier) != 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": masks == bits}
    found["filter_at"] = bits[:, None] == 1 << np.arange(len(FILTERS))
    return {k: v.astype(np.int64) for k, v in found.items()}


def text_mask() -> Column:
    """Bits of the filters A to D, which look at one text; needs text without nulls and its words."""
    n, distinct, points = F.size("words").cast("long"), F.size(F.array_distinct("words")), F.length("text")
    capitals = (points - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long")
    fails = [n < 50, distinct.cast("long") * 100 < n * 65, capitals * 100 > points.cast("long") * 5, F.rlike("text", F.lit(r"[#$%&*|]"))]
    return reduce(add, [x.cast("int") * (1 << k) for k, x in enumerate(fails)])


def document_masks(docs: DataFrame) -> DataFrame:
    """Distinct (id, part, mask) of ``docs`` with their number n, staged; mask has all five bits.

    A text's smallest id does not fail E; it is found by a join on digest and id, so copies
    of one text are spread over all tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("id", "part", F.sha2("text", 256).alias("digest"), text_mask().alias("mask"))
    rows = stage_table(rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    lead = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("lead", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("lead").isNull()
    flagged = rows.join(lead, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0))
    return stage_table(flagged.select("id", "part", "mask", "n"), "audit-masks")


def mask_histograms(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: cells of (mask, n, good, toxic), 32 at most."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")).na.fill(0)
    none = F.lit(0).cast("long")
    every = masks.groupBy("part", "mask").agg(F.sum("n").alias("n")).select("*", none.alias("good"), none.alias("toxic"))
    lost = masks.join(known.where("good + toxic > 0"), "id").groupBy("part", "mask").agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    cells = every.unionByName(lost.withColumn("n", none)).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters does at each step of each of their 120 orders, per source of ``docs`` (doc_id, text, source).

    Filters, by what fails: A, under 50 words; B, under 65 % distinct words; C, capitals
    over 5 % of the code points; D, a character of ``#$%&*|``; E, a text equal to one with
    a smaller doc_id anywhere in the table.  Returns one row per part, order and step,
    zeros included: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A null text counts as empty, a null source is the part ''.  Rows with a null doc_id
    never fail E and make no other row fail; rows of one doc_id and text are no copies of
    each other.  ``labels`` (doc_id, quality, toxic) may repeat an id: it counts as good or
    toxic if any of its rows says so; nulls say neither.  An empty table gives no rows.
    Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    histograms = mask_histograms(document_masks(docs), labels)

    def multiply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = outcome_matrices()
        steps = m["kept"].shape[1]
        order = pa.array(np.repeat(ORDERS, len(FILTERS)).tolist(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                rows = batch.slice(at, PARTS_AT_ONCE)
                n = rows.num_rows
                stacked = np.zeros((3, n, m["kept"].shape[0]), np.int64)  # all, good and toxic documents
                for k, cells in enumerate(rows.column("cells").to_pylist()):
                    for c in cells:
                        stacked[:, k, c["mask"]] += c["n"], c["good"], c["toxic"]
                removed = stacked @ m["removed"]
                shapley = removed[0] @ m["filter_at"] @ m["filter_at"].T
                counts = [stacked[0] @ m["kept"], removed[0], stacked[0] @ m["redundant"], stacked[0] @ m["unique"], removed[1], removed[2], shapley]
                each = np.arange(n * steps)
                columns = [rows.column("part").take(pa.array(each // steps)), order.take(pa.array(each % steps)), pa.array((each % len(FILTERS) + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c.ravel()) for c in counts]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return histograms.mapInArrow(multiply, SCHEMA)
