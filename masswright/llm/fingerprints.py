"""Document fingerprints: a homomorphic multiset hash, with DataFrame operations only.

A text is the multiset of its paragraphs, which are cut at sentence ends too.  Each
paragraph is hashed to a wide vector of small signed numbers, and the fingerprint is the
sum of these vectors modulo 2**40 in every lane.  Order does not matter, a paragraph is
inserted by adding and deleted by subtracting its vector, and since lanes have mean zero
the cosine of two fingerprints estimates how much of the multisets is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

LANES = 64
#: A text of at most 2**31 bytes has at most 2**30 paragraphs, so its lanes stay below 2**37 in size and never wrap.
MODULUS_BITS = 40
PARAGRAPH_END = r"\n|(?<=[.!?])\x20"
_MASK = (1 << MODULUS_BITS) - 1


def fingerprint_lanes(text: Column) -> Column:
    """The fingerprint of a text as an array of LANES numbers below 2**MODULUS_BITS."""
    paragraphs = F.filter(F.split(text, PARAGRAPH_END), lambda p: p != "")
    # Two independent hashes of every paragraph, each for half of the lanes: texts collide only if both do.
    hashes = [F.transform(paragraphs, lambda p: F.xxhash64(p)), F.transform(paragraphs, lambda p: F.xxhash64(F.lit(1), p))]

    def lanes(bound: Column) -> Column:
        def lane(j: Column) -> Column:
            total = F.aggregate(bound, F.lit(0).cast("long"), lambda s, h: s + F.xxhash64(h, j).bitwiseAND(F.lit(127)) * 2 - 127)
            return total.bitwiseAND(F.lit(_MASK))

        return F.transform(F.sequence(F.lit(0), F.lit(LANES // 2 - 1)), lane)

    # The outer transform binds the hashes to a variable, so that they are computed once and not for every lane.
    return F.flatten(F.transform(F.array(*hashes), lanes))


def add_lanes(a: Column, b: Column) -> Column:
    """The fingerprint after inserting all paragraphs of b into a."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))


def subtract_lanes(a: Column, b: Column) -> Column:
    """The fingerprint after deleting all paragraphs of b from a."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MASK)))


def fingerprint_string(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), MODULUS_BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two paragraph multisets, 0 to 1; 1 for equal fingerprints."""

    def signed(x: Column) -> Column:
        return F.when(x > _MASK // 2, x - (_MASK + 1)).otherwise(x)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: signed(p).cast("double") * signed(q)), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a == b, 1.0).when(norms == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def previous_in_order(ids: DataFrame) -> DataFrame:
    """For each id the next larger one and what it needs, the largest for the smallest.

    ``ids`` is (id, need) with unique ids.  Ids are range-partitioned; each range is
    ordered in a task of its own, and only one row a range is ordered globally.  The
    ranges are written first, since a recomputed range could have other bounds.
    """
    ranges = stage_table(ids.repartitionByRange(F.col("id").desc()).withColumn("part", F.spark_partition_id()), "id-ranges")
    here = Window.partitionBy("part").orderBy(F.col("id").desc())
    ends = ranges.groupBy("part").agg(F.min(F.struct("id", "need")).alias("end"))
    parts = Window.orderBy("part")
    last = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(parts), F.first("end").over(last)).alias("outer"))
    return (
        ranges.withColumn("inner", F.lag(F.struct("id", "need")).over(here))
        .join(ends, "part")
        .withColumn("before", F.coalesce("inner", "outer"))
        .select("id", F.col("before.id").alias("before_id"), F.col("before.need").alias("before_need"))
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text of ``docs`` (doc_id, text), its edited text and its likeness to the next.

    The edited text has its last third (floor) replaced by as many first code points, or
    all, of the next document in descending doc_id; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next.

    Null texts count as empty; an empty text has the zero fingerprint, like only to
    itself.  Null ids come last in the order.  Of rows with equal ids, the one with the
    largest text hash is "the next document" to the id before; each such row has a result
    of its own.  An empty table gives an empty result; other columns are ignored.
    """
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    need = F.floor(F.length("text") / 3).cast("int")
    order = previous_in_order(rows.groupBy("id").agg(F.max(need).alias("need")))

    ahead = rows.join(order, "id").select(
        F.col("before_id").alias("id"),
        F.xxhash64("text").alias("pick"),
        F.substring("text", F.lit(1), F.col("before_need")).alias("ahead"),
        fingerprint_lanes(F.col("text")).alias("next_lanes"),
    )
    first = F.lag("id").over(Window.partitionBy("id").orderBy(F.col("pick").desc())).isNull()
    ahead = ahead.withColumn("first", first).where("first").drop("first", "pick")

    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - need), F.substring(F.col("ahead"), F.lit(1), need))
    made = (
        rows.join(ahead, "id")
        .withColumn("edited", edited)
        .select("id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint_lanes(F.col("text")).alias("lanes"), fingerprint_lanes(F.col("edited")).alias("edited_lanes"), "next_lanes")
    )
    return made.select(
        F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint_string(F.col("lanes")).alias("fingerprint"),
        fingerprint_string(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
