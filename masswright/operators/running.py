"""Running values along an order within every batch, for batches of any size.

Batches that fit a task are windows by batch.  If any is larger, all rows are first cut
into ranges of the order and written; every range has a few sums and end values, windows
over these carry them from range to range, and rows then only need their own range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masswright.session import stage_table

#: Rows of a batch that meet in one task.
RANGE_ROWS = 50_000


@dataclass
class Ordered:
    """Rows with batch_id in the ascending order of some columns; _range numbers the ranges of a split table."""

    rows: DataFrame
    order: list[str]
    split: bool

    def where(self, condition: Column) -> Ordered:
        return Ordered(self.rows.where(condition), self.order, self.split)

    def with_columns(
        self,
        totals: dict[str, Column] | None = None,
        upto: dict[str, Column] | None = None,
        under: dict[str, Column] | None = None,
        before: dict[str, Column] | None = None,
        after: dict[str, Column] | None = None,
        filled: dict[str, Column] | None = None,
        last: str | None = None,
    ) -> Ordered:
        """Adds sums of the batch (totals), up to a row (upto) and of the rows before it (under, 0 for the first), the
        values of the row before and after (null at the ends), the last value up to a row that is not null (filled), and
        whether a row is the batch's last."""
        totals, upto, under, before, after, filled = (x or {} for x in (totals, upto, under, before, after, filled))
        keys = ["batch_id", "_range"] if self.split else ["batch_id"]
        rows, order = self.rows, F.struct(*self.order)
        if self.split:
            sums = {f"_s_{n}": F.sum(c) for n, c in (totals | upto | under).items()}
            ends = {f"_e_{n}": F.max_by(F.struct(c.alias("v")), order) for n, c in before.items()} | {f"_b_{n}": F.min_by(F.struct(c.alias("v")), order) for n, c in after.items()}
            held = {f"_f_{n}": F.max_by(F.when(c.isNotNull(), F.struct(c.alias("v"))), F.when(c.isNotNull(), order)) for n, c in filled.items()}
            edges = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in (sums | ends | held | {"_n": F.count(F.lit(1))}).items()])
            whole = Window.partitionBy("batch_id")
            across = whole.orderBy("_range")
            earlier = across.rowsBetween(Window.unboundedPreceding, -1)
            carried = {f"_t_{n}": F.sum(f"_s_{n}").over(whole) for n in totals} | {f"_o_{n}": F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0.0)) for n in upto | under}
            carried |= {f"_c_{n}": F.lag(f"_e_{n}").over(across) for n in before} | {f"_c_{n}": F.lead(f"_b_{n}").over(across) for n in after}
            carried |= {f"_c_{n}": F.last(f"_f_{n}", ignorenulls=True).over(earlier) for n in filled}
            edges = edges.select(*keys, *[c.alias(n) for n, c in carried.items()], F.lead("_range").over(across).isNull().alias("_last_range"))
            rows = rows.join(edges, keys)
        here = Window.partitionBy(*keys)
        along = here.orderBy(*self.order)
        so_far, past = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
        out: dict[str, Column] = {}
        for n, c in totals.items():
            out[n] = F.col(f"_t_{n}") if self.split else F.sum(c).over(here)
        for n, c in upto.items():
            out[n] = F.sum(c).over(so_far) + (F.col(f"_o_{n}") if self.split else F.lit(0.0))
        for n, c in under.items():
            out[n] = F.coalesce(F.sum(c).over(past), F.lit(0.0)) + (F.col(f"_o_{n}") if self.split else F.lit(0.0))
        for names, move in ((before, F.lag), (after, F.lead)):
            for n, c in names.items():
                near = move(F.struct(c.alias("v"))).over(along)
                out[n] = (F.coalesce(near, F.col(f"_c_{n}")) if self.split else near)["v"]
        for n, c in filled.items():
            found = F.last(c, ignorenulls=True).over(so_far)
            out[n] = F.coalesce(found, F.col(f"_c_{n}")["v"]) if self.split else found
        if last:
            end = F.lead(F.lit(1)).over(along).isNull()
            out[last] = end & F.col("_last_range") if self.split else end
        rows = rows.withColumns(out)
        return Ordered(rows.select(*self.rows.columns, *[n for n in out if n not in self.rows.columns]), self.order, self.split)

    def result(self) -> DataFrame:
        return self.rows.drop("_range")


def ranges_of(*tables: DataFrame) -> int:
    """Into how many ranges rows made from these tables (batch_id) are to be split: 0 if every batch fits a task."""
    rows = tables[0].select("batch_id")
    for more in tables[1:]:
        rows = rows.unionByName(more.select("batch_id"))
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return 0 if (sizes[0] or 0) <= RANGE_ROWS else -(-sizes[1] // RANGE_ROWS) + 1


def ordered(rows: DataFrame, order: list[str], ranges: int | None = None) -> Ordered:
    """``rows`` (batch_id and others) in the order of the columns ``order``, split into ``ranges`` ranges; None asks ranges_of."""
    ranges = ranges_of(rows) if ranges is None else ranges
    if not ranges:
        return Ordered(rows, order, False)
    # Written first, since a recomputed range could have other bounds.
    return Ordered(stage_table(rows.repartitionByRange(ranges, "batch_id", *order).withColumn("_range", F.spark_partition_id()), "ranges"), order, True)
