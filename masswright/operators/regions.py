"""A bounded tree over sites, and which of its leaves matter to which points.

The tree has at most MAX_LEAVES leaves over all batches, whatever the number of sites; it
is split on a sample and small enough to travel with a task.  Only the split planes come
from the sample: boxes, weight bounds and counts of the leaves are taken over all sites, so
searches that prune by them are exact.

The weights of a leaf are bounded by an affine function: a ridge fit of the weights by
position, raised until no weight is above it.  Costs of whole leaves are bounded with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masswright.functions import arrays
from masswright.session import ship_package, stage_table

MAX_LEAVES = 4096
SITES_PER_LEAF = 32
#: Sites, at most twice as many, from which the planes are taken.
SAMPLE_ROWS = 200_000
#: Affine bounds are fitted up to this dimension, constant ones beyond.
FIT_DIM = 3
#: Rounding allowed for in bounds, as a part of the numbers that they add up.
SLACK = 1e-12


def plain_sites(sites: DataFrame) -> DataFrame:
    """Sites (batch_id, site_id, pos, weight) as longs and doubles; a null weight is 0, rows without batch or position go."""
    rows = sites.select(F.col("batch_id").cast("long"), F.col("site_id").cast("long"), F.transform("pos", lambda x: x.cast("double")).alias("pos"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    return rows.where("batch_id is not null and pos is not null")


def positions(column, dim: int) -> np.ndarray:
    """An Arrow column of lists as rows of ``dim`` coordinates; NaN where it is null or has another length."""
    import pyarrow.compute as pc

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    out = np.full((len(column), dim), np.nan)
    out[good.to_numpy(zero_copy_only=False)] = pc.list_flatten(column.filter(good)).cast("double").to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


@dataclass
class SiteTree:
    """Split planes of all batches' trees: axis (-1 in leaves), value, first child (the second follows) or the leaf's number."""

    dim: int
    batches: np.ndarray
    roots: np.ndarray
    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    leaves: int

    def locate(self, batch: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The leaf of every position, -1 in unknown batches; undefined positions go to some leaf of their batch."""
        at = np.minimum(np.searchsorted(self.batches, batch), len(self.batches) - 1)
        node = self.roots[at]
        known = self.batches[at] == batch
        rows = np.arange(len(node))
        while len(rows):
            inner = self.axis[node[rows]] >= 0
            rows = rows[inner]
            k = node[rows]
            node[rows] = self.child[k] + (pos[rows, self.axis[k]] > self.value[k])
        return np.where(known, self.child[node], -1)


def build_tree(sites: DataFrame, per_leaf: int = SITES_PER_LEAF) -> SiteTree | None:
    """The tree of plain sites; None without sites or with more batches than leaves, each of which is then a region."""
    sizes = sites.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("pos")).alias("dim")).limit(MAX_LEAVES + 1).collect()
    if not sizes or len(sizes) > MAX_LEAVES:
        return None
    total, dim = sum(r["n"] for r in sizes), max(r["dim"] for r in sizes)
    sample = sites.select("batch_id", "pos").sample(min(1.0, SAMPLE_ROWS / total), seed=1).limit(2 * SAMPLE_ROWS).toArrow()
    batch, pos = sample.column("batch_id").to_numpy(), positions(sample.column("pos"), dim)
    axis, value, child, roots, leaves = [], [], [], [], 0
    per_leaf = max(per_leaf, 2 * total / max(1, MAX_LEAVES - len(sizes)))
    batches = np.array(sorted(r["batch_id"] for r in sizes), np.int64)
    n_of = {r["batch_id"]: r["n"] for r in sizes}

    def add() -> int:
        axis.append(-1), value.append(0.0), child.append(0)
        return len(axis) - 1

    for b in batches.tolist():
        own = pos[batch == b]
        roots.append(add())
        rate = max(1.0, n_of[b] / max(1, len(own)))  # sites a sampled one stands for
        todo = [(roots[-1], own)]
        while todo:
            node, p = todo.pop()
            extent = p.max(axis=0) - p.min(axis=0) if len(p) else np.zeros(dim)
            k = int(np.argmax(extent)) if dim else 0
            if len(p) * rate <= per_leaf or not extent[k] > 0:
                child[node], leaves = leaves, leaves + 1
                continue
            middle = float(np.median(p[:, k]))
            if not (p[:, k] > middle).any():
                middle = float(p[p[:, k] < middle, k].max())
            above = p[:, k] > middle
            axis[node], value[node] = k, middle
            child[node] = add()
            todo += [(child[node], p[~above]), (add(), p[above])]
    return SiteTree(dim, batches, np.array(roots), np.array(axis), np.array(value), np.array(child), leaves)


def add_leaf(rows: DataFrame, tree: SiteTree) -> DataFrame:
    """Adds _leaf to rows (batch_id, pos); rows of batches without a tree go."""
    import pyspark.sql.types as T

    ship_package(rows.sparkSession)
    at = rows.columns.index("batch_id"), rows.columns.index("pos")

    def locate(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids = batch.column(at[0])
            known = ids.is_valid()
            leaf = tree.locate(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), positions(batch.column(at[1]), tree.dim))
            table = pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "_leaf"])
            yield table.filter(pc.and_(known, pc.greater_equal(table.column(batch.num_columns), 0)))

    return rows.mapInArrow(locate, T.StructType([*rows.schema.fields, T.StructField("_leaf", T.LongType())]))


@dataclass
class LeafBounds:
    """Per leaf: batch, sites, box, affine bound of the weights (slope . pos + top), and its heaviest site."""

    batch: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    slope: np.ndarray
    top: np.ndarray
    best: np.ndarray
    best_weight: np.ndarray


def leaf_bounds(located: DataFrame, tree: SiteTree) -> LeafBounds:
    """Bounds of all leaves over all their sites (with _leaf); at most MAX_LEAVES rows reach the driver."""
    dim, spark = tree.dim, located.sparkSession
    axes = [F.get("pos", F.lit(d)) for d in range(dim)]
    v = [F.lit(1.0), *axes]
    fit = range(dim + 1) if dim <= FIT_DIM else ()
    sums = [F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i in fit for j in fit if j <= i] + [F.sum(v[i] * F.col("weight")).alias(f"r{i}") for i in fit]
    heaviest = F.max(F.struct("weight", (-F.col("site_id")).alias("id"), "pos")).alias("best")
    rows = located.groupBy("_leaf").agg(F.first("batch_id").alias("batch_id"), F.count(F.lit(1)).alias("n"), F.array(*[F.min(a) for a in axes]).alias("lo"), F.array(*[F.max(a) for a in axes]).alias("hi"), heaviest, *sums).collect()
    L = tree.leaves
    out = LeafBounds(np.zeros(L, np.int64), np.zeros(L, np.int64), np.full((L, dim), np.inf), np.full((L, dim), -np.inf), np.zeros((L, dim)), np.full(L, -np.inf), np.zeros((L, dim)), np.full(L, -np.inf))
    for r in rows:
        k = r["_leaf"]
        out.batch[k], out.n[k], out.lo[k], out.hi[k], out.best[k], out.best_weight[k] = r["batch_id"], r["n"], r["lo"], r["hi"], r["best"]["pos"], r["best"]["weight"]
        if dim <= FIT_DIM:
            m = np.array([[r[f"s{max(i, j)}_{min(i, j)}"] for j in fit] for i in fit])
            m[np.diag_indices(dim + 1)] += 1e-10 * m.diagonal().max()
            out.slope[k] = np.linalg.solve(m, np.array([r[f"r{i}"] for i in fit]))[1:]
    slopes = spark.createDataFrame([(k, out.slope[k].tolist()) for k in np.flatnonzero(out.n).tolist()], "_leaf long, slope array<double>")
    over = F.col("weight") - (arrays.dot(F.col("slope"), F.col("pos")) if dim <= FIT_DIM else F.lit(0.0))
    for r in located.join(F.broadcast(slopes), "_leaf").groupBy("_leaf").agg(F.max(over).alias("top")).collect():
        out.top[r["_leaf"]] = r["top"]
    return out


def near_leaves(bounds: LeafBounds, leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, leaf): leaves that may hold the best site of some point in the box [lo, hi] of each row, whose points lie in ``leaf``.

    Every box has a rival, the site of ``bounds.best`` that is best at its centre; a leaf is
    left out if none of its sites can be better than the rival anywhere in the box.  The
    difference of two sites' costs is linear in the point, so this bound stays tight for
    points far from the sites.
    """
    rows, found = [], []
    size = max(float(np.abs(x).max(initial=0.0)) for x in (lo, hi, bounds.lo[bounds.n > 0], bounds.hi[bounds.n > 0]))
    slack = SLACK * (1.0 + 4 * lo.shape[1] * size * size + size * np.abs(bounds.slope).max(initial=0.0) + np.abs(bounds.top[bounds.n > 0]).max(initial=0.0))
    for b in np.unique(bounds.batch[leaf]):
        own, others = np.flatnonzero(bounds.batch[leaf] == b), np.flatnonzero((bounds.batch == b) & (bounds.n > 0))
        plo, phi, slope = bounds.lo[others], bounds.hi[others], bounds.slope[others]
        for at in np.array_split(own, max(1, len(own) * len(others) // 500_000)):
            middle = (lo[at] + hi[at]) / 2
            rival = others[np.argmin(((middle[:, None] - bounds.best[others]) ** 2).sum(axis=2) - bounds.best_weight[others], axis=1)]
            q = bounds.best[rival][:, None]

            def least(x, low, high, q=q, slope=slope):
                # Convex in the site's coordinate p, for a point at x.
                p = np.clip(x + slope / 2, low, np.maximum(low, high))
                return np.where(low <= high, (p - q) * (p + q - 2 * x) - slope * p, np.inf)

            # Past the rival the worst point is the box's upper end, before it the lower one.
            gain = np.minimum(least(hi[at][:, None], np.maximum(plo, q), phi), least(lo[at][:, None], plo, np.minimum(phi, q))).sum(axis=2)
            r, k = np.nonzero(gain - bounds.top[others] + bounds.best_weight[rival][:, None] <= slack)
            rows.append(at[r])
            found.append(others[k])
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(found or [np.zeros(0, int)])


def stage_leaves(sites: DataFrame, tree: SiteTree) -> tuple[DataFrame, LeafBounds]:
    """The plain sites with _leaf, written, and the leaves' bounds."""
    located = stage_table(add_leaf(sites, tree), "site-leaves")
    return located, leaf_bounds(located, tree)


def _box_gaps(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of boxes [lo, hi] and [low, high]."""
    gap = np.maximum(0.0, np.maximum(lo - high, low - hi))
    return np.sqrt((gap * gap).sum(axis=-1))


def tiles_around(bounds: LeafBounds, shifts: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(tile, leaf, image) of the ``n`` leaves nearest to every leaf, itself first; images are rows of ``shifts``."""
    out = []
    for b in np.unique(bounds.batch[bounds.n > 0]):
        own = np.flatnonzero((bounds.batch == b) & (bounds.n > 0))
        low, high = (np.concatenate([x[own] + s for s in shifts]) for x in (bounds.lo, bounds.hi))
        middle = (low + high) / 2
        for k in own:
            gap = _box_gaps(bounds.lo[k], bounds.hi[k], low, high)
            near = np.lexsort((((middle - middle[np.searchsorted(own, k)]) ** 2).sum(axis=1), gap))[:n]
            out += [(int(k), int(own[i % len(own)]), int(i // len(own))) for i in near]
    return out


def leaves_in_reach(bounds: LeafBounds, shifts: np.ndarray, batch: int, pos: np.ndarray, radius: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, image) with a site that may cut a row's cell: its points are at most ``radius`` from ``pos``, and ``room`` is radius**2 less the weight."""
    own = np.flatnonzero((bounds.batch == batch) & (bounds.n > 0))
    found = [[np.zeros(0, np.int64)] * 3]
    if not len(pos):
        return tuple(found[0])
    # Only leaves near the box of all rows are met with each of them.
    lo, hi = pos.min(axis=0), pos.max(axis=0)
    farthest = radius.max() + np.sqrt(np.maximum(0.0, room.max() + bounds.best_weight[own]))
    for image, s in enumerate(shifts):
        for k in own[_box_gaps(bounds.lo[own] + s, bounds.hi[own] + s, lo, hi) <= farthest * (1 + SLACK)]:
            reach = radius + np.sqrt(np.maximum(0.0, room + bounds.best_weight[k]))
            rows = np.flatnonzero(_box_gaps(bounds.lo[k] + s, bounds.hi[k] + s, pos, pos) <= reach * (1 + SLACK))
            found.append([rows, np.full(len(rows), k), np.full(len(rows), image)])
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
