"""VTK files of diagrams: faces as rows, written in pieces and read back.

A file is a complete legacy PolyData set of at most ``faces_per_file`` faces with its own
points, so that partitions are written apart; a viewer loads the folder's files together.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masswright.functions import arrays
from masswright.functions.polytopes import INFINITE
from masswright.session import ship_package

FACE_SCHEMA = "batch_id long, site_id long, neighbor long, points array<array<double>>"


def _around(points: Column, first: Column, second: Column) -> Column:
    """Points of a convex polygon, counter-clockwise in the plane of two orthogonal directions."""
    n = F.size(points)
    center = F.transform(F.sequence(F.lit(0), F.size(F.get(points, F.lit(0))) - 1), lambda d: arrays.total(F.transform(points, lambda p: F.get(p, d))) / n)

    def keyed(p: Column) -> Column:
        off = arrays.subtract(p, center)
        return F.struct(F.atan2(arrays.dot(off, second), arrays.dot(off, first)).alias("angle"), p.alias("p"))

    return F.transform(F.array_sort(F.transform(points, keyed)), lambda s: s["p"])


def cross(a: Column, b: Column) -> Column:
    x, y = [F.get(a, F.lit(d)) for d in range(3)], [F.get(b, F.lit(d)) for d in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def cell_faces(diagram: DataFrame, dim: int, tolerance: float = 1e-9) -> DataFrame:
    """Polygons of a diagram's cells: batch_id, site_id, neighbor, points (three coordinates each).

    In two dimensions a cell is one polygon and neighbor is null; in three a polygon lies
    on every cut that holds three vertices or more, is seen counter-clockwise from outside,
    and neighbor is the cut's id.  Cells without vertices and faces at infinity have no rows.
    """
    if dim not in (2, 3):
        raise ValueError("faces are drawn in two or three dimensions")
    rows = diagram.where(F.size("vertices") > dim)
    if dim == 2:
        x, y = [F.array(F.lit(float(k == 0)), F.lit(float(k == 1))) for k in range(2)]
        flat = F.transform(_around(F.col("vertices"), x, y), lambda p: F.concat(p, F.array(F.lit(0.0))))
        return rows.select("batch_id", "site_id", F.lit(None).cast("long").alias("neighbor"), flat.alias("points"))
    cuts = rows.select("batch_id", "site_id", "vertices", F.explode(F.arrays_zip("cut_normals", "cut_offsets", "cut_ids")).alias("cut"))
    cuts = cuts.where(F.col("cut.cut_ids") != INFINITE).withColumn("n", arrays.normalized(F.col("cut.cut_normals")))
    cuts = cuts.withColumn("d", F.col("cut.cut_offsets") / arrays.norm(F.col("cut.cut_normals")))
    cuts = cuts.withColumn("points", F.filter("vertices", lambda v: F.abs(arrays.dot(v, F.col("n")) - F.col("d")) <= tolerance)).where(F.size("points") >= 3)
    flattest = arrays.arg_max(F.transform("n", lambda c: -F.abs(c)))
    axis = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == flattest, 1.0).otherwise(0.0))
    cuts = cuts.withColumn("u", arrays.normalized(cross(F.col("n"), axis)))
    cuts = cuts.withColumn("v", cross(F.col("n"), F.col("u")))
    return cuts.select("batch_id", "site_id", F.col("cut.cut_ids").alias("neighbor"), _around(F.col("points"), F.col("u"), F.col("v")).alias("points"))


def _document(rows: list[dict]) -> str:
    points = [p for r in rows for p in r["points"]]
    lines = ["# vtk DataFile Version 3.0", "cells", "ASCII", "DATASET POLYDATA", f"POINTS {len(points)} double"]
    lines += [" ".join(map(repr, p)) for p in points]
    lines.append(f"POLYGONS {len(rows)} {len(rows) + len(points)}")
    at = 0
    for r in rows:
        n = len(r["points"])
        lines.append(" ".join(map(str, [n, *range(at, at + n)])))
        at += n
    lines += [f"CELL_DATA {len(rows)}", "FIELD ids 2"]
    for name in ("batch_id", "site_id"):
        lines += [f"{name} 1 {len(rows)} long", *[str(r[name]) for r in rows]]
    return "\n".join(lines)


def write_vtk(faces: DataFrame, path: str, faces_per_file: int = 10_000) -> None:
    """Write faces (batch_id, site_id, points) as legacy VTK text files in the folder ``path``.

    Each task writes its own files; none holds more than ``faces_per_file`` faces.
    """
    ship_package(faces.sparkSession)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, faces_per_file):
                text = _document(batch.slice(start, faces_per_file).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])

    faces.select("batch_id", "site_id", "points").mapInArrow(write, "value string").write.option("maxRecordsPerFile", 1).text(path)


def read_vtk(spark: SparkSession, path: str) -> DataFrame:
    """Faces of files that ``write_vtk`` wrote: batch_id, site_id, neighbor (null), points."""
    ship_package(spark)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = text.split("\n")
                n = int(lines[4].split()[1])
                points = [[float(x) for x in line.split()] for line in lines[5 : 5 + n]]
                m = int(lines[5 + n].split()[1])
                polygons = [[points[int(i)] for i in line.split()[1:]] for line in lines[6 + n : 6 + n + m]]
                ids = lines[8 + n + m :]
                columns = [list(map(int, ids[1 : 1 + m])), list(map(int, ids[2 + m : 2 + 2 * m])), [None] * m, polygons]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["batch_id", "site_id", "neighbor", "points"])

    return spark.read.text(path, wholetext=True).mapInArrow(read, FACE_SCHEMA)
