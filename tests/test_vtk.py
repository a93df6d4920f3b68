"""Faces of diagrams and their VTK files."""

import os

import duckdb
import numpy as np
import pytest

from masswright.operators import power
from masswright.plans import queries as core
from masswright.sources import vtk

SF = "/root/testdata/sf0.001"


def sites(spark, pos):
    return spark.createDataFrame([(0, i, p, 0.0) for i, p in enumerate(np.asarray(pos, float).tolist())], "batch_id long, site_id long, pos array<double>, weight double")


def polygon_area(points):
    a, b = points[:, :2], np.roll(points[:, :2], -1, axis=0)
    return (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / 2


def test_polygons_fill_the_domain_and_files_read_back(spark, tmp_path):
    diagram = power.cells(sites(spark, np.random.default_rng(5).random((40, 2))), [0.0, 0.0], [1.0, 1.0])
    faces = vtk.cell_faces(diagram, 2)
    rows = sorted((f.site_id, f.points) for f in faces.collect())
    areas = [polygon_area(np.array(p)) for _, p in rows]
    assert min(areas) > 0 and sum(areas) == pytest.approx(1)
    path = str(tmp_path / "cells")
    vtk.write_vtk(faces, path, faces_per_file=3)
    back = sorted((f.site_id, f.points) for f in vtk.read_vtk(spark, path).collect())
    assert back == rows
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(names) >= 40 / 3
    assert (tmp_path / "cells" / names[0]).read_text().startswith("# vtk DataFile Version 3.0\n")


def test_faces_of_solids_look_outwards(spark):
    """The divergence theorem: outward faces give every cell's volume, and volumes fill the cube."""
    diagram = power.cells(sites(spark, np.random.default_rng(6).random((12, 3))), [0.0] * 3, [1.0] * 3)
    volumes = {}
    for f in vtk.cell_faces(diagram, 3).collect():
        p = np.array(f.points)
        parts = [np.linalg.det(np.array([p[0], p[k], p[k + 1]])) / 6 for k in range(1, len(p) - 1)]
        volumes[f.site_id] = volumes.get(f.site_id, 0.0) + sum(parts)
    assert len(volumes) == 12 and min(volumes.values()) > 0
    assert sum(volumes.values()) == pytest.approx(1)


def test_no_cells_no_faces(spark):
    empty = spark.createDataFrame([], power.CELL_SCHEMA)
    assert vtk.cell_faces(empty, 2).count() == 0 and vtk.cell_faces(empty, 3).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        vtk.cell_faces(empty, 4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_boundary_distances_equal_their_sql(spark):
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    found = core.QUERIES["boundary_distances"](spark, SF).select("point_id", "distance").collect()
    want = con.sql(core.ORACLES["boundary_distances"]).fetchall()
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert core.QUERIES["vtk_faces"](spark, SF).where("n_points >= 3").count() > 0
