"""The driver's entry points, and the core queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from masswright.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(core.QUERIES) <= set(driver.queries())


def test_entry_has_a_stable_schema(spark):
    df = driver.entry(spark)
    assert df.columns == driver.entry(spark).columns and df.count() > 0


def rounded(rows):
    return sorted((tuple(None if x is None or x != x else round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["ot1d_uniform_distance", "ot1d_step_barycenter", "ot1d_affine_cuts", "grid_hist_2d", "power_assign", "power_cell_barycenter", "power_assign_64d", "bisector_planes", "cell_facets", "cell_clip", "cell_integrals", "newton_matrix", "vtk_faces", "lloyd_points", "cell_measure_box", "linspace", "ot1d_discrete_discrete", "cdf_1d", "quantile_1d", "part_assign", "image_assign", "torus_cell_integrals", "ball_newton_matrix", "centroid_derivatives", "obstacle_cell_integrals", "node_axis_split"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    found = core.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(core.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rounded(found.select(*columns).collect()) == rounded(want.select(*[f'"{c}"' for c in columns]).fetchall())
