"""The registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from sensorloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem", "embeddings", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(names)) for r in got.collect())))
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["j16_all_camera_lidar_pairs", "f14_all_boxes_in_ego", "f11_all_ego_to_camera", "f13_all_project", "f19_all_boxes_2d", "f20_p16_all_boxes_2d_counts", "f16_f22_all_wireframe"])
def test_every_camera_has_rows(spark, name):
    rows = QUERIES[name](spark, SF)
    token = "camera_token" if "camera_token" in rows.columns else "token"
    assert {r[0] for r in rows.selectExpr(f"{token} % 10").distinct().collect()} == set(range(6))  # the rig's six cameras


def test_window_cloud_holds_every_raster_in_one_window(spark):
    rows = QUERIES["c4_all_window_cloud"](spark, SF)
    kept = QUERIES["c1_depth_points"](spark, SF).select("vec_id").distinct()  # rasters with a pixel in reach
    assert kept.join(rows, "vec_id", "left_anti").count() == 0
    places = rows.select("vec_id", "token", "window_id").distinct().collect()
    assert len(places) == len({r.vec_id for r in places})
    assert {r.token % 10 for r in places} == set(range(6)) and max(r.window_id for r in places) > 0
