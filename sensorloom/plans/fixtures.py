"""Driving-data shaped tables derived from the given tables, as SQL that Spark and DuckDB run alike (see FIXTURES.md).

A scene is a user of `events`, a sample an event, annotations and lidar points come from `lineitem`, detector output and 8x8
rasters from `embeddings`. Names in braces are other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "fx_sensor": """
SELECT * FROM (VALUES
  (0,'CAM_FRONT',       1e0,-1e0, 1e0,-1e0, 1.70e0, 0.0e0,1.5e0),
  (1,'CAM_FRONT_RIGHT', 1e0,-1e0, 3e0,-3e0, 1.55e0,-0.5e0,1.5e0),
  (2,'CAM_BACK_RIGHT', -1e0, 1e0, 3e0,-3e0, 1.05e0,-0.5e0,1.5e0),
  (3,'CAM_BACK',        1e0,-1e0,-1e0, 1e0, 0.05e0, 0.0e0,1.5e0),
  (4,'CAM_BACK_LEFT',   3e0,-3e0,-1e0, 1e0, 1.05e0, 0.5e0,1.5e0),
  (5,'CAM_FRONT_LEFT',  3e0,-3e0, 1e0,-1e0, 1.55e0, 0.5e0,1.5e0),
  (6,'LIDAR_TOP',       1e0, 0e0, 0e0,-1e0, 0.95e0, 0.0e0,1.8e0)
) AS t(sensor_id, channel, qw, qx, qy, qz, tx, ty, tz)
""",
    "fx_category": """
SELECT * FROM (VALUES
  (0,'vehicle.car','car',0,'vehicle'), (1,'vehicle.truck','truck',1,'vehicle'),
  (2,'vehicle.construction','construction_vehicle',2,'vehicle'),
  (3,'vehicle.bus.bendy','bus',3,'vehicle'), (4,'vehicle.bus.rigid','bus',3,'vehicle'),
  (5,'vehicle.trailer','trailer',4,'vehicle'), (6,'movable_object.barrier','barrier',5,'road_object'),
  (7,'vehicle.motorcycle','motorcycle',6,'two_wheeler'), (8,'vehicle.bicycle','bicycle',7,'two_wheeler'),
  (9,'human.pedestrian.adult','pedestrian',8,'pedestrian'), (10,'human.pedestrian.child','pedestrian',8,'pedestrian'),
  (11,'human.pedestrian.construction_worker','pedestrian',8,'pedestrian'),
  (12,'human.pedestrian.police_officer','pedestrian',8,'pedestrian'),
  (13,'movable_object.trafficcone','traffic_cone',9,'road_object'),
  (14,'animal',NULL,NULL,NULL), (15,'static_object.bicycle_rack',NULL,NULL,NULL)
) AS t(category_token, name, category_name, id, category_group)
""",
    "fx_sample": """
SELECT event_id AS sample_token, user_id AS scene_token, ts AS sample_ts FROM {events}
""",
    "fx_sample_data": """
SELECT e.event_id * 10 + s.sensor_id AS token, e.event_id AS sample_token, s.sensor_id AS calibrated_sensor_token,
       e.event_id * 10 + s.sensor_id AS ego_pose_token, e.event_id % 7 <> 0 AS is_key_frame,
       1600 AS width, 900 AS height, e.ts AS sd_ts
FROM {events} e CROSS JOIN {fx_sensor} s
""",
    "fx_ego_pose": """
SELECT e.event_id * 10 + s.sensor_id AS token,
       e.value * 0.5e0 + s.sensor_id * 0.01e0 AS tx, (e.user_id % 17) * 3e0 AS ty, 0.5e0 AS tz,
       1e0 + e.event_id % 5 AS qw, 0e0 AS qx, 0e0 AS qy, 0e0 + e.event_id % 3 AS qz
FROM {events} e CROSS JOIN {fx_sensor} s
""",
    "fx_annotation": """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, e.event_id AS sample_token,
       l.l_partkey AS instance_token, l.l_partkey % 16 AS category_token,
       e.value * 0.5e0 + (l.l_quantity - 25e0) * 1.6e0 AS cx,
       (e.user_id % 17) * 3e0 + (l.l_partkey % 81 - 40) * 1e0 AS cy, 0.5e0 + (l.l_suppkey % 5) * 0.5e0 AS cz,
       1e0 + (l.l_partkey % 50) / 25e0 AS sw, 2e0 + (l.l_partkey % 50) / 10e0 AS sl, 1e0 + (l.l_partkey % 50) / 30e0 AS sh,
       1e0 + l.l_linenumber AS qw, 0e0 AS qx, 0e0 AS qy, 0e0 + l.l_partkey % 4 AS qz,
       (l.l_suppkey % 9) * 1e0 AS vx, l.l_discount * 10e0 AS vy
FROM {lineitem} l JOIN {events} e ON e.event_id = l.l_orderkey % (SELECT count(*) FROM {events})
""",
    "fx_lidar": """
SELECT l_orderkey % (SELECT count(*) FROM {events}) AS sample_token, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity - 25e0 AS x, (l_partkey % 101 - 50) * 1e0 AS y, l_tax * 10e0 - 1e0 AS z,
       l_discount AS intensity, 0e0 + l_linenumber AS ring
FROM {lineitem}
""",
    "fx_detection": """
SELECT vec_id - vec_id % 900 AS frame_id, vec_id AS query_idx, embedding AS logits,
       0.3e0 + (vec_id % 7) * 0.06e0 AS cx, 0.3e0 + (vec_id % 5) * 0.08e0 AS cy,
       0.10e0 + (vec_id % 4) * 0.05e0 AS w, 0.10e0 + (vec_id % 3) * 0.05e0 AS h
FROM {embeddings}
""",
}
#: Intrinsics of all cameras: fx, fy, cx, cy; image size.
K = (1266.0, 1266.0, 816.0, 491.0)
WIDTH, HEIGHT = 1600, 900


def duck(body: str) -> str:
    """SQL for DuckDB: the fixtures that the body names, as common table expressions, then the body (itself WITH ... or SELECT)."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, sql in SQL.items():
            if name in text and name not in wanted:
                need(sql)
                wanted.append(name)

    need(body)
    names = {n: n for n in [*SQL, "events", "lineitem", "embeddings"]}
    parts = [f"{n} AS ({SQL[n].strip().format(**names)})" for n in wanted]
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, body[15:]])
    if body.startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


class Fixtures:
    """The derived tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self.made:
            if f"fx_{name}" in SQL:
                text = SQL[f"fx_{name}"]
                parts = {n: self.raw(n) for n in ("events", "lineitem", "embeddings") if "{" + n + "}" in text}
                if "{fx_sensor}" in text:
                    # Each event becomes a row for each sensor: few blocks of a file would be few, long tasks.
                    parts["events"] = parts["events"].repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
                    parts["fx_sensor"] = self.sensor
                self.made[name] = self.spark.sql(text, **parts)
            else:
                raise AttributeError(name)
        return self.made[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
