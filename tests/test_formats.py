"""Data sources of driving-dataset files, bucketed tables, and the package on workers."""

import gzip
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorloom.sources import formats, readers

ROOT = Path(__file__).resolve().parents[1]


def points(spark, frames, n):
    rows = spark.range(frames * n).select((F.col("id") % frames).cast("string").alias("frame"), *((F.col("id") * k).cast("float").alias(c) for k, c in enumerate(formats.POINT, 1)))
    return formats.by_frame(rows, "frame", "x")


def test_sweeps_round_trip(spark, tmp_path):
    formats.register(spark)
    points(spark, 7, 50).write.format("lidar_sweeps").mode("append").save(f"file://{tmp_path}/s")
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == [f"{i}.bin" for i in range(7)]  # no work folder is left
    back = spark.read.format("lidar_sweeps").option("group_bytes", 3000).load(f"file://{tmp_path}/s")
    assert back.rdd.getNumPartitions() == 3  # three files of 1,000 bytes a group
    got = {(r.frame, r.point_idx): (r.x, r.ring) for r in back.collect()}
    assert got == {(str(i), k): (float(i + 7 * k), 5.0 * (i + 7 * k)) for i in range(7) for k in range(50)}
    narrow = spark.read.format("lidar_sweeps").schema("x float").load(f"file://{tmp_path}/s")
    assert narrow.columns == ["x"] and narrow.count() == 350
    with pytest.raises(PySparkException, match="have no colour"):
        spark.read.format("lidar_sweeps").schema("colour float").load(f"file://{tmp_path}/s").count()


def test_overwriting_and_failing_jobs(spark, tmp_path):
    formats.register(spark)
    path = f"file://{tmp_path}/s"
    points(spark, 3, 5).write.format("lidar_sweeps").mode("append").save(path)
    bad = points(spark, 4, 5).withColumn("frame", F.concat(F.lit("a/"), "frame"))
    with pytest.raises(PySparkException, match="no slash"):
        bad.write.format("lidar_sweeps").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "s").glob("*.bin")) == ["0.bin", "1.bin", "2.bin"]
    points(spark, 1, 5).write.format("lidar_sweeps").mode("overwrite").save(path)
    assert sorted(p.name for p in (tmp_path / "s").glob("*.bin")) == ["0.bin"]
    (tmp_path / "s/9.bin").write_bytes(b"123")
    with pytest.raises(PySparkException, match="ends inside a point"):
        spark.read.format("lidar_sweeps").load(path).count()


def test_empty_folder_has_no_points(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("lidar_sweeps").load(f"file://{tmp_path}/none").count() == 0


def test_clouds_round_trip(spark, tmp_path):
    formats.register(spark)
    rows = spark.createDataFrame([(f, float(k), 0.1 * k, -1e-9 * k, k / 255, 0.0, 1.0) for f in (3, 12345) for k in range(20)], "frame_idx int, x double, y double, z double, red double, green double, blue double")
    formats.by_frame(rows, "frame_idx", "x").write.format("ply_clouds").mode("append").save(f"file://{tmp_path}/c")
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["point0003.ply", "point12345.ply"]
    back = spark.read.format("ply_clouds").load(f"file://{tmp_path}/c").where("frame = 'point0003'").orderBy("point_idx").collect()
    assert [(r.x, r.y, r.z, r.red, r.blue) for r in back] == [(float(k), 0.1 * k, -1e-9 * k, k / 255, 1.0) for k in range(20)]


def test_images_are_numbered_by_name(spark, tmp_path):
    formats.register(spark)
    for i in range(12):
        (tmp_path / f"f{11 - i:03d}.png").write_bytes(bytes([i]) * 10)
    back = spark.read.format("image_files").option("group_bytes", 40).load(f"file://{tmp_path}")
    assert [(r.nth, r.filename, bytes(r.content)) for r in back.orderBy("nth").collect()] == [(i, f"f{i:03d}.png", bytes([11 - i]) * 10) for i in range(12)]


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    left = formats.bucketed(spark.range(1000).withColumn("k", F.col("id") % 50), "bucket_left", "k", 4, f"file://{tmp_path}/l")
    right = formats.bucketed(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("one")), "bucket_right", "k", 4, f"file://{tmp_path}/r")
    joined = left.hint("merge").join(right, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 1000
    spark.sql("DROP TABLE bucket_left")
    spark.sql("DROP TABLE bucket_right")


def test_workers_find_the_package(tmp_path):
    """A session that starts in another folder, and knows the repository by sys.path only."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from sensorloom.plans.queries import QUERIES
for name in ("m3_morphology_list", "f19_all_boxes_2d", "d9_detector_chain", "m2_run_union"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
    import os

    env |= {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = dict(line.split() for line in out.stdout.splitlines() if len(line.split()) == 2)
    assert len(counts) == 4 and all(int(n) > 0 for n in counts.values())


def test_records_are_made_once_and_written_compressed_where_they_lie(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(0, 250, 1, 2).select(F.concat(F.lit('é"'), "id").alias("token"), F.when(F.col("id") % 5 > 0, F.lit("one")).alias("name"))
    formats.record_files(rows.mapInPandas(seen, "token string, name string"), f"file://{tmp_path}/scene", per_file=100)
    assert made.value == 250
    files = [json.loads(gzip.decompress(p.read_bytes())) for p in (tmp_path / "scene").iterdir()]  # no work folder is left
    assert sorted(map(len, files)) == [25, 25, 100, 100]  # two tasks of 125 records
    back = readers.read_table(spark, f"file://{tmp_path}", "scene", parts=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_a_record_table_may_be_empty(spark, tmp_path):
    formats.record_files(spark.createDataFrame([], "token string, name string"), f"file://{tmp_path}/scene")
    assert readers.read_table(spark, f"file://{tmp_path}", "scene", parts=True).count() == 0


def test_packed_sweeps_hold_the_bytes_of_their_files(spark, tmp_path):
    formats.register(spark)
    points(spark, 300, 7).write.format("lidar_sweeps").mode("append").save(f"file://{tmp_path}/s")
    packs = formats.packed_sweeps(points(spark, 300, 7), "frame", f"file://{tmp_path}/p")
    assert {r.filename: bytes(r.content) for r in packs.collect()} == {p.name: p.read_bytes() for p in (tmp_path / "s").glob("*.bin")}
    assert len(list((tmp_path / "p").glob("*.parquet"))) <= 5  # files grow with the tasks, not with the sweeps
    want = sorted(map(tuple, spark.read.format("lidar_sweeps").load(f"file://{tmp_path}/s").collect()))
    assert sorted(map(tuple, formats.packed_points(packs).collect())) == want and len(want) == 2100
    records = spark.createDataFrame([("a", "7.bin"), ("b", "7.bin"), ("c", None)], "token string, filename string")
    got = [tuple(r) for r in formats.points_in(records, packs, ["token"]).collect()]
    assert sorted(got) == sorted((t, *w[1:]) for t in "ab" for w in want if w[0] == "7")
    with pytest.raises(PySparkException, match="no sweep 300.bin"):
        formats.points_in(records.withColumn("filename", F.lit("300.bin")), packs, ["token"]).count()
    with pytest.raises(PySparkException, match="7.bin ends inside a point"):
        formats.packed_points(packs.withColumn("content", F.expr("substring(content, 1, 19)")).where("filename = '7.bin'")).count()
    with pytest.raises(PySparkException, match="no slash"):
        formats.packed_sweeps(points(spark, 2, 5).withColumn("frame", F.concat(F.lit("a/"), "frame")), "frame", f"file://{tmp_path}/q")
