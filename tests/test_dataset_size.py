"""What a dataset's queries leave on disk and move: files and shuffle data of conversions, joins in bounded parts."""

import time

import pytest

from sensorloom import session
from sensorloom.operators import scene as S
from sensorloom.plans import source_queries
from sensorloom.plans.fixtures import Fixtures
from sensorloom.sources import dataset, formats, readers
from test_dataset import opened, records


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """Bytes that lie in shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_a_stored_dataset_leaves_neither_its_files_nor_what_was_moved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "new_path", lambda *_: f"file://{tmp_path}/d")
    monkeypatch.setattr(readers, "FEW", 0)  # joins move both sides
    before = shuffled(spark)
    data = source_queries.stored_dataset(Fixtures(spark, "/root/testdata/sf0.001"))
    assert not list((tmp_path / "d/files").iterdir())
    assert {p.name for p in (tmp_path / "d/tables").iterdir()} == set(readers.SCHEMAS)
    for _ in range(100):  # freed beside what runs next; counts of rows leave some bytes
        if shuffled(spark) < before + 2000:
            break
        time.sleep(0.1)
    assert shuffled(spark) < before + 2000
    assert data.annotation.count() > 0
    assert spark.conf.get(session.FREED) == "false"  # for the conversion only


def test_boxes_move_to_their_sample_only(spark, tmp_path):
    """No exchange on an annotation's instance or category, nor of records of other sensors than those asked for."""
    rows = opened(spark, tmp_path, records()).boxes_2d()
    text = plan(rows)
    assert text.count("hashpartitioning(") > 0
    assert "hashpartitioning(instance_token" not in text and "hashpartitioning(category_token" not in text and "hashpartitioning(name" not in text
    assert "isnull(channel#" in text and {r.token for r in rows.collect()} == {"f1", "f2"}


@pytest.mark.parametrize("few", [0, 100])
def test_large_tables_meet_in_parts_that_tasks_hold(spark, tmp_path, monkeypatch, few):
    whole = opened(spark, tmp_path, records())
    want = sorted(map(str, whole.boxes_2d().collect()))
    monkeypatch.setattr(readers, "FEW", few)
    assert session.parts_for(0) == 0 and session.parts_for(session.ROWS) == 1 and session.parts_for(session.ROWS + 1) == 2
    for module in (readers, dataset):
        monkeypatch.setattr(module, "parts_for", lambda n: 9 * n)
    readers.convert_tables(spark, f"file://{tmp_path}/json", f"file://{tmp_path}/dealt")
    data = dataset.open_tables(spark, f"file://{tmp_path}/dealt")
    assert data.parts == 36
    rows = data.boxes_2d()
    assert sorted(map(str, rows.collect())) == want
    text = plan(rows)
    assert "sample_token" in text and ", 36)" in text
    assert ("ShuffledHashJoin" in text) == (few == 0)  # poses are held, not sorted


def test_a_record_that_points_nowhere_stays_and_repeated_tokens_too(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, key string")
    other = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "_token string, x double")
    for few in (0, 10):
        monkeypatch.setattr(readers, "FEW", few)
        assert sorted(map(tuple, readers.looked_up(rows, "key", other).collect()), key=str) == [(1, "a", 1.0), (2, "b", None), (3, None, None), (4, "a", 1.0)]


def test_remove_folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/b").write_text("x")
    formats.remove_folder(f"file://{tmp_path}/a")
    assert not (tmp_path / "a").exists()


def test_annotations_meet_their_instances_at_the_conversion_or_later(spark, tmp_path):
    whole = opened(spark, tmp_path, records())
    readers.convert_tables(spark, f"file://{tmp_path}/json", f"file://{tmp_path}/plain", resolved=False)
    plain = dataset.open_tables(spark, f"file://{tmp_path}/plain", resolved=False)
    assert "category_token" not in readers.converted(spark, f"file://{tmp_path}/plain", "sample_annotation", False).columns
    for rows in (lambda d: d.boxes_2d(), lambda d: d.boxes(keep_unmapped=True), lambda d: d.windows(3, 2)):
        assert sorted(map(str, rows(plain).collect())) == sorted(map(str, rows(whole).select(*rows(plain).columns).collect()))


def test_windows_sort_rows_as_they_moved_and_deal_a_samples_cameras_together(spark, tmp_path):
    lines = plan(opened(spark, tmp_path, records()).windows(3, 2)).splitlines()
    at = next(i for i, line in enumerate(lines) if "Window [" in line and "collect_list(_row" in line)
    nested = next(i for i, line in enumerate(lines) if i > at and "AS _row#" in line)
    ordered = next(i for i, line in enumerate(lines) if i > at and " Sort [" in line)
    assert nested < ordered  # the plan's top is its end: nested values are made of sorted rows
    moved = next(line for line in lines[ordered:] if "Exchange hashpartitioning(" in line)
    assert "_block#" in moved and "channel#" not in moved
    assert "eqw#" in "".join(lines[ordered : lines.index(moved)])  # poses are composed behind the move


def test_windows_in_parts_equal_those_in_few(spark, tmp_path):
    tables = records()
    tables["sample"] = [{"token": f"t{i}", "scene_token": "s1", "timestamp": 500_000 * i} for i in range(90)]
    tables["sample_data"] = [{**tables["sample_data"][0], "token": f"d{i}{c}", "sample_token": f"t{i}", "calibrated_sensor_token": c, "filename": f"{c}/{i}", "timestamp": 500_000 * i} for i in range(90) for c in ("c1", "c2", "l1")]
    tables["sample_annotation"] = []
    frames = opened(spark, tmp_path, tables).frames()
    rows = lambda parts: sorted(map(str, S.window_bundles(frames, 3, 2, parts=parts).collect()))
    assert rows(9) == rows(0) and len(rows(0)) == 3 * 45  # [0, 3), [2, 5), ..., [86, 89), [87, 90)
