"""Events are loaded once across batches, failures and restarts."""

import datetime as dt

import pytest
from placelens.streaming import events, intake

_SCHEMA = "uuid string, ts timestamp, kind string"
_NOW = dt.datetime(2026, 3, 1)


def _at(day, hour=0):
    return dt.datetime(2026, 2, 1) + dt.timedelta(days=day, hours=hour)


def _files(spark, path, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{path}/in/{k}")


def _pull(spark, path, **more):
    stream = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in/*")
    intake.pull(stream, f"{path}/table", "uuid", "ts", _NOW, **more).awaitTermination()


def _ids(spark, path, kind="events"):
    return sorted(r.uuid for r in intake.stored(spark, f"{path}/table", _SCHEMA, kind).collect())


def test_stops_and_goes_on(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    _files(spark, path, [("a", _at(1), "x"), ("b", _at(2), "x"), ("b", _at(2), "x"), (None, _at(2), "x"), ("z", None, "x"), ("old", dt.datetime(2025, 1, 1), "x")])
    _files_2 = [[("c", _at(3), "y"), ("b", _at(2), "x"), ("a", _at(4), "again")], [("d", _at(5), "y"), ("c", _at(5), "y"), ("late", _at(0, 5), "y")]]
    _pull(spark, path)
    assert _ids(spark, path) == ["a", "b"] and _ids(spark, path, "late") == ["old"]
    for k, rows in enumerate(_files_2, 1):
        spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{path}/in/{k}")

    real, calls = intake.load_batch, []

    def broken(batch, number, *a, **b):
        real(batch, number, *a, **b)
        calls.append(number)
        raise RuntimeError("lost between the batch and its commit")

    monkeypatch.setattr(intake, "load_batch", broken)
    with pytest.raises(Exception, match="lost between"):
        _pull(spark, path)
    monkeypatch.setattr(intake, "load_batch", real)
    _pull(spark, path)
    assert calls == [1]
    assert _ids(spark, path) == ["a", "b", "c", "d"]
    rows = {r.batch: r for r in intake.log(spark, f"{path}/table").collect()}
    assert [(r.loaded, r.late, r.repeated) for _, r in sorted(rows.items())] == [(2, 1, 1), (1, 1, 1), (1, 1, 1)]
    assert rows[2].cursor == _at(5) and _ids(spark, path, "late") == ["b", "late", "old"]


def test_repeated_within_the_day_and_nothing_new(spark, tmp_path):
    path = f"file://{tmp_path}"
    _files(spark, path, [("a", _at(1, 1), "x")], [("a", _at(1, 2), "x"), ("b", _at(1, 3), "x")])
    _pull(spark, path)
    _pull(spark, path)
    assert _ids(spark, path) == ["a", "b"]
    assert sum(r.repeated for r in intake.log(spark, f"{path}/table").collect()) == 1


def test_sessions_and_windows(spark):
    rows = [(1, _at(0), "k", 1.0), (1, _at(0) + dt.timedelta(minutes=29), "k", 2.0), (1, _at(0) + dt.timedelta(minutes=60), "k", 4.0), (2, _at(0), "m", None)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_type string, value double")
    got = sorted((r.user_id, r.n_events, r.value) for r in events.session_counts(df).collect())
    assert got == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, None)]
    assert sorted((r.event_type, r.n) for r in events.windowed_counts(df).collect()) == [("k", 1), ("k", 2), ("m", 1)]


def test_read_events_goes_on_from_its_checkpoint(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.createDataFrame([("a", _at(1), "x")], _SCHEMA)
    for k in range(2):
        df.write.mode("append").parquet(f"{path}/in")
        events.load_available(events.read_events(spark, f"{path}/in", df.schema), f"{path}/out", f"{path}/state").awaitTermination()
        assert spark.read.parquet(f"{path}/out").count() == k + 1
