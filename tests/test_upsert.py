"""The store of micro-batches: replays, crashes, late copies."""

import datetime as dt

import pytest

from bookrisk.streaming import stream as SS
from bookrisk.streaming import upsert as UP

ROW = "booking_id string, model_version string, scored_at timestamp_ntz, p double"


def batch(spark, *rows):
    return spark.createDataFrame([(b, v, None if d is None else dt.datetime(2024, 1, d, 9), p) for b, v, d, p in rows], ROW)


def rows_of(spark, path):
    return sorted(((r[0], r[1], r[2] and r[2].day, r[3]) for r in UP.read(spark, path, ROW).collect()), key=str)


@pytest.mark.parametrize("grain", ["yyyy-MM", "yyyy-MM-dd"])
def test_replays_leave_one_row(spark, tmp_path, grain):
    path = str(tmp_path / "s")
    assert rows_of(spark, path) == []
    first = batch(spark, ("a", "v1", 1, 0.1), ("b", "v1", 1, 0.2), ("b", "v1", 1, 0.2), ("n", "v1", None, 0.9))
    assert UP.upsert(first, 0, path, grain=grain)
    assert not UP.upsert(first, 0, path)  # a committed batch again
    assert UP.upsert(batch(spark, ("c", "v1", 28, 0.3), ("a", "v2", 1, 0.5)), 1, path, grain=grain)
    assert UP.upsert(batch(spark, ("b", "v1", 1, 0.2), ("a", "v1", 1, 0.7), ("n", "v1", None, 0.9)), 2, path, grain=grain)  # long after: a copy and a correction
    assert UP.upsert(batch(spark), 3, path) and not UP.upsert(batch(spark, ("z", "v1", 1, 1.0)), 3, path)
    assert rows_of(spark, path) == sorted([("a", "v1", 1, 0.7), ("a", "v2", 1, 0.5), ("b", "v1", 1, 0.2), ("c", "v1", 28, 0.3), ("n", "v1", None, 0.9)], key=str)


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    UP.upsert(batch(spark, ("a", "v1", 1, 0.1)), 0, path)
    second = batch(spark, ("b", "v1", 1, 0.2), ("a", "v1", 1, 0.4), ("c", "v1", 2, 0.3))

    def stop(*_):
        raise OSError("stopped")
    with monkeypatch.context() as m:
        m.setattr(UP, "_commit", stop)
        with pytest.raises(OSError, match="stopped"):
            UP.upsert(second, 1, path)
    assert rows_of(spark, path) == [("a", "v1", 1, 0.1)]  # what was written is not in force
    assert UP.upsert(second, 1, path)
    assert rows_of(spark, path) == [("a", "v1", 1, 0.4), ("b", "v1", 1, 0.2), ("c", "v1", 2, 0.3)]


def test_stream_resumes_after_a_crash(spark, tmp_path, monkeypatch):
    feed, path, check = (str(tmp_path / x) for x in ("feed", "store", "check"))
    batch(spark, ("a", "v1", 1, 0.1), ("b", "v1", 2, 0.2)).write.parquet(feed)

    def run():
        UP.run_available_now(SS.read_files(spark, feed, batch(spark).schema), path, check)
    real = UP._commit
    with monkeypatch.context() as m:
        m.setattr(UP, "_commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(Exception, match="stopped"):
            run()
    assert UP._commit is real and rows_of(spark, path) == []
    run()
    batch(spark, ("a", "v1", 1, 0.1), ("c", "v1", 3, 0.3)).write.mode("append").parquet(feed)
    run()
    assert rows_of(spark, path) == [("a", "v1", 1, 0.1), ("b", "v1", 2, 0.2), ("c", "v1", 3, 0.3)]
