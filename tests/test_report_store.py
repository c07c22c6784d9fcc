"""Upserts of a stored report."""

import os

import pytest

from gradeframe.sources import report_store as RS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_updates_touch_only_their_buckets(spark, tmpdir_path):
    root = f"{tmpdir_path}/report"
    with pytest.raises(ValueError, match="no report"):
        RS.read_report(spark, root)
    first = RS.upsert(spark.createDataFrame([(str(k), k, 1.0 * k) for k in range(100)], "q string, step long, a double"), root, ["q", "step"])
    early = RS.read_report(spark, root)
    second = RS.upsert(spark.createDataFrame([("7", 7, None, 5), ("new", 1, 2.5, 6), (None, None, 0.5, 7)], "q string, step long, a double, b int"), root, ["q", "step"])
    want = {(str(k), k): (1.0 * k, None) for k in range(100)} | {("7", 7): (7.0, 5), ("new", 1): (2.5, 6), (None, None): (0.5, 7)}
    assert rows(RS.read_report(spark, root)) == sorted(((*k, *v) for k, v in want.items()), key=str)
    assert early.count() == 100                                       # who began to read before reads the old report whole
    moved = {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)}
    assert 1 <= len(moved) <= 3 and len(first["folders"]) == RS.BUCKETS
    assert RS.upsert(spark.createDataFrame([], "q string, step long, a double"), root, ["q", "step"])["folders"] == second["folders"]
    with pytest.raises(ValueError, match="keyed by"):
        RS.upsert(spark.createDataFrame([("x",)], "q string"), root, ["q"])


def test_a_broken_update_changes_nothing(spark, tmpdir_path, monkeypatch):
    root = f"{tmpdir_path}/report"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    first = RS.upsert(df, root, ["k"])
    monkeypatch.setattr(RS, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        RS.upsert(spark.createDataFrame([("a", 9)], "k string, v int"), root, ["k"])
    monkeypatch.undo()
    assert rows(RS.read_report(spark, root)) == [("a", 1), ("b", 2)]
    assert RS.vacuum(spark, root) == 1 and rows(RS.read_report(spark, root)) == [("a", 1), ("b", 2)]
    # an update that began before another was committed is refused
    with pytest.raises(RuntimeError, match="meanwhile"):
        RS._commit(spark, root, None, "x")
    RS.upsert(spark.createDataFrame([("a", 9), ("a", 3)], "k string, v int"), root, ["k"])
    assert rows(RS.read_report(spark, root)) == [("a", 9), ("b", 2)]
    assert rows(RS.read_report(spark, root, first)) == [("a", 1), ("b", 2)]
    assert RS.vacuum(spark, root, keep=[first]) == 0 and RS.vacuum(spark, root) >= 1
    assert sorted(os.listdir(root))[-3:] == ["current", "data", "snapshots"]
