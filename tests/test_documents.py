"""One file per key: writer, its failures, and path keys."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gradeframe.sources import documents as D
from gradeframe.sources import scans as SC
from gradeframe.sources import sinks as SK


def _files(root):
    return {os.path.relpath(f"{d}/{f}", root): open(f"{d}/{f}", encoding="utf-8").read()
            for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")}


PIECES = [("a b/1.json", 2, "zwei"), ("a b/1.json", 0, "null,"), ("a b/1.json", 1, "eins,"), ("%41+ü.txt", 0, "é"), ("e", 5, None), ("f/g/h", 0, "")]


def test_pieces_become_files(spark, tmpdir_path):
    root = f"{tmpdir_path}/my root +%41 ü"
    df = spark.createDataFrame(PIECES, D.PIECES)
    D.write_documents(df, root)
    want = {"a b/1.json": "null,eins,zwei", "%41+ü.txt": "é", "e": "", "f/g/h": ""}
    assert _files(root) == want
    D.write_documents(spark.createDataFrame([("e", 0, "new"), ("x", 0, "more")], D.PIECES), f"file:{root}")
    assert _files(root) == want | {"e": "new", "x": "more"}
    D.write_documents(df.limit(0), root)
    assert len(_files(root)) == 5


@pytest.mark.parametrize("bad", ["", None, "a//b", "../x", "_hidden/x", "a/.x", "/a"])
def test_bad_paths_write_nothing(spark, tmpdir_path, bad):
    df = spark.createDataFrame([*PIECES, (bad, 0, "x")], D.PIECES)
    with pytest.raises(Exception, match="is no path of a document"):
        D.write_documents(df, f"{tmpdir_path}/r")
    assert not os.path.exists(f"{tmpdir_path}/r") or _files(f"{tmpdir_path}/r") == {}


def test_a_failed_task_leaves_nothing(spark, tmpdir_path):
    @F.udf("string")
    def broken(k):
        if k == 777:
            raise ValueError("lost")
        return "x" * 1000

    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("path"), F.lit(0).alias("part"), broken("id").alias("piece"))
    with pytest.raises(Exception, match="lost"):
        D.write_documents(df, f"{tmpdir_path}/r")
    assert not os.path.exists(f"{tmpdir_path}/r") or _files(f"{tmpdir_path}/r") == {}


def test_publishing_can_be_repeated(spark, tmpdir_path, monkeypatch):
    """A run that breaks between the two jobs is finished by publishing its job folder."""
    jobs = []
    monkeypatch.setattr(D, "publish", lambda spark, root, job: jobs.append(job))
    D.write_documents(spark.createDataFrame(PIECES, D.PIECES), f"{tmpdir_path}/r")
    monkeypatch.undo()
    assert SC.jsonl_scan(spark, f"{tmpdir_path}/r", "x string").count() == 0      # no scan looks into a job folder
    lines = [json.loads(x) for f in os.listdir(jobs[0]) if f.startswith("manifest") for x in open(f"{jobs[0]}/{f}")]
    one = next(x for x in lines if x["path"] == "e")
    os.makedirs(f"{tmpdir_path}/r", exist_ok=True)
    os.rename(f"{jobs[0]}/{one['staged']}", f"{tmpdir_path}/r/e")                  # moved before the run broke
    D.publish(spark, f"{tmpdir_path}/r", jobs[0])
    assert set(_files(f"{tmpdir_path}/r")) == {"a b/1.json", "%41+ü.txt", "e", "f/g/h"}


def test_verdict_documents(spark, tmpdir_path):
    rows = [("p", 0, 0, i, (i % 4) - 2) for i in range(25)] + [("p", 0, 3, 0, 1), ("p", 7, 1, 0, 0), ("q/2", 1, 0, 0, -1)]
    v = spark.createDataFrame(rows, "qid string, step long, sample int, test_idx int, verdict int")
    D.write_documents(SK.verdict_documents(v, F.concat(F.col("qid"), F.lit("/r.json")), tests_per_line=10), tmpdir_path)
    said = {1: True, 0: False}
    assert {k: json.loads(x) for k, x in _files(tmpdir_path).items()} == {
        "p/r.json": {"0": [[said.get((i % 4) - 2, (i % 4) - 2) for i in range(25)], [], [], [True]], "7": [[], [False]]},
        "q/2/r.json": {"1": [[-1]]}}


def test_keys_of_odd_paths(spark, tmpdir_path):
    root = f"{tmpdir_path}/my tree"
    texts = {"raw_output/q 1/r.json": '{"0": [[true]]}', "raw_output/a%20b/r.json": '{"0": [[false]]}', "raw_output/x+y=z/r.json": '{"0": [[-1]]}',
             "raw_output/qid=u%3Av/r.json": '{"0": [[-2]]}'}
    D.write_documents(spark.createDataFrame([(k, 0, t) for k, t in texts.items()], D.PIECES), root)
    got = {r.qid: r.verdict for r in SC.verdict_scan(spark, root, name="r.json").collect()}
    assert got == {"q 1": 1, "a%20b": 0, "x+y=z": -1, "u:v": -2}
    D.write_documents(spark.createDataFrame([("set 1/pass.json", 0, '{"pass_k": 1}'), ("a%20b/pass.json", 0, '{"pass_k": 2}')], D.PIECES), f"{root}/rep")
    assert {r.setting: r.pass_k for r in SC.report_scan(spark, f"{root}/rep", name="pass.json").collect()} == {"set 1": 1, "a%20b": 2}
    df = spark.createDataFrame([("a b%:=/ü", "x", "1")], "dataset string, transformation string, qid string")
    SK.write_partitioned(df, f"{root}/parts", ["dataset", "transformation"], fmt="json")
    p = SC.problem_scan(spark, f"{root}/parts", layout="partitioned").select("dataset", "difficulty_dir", "transformation", "qid").collect()
    assert [tuple(r) for r in p] == [("a b%:=/ü", None, "x", "1")]


def test_source_files_are_packed_by_size(spark, tmpdir_path):
    """A folder with most of the bytes and one huge file: tasks hold at most twice the median or one file."""
    rows = [(f"hot/{i}.py", 0, "x = 1\n" * 200) for i in range(300)] + [(f"cold{i}/a.py", 0, "y = 2\n" * 20) for i in range(100)] + [("big/b.py", 0, "z = 3\n" * 60_000)]
    D.write_documents(spark.createDataFrame(rows, D.PIECES), tmpdir_path)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        src = SC.source_tree_scan(spark, tmpdir_path).select(F.spark_partition_id().alias("p"), "repo", F.length("content").alias("n"))
        per = src.groupBy("p").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files")).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r.files for r in per) == 401
    sizes = sorted(r.n for r in per)
    assert all(r.files == 1 or r.n <= 2 * sizes[len(sizes) // 2] for r in per)


def test_a_hot_key_is_split(spark, tmpdir_path):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        SK.split_by_key(df, f"{tmpdir_path}/s", ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert spark.read.json(f"{tmpdir_path}/s").count() == 50_000
    assert sum(f.startswith("part-") for f in os.listdir(f"{tmpdir_path}/s/k=hot")) > 1
