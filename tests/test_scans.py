"""Scans and sinks on small trees written by the tests."""

import json
import os

from pyspark.sql import functions as F

from gradeframe.sources import scans as SC
from gradeframe.sources import sinks as SK


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_reference_layout_verdicts_and_rollouts(spark, tmpdir_path):
    r = tmpdir_path
    _write(f"{r}/raw_output/12/test_case_results.json", json.dumps({"0": [[-2], [True, False]], "1": [[-1, True]]}))
    _write(f"{r}/raw_output/ClassEval_0/test_case_results.json", json.dumps({"0": [[True]]}))
    v = SC.verdict_scan(spark, r).orderBy("qid", "step", "sample", "test_idx").collect()
    assert [(x.qid, x.step, x.sample, x.test_idx, x.verdict) for x in v] == [
        ("12", 0, 0, 0, -2), ("12", 0, 1, 0, 1), ("12", 0, 1, 1, 0), ("12", 1, 0, 0, -1), ("12", 1, 0, 1, 1),
        ("ClassEval_0", 0, 0, 0, 1)]
    doc = {"0": {"final_code": "a"}, "1": {"final_code": "b"}, "final_code": "b", "total_ir_steps": 2,
           "iter_refinement_data": {"0": {"asst_ir_query": "q", "user_ir_answer": "ans"}}}
    _write(f"{r}/raw_output/12/generation_data/sample_1/iter_refinement_data.json", json.dumps(doc, indent=2))
    ro = SC.rollout_scan(spark, r).orderBy("step").collect()
    assert [(x.qid, x.sample, x.step, x.final_code, x.user_answer) for x in ro] == [
        ("12", 1, 0, "a", "ans"), ("12", 1, 1, "b", None)]


def test_problem_scan_skips_template(spark, tmpdir_path):
    r = tmpdir_path
    _write(f"{r}/template.json", "{not json")
    _write(f"{r}/apps/introductory/test/input/vanilla/1.json", json.dumps({"qid": 1, "orig_input": "q", "input": "i"}))
    _write(f"{r}/code_generation_lite/easy/test/input/plain_summary/7.json",
           json.dumps({"qid": "7", "orig_input": "q7", "input": "s7", "starter": ""}))
    _write(f"{r}/class_eval/test/input/vanilla/ClassEval_0.json", json.dumps({"qid": "ClassEval_0", "input": "c"}, indent=1))
    p = SC.problem_scan(spark, r).orderBy("file_qid").collect()
    assert [(x.qid, x.dataset, x.difficulty_dir, x.transformation, x.file_qid) for x in p] == [
        ("1", "apps", "introductory", "vanilla", "1"), ("7", "code_generation_lite", "easy", "plain_summary", "7"),
        ("ClassEval_0", "class_eval", None, "vanilla", "ClassEval_0")]
    _write(f"{r}/class_eval/test/solutions/full_solution/ClassEval_0.json", json.dumps({"qid": "ClassEval_0", "solutions": "class A: pass"}))
    _write(f"{r}/apps/introductory/test/solutions/full_solution/1.json", json.dumps({"qid": "1", "solutions": json.dumps(["a", "b"])}))
    got = SC.solution_scan(spark, r).orderBy("qid").collect()
    assert [(x.dataset, x.difficulty_dir, x.solution_type, x.qid, x.solutions) for x in got] == [
        ("apps", "introductory", "full_solution", "1", ["a", "b"]), ("class_eval", None, "full_solution", "ClassEval_0", ["class A: pass"])]


def test_round_records_of_the_reference_tree(spark, tmpdir_path):
    r = tmpdir_path
    _write(f"{r}/raw_output/12/generation_data/sample_3/iter_0/round_1.json",
           json.dumps({"asst_code": "x = 1", "asst_mg_query": None, "user_mg_answer": "ok", "is_finished": True}, indent=1))
    assert [tuple(x) for x in SC.round_scan(spark, r).collect()] == [("12", 3, 0, 1, "x = 1", None, "ok", True)]


def test_long_rollout_takes_several_records(spark, tmpdir_path):
    rows = [("q", 0, 0, i, (i % 4) - 2) for i in range(2500)]
    v = spark.createDataFrame(rows, "qid string, step long, sample int, test_idx int, verdict int")
    lines = SK.verdict_lines(v, tests_per_line=1000)
    assert lines.count() == 3
    lines.write.json(f"{tmpdir_path}/v")
    back = SC.verdict_lines_scan(spark, f"{tmpdir_path}/v").collect()
    assert sorted((r.qid, r.step, r.sample, r.test_idx, r.verdict) for r in back) == rows


def test_source_tree_reports_and_settings(spark, tmpdir_path):
    r = tmpdir_path
    _write(f"{r}/src/repoA/a.py", "def f():\n    return 1\n")
    _write(f"{r}/src/repoA/readme.md", "no")
    _write(f"{r}/src/repoB/pkg/b.py", "x = 1\n")
    s = SC.source_tree_scan(spark, f"{r}/src").orderBy("path").collect()
    assert [(x.repo, x.content) for x in s] == [("repoA", "def f():\n    return 1\n"), ("pkg", "x = 1\n")]
    _write(f"{r}/res/settingX/pass_at_k_result.json", json.dumps({"pass_k": 1, "fun_success": 0.5}))
    rep = SC.report_scan(spark, f"{r}/res").collect()
    assert rep[0]["setting"] == "settingX" and rep[0]["fun_success"] == 0.5
    _write(f"{r}/test_cases_results/s1/3.json", json.dumps({"0": [[True, -1]]}))
    sv = SC.setting_verdict_scan(spark, r).collect()
    assert sorted((x.setting, x.qid, x.part, x.verdict) for x in sv) == [("s1", "3", 0, -1), ("s1", "3", 0, 1)]


def test_sinks_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 0, 1.5), ("b", 1, 2.5)], "k string, step long, v double")
    SK.write_tsv(df, f"{tmpdir_path}/tsv")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmpdir_path}/tsv")
    assert sorted(tuple(r) for r in back.collect()) == [("a", "0", "1.5"), ("b", "1", "2.5")]
    SK.append(df, f"{tmpdir_path}/app")
    SK.append(df, f"{tmpdir_path}/app")
    assert spark.read.json(f"{tmpdir_path}/app").count() == 4          # U2: duplicates kept
    SK.consolidate(df, f"{tmpdir_path}/cons")
    assert {"step=0", "step=1"} <= set(os.listdir(f"{tmpdir_path}/cons"))


def test_incremental_ingest_is_idempotent(spark, tmpdir_path):
    from gradeframe.streaming.incremental import ingest_verdicts, ingested_statistics
    r, table, ck = f"{tmpdir_path}/in", f"{tmpdir_path}/table", f"{tmpdir_path}/ck"
    _write(f"{r}/raw_output/1/test_case_results.json", json.dumps({"0": [[True, False]]}))
    ingest_verdicts(spark, r, table, ck)
    _write(f"{r}/raw_output/2/test_case_results.json", json.dumps({"0": [[True]]}))
    _write(f"{r}/raw_output/1b/copy/test_case_results.json", json.dumps({"0": [[True, False]]}))
    ingest_verdicts(spark, r, table, ck)
    assert spark.read.parquet(table).count() == 5
    ingest_verdicts(spark, r, table, ck)                                  # nothing new
    assert spark.read.parquet(table).count() == 5
    st = ingested_statistics(spark, table).collect()[0]
    assert st["num_rollouts"] == 3


def test_single_problem_filter_reaches_the_scan(spark):
    from gradeframe.operators.corpus import single_problem
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr(
        "l_partkey AS qid", "l_quantity")
    plan = single_problem(df, 5).select("qid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_partkey), EqualTo(l_partkey,5)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint>" in plan


def test_files_behind_the_last_match_are_not_opened(spark, tmpdir_path):
    root = f"{tmpdir_path}/a b{{1}}"
    for k in range(30):
        spark.range(k * 10, k * 10 + 10, numPartitions=1).withColumn("odd", F.col("id") % 2 == 1).write.parquet(f"{root}/f{k:02}")
    for k in range(20, 30):                                    # the first rounds end before these
        for f in os.listdir(f"{root}/f{k:02}"):
            if f.startswith("part-"):
                with open(f"{root}/f{k:02}/{f}", "wb") as out:
                    out.write(b"no parquet")
    path = f"{tmpdir_path}/a b?1?"
    got = SC.first_of_files(spark, path, F.col("odd"), 23)
    assert [r.id for r in got.collect()] == list(range(1, 46, 2))           # 20 matches in the first 4 files, 3 in the next round
    assert got.columns == ["id", "odd", "_file", "_row"] and [r._row for r in got.limit(5).collect()] == [1, 3, 5, 7, 9]
    assert SC.first_of_files(spark, path, F.col("odd"), 0).count() == 0
    try:
        SC.first_of_files(spark, path, F.col("id") < 0, 1)
        raise AssertionError("all files are opened when nothing matches")
    except Exception as e:
        assert "AssertionError" not in type(e).__name__
    assert [r.id for r in SC.first_of_files(spark, f"{path}/f1*", F.col("id") > 195, 100).collect()] == [196, 197, 198, 199]
    os.makedirs(f"{tmpdir_path}/none")
    assert SC.first_of_files(spark, f"{tmpdir_path}/none", F.col("id") > 5, 3).count() == 0


def _lines(path, rows):
    _write(path, "".join(json.dumps(r) + "\n" for r in rows))


def test_corrections_replace_and_batches_do_not_read_the_table(spark, tmpdir_path):
    from gradeframe.streaming.incremental import current_verdicts, ingest_verdicts
    src, table, ck = f"{tmpdir_path}/in", f"{tmpdir_path}/table", f"{tmpdir_path}/ck"
    one = {"qid": "1", "step": 0, "sample": 0, "first_test": 0, "results": "[true, false, -1]", "version": 1}
    two = one | {"qid": "2", "results": "[true]"}
    go = lambda: ingest_verdicts(spark, src, table, ck, name="*.json", layout="lines")
    now = lambda: sorted(tuple(r) for r in current_verdicts(spark, table).collect())     # noqa: E731
    _lines(f"{src}/a.json", [one, two, one])
    go()
    before = [("1", 0, 0, 0, 1), ("1", 0, 0, 1, 0), ("1", 0, 0, 2, -1), ("2", 0, 0, 0, 1)]
    assert now() == before
    files = {os.path.join(d, f) for d, _, fs in os.walk(table) for f in fs if f.startswith("part-")}
    for f in files:                              # no batch may read what is there
        os.rename(f, f + ".away")
    _lines(f"{src}/b.json", [one, one | {"results": "[false, false]", "version": 3}, one | {"results": "[-2]", "version": 2}])
    go()
    for f in files:
        os.rename(f + ".away", f)
    # the last version counts whole: the test it no longer has is gone
    assert now() == [("1", 0, 0, 0, 0), ("1", 0, 0, 1, 0), ("2", 0, 0, 0, 1)]
    assert spark.read.parquet(table).count() == 4 + 3                                  # the repeated record was dropped by its key
    _lines(f"{src}/c.json", [{k: v for k, v in two.items() if k != "version"} | {"results": "[false]"}])    # the file's time is the version
    go()
    assert now()[-1] == ("2", 0, 0, 0, 0)


def test_a_replayed_batch_replaces_itself(spark, tmpdir_path):
    from gradeframe.streaming.incremental import append_batch, current_verdicts
    batch = spark.createDataFrame([("1", 0, 0, 0, "[true]", 1)], "qid string, step long, sample int, first_test int, results string, version long")
    write = append_batch(f"{tmpdir_path}/t", "r")
    for _ in range(2):
        write(batch, 5)
    assert spark.read.parquet(f"{tmpdir_path}/t").count() == 1
    append_batch(f"{tmpdir_path}/t", "other")(batch, 0)        # a run that lost its checkpoint
    assert [tuple(r) for r in current_verdicts(spark, f"{tmpdir_path}/t").collect()] == [("1", 0, 0, 0, 1)]


def test_a_large_delivery_is_taken_in_bounded_steps(spark, tmpdir_path, monkeypatch):
    """Batches, and tasks behind the table, are bounded by their bytes and rows; the verdicts are the same."""
    from gradeframe.streaming import incremental as I
    rec = lambda q, v, res: {"qid": str(q), "step": q % 2, "sample": 0, "first_test": 0, "results": res, "version": v}
    for k in range(6):
        _lines(f"{tmpdir_path}/in/{k}.json", [rec(q, 1, "[true, false]") for q in range(k * 50, k * 50 + 60)])
    _lines(f"{tmpdir_path}/in/9.json", [rec(q, 2, "[-1]") for q in range(0, 300, 3)])
    got = {}
    for name, size, rows in (("whole", I.BATCH_BYTES, I.TASK_ROWS), ("steps", 1, 20)):
        monkeypatch.setattr(I, "BATCH_BYTES", size)
        monkeypatch.setattr(I, "TASK_ROWS", rows)
        I.ingest_verdicts(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/{name}", f"{tmpdir_path}/ck-{name}", name="*.json", layout="lines")
        now = I.current_verdicts(spark, f"{tmpdir_path}/{name}")
        got[name] = sorted(tuple(r) for r in now.collect())
        batches = {d for _, ds, _ in os.walk(f"{tmpdir_path}/{name}") for d in ds if d.startswith("batch=")}
        assert len(batches) == (1 if name == "whole" else 7)
    assert "RepartitionByExpression [qid" in now._jdf.queryExecution().optimizedPlan().toString()
    assert got["whole"] == got["steps"] and len(got["whole"]) == 310 * 2 - 100


def test_range_partitions_follow_the_input(spark, tmpdir_path):
    """A task sorts rows of at most 32 MB of files."""
    from gradeframe.operators import positions as P
    spark.range(3_000_000).selectExpr("id", "uuid() AS u").coalesce(1).write.option("compression", "none").parquet(f"{tmpdir_path}/t")
    size = sum(os.path.getsize(f"{tmpdir_path}/t/{f}") for f in os.listdir(f"{tmpdir_path}/t"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert P.range_partitions(spark.read.parquet(f"{tmpdir_path}/t")) >= size // (32 << 20) > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
