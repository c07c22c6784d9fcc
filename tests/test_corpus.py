"""Small corpus operators: unions, filters, completeness, prompt choice, scans, splits."""

import json
import os

from pyspark.sql import functions as F

from gradeframe.functions import text as X
from gradeframe.operators import corpus as C
from gradeframe.operators import history as H
from gradeframe.sources import scans as SC
from gradeframe.sources import sinks as SK


def test_union_filters_and_completeness(spark):
    a = spark.createDataFrame([("1", "q")], "qid string, input string")
    b = spark.createDataFrame([("2", "q2", "imports")], "qid string, input string, import_statement string")
    u = C.union_optional([a, b]).orderBy("qid").collect()                        # P3
    assert u[0]["import_statement"] is None and u[1]["import_statement"] == "imports"
    assert C.single_problem(C.union_optional([a, b]), "2").count() == 1           # P4
    r = spark.createDataFrame([("1", 0, 0), ("1", 0, 1), ("1", 1, 0), ("2", 0, 0)], "qid string, step long, sample int")
    ok, bad = C.complete_samples(r, 2)                                             # P17
    assert sorted((x.qid, x.step) for x in ok.select("qid", "step").distinct().collect()) == [("1", 0)]
    assert bad.count() == 2
    steps = spark.createDataFrame([("1", 0, 0)], "qid string, sample int, step long")
    assert C.existing_steps(r, steps).count() == 1                                 # P9 / P16


def test_prompt_choice_and_stop_flags(spark):
    df = spark.createDataFrame([(0, "comment", "always_stop"), (2, "clarifying_question", "ask_asst"),
                                (1, "nl_feedback", "never")], "step long, ft string, sc string")
    rows = df.select(X.prompt_type("step").alias("p"), X.needs_user_query("ft").alias("q"),
                     H.should_stop("sc").alias("s")).collect()
    assert [(r.p, r.q, r.s) for r in rows] == [("asst_initial_code", False, True), ("asst_code", True, True),
                                               ("asst_code", False, False)]


def test_jsonl_first_matches_and_split_save(spark, tmpdir_path):
    path = f"{tmpdir_path}/data.jsonl"
    with open(path, "w") as f:
        for i in range(10):
            f.write(json.dumps({"qid": str(i), "lang": "Python" if i % 2 else "C"}) + "\n")
    df = SC.jsonl_scan(spark, path, "qid string, lang string")                    # S2
    assert [r.qid for r in SC.first_matches(df, F.col("lang") == "Python", 3, ["qid"]).collect()] == ["1", "3", "5"]         # S8 + O4
    SK.save_split(df, f"{tmpdir_path}/saved", "train")                            # S20
    back = SC.table_scan(spark, f"{tmpdir_path}/saved")                           # S9
    assert back.filter(F.col("split") == "train").count() == 10
    SK.split_by_key(df, f"{tmpdir_path}/bykey", ["lang"])                          # S17
    assert {"lang=C", "lang=Python"} <= set(os.listdir(f"{tmpdir_path}/bykey"))


def test_stuck_runs_skip_first_turn(spark):
    rows = [("q", 0, 0, 1, i, "assistant", t) for i, t in enumerate([" ", "a", "", "  "] + [""] * 9)]
    df = spark.createDataFrame(rows, "qid string, sample int, step long, conv_id long, turn long, role string, text string")
    r = H.stuck_runs(df).collect()[0]
    assert (r.n_turns, r.n_stuck, r.given_up, r.final_code) == (13, 11, 1, "")
    r9 = H.stuck_runs(df.filter("turn < 11")).collect()[0]          # 9 counted blanks: not yet given up
    assert (r9.n_stuck, r9.given_up) == (9, 0)
    pieces = [("q", 0, 0, 1, i, "assistant", t) for i, t in enumerate(["x = 1\n", "y = 2\n", "", "z = 3"])]
    code = H.stuck_runs(spark.createDataFrame(pieces, df.schema)).collect()[0]
    assert (code.n_stuck, code.final_code) == (1, "x = 1\ny = 2\nz = 3")           # what the loop has accumulated


def test_chat_messages_forms(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    full = [(r.msg_idx, r.role, r.content) for r in
            H.chat_messages(t, True, prefill="```python").orderBy("msg_idx").collect()]
    assert full == [(0, "system", "S"), (2, "user", "u1"), (3, "assistant", "a1"), (4, "user", "u2"),
                    (5, "assistant", "```python")]
    q = [(r.role, r.content) for r in
         H.chat_messages(t, True, prefill="P", prefill_in_query=True).orderBy("msg_idx").collect()]
    assert q[-1] == ("user", "u2\n\nP") and len(q) == 4
    gemma = [(r.request, r.content) for r in H.chat_messages(t, False, merge_system=True).orderBy("request").collect()]
    assert gemma == [(1, "S\n\nu1"), (3, "S\n\nu2")]


def test_chat_messages_merge_all(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r.role, r.content) for r in H.chat_messages(t, True, merge_system="all").orderBy("msg_idx").collect()]
    assert got == [("user", "S\n\nu1"), ("assistant", "a1"), ("user", "S\n\nu2")]


def test_running_text_in_chunks(spark):
    from gradeframe.operators import history as H
    rows = [(1, 0, "system", "sys"), (1, 1, "assistant", "def f():\n" * 5), (1, 2, "user", "é日😀"), (1, 3, "assistant", ""), (1, 4, "assistant", None),
            (1, 5, "assistant", "x" * 100), (2, 0, "user", None), (3, 7, "assistant", "abc"), (None, 0, "assistant", "lost")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (2, 0), (3, 7), (3, 8)], "conv_id long, turn long")
    texts = {(1, 1): rows[1][3], (1, 2): rows[1][3] + "\n" + "é日😀", (1, 5): rows[1][3] + "\n" + "é日😀" + "x" * 100, (3, 7): "abc"}
    for size in (1, 7, 10, 4096):
        got = {}
        for r in H.running_text(t, chosen, size=size).orderBy("conv_id", "turn", "chunk").collect():
            got.setdefault((r.conv_id, r.turn), []).append(r.chars)
        assert {k: "".join(v) for k, v in got.items()} == texts
        assert all(len(c) == size for v in got.values() for c in v[:-1])
    lists = H.final_code_chunks(t.withColumn("qid", F.col("conv_id")).withColumn("sample", F.lit(0)).withColumn("step", F.lit(0)), size=50)
    assert sorted((r.qid, r.chunk, len(r.chars)) for r in lists.collect() if r.qid) == [(1, 0, 50), (1, 1, 50), (1, 2, 45), (3, 0, 3)]


def test_step_tables_scan_the_verdicts_once(spark, tmpdir_path):
    from gradeframe.operators import stats as S
    from gradeframe.sources import sinks as SK
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(v):
        seen.add(1)
        return v

    v = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 0, 0), ("b", 0, 1, 1), ("b", 1, 0, -2)], "qid string, step long, sample int, verdict int")
    r = S.rollout_stats(v.select("qid", "step", "sample", counted.asNondeterministic()("verdict").alias("verdict")))
    SK.write_step_tables(r, None, f"{tmpdir_path}/t")
    assert seen.value == 4
    tables = {n: spark.read.parquet(f"{tmpdir_path}/t/{n}") for n in SK.STEP_TABLES}
    assert [tables[n].count() for n in SK.STEP_TABLES] == [3, 4, 2, 2]


def test_stuck_runs_query_gives_the_code(spark, tmpdir_path):
    """The registered query returns the accumulated code, also of long steps."""
    from gradeframe.plans.catalogue import oracle_sql, queries
    texts = {14: "a = 1\n\nb = 2", 12: "x", 15: "y\n\n\n\n\nz" * 700}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    got = {r.qid: (r.n_turns, r.given_up, r.final_code) for r in queries()["stuck_runs"](spark, tmpdir_path).collect()}
    assert got == {"14": (4, 0, "a = 1\n\nb = 2\n \n"), "12": (14, 1, ""), "15": (3504, 1, "")}
    assert "final_code" in oracle_sql()["stuck_runs"]


def test_stuck_runs_over_many_turns(spark):
    """Stretches of turns are joined in order; null keys and turns that come twice count as they are."""
    rows = [(None, 0, 0, i, "assistant", f"{i};") for i in range(3500)] + [("q", 0, 0, 7, "assistant", t) for t in ("b", "a", None)]
    r = {x.qid: x for x in H.stuck_runs(spark.createDataFrame(rows, "qid string, sample int, step long, turn long, role string, text string")).collect()}
    assert r[None].final_code == "".join(f"{i};" for i in range(3500)) and (r[None].n_turns, r[None].n_stuck) == (3500, 0)
    assert (r["q"].n_turns, r["q"].final_code) == (3, "ab")
