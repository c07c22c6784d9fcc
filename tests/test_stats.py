"""Verdict statistics: golden numbers of the reference's disabled doctest and hand-made cases."""

import math

from gradeframe.operators import stats as S

# Golden 1: five rollouts, one problem each.
GOLDEN = {
    "0": [-2],
    "1": [0, 0, 0],
    "2": [1, 1],
    "3": [0, 1, 0, 1, 0, 0, 0, 1, 0, 1, 0, 1, 1, 1, 0, 1],
    "4": [-1] * 21,
}


def _verdicts(spark, data, step=0):
    rows = [(q, step, 0, i, v) for q, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "qid string, step long, sample int, test_idx int, verdict int")


def test_golden_report_totals(spark):
    r = S.rollout_stats(_verdicts(spark, GOLDEN))
    t = S.report_totals(r).collect()[0]
    assert t["had_compile_errors"] == 1 and t["had_runtime_errors"] == 1
    assert math.isclose(t["avg_compile_errors"], 0.2)
    assert math.isclose(t["avg_runtime_errors"], 0.2)
    assert math.isclose(t["test_case_average"], 0.3)
    assert math.isclose(t["strict_accuracy"], 0.2)
    assert t["num_rollouts"] == 5


def test_golden_rollout_rows(spark):
    rows = {r["qid"]: r for r in S.rollout_stats(_verdicts(spark, GOLDEN)).collect()}
    assert rows["0"]["had_compile_errors"] == 1 and rows["0"]["avg_compile_errors"] == 1.0
    assert rows["3"]["test_case_average"] == 0.5 and rows["3"]["strict_accuracy"] == 0
    assert rows["2"]["strict_accuracy"] == 1
    assert rows["4"]["avg_runtime_errors"] == 1.0 and rows["4"]["test_cases_run"] == 21


def test_problem_stats_share_of_rollouts_and_null_when_all_fail_to_compile(spark):
    data = [("p", 0, s, i, v) for s, vs in enumerate([[-2], [-2, 1], [1, 1, 0]]) for i, v in enumerate(vs)]
    v = spark.createDataFrame(data, "qid string, step long, sample int, test_idx int, verdict int")
    p = S.problem_stats(S.rollout_stats(v)).collect()[0]
    assert math.isclose(p["avg_compile_errors"], 2 / 3)           # share of rollouts, not of tests
    assert p["test_cases_run"] == 3                                 # last rollout (W4)
    assert math.isclose(p["test_case_average_ignoring_compile_errors"], 2 / 3)
    only_ce = spark.createDataFrame([("q", 0, 0, 0, -2)], "qid string, step long, sample int, test_idx int, verdict int")
    q = S.problem_stats(S.rollout_stats(only_ce)).collect()[0]
    assert q["test_case_average_ignoring_compile_errors"] is None  # NaN in the reference


def test_overall_two_denominators(spark):
    # problem a: 2 rollouts, one passes; problem b: 1 rollout failing
    data = [("a", 0, 0, 0, 1), ("a", 0, 1, 0, 0), ("b", 0, 0, 0, 0)]
    v = spark.createDataFrame(data, "qid string, step long, sample int, test_idx int, verdict int")
    o = S.overall_stats(S.rollout_stats(v)).collect()[0]
    assert math.isclose(o["pass_at_1"], 1 / 3)   # over rollouts
    assert math.isclose(o["pass_at_n"], 1 / 2)   # over problems
    assert math.isclose(o["strict_accuracy_std"], (2 / 9) ** 0.5 / 3 ** 0.5)


def test_macro_null_guard_in_the_chain(spark):
    """Problems a and c are graded at both steps, b only at step 0: step 1 has no averages."""
    data = [(q, st, 0, 0, 1) for q in "abc" for st in (0, 1) if (q, st) != ("b", 1)]
    v = spark.createDataFrame(data, "qid string, step long, sample int, test_idx int, verdict int")
    p = S.with_all_problems(S.problem_stats(S.rollout_stats(v)), v.select("qid"))
    rows = {r["step"]: r for r in S.macro_stats(p).collect()}
    assert set(rows) == {0, 1} and rows[0]["strict_accuracy"] == 1.0 and rows[1]["strict_accuracy"] is None
    assert rows[1]["num_problems"] == 3


def test_deviation_of_large_values(spark):
    r = spark.createDataFrame([("a", 0, 3000000001.0), ("b", 0, 3000000002.0)], "qid string, step long, test_cases_run double")
    for m in S.ROLLOUT_METRICS:
        if m != "test_cases_run":
            r = r.withColumn(m, r["test_cases_run"] * 0)
    got = S.overall_stats(r).collect()[0]["test_cases_run_std"]
    assert math.isclose(got, 0.5 / math.sqrt(2))


def test_quarantine(spark):
    from gradeframe.functions import verdict as VD
    raw = ["true", "False", "-1", "1.0", "-2.0", "2", "7", "0.9", "nan", "", None, "0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string")
    df = df.select("i", VD.normalize_verdict("raw").alias("verdict"))
    assert [r.verdict for r in df.orderBy("i").collect()] == [1, 0, -1, 1, -2, None, None, None, None, None, None, 0]
    ok, bad = VD.quarantine(df)
    assert (ok.count(), bad.count()) == (6, 6)


def test_problem_keys(spark):
    from gradeframe.functions import verdict as VD
    names = ["12", " +007 ", "-0", "-12", "1_000", "a", "ClassEval_1000000", "9" * 60]
    df = spark.createDataFrame([(n,) for n in names], "qid string").select("qid", VD.numeric_problem_key().alias("qid_key"))
    got = {r.qid: r.qid_key for r in df.collect()}
    assert [got[n] for n in names] == ["12", "7", "0", "-12", "1000", "97",
                                       "".join(str(ord(c)) for c in "ClassEval_1000000"), "9" * 60]
    assert [r.qid for r in df.orderBy(*VD.numeric_order()).collect()] == sorted(names, key=lambda n: int(got[n]))


def test_format_rounded(spark):
    from pyspark.sql import functions as F
    vals = [0.0005, 0.43, 1.0, 0.123456, 0.0, 0.00015, 0.33335, 0.00025, 12.34565, -0.00005, float('nan'), *[k / 20000 for k in range(1, 4001, 2)]]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(S.format_rounded("v")).collect()]
    assert got == [str(round(v, 4)) for v in vals]


def test_permuting_samples_changes_only_order_dependent_outputs(spark):
    """Invariant: relabelling samples changes only W4 (tests run of the last sample)
    and the A10 order, never means, errors or pass@k."""
    from pyspark.sql import functions as F
    from gradeframe.operators.passk import instance_results, pass_at_k_report, task_counts
    rows = [("a", 0, 0, 0, 1), ("a", 0, 1, 0, 0), ("a", 0, 1, 1, 1), ("a", 0, 2, 0, -1),
            ("b", 0, 0, 0, 1), ("b", 0, 1, 0, 1), ("b", 0, 1, 1, -2)]
    v = spark.createDataFrame(rows, "qid string, step long, sample int, test_idx int, verdict int")
    w = v.withColumn("sample", (F.col("sample") + 1) % 3)           # a permutation of 0..2
    keep = [c for c in S.MACRO_METRICS if c != "test_cases_run"]
    m1 = S.macro_stats(S.problem_stats(S.rollout_stats(v))).select(*keep).collect()
    m2 = S.macro_stats(S.problem_stats(S.rollout_stats(w))).select(*keep).collect()
    assert m1 == m2
    o1 = S.overall_stats(S.rollout_stats(v)).collect()
    o2 = S.overall_stats(S.rollout_stats(w)).collect()
    assert o1 == o2
    p1 = pass_at_k_report(task_counts(S.rollout_stats(v)), [1, 2]).collect()
    p2 = pass_at_k_report(task_counts(S.rollout_stats(w)), [1, 2]).collect()
    assert sorted(p1) == sorted(p2)
    r1 = {r.qid: r.results for r in instance_results(S.rollout_stats(v)).collect()}
    r2 = {r.qid: r.results for r in instance_results(S.rollout_stats(w)).collect()}
    assert sorted(r1["a"].split(",")) == sorted(r2["a"].split(",")) and r1 != r2
