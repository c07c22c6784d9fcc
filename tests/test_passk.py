"""pass@k estimators: hand cases, closed-form equality, invariants."""

import math

from pyspark.sql import functions as F

from gradeframe.functions.passk import pass_at_k, pass_at_k_comb

CASES = [(4, 1, 1, 0.25), (4, 0, 2, 0.0), (4, 2, 2, 5 / 6), (4, 4, 4, 1.0), (4, 3, 2, 1.0)]


def test_hand_cases(spark):
    df = spark.createDataFrame([c[:3] for c in CASES], "n int, c int, k int")
    got = [r[0] for r in df.select(pass_at_k("n", "c", "k")).collect()]
    for g, (_, _, _, want) in zip(got, CASES):
        assert math.isclose(g, want, abs_tol=1e-12)


def test_estimators_agree_and_are_monotone(spark):
    rows = [(n, c, k) for n in range(1, 11) for c in range(0, n + 1) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n int, c int, k int")
    out = df.select("n", "c", "k", pass_at_k("n", "c", "k").alias("a"),
                    pass_at_k_comb("k", "n", "c").alias("b")).collect()
    by = {}
    for r in out:
        assert math.isclose(r["a"], r["b"], abs_tol=1e-9)
        exact = 1.0 - (math.comb(r["n"] - r["c"], r["k"]) / math.comb(r["n"], r["k"]))
        assert math.isclose(r["a"], exact, abs_tol=1e-9)
        by.setdefault((r["n"], r["c"]), []).append((r["k"], r["a"]))
    for (n, c), ks in by.items():
        vals = [a for _, a in sorted(ks)]
        assert all(x <= y + 1e-12 for x, y in zip(vals, vals[1:]))      # monotone in k
        assert vals[-1] == (1.0 if c > 0 else 0.0)                       # pass@n = any


def test_report_only_for_k_every_task_supports(spark):
    from gradeframe.operators.passk import pass_at_k_report
    counts = spark.createDataFrame([(0, "a", 4, 1), (0, "b", 2, 2)], "step long, qid string, n_samples long, n_correct long")
    rep = {r["k"]: r["pass_at_k"] for r in pass_at_k_report(counts, [1, 2, 4]).collect()}
    assert set(rep) == {1, 2}
    assert math.isclose(rep[1], (0.25 + 1.0) / 2)
