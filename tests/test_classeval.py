"""ClassEval outcomes and verdict collapse."""

from gradeframe.operators import classeval as C

OUTCOME_CASES = [((0, 0, 0), "error"), ((3, 0, 3), "error"), ((0, 0, 3), "success"),
                 ((1, 1, 3), "partial_success"), ((0, 3, 3), "fail")]


def test_outcomes(spark):
    df = spark.createDataFrame([c for c, _ in OUTCOME_CASES], "errors int, failures int, tests_run int")
    got = [r[0] for r in df.select(C.test_outcome()).collect()]
    assert got == [o for _, o in OUTCOME_CASES]


def test_class_verdicts(spark):
    df = spark.createDataFrame([("t", 0, "A", 1, 1, 4), ("t", 1, "A", 0, 0, 0)],
                               "task string, sample int, test_class string, errors int, failures int, tests_run int")
    got = sorted((r["sample"], r["run"], r["verdict"], r["n"]) for r in C.class_verdicts(df).collect())
    assert got == [(0, 0, 1, 2), (0, 1, 0, 1), (0, 2, -1, 1), (1, 0, -2, 1)]      # runs of equal verdicts


def test_class_level_rollup(spark):
    rows = [("t", 0, "A", 0, 0, 2), ("t", 0, "B", 0, 0, 2),     # all success
            ("t", 1, "A", 0, 0, 2), ("t", 1, "B", 0, 1, 2),     # partial
            ("t", 2, "A", 0, 2, 2)]                             # fail
    df = spark.createDataFrame(rows, "task string, sample int, test_class string, errors int, failures int, tests_run int")
    r = C.class_rollup(df).collect()[0]
    assert (r["class_success"], r["class_partial_success"], r["class_fail"]) == (1, 1, 1)
