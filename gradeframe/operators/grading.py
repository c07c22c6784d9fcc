"""Grading-record operators: verdict lists, default verdicts, early stop, error
taxonomy and feedback messages (X24-X27, J2, O9).

The long verdict table is the primary form. Per-rollout facts (first
verdict, first runtime error) are aggregates - partial per map task - and
test details are attached with equi-joins, so no step needs a whole rollout's
tests in one place except where the feature is the ordered list itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.verdict import COMPILE_ERROR, RUNTIME_ERROR
from . import corpus as C

ROLLOUT = ("qid", "step", "sample")


def fill_missing(expected: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ROLLOUT, n_tests: str = "n_tests",
                 code: int = RUNTIME_ERROR) -> DataFrame:
    """X26 on the long table: rollouts of ``expected`` without any verdict row get as
    many rows of ``code`` as their problem has tests (column ``n_tests`` of ``expected``)."""
    missing = expected.join(verdicts.select(*keys).distinct(), list(keys), "left_anti").filter(F.col(n_tests) > 0)
    filler = missing.select(*keys, F.explode(F.sequence(F.lit(0), F.col(n_tests).cast("int") - 1)).alias("test_idx"),
                            F.lit(code).alias("verdict"))
    return verdicts.select(*keys, "test_idx", "verdict").unionByName(filler)


def stop_at_first_runtime_error(verdicts: DataFrame, keys: Sequence[str] = ROLLOUT) -> DataFrame:
    """X27 on the long table: keep tests up to the first runtime error (an aggregate
    and an equi-join; no per-rollout list is built)."""
    first = verdicts.groupBy(*keys).agg(F.min(F.when(F.col("verdict") == RUNTIME_ERROR, F.col("test_idx")))
                                        .alias("_stop"))
    j = verdicts.join(first, list(keys))
    return j.filter(F.col("_stop").isNull() | (F.col("test_idx") <= F.col("_stop"))).drop("_stop")


def rollout_firsts(verdicts: DataFrame, keys: Sequence[str] = ROLLOUT, idx: str = "test_idx",
                   verdict: str = "verdict") -> DataFrame:
    """First verdict and first runtime-error test index of every rollout (aggregates)."""
    v, i = F.col(verdict), F.col(idx)
    return verdicts.groupBy(*keys).agg(
        F.min_by(v, i).alias("first_verdict"),
        F.min(F.when(v == RUNTIME_ERROR, i)).alias("first_runtime_idx"))


def feedback_messages(verdicts: DataFrame, tests: DataFrame, seed=0, keys: Sequence[str] = ROLLOUT,
                      problem: str = "qid") -> DataFrame:
    """J2 + X25 + O9: the test-based feedback sent back to the assistant.

    Compile error -> fixed text; else the first runtime error with its test's
    input and expected output; else a seeded random test of the problem. Which
    test a rollout shows is settled on indexes alone (hash aggregates); the
    texts are then fetched once, by problem and index.
    """
    f = rollout_firsts(verdicts, keys)
    failed = F.col("first_runtime_idx").isNotNull()
    shown = F.when(F.col("first_verdict") == COMPILE_ERROR, F.lit(None).cast("int")).otherwise(F.coalesce("first_runtime_idx", "_random"))
    picked = C.random_index(tests.select(problem, "test_idx"), seed, problem).withColumnRenamed("test_idx", "_random")
    wanted = f.join(picked, problem, "left").withColumn("test_idx", shown)
    j = wanted.join(tests.select(problem, "test_idx", "input", "expected"), [problem, "test_idx"], "left")
    msg = X.failure_message(F.col("first_verdict"), F.col("input"), F.col("expected"), failed, F.col("input"), F.col("expected"))
    return j.select(*keys, msg.alias("message"))


# Error codes and messages of the LiveCodeBench grader, and the widths of its report.
COMPILATION = (-1, "Compilation Error")
NO_CODE = (-1, "Unable to extract code")
TIME_LIMIT = (-3, "Time Limit Exceeded")
RUNTIME = (-4, "Runtime Error")
INPUT_WIDTH, EXPECTED_WIDTH = 300, 200


def error_taxonomy(verdicts: DataFrame, tests: DataFrame, error_text: str, call_based: str, keys: Sequence[str] = ROLLOUT,
                   problem: str = "qid", idx: str = "test_idx") -> DataFrame:
    """X24 + X18: error code and message of a rollout with shortened input and expected output.

    ``error_text`` names the verdict column with the grader's error text,
    ``call_based`` the test column that tells call-based tests. A leading
    compile error is a compilation error, or "Unable to extract code" when the
    named method is missing; the first runtime error is a runtime error, or a
    time limit when its text names a timeout. Rollouts that pass carry no error.
    """
    v, i = F.col("verdict"), F.col(idx)
    f = verdicts.groupBy(*keys).agg(
        F.min(F.struct(i, v, F.col(error_text).alias("e"))).alias("_first"),
        F.min(F.when(v == RUNTIME_ERROR, F.struct(i, F.col(error_text).alias("e")))).alias("_stop"))
    rt = tests.select(problem, F.col(idx).alias("_at"), "input", "expected", F.col(call_based).alias("_call"))
    j = (f.select(*keys, "_first", F.col(f"_stop.{idx}").alias("_at"), F.col("_stop.e").alias("_text"))
         .join(rt, [problem, "_at"], "left"))
    ce = F.col("_first.verdict") == COMPILE_ERROR
    has_rt = F.col("_at").isNotNull() & ~ce
    missing = F.coalesce(F.lower("_first.e").contains("attributeerror"), F.lit(False))
    timeout = F.coalesce(F.lower("_text").contains("timeoutexception"), F.lit(False))

    def pick(n: int) -> Column:
        return (F.when(ce & missing, F.lit(NO_CODE[n])).when(ce, F.lit(COMPILATION[n]))
                .when(has_rt & timeout, F.lit(TIME_LIMIT[n])).when(has_rt, F.lit(RUNTIME[n])))

    shown = F.when(F.col("_call"), X.truncate_lines(F.col("input"), INPUT_WIDTH)) \
        .otherwise(X.truncate_middle(F.col("input"), INPUT_WIDTH))
    return j.select(*keys, pick(0).alias("error_code"), pick(1).alias("error_message"),
                    F.when(has_rt, shown).alias("inputs"),
                    F.when(has_rt, X.truncate_middle(F.col("expected"), EXPECTED_WIDTH)).alias("expected"))
