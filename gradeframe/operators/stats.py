"""Verdict statistics: rollout -> problem -> overall, as chained aggregates.

Every function is ``DataFrame -> DataFrame`` over the long verdict table
``(..., qid, sample, verdict)``. ``by`` holds the outer grouping keys (the
refinement ``step``, or ``setting`` and ``part``), so one job computes the
statistics of all steps / settings at once (A26, A27).

Scale notes: all aggregates are hash aggregates with a map-side partial step,
so a problem holding a third of all verdict rows is reduced inside each map
task before the shuffle. Only small per-group results are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import py_round
from ..functions.verdict import is_compile_error, is_pass, is_runtime_error, quarantine

# The rollout metric names of the reference statistics, in order.
ROLLOUT_METRICS = (
    "had_compile_errors",
    "avg_compile_errors",
    "had_runtime_errors",
    "avg_runtime_errors",
    "test_cases_run",
    "test_case_average",
    "strict_accuracy",
)
# Metrics shown in the text report (mean +/- standard error).
REPORT_METRICS = ("avg_runtime_errors", "test_case_average", "strict_accuracy")


def std_error(x) -> Column:
    """Population standard deviation over sqrt(n) (NULL on no rows)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.stddev_pop(c) / F.sqrt(F.count(c))


def _keys(by: Sequence[str]) -> list[str]:
    return list(by) if not isinstance(by, str) else [by]


# ------------------------------------------------------------------ A1
def rollout_stats(verdicts: DataFrame, by: Sequence[str] = ("step",),
                  problem: str = "qid", sample: str = "sample",
                  verdict: str = "verdict") -> DataFrame:
    """A1: one row per rollout (by..., qid, sample).

    had_* are 0/1 flags, avg_* shares of tests, strict_accuracy = all tests pass.
    Rows without one of the four codes are quarantined first and count nowhere.
    """
    keys = [*_keys(by), problem, sample]
    agg = quarantine(verdicts, verdict)[0].groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_cases_run"),
        F.count_if(is_compile_error(verdict)).alias("_ce"),
        F.count_if(is_runtime_error(verdict)).alias("_re"),
        F.count_if(is_pass(verdict)).alias("_ok"),
    )
    n = F.col("test_cases_run")
    return agg.select(
        *keys,
        (F.col("_ce") > 0).cast("int").alias("had_compile_errors"),
        F.try_divide(F.col("_ce"), n).alias("avg_compile_errors"),
        (F.col("_re") > 0).cast("int").alias("had_runtime_errors"),
        F.try_divide(F.col("_re"), n).alias("avg_runtime_errors"),
        n.alias("test_cases_run"),
        F.try_divide(F.col("_ok"), n).alias("test_case_average"),
        (F.col("_ok") == n).cast("int").alias("strict_accuracy"),
    )


# ------------------------------------------------------------------ A2 A3 W4
def problem_stats(rollouts: DataFrame, by: Sequence[str] = ("step",),
                  problem: str = "qid", sample: str = "sample") -> DataFrame:
    """A2 + A3 + W4: statistics of each problem over its rollouts.

    avg_compile_errors is here the share of *rollouts* with a compile error;
    test_cases_run is the value of the last rollout (highest sample).
    """
    ok_ce = F.col("had_compile_errors") == 0
    tca_nce = F.when(ok_ce, F.col("test_case_average"))
    return rollouts.groupBy(*_keys(by), problem).agg(
        F.count(F.lit(1)).alias("n_rollouts"),
        F.max("had_compile_errors").alias("had_compile_errors"),
        F.avg("had_compile_errors").alias("avg_compile_errors"),
        F.max("had_runtime_errors").alias("had_runtime_errors"),
        F.avg("avg_runtime_errors").alias("avg_runtime_errors"),
        std_error("avg_runtime_errors").alias("avg_runtime_errors_std"),
        F.max_by("test_cases_run", sample).alias("test_cases_run"),
        F.avg("test_case_average").alias("test_case_average"),
        std_error("test_case_average").alias("test_case_average_std"),
        F.avg(tca_nce).alias("test_case_average_ignoring_compile_errors"),
        std_error(tca_nce).alias("test_case_average_ignoring_compile_errors_std"),
        F.avg("strict_accuracy").alias("strict_accuracy"),
        std_error("strict_accuracy").alias("strict_accuracy_std"),
        F.max("test_case_average").alias("best_tca"),
    )


def with_all_problems(pstats: DataFrame, problems: DataFrame, by: Sequence[str] = ("step",),
                      problem: str = "qid") -> DataFrame:
    """A2 tail: in every group, problems without any rollout get one all-NULL row.

    The groups are those present in ``pstats`` (steps or settings: a handful),
    taken as one array value, so each problem is only joined on (group, problem).
    """
    keys = _keys(by)
    groups = pstats.select(F.array_sort(F.collect_set(F.struct(*keys)))).scalar()
    grid = problems.select(problem).distinct().select(problem, F.explode(groups).alias("_g")).select(*[f"_g.{k}" for k in keys], problem)
    return grid.join(pstats, [*keys, problem], "left")


# ------------------------------------------------------------------ A6 P18
# The metric names of the macro averages, in order.
MACRO_METRICS = (
    "had_compile_errors", "avg_compile_errors", "had_runtime_errors", "avg_runtime_errors",
    "avg_runtime_errors_std", "test_cases_run", "test_case_average", "test_case_average_std",
    "test_case_average_ignoring_compile_errors", "test_case_average_ignoring_compile_errors_std",
    "strict_accuracy", "strict_accuracy_std",
)


def macro_stats(pstats: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """A6 + P18: macro averages over problems; NULL-skipping ``avg`` plays ``nanmean``.

    If any problem of a group has no results (n_rollouts NULL, as
    :func:`with_all_problems` leaves it) the group's whole row is NULL.
    """
    any_missing = F.max(F.col("n_rollouts").isNull().cast("int")) == 1
    aggs = [F.when(any_missing, F.lit(None)).otherwise(F.avg(m)).cast("double").alias(m)
            for m in MACRO_METRICS]
    return pstats.groupBy(*_keys(by)).agg(*aggs, F.count(F.lit(1)).alias("num_problems"))


# ------------------------------------------------------------------ A4 A5
def overall_stats(rollouts: DataFrame, by: Sequence[str] = ("step",),
                  problem: str = "qid") -> DataFrame:
    """A4 + A5: every metric averaged over rollouts with std/sqrt(n);
    pass@1 = strict accuracy over rollouts; pass@n = any rollout of a problem
    fully passes, averaged over problems (its own denominator).

    Deviations come from Spark's merging (count, mean, M2) aggregate, which does
    not cancel for large values. Both aggregates read the same rollout table,
    whose exchange Spark plans once; only their few result rows are joined.
    """
    keys = _keys(by)
    out = []
    for m in ROLLOUT_METRICS:
        x = F.col(m).cast("double")
        out += [F.avg(x).alias(m), std_error(x).alias(f"{m}_std")]
    strict = F.col("strict_accuracy").cast("double")
    out += [F.avg(strict).alias("pass_at_1"), std_error(strict).alias("pass_at_1_std"), F.count(F.lit(1)).alias("num_rollouts")]
    over_rollouts = rollouts.groupBy(*keys).agg(*out)
    over_problems = (rollouts.groupBy(*keys, problem).agg(F.max("strict_accuracy").alias("_any")).groupBy(*keys)
                     .agg(F.avg("_any").alias("pass_at_n"), std_error("_any").alias("pass_at_n_std"),
                          F.count(F.lit(1)).alias("num_problems")))
    return over_rollouts.join(over_problems, keys)


# ------------------------------------------------------------------ A7
def report_totals(rollouts: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Printed totals: *sums* of had-error flags, means of the rest."""
    return rollouts.groupBy(*_keys(by)).agg(
        F.sum("had_compile_errors").alias("had_compile_errors"),
        F.avg("avg_compile_errors").alias("avg_compile_errors"),
        F.sum("had_runtime_errors").alias("had_runtime_errors"),
        F.avg("avg_runtime_errors").alias("avg_runtime_errors"),
        F.avg("test_cases_run").alias("test_cases_run"),
        F.avg("test_case_average").alias("test_case_average"),
        F.avg("strict_accuracy").alias("strict_accuracy"),
        F.count(F.lit(1)).alias("num_rollouts"),
    )


# ------------------------------------------------------------------ W8 P11 O6
def format_rounded(x, digits: int = 4) -> Column:
    """P11 text form of ``str(round(v, 4))``: rounded as Python does (the exact binary value, ties to
    even), fixed digits, trailing zeros cut, at least one digit after the point (0.43, 1.0, 0.0005)."""
    c = F.col(x) if isinstance(x, str) else x
    s = F.format_string(f"%.{digits}f", py_round(c.cast("double"), digits))
    s = F.regexp_replace(s, "0+$", "")
    return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(
        F.when(s.endswith(F.lit(".")), F.concat(s, F.lit("0"))).otherwise(s))


def latest_step_report(overall: DataFrame, step: str = "step",
                       metrics: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """W8 + P11 + O6: keep the numerically largest step, print ``mean +/- se``."""
    latest = overall.agg(F.max(F.col(step).cast("long")).alias("_m"))
    # a one-row aggregate: broadcast is size-bounded by construction
    row = overall.join(F.broadcast(latest), F.col(step).cast("long") == F.col("_m"))
    cols = [F.concat(format_rounded(m), F.lit(" +/- "), format_rounded(f"{m}_std")).alias(m)
            for m in metrics]
    return row.select(F.col(step).cast("long").alias(step), *cols).orderBy(*metrics)


# ------------------------------------------------------------------ A19 J6 U4
def difficulty_buckets(rollouts: DataFrame, problem: str = "qid",
                       good_threshold: float = 0.6) -> DataFrame:
    """Perfect (some rollout scores 1), good (some > 0.6), bad (neither).

    ``rollouts`` should already be restricted to the baseline part/step.
    perfect and good overlap, as in the reference.
    """
    best = rollouts.groupBy(problem).agg(F.max("test_case_average").alias("best_tca"))
    return best.select(
        problem, "best_tca",
        (F.col("best_tca") == 1.0).cast("int").alias("perfect"),
        (F.col("best_tca") > good_threshold).cast("int").alias("good"),
        ((F.col("best_tca") < 1.0) & (F.col("best_tca") <= good_threshold)).cast("int").alias("bad"),
    )


def bucket_stats(pstats: DataFrame, baseline_step: int = 0, step: str = "step", problem: str = "qid",
                 good_threshold: float = 0.6) -> DataFrame:
    """J6 + A6: macro statistics restricted to each bucket's problems, for every step.

    The buckets come from the baseline step's rows of the same problem table:
    a window over each problem's steps (bounded by the step count) carries
    the baseline's best score to all its steps, so nothing is scanned twice.
    """
    from pyspark.sql import Window
    best = F.max(F.when(F.col(step) == baseline_step, F.col("best_tca"))).over(Window.partitionBy(problem))
    t = pstats.withColumn("_b", best).filter(F.col("_b").isNotNull())
    names = F.array_compact(F.array(
        F.when(F.col("_b") == 1.0, F.lit("perfect")),
        F.when(F.col("_b") > good_threshold, F.lit("good")),
        F.when((F.col("_b") < 1.0) & (F.col("_b") <= good_threshold), F.lit("bad"))))
    m = t.withColumn("bucket", F.explode(names)).drop("_b")
    return macro_stats(m, by=["bucket", step])


def bad_only(problems: DataFrame, buckets: DataFrame, problem: str = "qid") -> DataFrame:
    """U4: all problems minus (perfect or good), as an anti-join."""
    good = buckets.filter((F.col("perfect") == 1) | (F.col("good") == 1)).select(problem)
    return problems.join(good, problem, "left_anti")


# ------------------------------------------------------------------ J5 A20 O8
#: Setting pairs that are broadcast.
MOST_PAIRS = 10_000


def paired_delta(values: DataFrame, pairs: Sequence[tuple[str, str]],
                 keys: Sequence[str] = ("part", "qid", "sample"),
                 setting: str = "setting", value: str = "value",
                 n_samples: int | None = None, sample: str = "sample") -> DataFrame:
    """value(setting a) - value(setting b) per key for each requested pair.

    ``pairs`` is a caller-given list, broadcast up to ``MOST_PAIRS`` of them and
    joined as Spark plans it beyond; each side is unique per key, so the join is
    one-to-one. O8 keeps the first n samples.
    """
    spark = values.sparkSession
    if n_samples is not None:
        values = values.filter(F.col(sample) < n_samples)
    pr = spark.createDataFrame([(a, b) for a, b in pairs], "setting_a string, setting_b string")
    pr = F.broadcast(pr) if len(pairs) <= MOST_PAIRS else pr
    left = values.join(pr, F.col(setting) == F.col("setting_a")).select(
        "setting_a", "setting_b", *keys, F.col(value).alias("value_a"))
    right = values.select(F.col(setting).alias("setting_b"), *keys, F.col(value).alias("value_b"))
    return (left.join(right, ["setting_b", *keys])
            .select("setting_a", "setting_b", *keys, "value_a", "value_b",
                    (F.col("value_a") - F.col("value_b")).alias("delta")))


def mean_delta(deltas: DataFrame, by: Sequence[str] = ("part",)) -> DataFrame:
    """Mean paired delta per part and setting pair."""
    return deltas.groupBy("setting_a", "setting_b", *_keys(by)).agg(
        F.avg("delta").alias("mean_delta"), F.count(F.lit(1)).alias("n_pairs"))


# ------------------------------------------------------------------ A22
def wide_metrics(long: DataFrame, settings: Sequence[str], row: str = "part",
                 setting: str = "setting", value: str = "value") -> DataFrame:
    """One row per part, one column per setting (pivot with fixed values,
    so no extra job is spent finding them)."""
    return long.groupBy(row).pivot(setting, list(settings)).agg(F.avg(value))


# ------------------------------------------------------------------ A23
def pass_rate(verdicts: DataFrame, keys: Sequence[str] = ("qid", "step", "sample"),
              verdict: str = "verdict") -> DataFrame:
    """Correct / tests of one generation (0 when no tests) and a compiles flag."""
    return quarantine(verdicts, verdict)[0].groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.count_if(is_pass(verdict)), F.count(verdict)), F.lit(0.0)).alias("pass_rate"),
        (F.count_if(is_compile_error(verdict)) == 0).cast("int").alias("compiles"),
    )
