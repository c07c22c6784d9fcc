"""Class-level unit-test outcomes.

Input is the count table ``(task, sample, test_class, errors, failures,
tests_run)`` - the three nested maps of the grader flattened by ``explode``
(see ``sources.scans.class_count_scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passk import pass_at_k_comb

# Outcome labels of one test class, and of one class as a whole.
OUTCOMES = ("success", "partial_success", "fail", "error")
CLASS_OUTCOMES = ("class_success", "class_partial_success", "class_fail")
# The report's four rates.
RATES = ("fun_success", "class_success", "fun_partial_success", "class_partial_success")


def test_outcome(errors="errors", failures="failures", tests_run="tests_run") -> Column:
    """Error / success / partial_success / fail of one test class run."""
    e, f, n = (F.col(x) if isinstance(x, str) else x for x in (errors, failures, tests_run))
    return (F.when((n == 0) | (e == n), F.lit("error"))
            .when(e + f == 0, F.lit("success"))
            .when(e + f < n, F.lit("partial_success"))
            .otherwise(F.lit("fail")))


def with_outcome(counts: DataFrame) -> DataFrame:
    return counts.withColumn("outcome", test_outcome())


def outcome_counts(counts: DataFrame, keys: Sequence[str] = ("task", "test_class"),
                   sample: str = "sample") -> DataFrame:
    """Per (task, test class) the count of each outcome and the outcomes in sample order.

    One aggregate gives both.
    The outcome list holds one entry per sample (bounded by the sample budget).
    """
    o = with_outcome(counts)
    done = o.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES],
                                F.array_sort(F.collect_list(F.struct(F.col(sample), F.col("outcome")))).alias("_l"))
    return done.select(*keys, *OUTCOMES, F.array_join(F.transform("_l", lambda x: x["outcome"]), ",").alias("outcomes"))


def class_outcomes(counts: DataFrame, task: str = "task", sample: str = "sample") -> DataFrame:
    """A14 (per sample): all classes succeed -> class_success; no fail and no
    error -> class_partial_success; else class_fail."""
    o = with_outcome(counts)
    per = o.groupBy(task, sample).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.col("outcome") == "success").alias("n_success"),
        F.count_if(F.col("outcome").isin("fail", "error")).alias("n_bad"))
    return per.select(
        task, sample,
        F.when(F.col("n_success") == F.col("n_classes"), F.lit("class_success"))
         .when(F.col("n_bad") == 0, F.lit("class_partial_success"))
         .otherwise(F.lit("class_fail")).alias("class_outcome"))


def class_rollup(counts: DataFrame, task: str = "task") -> DataFrame:
    """A14 (per task): how many samples reached each class-level outcome."""
    co = class_outcomes(counts, task)
    return (co.groupBy(task)
            .agg(*[F.count_if(F.col("class_outcome") == x).alias(x) for x in CLASS_OUTCOMES]))


def class_report(counts: DataFrame, pass_k: int | Sequence[int], by: Sequence[str] = (),
                 task: str = "task", test_class: str = "test_class", sample: str = "sample") -> DataFrame:
    """A15 + A16: the four ClassEval rates at pass@k, one row per (by..., k).

    The sample count of each task comes from the data. Function-level rates
    average over (task, test class) pairs, class-level rates over tasks;
    pairs/tasks with no success add 0. One lazy plan reads the counts once:
    grouping sets aggregate them at both grains - (task, sample) for the
    class-level outcome and (task, class) for the function-level counts - in
    one shuffle, the next brings a task's few grain rows together (its pairs are
    a list bounded by the task's test classes), and all k are columns of the
    same final aggregate.
    """
    ks = [int(pass_k)] if isinstance(pass_k, int) else [int(k) for k in pass_k]
    by = list(by)
    o = with_outcome(counts)
    grouped = bool(by)
    if not grouped:  # one report row per k: group on a constant key rather than cross-joining
        o, by = o.withColumn("_all", F.lit(1)), ["_all"]
    good, fair = F.col("outcome") == "success", F.col("outcome").isin("success", "partial_success")
    keys = [*by, task]
    grains = o.groupingSets([[*keys, sample], [*keys, test_class]], *keys, sample, test_class).agg(
        F.grouping(sample).alias("_pair"), F.count(F.lit(1)).alias("_n"), F.count_if(good).alias("_s"), F.count_if(fair).alias("_sp"))
    run = F.col("_pair") == 0
    per_task = grains.groupBy(*keys).agg(
        F.count_if(run).alias("n"), F.count_if(run & (F.col("_s") == F.col("_n"))).alias("cs"),
        F.count_if(run & (F.col("_sp") == F.col("_n"))).alias("cps"),
        F.collect_list(F.when(~run, F.struct(F.col("_s").alias("s"), F.col("_sp").alias("sp")))).alias("pairs"))

    def pk(s, k, n):
        return F.when(s > 0, pass_at_k_comb(F.lit(k), n, s)).otherwise(0.0)

    # the pairs of a task leave as rows, its own row as one without a pair
    rows = per_task.select(*by, "n", "cs", "cps", F.explode(F.array_append("pairs", F.lit(None).cast("struct<s:bigint,sp:bigint>"))).alias("p"))
    mine, n = F.col("p").isNull(), F.col("n")
    rates = [F.avg(F.when(~mine, pk(F.col(f"p.{c}"), k, n))).alias(f"{name}_{k}") for k in ks for c, name in (("s", "fun_success"), ("sp", "fun_partial_success"))]
    rates += [F.avg(F.when(mine, pk(F.col(c), k, n))).alias(f"{name}_{k}") for k in ks for c, name in (("cs", "class_success"), ("cps", "class_partial_success"))]
    wide = rows.groupBy(*by).agg(*rates)
    out = F.explode(F.array(*[F.struct(F.lit(k).alias("pass_k"), *[F.col(f"{r}_{k}").alias(r) for r in RATES]) for k in ks]))
    keep = by if grouped else []
    return wide.select(*keep, out.alias("_r")).select(*keep, "_r.*")


def report_projection(report: DataFrame, pass_k: int, setting: str = "setting") -> DataFrame:
    """The chosen k's four rates with the setting first, fixed order."""
    return report.filter(F.col("pass_k") == pass_k).select(setting, *RATES)


def report_long(report: DataFrame, key: Sequence[str] = ("setting",)) -> DataFrame:
    """Report in long form (setting, pass_k, metric, value)."""
    stack = F.explode(F.array(*[F.struct(F.lit(r).alias("metric"), F.col(r).alias("value"))
                                for r in RATES]))
    return report.select(*key, "pass_k", stack.alias("_m")).select(*key, "pass_k", "_m.metric", "_m.value")


def upsert_versions(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """U6 in one pass: rows of several report versions in one frame; per key the row of
    the highest version wins (an aggregate, so no second read of either version)."""
    cols = [c for c in df.columns if c not in key and c != version]
    win = F.max_by(F.struct(*cols), F.col(version))
    return df.groupBy(*key).agg(win.alias("_w")).select(*key, "_w.*")


def class_verdicts(counts: DataFrame, task: str = "task", sample: str = "sample") -> DataFrame:
    """Class counts as runs of equal verdicts per (task, sample): (run, verdict, n) in the
    order passes, failures, errors, or one -2 when nothing ran. No row grows with the tests."""
    s = counts.groupBy(task, sample).agg(
        F.sum("errors").alias("errors"), F.sum("failures").alias("failures"), F.sum("tests_run").alias("tests_run"))
    correct = F.greatest(F.col("tests_run") - F.col("errors") - F.col("failures"), F.lit(0))
    run = lambda k, v, n: F.struct(F.lit(k).alias("run"), F.lit(v).alias("verdict"), n.cast("long").alias("n"))
    runs = F.when(F.col("tests_run") > 0, F.array(run(0, 1, correct), run(1, 0, F.col("failures")), run(2, -1, F.col("errors")))) \
        .otherwise(F.array(run(0, -2, F.lit(1))))
    return s.select(task, sample, F.inline(F.filter(runs, lambda r: r["n"] > 0)))


def latest_item(items: DataFrame, task: str = "task", position: str = "position") -> DataFrame:
    """Index grading items by task; the last one (highest position) wins."""
    cols = [c for c in items.columns if c != task]
    win = F.max_by(F.struct(*cols), F.col(position))
    return items.groupBy(task).agg(win.alias("_w")).select(task, "_w.*")
