"""pass@k reports over rollouts (A9, A10) and per-task correctness counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.passk import pass_at_k


def task_counts(rollouts: DataFrame, by: Sequence[str] = ("step",), problem: str = "qid",
                correct: str = "strict_accuracy") -> DataFrame:
    """(by..., qid, n_samples, n_correct): samples and fully-passing samples per task."""
    return rollouts.groupBy(*by, problem).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.col(correct).cast("long")).alias("n_correct"))


def pass_at_k_detail(counts: DataFrame, k_list: Sequence[int]) -> DataFrame:
    """A8 per task for every k: long form (…, qid, k, pass_at_k).

    The k list is a caller parameter; it is expanded with ``explode`` of a
    literal array, not a join.
    """
    ks = F.array(*[F.lit(int(k)) for k in k_list])
    return (counts.select("*", F.explode(ks).alias("k"))
            .withColumn("pass_at_k", pass_at_k("n_samples", "n_correct", "k")))


def pass_at_k_report(counts: DataFrame, k_list: Sequence[int],
                     by: Sequence[str] = ("step",)) -> DataFrame:
    """Mean pass@k per k, reported only when *every* task has >= k samples."""
    d = pass_at_k_detail(counts, k_list)
    return (d.groupBy(*by, "k")
            .agg(F.avg("pass_at_k").alias("pass_at_k"),
                 F.min("n_samples").alias("min_samples"),
                 F.count(F.lit(1)).alias("num_tasks"))
            .filter(F.col("min_samples") >= F.col("k"))
            .drop("min_samples"))


def instance_results(rollouts: DataFrame, by: Sequence[str] = ("step",), problem: str = "qid",
                     sample: str = "sample", correct: str = "strict_accuracy") -> DataFrame:
    """A10 + O5: per task, the pass/fail of its samples in sample order.

    Input is already one row per rollout, so each list is bounded by the
    configured number of samples per problem, never by the verdict count.
    """
    lst = F.array_sort(F.collect_list(F.struct(F.col(sample), F.col(correct).cast("int").alias("ok"))))
    return (rollouts.groupBy(*by, problem)
            .agg(lst.alias("_l"))
            .select(*by, problem,
                    F.array_join(F.transform("_l", lambda x: x["ok"].cast("string")), ",").alias("results")))
