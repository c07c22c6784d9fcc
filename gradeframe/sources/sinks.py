"""Sinks (S11-S21): Spark writers for the evaluation outputs.

Everything is written in parallel by the executors - directories of part
files partitioned by low-cardinality keys (dataset, transformation, step,
setting), never ``coalesce(1)`` and never partitioned by problem id (that
would make one directory per problem). Documents of a problem or rollout are
JSON lines with the key as a field, many per file; where a tool needs a file
per key, ``documents.py`` streams it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """Parallel write, partitioned by ``by``."""
    w = df.write.mode(mode)
    if by:
        w = w.partitionBy(*by)
    w.format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append new records; old part files stay (no read-modify-write)."""
    df.write.mode("append").format(fmt).save(path)


def split_by_key(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "json") -> None:
    """One output folder per key value (e.g. setting, problem), written in parallel. The rows of a
    key come together where they fill no more than a partition; a larger key is split over tasks.
    One file per key: ``sources.documents.write_documents``."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).format(fmt).save(path)


def save_split(df: DataFrame, path: str, split: str = "train", mode: str = "overwrite") -> None:
    """Save a dataset under a split name (a ``split`` partition column); S9 loads
    it back with ``spark.read.parquet(path)`` (``split`` becomes a column again)."""
    df.withColumn("split", F.lit(split)).write.mode(mode).partitionBy("split").parquet(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated text with a header line."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


#: Verdicts of one result record: a rollout with more tests takes several records.
TESTS_PER_LINE = 1000


def verdict_lines(verdicts: DataFrame, tests_per_line: int = TESTS_PER_LINE) -> DataFrame:
    """Result records (qid, step, sample, first_test, results), ``results`` a JSON list with
    1/0 written as true/false. No record grows with a rollout's tests, no row with a problem's."""
    v = F.when(F.col("verdict") == 1, F.lit("true")).when(F.col("verdict") == 0, F.lit("false")) \
        .otherwise(F.col("verdict").cast("string"))
    line = F.floor(F.col("test_idx") / tests_per_line).cast("int")
    per = (verdicts.groupBy("qid", "step", "sample", (line * tests_per_line).alias("first_test"))
           .agg(F.array_sort(F.collect_list(F.struct("test_idx", v.alias("v")))).alias("_t")))
    return per.select("qid", "step", "sample", "first_test", F.concat(
        F.lit("["), F.array_join(F.transform("_t", lambda x: x["v"]), ", "), F.lit("]")).alias("results"))


def verdict_documents(verdicts: DataFrame, path: Column, tests_per_line: int = TESTS_PER_LINE) -> DataFrame:
    """The pieces of ``{step: [[verdicts of sample 0], ...]}``, one document per path.

    A piece is a stretch of at most ``tests_per_line`` verdicts of a rollout with
    the brackets before it, which follow from the piece before; the window sees
    one row per stretch. Samples that are missing before others are empty lists.
    ``sources.documents.write_documents`` streams the pieces into files.
    """
    lines = verdict_lines(verdicts.withColumn("qid", path), tests_per_line).withColumnRenamed("qid", "path")
    w = Window.partitionBy("path").orderBy("step", "sample", "first_test")
    step, sample = F.lag("step").over(w), F.lag("sample").over(w)
    rows = lines.select("*", step.alias("_step"), sample.alias("_sample"), F.lead("step").over(w).isNull().alias("_last"),
                        F.row_number().over(w).alias("part"))
    opened = F.concat(F.lit('"'), F.col("step").cast("string"), F.lit('": ['), F.repeat(F.lit("[], "), F.col("sample")), F.lit("["))
    lead = (F.when(F.col("_step").isNull(), F.concat(F.lit("{"), opened))
            .when(F.col("_step") != F.col("step"), F.concat(F.lit("]], "), opened))
            .when(F.col("_sample") != F.col("sample"),
                  F.concat(F.lit("], "), F.repeat(F.lit("[], "), F.col("sample") - F.col("_sample") - 1), F.lit("[")))
            .otherwise(", "))
    body = F.substring("results", F.lit(2), F.length("results") - 2)
    return rows.select("path", "part", F.concat(lead, body, F.when(F.col("_last"), "]]}").otherwise("")).alias("piece"))


def rollout_documents(steps: DataFrame) -> DataFrame:
    """One rollout document per (qid, sample): an object per step, the feedback by step,
    the last code and the step count (its length is bounded by the steps of a rollout).

    ``steps`` has qid, sample, step, code, feedback.
    """
    key = F.col("step").cast("string")
    per = steps.groupBy("qid", "sample").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(F.col("code").alias("final_code")))))).alias("_steps"),
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(key, F.struct(
            F.col("code").alias("asst_ir_query"), F.col("feedback").alias("user_ir_answer"))))).alias("iter_refinement_data"),
            F.max_by("code", "step").alias("final_code"), (F.max("step") + 1).alias("total_ir_steps"))).alias("_rest"))
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)   # noqa: E731  an object without its braces
    return per.select("qid", "sample", F.concat(F.lit("{"), inner(F.col("_steps")), F.lit(","), inner(F.col("_rest")),
                                                F.lit("}")).alias("doc"))


#: Names of the four tables of S14.
STEP_TABLES = ("problem_level_stats", "problem_level_agg_stats", "agg_results", "agg_stats")


def write_step_tables(rollouts: DataFrame, problems: DataFrame | None, root: str) -> None:
    """Rollout rows, per-problem rows, overall rows and macro rows, each a table partitioned by step.

    Each grain is computed once: the rollout rows are written first, and the
    coarser tables are made from the rows read back, so the verdicts behind
    ``rollouts`` are scanned a single time. Without ``problems`` the grid has
    the problems of the rollouts.
    """
    from ..operators import stats as S
    names = dict(zip(("rollouts", "problems", "overall", "macro"), STEP_TABLES, strict=True))

    def stored(table: DataFrame, name: str) -> DataFrame:
        write_partitioned(table, f"{root}/{name}", ["step"])
        return table.sparkSession.read.schema(table.schema).parquet(f"{root}/{name}")

    r = stored(rollouts, names["rollouts"])
    p = stored(S.with_all_problems(S.problem_stats(r), r.select("qid") if problems is None else problems), names["problems"])
    write_partitioned(S.overall_stats(r), f"{root}/{names['overall']}", ["step"])
    write_partitioned(S.macro_stats(p), f"{root}/{names['macro']}", ["step"])


def label_documents(labels: DataFrame, qid: str = "qid", sample: str = "sample") -> DataFrame:
    """``{sample: {labels: [...], full_outputs: [...]}}`` text per problem
    (bounded by the samples of one problem)."""
    entry = F.struct(F.col("labels"), F.col("full_outputs"))
    return labels.groupBy(qid).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col(sample).cast("string"), entry)))).alias("doc"))


def consolidate(df: DataFrame, path: str, step: str = "step") -> None:
    """All per-task records of a step in one place - a directory per step
    written in parallel (``partitionBy``), instead of one array file built by
    a single task."""
    write_partitioned(df, path, [step], fmt="json")
