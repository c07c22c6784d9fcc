"""pass@k and ClassEval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classeval as C
from ..operators import passk as P
from ..operators import stats as S
from . import views as V
from .catalogue import finish, register
from .q_stats import rollout_cte

# Fixed parameters: the k values reported.
K_LIST = [1, 2, 4]
CLASS_PASS_K = [1, 3]


def pk_sql(n: str, c: str, k: str) -> str:
    """SQL twin of the unbiased pass@k estimator (DuckDB list product)."""
    return (f"(CASE WHEN {n} - {c} < {k} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE 1.0 - "
            f"list_aggregate(list_transform(range({n} - {c} + 1, {n} + 1), "
            f"lambda i: 1.0 - {k} / i), 'product') END)")


COUNTS_CTE = """tc AS (SELECT step, qid, count(*) AS n_samples, CAST(sum(strict_accuracy) AS BIGINT) AS n_correct
                FROM r GROUP BY step, qid)"""
KS_CTE = f"ks AS (SELECT unnest([{', '.join(map(str, K_LIST))}]) AS k)"


def _counts(spark, sf_dir):
    return P.task_counts(S.rollout_stats(V.verdicts(spark, sf_dir)))


@register("pass_at_k_unbiased", V.with_views(["verdicts"], f"""
SELECT step, qid, n_samples, n_correct, k, round({pk_sql('n_samples', 'n_correct', 'k')}, 6) AS pass_at_k
FROM tc, ks""", [rollout_cte(["step"]), COUNTS_CTE, KS_CTE]))
def q_pass_at_k_unbiased(spark, sf_dir):
    """A8 per task and k."""
    return finish(P.pass_at_k_detail(_counts(spark, sf_dir), K_LIST))


@register("pass_at_k_report", V.with_views(["verdicts"], f"""
SELECT step, k, round(avg({pk_sql('n_samples', 'n_correct', 'k')}), 6) AS pass_at_k, count(*) AS num_tasks
FROM tc, ks GROUP BY step, k HAVING min(n_samples) >= k""", [rollout_cte(["step"]), COUNTS_CTE, KS_CTE]))
def q_pass_at_k_report(spark, sf_dir):
    """Reported only for k that every task has enough samples for."""
    return finish(P.pass_at_k_report(_counts(spark, sf_dir), K_LIST))


@register("instance_results", V.with_views(["verdicts"], """
SELECT step, qid, string_agg(CAST(strict_accuracy AS VARCHAR), ',' ORDER BY sample) AS results
FROM r GROUP BY step, qid""", [rollout_cte(["step"])]))
def q_instance_results(spark, sf_dir):
    """A10 + O5"""
    return P.instance_results(S.rollout_stats(V.verdicts(spark, sf_dir)))


# ------------------------------------------------------------------ ClassEval
OUTCOME_SQL = """CASE WHEN tests_run = 0 OR errors = tests_run THEN 'error'
                     WHEN errors + failures = 0 THEN 'success'
                     WHEN errors + failures < tests_run THEN 'partial_success' ELSE 'fail' END"""
O_CTE = f"""o AS (SELECT CAST(CAST(task AS BIGINT) % 3 AS INTEGER) AS setting, task, sample, test_class,
                 errors, failures, tests_run, {OUTCOME_SQL} AS outcome FROM class_counts)"""


@register("class_outcomes", V.with_views(["class_counts"], """
SELECT task, test_class,
       count(*) FILTER (WHERE outcome = 'success') AS success,
       count(*) FILTER (WHERE outcome = 'partial_success') AS partial_success,
       count(*) FILTER (WHERE outcome = 'fail') AS fail,
       count(*) FILTER (WHERE outcome = 'error') AS error,
       string_agg(outcome, ',' ORDER BY sample) AS outcomes
FROM o GROUP BY task, test_class""", [O_CTE]))
def q_class_outcomes(spark, sf_dir):
    """A12 + A13"""
    return C.outcome_counts(V.class_counts(spark, sf_dir))


CO_CTE = """co AS (SELECT setting, task, sample,
       CASE WHEN count(*) FILTER (WHERE outcome = 'success') = count(*) THEN 'class_success'
            WHEN count(*) FILTER (WHERE outcome IN ('fail', 'error')) = 0 THEN 'class_partial_success'
            ELSE 'class_fail' END AS class_outcome
  FROM o GROUP BY setting, task, sample)"""


@register("class_rollup", V.with_views(["class_counts"], """
SELECT task, count(*) FILTER (WHERE class_outcome = 'class_success') AS class_success,
       count(*) FILTER (WHERE class_outcome = 'class_partial_success') AS class_partial_success,
       count(*) FILTER (WHERE class_outcome = 'class_fail') AS class_fail
FROM co GROUP BY task""", [O_CTE, CO_CTE]))
def q_class_rollup(spark, sf_dir):
    """A14"""
    return C.class_rollup(V.class_counts(spark, sf_dir))


def _class_report_sql(k: int) -> str:
    def pk(s):
        return f"CASE WHEN {s} > 0 THEN {pk_sql('n', s, str(k))} ELSE 0.0 END"
    return f"""
SELECT f.setting, {k} AS pass_k, round(f.fs, 6) AS fun_success, round(c.cs, 6) AS class_success,
       round(f.fps, 6) AS fun_partial_success, round(c.cps, 6) AS class_partial_success
FROM (SELECT setting, avg({pk('s')}) AS fs, avg({pk('sp')}) AS fps
      FROM pairs JOIN ns USING (setting, task) GROUP BY setting) f
JOIN (SELECT setting, avg({pk('cs')}) AS cs, avg({pk('cps')}) AS cps
      FROM tk JOIN ns USING (setting, task) GROUP BY setting) c USING (setting)"""


REPORT_CTES = [O_CTE, CO_CTE,
               "ns AS (SELECT setting, task, count(DISTINCT sample) AS n FROM o GROUP BY 1, 2)",
               """pairs AS (SELECT setting, task, test_class,
                        count(*) FILTER (WHERE outcome = 'success') AS s,
                        count(*) FILTER (WHERE outcome IN ('success', 'partial_success')) AS sp
                 FROM o GROUP BY 1, 2, 3)""",
               """tk AS (SELECT setting, task, count(*) FILTER (WHERE class_outcome = 'class_success') AS cs,
                     count(*) FILTER (WHERE class_outcome <> 'class_fail') AS cps FROM co GROUP BY 1, 2)"""]


def _class_counts_by_setting(spark, sf_dir):
    cc = V.class_counts(spark, sf_dir)
    return cc.withColumn("setting", (F.col("task").cast("long") % 3).cast("int"))


def _reports(spark, sf_dir, ks):
    return C.class_report(_class_counts_by_setting(spark, sf_dir), ks, by=["setting"])


@register("class_pass_at_k", V.with_views(["class_counts"], "\nUNION ALL\n".join(
    _class_report_sql(k) for k in CLASS_PASS_K), REPORT_CTES))
def q_class_pass_at_k(spark, sf_dir):
    """A15 + A16 per setting for each pass@k."""
    return finish(_reports(spark, sf_dir, CLASS_PASS_K))


@register("report_projection", V.with_views(["class_counts"], f"""
SELECT setting, fun_success, class_success, fun_partial_success, class_partial_success
FROM ({_class_report_sql(1)}) x""", REPORT_CTES))
def q_report_projection(spark, sf_dir):
    """P19"""
    return finish(C.report_projection(_reports(spark, sf_dir, [1]), 1))


@register("report_upsert", V.with_views(["class_counts"], f"""
SELECT setting, pass_k, metric, value FROM (
  SELECT setting, pass_k, unnest(['fun_success', 'class_success', 'fun_partial_success', 'class_partial_success']) AS metric,
         unnest([fun_success, class_success, fun_partial_success, class_partial_success]) AS value
  FROM ({_class_report_sql(1)}) a) old
WHERE setting NOT IN (1, 2)
UNION ALL
SELECT setting, pass_k, metric, value FROM (
  SELECT setting, pass_k, unnest(['fun_success', 'class_success', 'fun_partial_success', 'class_partial_success']) AS metric,
         unnest([fun_success, class_success, fun_partial_success, class_partial_success]) AS value
  FROM ({_class_report_sql(3)}) b) new WHERE setting IN (1, 2)""", REPORT_CTES))
def q_report_upsert(spark, sf_dir):
    """pass@3 rates of settings 1 and 2 replace their pass@1 rates."""
    rep = C.report_long(_reports(spark, sf_dir, [1, 3]))       # one plan for both k
    version = (F.when(F.col("pass_k") == 1, F.lit(0))                       # old report
               .when((F.col("pass_k") == 3) & F.col("setting").isin(1, 2), F.lit(1)))  # new rows
    rows = rep.withColumn("_version", version).filter(F.col("_version").isNotNull())
    return finish(C.upsert_versions(rows, ["setting", "metric"], "_version"))


@register("class_verdicts", V.with_views(["class_counts"], """
SELECT task, sample, CAST(r.run AS INTEGER) AS run, CAST(r.verdict AS INTEGER) AS verdict, r.n FROM (
  SELECT task, sample, unnest(CASE WHEN tests_run > 0 THEN
           [{'run': 0, 'verdict': 1, 'n': greatest(tests_run - errors - failures, 0)},
            {'run': 1, 'verdict': 0, 'n': failures}, {'run': 2, 'verdict': -1, 'n': errors}]
         ELSE [{'run': 0, 'verdict': -2, 'n': CAST(1 AS BIGINT)}] END) AS r
  FROM (SELECT task, sample, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(failures) AS BIGINT) AS failures,
               CAST(sum(tests_run) AS BIGINT) AS tests_run FROM class_counts GROUP BY 1, 2) s) t
WHERE r.n > 0"""))
def q_class_verdicts(spark, sf_dir):
    """Verdict runs of each graded class sample."""
    return C.class_verdicts(V.class_counts(spark, sf_dir))


@register("latest_item", V.with_views(["class_counts"], """
SELECT task, arg_max(sample, position) AS sample, arg_max(test_class, position) AS test_class,
       arg_max(tests_run, position) AS tests_run, max(position) AS position
FROM (SELECT task, sample, test_class, tests_run, sample * 256 + ascii(test_class) AS position
      FROM class_counts) i GROUP BY task"""))
def q_latest_item(spark, sf_dir):
    """Last grading item per task wins."""
    cc = V.class_counts(spark, sf_dir)
    items = cc.select("task", "sample", "test_class", "tests_run",
                      (F.col("sample") * 256 + F.ascii("test_class")).alias("position"))
    return C.latest_item(items)


@register("regrouped_results", V.with_views(["verdicts"], """
SELECT qid, step, string_agg(CAST(strict_accuracy AS VARCHAR), ',' ORDER BY sample) AS results,
       string_agg(to_json({'test_cases_run': test_cases_run, 'had_compile_errors': had_compile_errors}), '|'
                  ORDER BY sample) AS metadata
FROM r GROUP BY qid, step""", [rollout_cte(["step"])]))
def q_regrouped_results(spark, sf_dir):
    """Per-generation grades regrouped into per-problem lists in sample order,
    with each generation's metadata as JSON text."""
    from ..operators.history import regroup_results
    r = S.rollout_stats(V.verdicts(spark, sf_dir)).withColumn(
        "meta", F.struct("test_cases_run", "had_compile_errors"))
    g = regroup_results(r, ["qid", "step"], "sample", "strict_accuracy", "meta")
    return g.select("qid", "step", F.array_join(F.col("results").cast("array<string>"), ",").alias("results"),
                    F.array_join("metadata", "|").alias("metadata"))
