"""Statistics queries over the verdict table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from . import views as V
from .catalogue import finish, register

R6 = "round({}, 6)"


def _r(expr: str) -> str:
    return R6.format(expr)


def rollout_cte(by: list[str], src: str = "verdicts", name: str = "r") -> str:
    k = ", ".join([*by, "qid", "sample"])
    return f"""{name} AS (
  SELECT {k},
         CAST(sum(CASE WHEN verdict = -2 THEN 1 ELSE 0 END) > 0 AS INTEGER) AS had_compile_errors,
         sum(CASE WHEN verdict = -2 THEN 1 ELSE 0 END) / count(*) AS avg_compile_errors,
         CAST(sum(CASE WHEN verdict = -1 THEN 1 ELSE 0 END) > 0 AS INTEGER) AS had_runtime_errors,
         sum(CASE WHEN verdict = -1 THEN 1 ELSE 0 END) / count(*) AS avg_runtime_errors,
         count(*) AS test_cases_run,
         sum(CASE WHEN verdict > 0 THEN 1 ELSE 0 END) / count(*) AS test_case_average,
         CAST(sum(CASE WHEN verdict > 0 THEN 1 ELSE 0 END) = count(*) AS INTEGER) AS strict_accuracy
  FROM {src} GROUP BY {k})"""


def _se(x: str) -> str:
    return f"stddev_pop({x}) / sqrt(count({x}))"


def problem_cte(by: list[str], src: str = "r", name: str = "p") -> str:
    k = ", ".join([*by, "qid"])
    nce = "CASE WHEN had_compile_errors = 0 THEN test_case_average END"
    return f"""{name} AS (
  SELECT {k}, count(*) AS n_rollouts,
         max(had_compile_errors) AS had_compile_errors,
         avg(had_compile_errors) AS avg_compile_errors,
         max(had_runtime_errors) AS had_runtime_errors,
         avg(avg_runtime_errors) AS avg_runtime_errors,
         {_se('avg_runtime_errors')} AS avg_runtime_errors_std,
         arg_max(test_cases_run, sample) AS test_cases_run,
         avg(test_case_average) AS test_case_average,
         {_se('test_case_average')} AS test_case_average_std,
         avg({nce}) AS test_case_average_ignoring_compile_errors,
         {_se(nce)} AS test_case_average_ignoring_compile_errors_std,
         avg(strict_accuracy) AS strict_accuracy,
         {_se('strict_accuracy')} AS strict_accuracy_std
  FROM {src} GROUP BY {k})"""


PROBLEM_COLS = ["n_rollouts", "had_compile_errors", "avg_compile_errors", "had_runtime_errors",
                "avg_runtime_errors", "avg_runtime_errors_std", "test_cases_run", "test_case_average",
                "test_case_average_std", "test_case_average_ignoring_compile_errors",
                "test_case_average_ignoring_compile_errors_std", "strict_accuracy",
                "strict_accuracy_std"]
INT_COLS = {"n_rollouts", "had_compile_errors", "had_runtime_errors", "test_cases_run"}


def macro_select(by: list[str], src: str = "p") -> str:
    k = ", ".join(by)
    miss = "max(CASE WHEN n_rollouts IS NULL THEN 1 ELSE 0 END) = 1"
    cols = ",\n  ".join(
        f"round(CAST(CASE WHEN {miss} THEN NULL ELSE avg({m}) END AS DOUBLE), 6) AS {m}"
        for m in S.MACRO_METRICS)
    return f"SELECT {k},\n  {cols},\n  count(*) AS num_problems\nFROM {src} GROUP BY {k}"


# ---------------------------------------------------------------- queries
def _rollouts(spark, sf_dir, by=("step",)):
    return S.rollout_stats(V.verdicts(spark, sf_dir), by=by)


_overall_cols = []
for _m in S.ROLLOUT_METRICS:
    _overall_cols += [f"{_r(f'avg({_m})')} AS {_m}", f"{_r(_se(_m))} AS {_m}_std"]
_overall_cols += [f"{_r('avg(strict_accuracy)')} AS pass_at_1",
                  f"{_r(_se('strict_accuracy'))} AS pass_at_1_std", "count(*) AS num_rollouts"]

OVERALL_SQL = V.with_views(["verdicts"], f"""
SELECT a.*, b.pass_at_n, b.pass_at_n_std, b.num_problems
FROM (SELECT step, {", ".join(_overall_cols)} FROM r GROUP BY step) a
JOIN (SELECT step, {_r('avg(pp)')} AS pass_at_n, {_r(_se('pp'))} AS pass_at_n_std,
             count(*) AS num_problems
      FROM (SELECT step, qid, max(strict_accuracy) AS pp FROM r GROUP BY step, qid) x
      GROUP BY step) b USING (step)""", [rollout_cte(["step"])])


@register("overall_stats", OVERALL_SQL)
def q_overall_stats(spark, sf_dir):
    """A1 -> A4 + A5 per step (A26), X39 standard errors, P10 predicates."""
    return finish(S.overall_stats(_rollouts(spark, sf_dir)))


@register("rollout_stats", V.with_views(["verdicts"], "SELECT qid, step, sample, had_compile_errors, "
          + f"{_r('avg_compile_errors')} AS avg_compile_errors, had_runtime_errors, "
          + f"{_r('avg_runtime_errors')} AS avg_runtime_errors, test_cases_run, "
          + f"{_r('test_case_average')} AS test_case_average, strict_accuracy FROM r",
          [rollout_cte(["step"])]))
def q_rollout_stats(spark, sf_dir):
    """A1"""
    return finish(_rollouts(spark, sf_dir))


_pcols = ", ".join(c if c in INT_COLS else f"round({c}, 6) AS {c}" for c in PROBLEM_COLS)


@register("problem_stats", V.with_views(["verdicts"], f"""
SELECT pr.qid, s.step, {", ".join(("p." + c) if c in INT_COLS else f"round(p.{c}, 6) AS {c}" for c in PROBLEM_COLS)}
FROM (SELECT CAST(p_partkey AS VARCHAR) AS qid FROM part) pr CROSS JOIN (SELECT DISTINCT step FROM p) s
LEFT JOIN p ON pr.qid = p.qid AND p.step = s.step""",
          [rollout_cte(["step"]), problem_cte(["step"])]))
def q_problem_stats(spark, sf_dir):
    """A2 + A3 + W4, with problems that have no rollout kept as NULL rows."""
    ps = S.problem_stats(_rollouts(spark, sf_dir)).drop("best_tca")
    problems = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qid"))
    return finish(S.with_all_problems(ps, problems))


@register("macro_stats", V.with_views(["verdicts"], macro_select(["step"]),
                                      [rollout_cte(["step"]), problem_cte(["step"])]))
def q_macro_stats(spark, sf_dir):
    """A6 + P18"""
    return finish(S.macro_stats(S.problem_stats(_rollouts(spark, sf_dir))))


# A later step is graded for some problems only, so that the guard has something to do.
GUARDED_CTES = ["""gv AS (SELECT qid, step, sample, verdict FROM verdicts
       UNION ALL SELECT qid, 2 AS step, sample, verdict FROM verdicts WHERE step = 1 AND CAST(qid AS BIGINT) % 7 <> 0)""",
                rollout_cte(["step"], "gv"), problem_cte(["step"]),
                """gp AS (SELECT g.qid, g.step, p.* EXCLUDE (qid, step)
       FROM (SELECT * FROM (SELECT DISTINCT qid FROM gv) a CROSS JOIN (SELECT DISTINCT step FROM gv) b) g
       LEFT JOIN p ON p.qid = g.qid AND p.step = g.step)"""]


@register("macro_stats_guarded", V.with_views(["verdicts"], macro_select(["step"], "gp"), GUARDED_CTES))
def q_macro_stats_guarded(spark, sf_dir):
    """A2 tail + A6 + P18: a step that lacks a problem's results has no macro averages."""
    v = V.verdicts(spark, sf_dir)
    later = v.filter((F.col("step") == 1) & (F.col("qid").cast("long") % 7 != 0)).withColumn("step", F.lit(2).cast("long"))
    v = v.unionByName(later)
    p = S.problem_stats(S.rollout_stats(v))
    return finish(S.macro_stats(S.with_all_problems(p, v.select("qid"))))


@register("raw_verdicts", V.with_views([], """
SELECT l_partkey % 10 AS bucket, count(*) FILTER (WHERE good) AS n_valid, count(*) FILTER (WHERE NOT good) AS n_quarantined,
       count(*) FILTER (WHERE good AND raw IN ('true', '1.0')) AS n_pass
FROM (SELECT l_partkey, raw, raw IN ('true', '1.0', 'False', '0', '-1', '-2.0') AS good FROM raw) a GROUP BY 1""",
    ["""raw AS (SELECT l_partkey, ['true', 'False', '-1', '1.0', '-2.0', '2', '7', '0.9', 'NaN', 'pass', '0'][l_orderkey % 11 + 1] AS raw
       FROM lineitem)"""]))
def q_raw_verdicts(spark, sf_dir):
    """X1 + P10: raw verdict texts normalised; everything but the four codes is quarantined."""
    from ..functions import verdict as VD
    raw = F.array(*[F.lit(x) for x in ("true", "False", "-1", "1.0", "-2.0", "2", "7", "0.9", "NaN", "pass", "0")])
    li = V.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 10).alias("bucket"),
        VD.normalize_verdict(F.element_at(raw, (F.col("l_orderkey") % 11 + 1).cast("int"))).alias("verdict"))
    ok, bad = VD.quarantine(li)
    n = ok.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_valid"), F.count_if(VD.is_pass()).alias("n_pass"))
    q = bad.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_quarantined"))
    return n.join(q, "bucket", "full").na.fill(0)


@register("report_totals", V.with_views(["verdicts"], f"""
SELECT step, CAST(sum(had_compile_errors) AS BIGINT) AS had_compile_errors,
       {_r('avg(avg_compile_errors)')} AS avg_compile_errors,
       CAST(sum(had_runtime_errors) AS BIGINT) AS had_runtime_errors,
       {_r('avg(avg_runtime_errors)')} AS avg_runtime_errors,
       {_r('avg(test_cases_run)')} AS test_cases_run,
       {_r('avg(test_case_average)')} AS test_case_average,
       {_r('avg(strict_accuracy)')} AS strict_accuracy, count(*) AS num_rollouts
FROM r GROUP BY step""", [rollout_cte(["step"])]))
def q_report_totals(spark, sf_dir):
    """A7"""
    return finish(S.report_totals(_rollouts(spark, sf_dir)))


def _fmt_sql(x: str) -> str:
    """DuckDB: ``str(round(x, 4))``; the formatter rounds the exact binary value, ties to even."""
    s = f"regexp_replace(format('{{:.4f}}', {x}), '0+$', '')"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN 'nan' WHEN ends_with({s}, '.') THEN {s} || '0' ELSE {s} END)"


_rep = ", ".join(f"{_fmt_sql(m)} || ' +/- ' || {_fmt_sql(m + '_std')} AS {m}" for m in S.REPORT_METRICS)


@register("latest_step_report", V.with_views(["verdicts"], f"""
SELECT step, {_rep}
FROM (SELECT step, {", ".join(f"avg({m}) AS {m}, {_se(m)} AS {m}_std" for m in S.REPORT_METRICS)}
      FROM r GROUP BY step) o
WHERE step = (SELECT max(step) FROM r)""", [rollout_cte(["step"])]))
def q_latest_step_report(spark, sf_dir):
    """W8 + P11 + O6: text report of the latest step."""
    return S.latest_step_report(S.overall_stats(_rollouts(spark, sf_dir)))


@register("rounded_rates", f"""
SELECT rate, {_fmt_sql('rate')} AS text, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (o_orderkey % 4003) / 20000.0::DOUBLE END AS rate FROM orders) r
GROUP BY rate""")
def q_rounded_rates(spark, sf_dir):
    """P11 over many rates, half of them in the middle between two printed values."""
    key = F.col("o_orderkey")
    rate = F.when(key % 50 != 0, (key % 4003) / F.lit(20000.0))
    return (V.table(spark, sf_dir, "orders").groupBy(rate.alias("rate")).agg(F.count(F.lit(1)).alias("n"))
            .select("rate", S.format_rounded("rate").alias("text"), "n"))


SETTING_VERDICTS = """
sv AS (SELECT CAST(CAST(qid AS BIGINT) % 3 AS INTEGER) AS setting, step AS part, qid, sample, verdict
       FROM verdicts)"""


@register("setting_stats", V.with_views(["verdicts"], macro_select(["setting", "part"]),
                                        [SETTING_VERDICTS, rollout_cte(["setting", "part"], "sv"),
                                         problem_cte(["setting", "part"])]))
def q_setting_stats(spark, sf_dir):
    """The same statistics for every (setting, part) pair, plus macro averages."""
    v = V.verdicts(spark, sf_dir).select(
        (F.col("qid").cast("long") % 3).cast("int").alias("setting"),
        F.col("step").alias("part"), "qid", "sample", "verdict")
    r = S.rollout_stats(v, by=["setting", "part"])
    return finish(S.macro_stats(S.problem_stats(r, by=["setting", "part"]), by=["setting", "part"]))


BUCKET_CTE = """
b AS (SELECT qid, max(test_case_average) AS best_tca FROM r WHERE step = 0 GROUP BY qid)"""


@register("buckets", V.with_views(["verdicts"], """
SELECT qid, round(best_tca, 6) AS best_tca, CAST(best_tca = 1.0 AS INTEGER) AS perfect,
       CAST(best_tca > 0.6 AS INTEGER) AS good,
       CAST(best_tca < 1.0 AND best_tca <= 0.6 AS INTEGER) AS bad
FROM b""", [rollout_cte(["step"]), BUCKET_CTE]))
def q_buckets(spark, sf_dir):
    """A19 on the baseline step 0."""
    r = _rollouts(spark, sf_dir).filter(F.col("step") == 0)
    return finish(S.difficulty_buckets(r))


@register("bucket_stats", V.with_views(["verdicts"], macro_select(["bucket", "step"], "pb"), [
    rollout_cte(["step"]), problem_cte(["step"]), BUCKET_CTE,
    """m AS (SELECT qid, 'perfect' AS bucket FROM b WHERE best_tca = 1.0
            UNION ALL SELECT qid, 'good' FROM b WHERE best_tca > 0.6
            UNION ALL SELECT qid, 'bad' FROM b WHERE best_tca < 1.0 AND best_tca <= 0.6)""",
    "pb AS (SELECT p.*, m.bucket FROM p JOIN m USING (qid))"]))
def q_bucket_stats(spark, sf_dir):
    """J6 + A6: macro statistics per difficulty bucket and step."""
    return finish(S.bucket_stats(S.problem_stats(_rollouts(spark, sf_dir))))


@register("bad_only", V.with_views(["verdicts"], """
SELECT CAST(p_partkey AS VARCHAR) AS qid FROM part
WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT qid FROM b WHERE best_tca = 1.0 OR best_tca > 0.6)""",
                                   [rollout_cte(["step"]), BUCKET_CTE]))
def q_bad_only(spark, sf_dir):
    """U4: problems in neither the perfect nor the good bucket."""
    r = _rollouts(spark, sf_dir).filter(F.col("step") == 0)
    problems = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qid"))
    return S.bad_only(problems, S.difficulty_buckets(r))


# Fixed parameters of the paired-delta query: the compared settings and sample budget.
DELTA_PAIRS = [("click", "view"), ("purchase", "view"), ("signup", "error")]
DELTA_SAMPLES = 3


@register("paired_delta", V.with_views(["setting_values"], f"""
SELECT a.setting AS setting_a, b.setting AS setting_b, a.part,
       round(avg(a.value - b.value), 6) AS mean_delta, count(*) AS n_pairs
FROM setting_values a JOIN setting_values b
  ON a.part = b.part AND a.qid = b.qid AND a.sample = b.sample
WHERE (a.setting, b.setting) IN ({", ".join(f"('{x}', '{y}')" for x, y in DELTA_PAIRS)})
  AND a.sample < {DELTA_SAMPLES} AND b.sample < {DELTA_SAMPLES}
GROUP BY 1, 2, 3"""))
def q_paired_delta(spark, sf_dir):
    """J5 + A20 + O8"""
    d = S.paired_delta(V.setting_values(spark, sf_dir), DELTA_PAIRS, n_samples=DELTA_SAMPLES)
    return finish(S.mean_delta(d))


# The event types that act as settings.
SETTINGS = ["click", "error", "purchase", "signup", "view"]


@register("wide_metrics", V.with_views(["setting_values"], "SELECT part, " + ", ".join(
    f"round(avg(value) FILTER (WHERE setting = '{s}'), 6) AS {s}" for s in SETTINGS)
    + " FROM setting_values GROUP BY part"))
def q_wide_metrics(spark, sf_dir):
    """Pivot settings into columns."""
    return finish(S.wide_metrics(V.setting_values(spark, sf_dir), SETTINGS))


@register("pass_rate", V.with_views(["verdicts"], """
SELECT qid, step, sample,
       round(coalesce(sum(CASE WHEN verdict > 0 THEN 1 ELSE 0 END) / count(verdict), 0.0), 6) AS pass_rate,
       CAST(sum(CASE WHEN verdict = -2 THEN 1 ELSE 0 END) = 0 AS INTEGER) AS compiles
FROM verdicts GROUP BY 1, 2, 3"""))
def q_pass_rate(spark, sf_dir):
    """A23"""
    return finish(S.pass_rate(V.verdicts(spark, sf_dir)))
