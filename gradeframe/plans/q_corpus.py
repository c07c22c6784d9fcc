"""Grading-record and corpus queries (J1-J3, J2/X25/O9, X24/X18, X26, X27, W1/X32/A25,
P5-P8, O4, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import grading as G
from ..operators import stats as S
from . import views as V
from .catalogue import register
from .q_stats import rollout_cte
from .q_text import strip

SEED = 0


@register("generations_join", V.with_views(["verdicts"], """
SELECT r.qid, r.step, r.sample, r.test_cases_run, p.p_name, p.p_brand
FROM r JOIN part p ON r.qid = CAST(p.p_partkey AS VARCHAR)""", [rollout_cte(["step"])]))
def q_generations_join(spark, sf_dir):
    """Every graded generation next to its problem (one join, not a scan per problem)."""
    r = S.rollout_stats(V.verdicts(spark, sf_dir)).select("qid", "step", "sample", "test_cases_run")
    problems = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qid"),
                                                     "p_name", "p_brand")
    return C.attach_problems(r, problems)


FIRSTS_CTE = """f AS (SELECT qid, step, sample, arg_min(verdict, test_idx) AS first_verdict,
                     min(test_idx) FILTER (WHERE verdict = -1) AS first_runtime_idx
              FROM verdicts GROUP BY 1, 2, 3)"""


def _msg(kind: str, i: str, o: str) -> str:
    return (f"'\"{kind}' || chr(10) || chr(10) || 'Input:' || chr(10) || {i} || chr(10) || 'Expected Output:' "
            f"|| chr(10) || {o} || '\"'")


@register("failing_test", V.with_views(["verdicts", "tests"], f"""
SELECT f.qid, f.step, f.sample,
       CASE WHEN f.first_verdict = -2 THEN '"Code failed to compile."'
            WHEN f.first_runtime_idx IS NOT NULL THEN {_msg('Runtime error.', 't.input', 't.expected')}
            ELSE {_msg('Test case failed.', 'rt.r_in', 'rt.r_out')} END AS message
FROM f LEFT JOIN tests t ON t.qid = f.qid AND t.test_idx = f.first_runtime_idx
LEFT JOIN (SELECT qid, arg_min(input, md5('{SEED}|' || qid || '|' || CAST(test_idx AS VARCHAR))) AS r_in,
                  arg_min(expected, md5('{SEED}|' || qid || '|' || CAST(test_idx AS VARCHAR))) AS r_out
           FROM tests GROUP BY qid) rt ON rt.qid = f.qid""", [FIRSTS_CTE]))
def q_failing_test(spark, sf_dir):
    """J2 + X25 + O9: test-based feedback per rollout."""
    return G.feedback_messages(V.verdicts(spark, sf_dir, positions=True), V.tests(spark, sf_dir), SEED)


# Fixed value: the test count assumed for a problem whose tests are not known (APPS).
DEFAULT_TESTS = 21


@register("default_verdicts", V.with_views(["verdicts"], f"""
SELECT qid, step, sample, test_idx, verdict FROM verdicts
UNION ALL
SELECT e.qid, e.step, e.sample, CAST(unnest(range(coalesce(t.n, {DEFAULT_TESTS}))) AS INTEGER) AS test_idx, -1 AS verdict
FROM (SELECT CAST(p_partkey AS VARCHAR) AS qid, s.step, s.sample
      FROM part, (SELECT DISTINCT step, sample FROM verdicts) s) e
LEFT JOIN (SELECT qid, count(*) AS n FROM verdicts GROUP BY qid) t ON t.qid = e.qid
WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.qid = e.qid AND v.step = e.step AND v.sample = e.sample)"""))
def q_default_verdicts(spark, sf_dir):
    """X26 in long form: every expected rollout (problem x the step and sample pairs of
    the run) has verdict rows; rollouts grading did not return get -1 for each of
    the problem's tests (21 where the tests are not known)."""
    v = V.verdicts(spark, sf_dir)
    n_tests = v.groupBy("qid").agg(F.count(F.lit(1)).alias("n_tests"))
    runs = v.select(F.collect_set(F.struct("step", "sample"))).scalar()        # a handful: the run's configuration
    problems = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qid"))
    expected = (problems.join(n_tests, "qid", "left").na.fill(DEFAULT_TESTS, ["n_tests"])
                .select("qid", "n_tests", F.explode(runs).alias("_r")).select("qid", "_r.step", "_r.sample", "n_tests"))
    return G.fill_missing(expected, V.verdicts(spark, sf_dir, positions=True))


@register("early_stop", V.with_views(["verdicts"], """
SELECT v.qid, v.step, v.sample, v.test_idx, v.verdict
FROM verdicts v JOIN f ON v.qid = f.qid AND v.step = f.step AND v.sample = f.sample
WHERE f.first_runtime_idx IS NULL OR v.test_idx <= f.first_runtime_idx""", [FIRSTS_CTE]))
def q_early_stop(spark, sf_dir):
    """X27 in long form: each rollout's verdicts up to and including its first runtime error."""
    return G.stop_at_first_runtime_error(V.verdicts(spark, sf_dir, positions=True))


def _trunc_sql(x: str, n: str) -> str:
    tail = f"CASE WHEN {n} = 0 THEN {x} ELSE right({x}, CAST(ceil({n} / 2) AS BIGINT)) END"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substring({x}, 1, {n} // 2) || '...(truncated) ...' || {tail} END"


_LINES = f"string_split({strip('t.input')}, chr(10))"
_SHARE = "(300 // len(string_split(t.input, chr(10))))"
_SHOWN = (f"CASE WHEN t.call_based THEN array_to_string(list_transform({_LINES}, lambda l: {_trunc_sql('l', _SHARE)}), chr(10)) "
          f"ELSE {_trunc_sql('t.input', '300')} END")


@register("error_taxonomy", V.with_views(["verdicts", "tests"], f"""
SELECT f.qid, f.step, f.sample,
       CASE WHEN f.first_verdict = -2 THEN -1 WHEN f.first_runtime_idx IS NULL THEN NULL
            WHEN f.stop_text = 'TimeoutException()' THEN -3 ELSE -4 END AS error_code,
       CASE WHEN f.first_verdict = -2 THEN CASE WHEN starts_with(f.first_text, 'AttributeError') THEN 'Unable to extract code'
                                                ELSE 'Compilation Error' END
            WHEN f.first_runtime_idx IS NULL THEN NULL
            WHEN f.stop_text = 'TimeoutException()' THEN 'Time Limit Exceeded' ELSE 'Runtime Error' END AS error_message,
       CASE WHEN f.first_runtime_idx IS NOT NULL AND f.first_verdict <> -2 THEN {_SHOWN} END AS inputs,
       CASE WHEN f.first_runtime_idx IS NOT NULL AND f.first_verdict <> -2 THEN {_trunc_sql('t.expected', '200')} END AS expected
FROM f LEFT JOIN tests t ON t.qid = f.qid AND t.test_idx = f.first_runtime_idx""", [
    """f AS (SELECT qid, step, sample, arg_min(verdict, test_idx) AS first_verdict, arg_min(coalesce(error_text, ''), test_idx) AS first_text,
             min(test_idx) FILTER (WHERE verdict = -1) AS first_runtime_idx,
             arg_min(error_text, test_idx) FILTER (WHERE verdict = -1) AS stop_text
      FROM verdicts GROUP BY 1, 2, 3)"""]))
def q_error_taxonomy(spark, sf_dir):
    """X24 + X18"""
    return G.error_taxonomy(V.verdicts(spark, sf_dir, positions=True, errors=True), V.tests(spark, sf_dir), "error_text", "call_based")


@register("todo_problems", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_todo_problems(spark, sf_dir):
    """Problems without saved labels still to do (anti-join)."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.todo(d, V.table(spark, sf_dir, "labels"), "doc_id")


# ------------------------------------------------------------------ repository corpus
def _files(spark, sf_dir):
    """Source files: each document is a file of repository ``source``."""
    d = V.table(spark, sf_dir, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, F.lit(".md")).otherwise(F.lit(".py"))
    path = F.concat(F.lit("repos/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return d.select(path.alias("path"), F.col("doc_id").alias("position"), F.col("text").alias("content"),
                    F.col("n_chars").alias("size"), "lang")


FILES_CTE = """files AS (
  SELECT 'repos/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.py' END AS path,
         doc_id AS position, text AS content, n_chars AS size, lang
  FROM documents)"""


def _significant_sql(x: str) -> str:
    return (f"CAST(len(list_filter(string_split({x}, chr(10)), lambda l: {strip('l')} <> '' "
            f"AND NOT starts_with({strip('l')}, '#'))) AS INTEGER)")


def _significant(c):
    return F.size(F.filter(F.split(c, "\n", -1), lambda l: (X.py_strip(l) != "") & ~X.py_strip(l).startswith("#")))


MAX_PER_REPO = 5


@register("top_per_repo", V.with_views([], f"""
SELECT repo, path, CAST(rn - 1 AS INTEGER) AS index, significant_lines
FROM (SELECT string_split(path, '/')[-2] AS repo, path, significant_lines,
             row_number() OVER (PARTITION BY string_split(path, '/')[-2] ORDER BY path) AS rn
      FROM (SELECT path, {_significant_sql('content')} AS significant_lines FROM files WHERE ends_with(path, '.py')) a
      WHERE significant_lines > 20) b
WHERE rn <= {MAX_PER_REPO}""", [FILES_CTE]))
def q_top_per_repo(spark, sf_dir):
    """W1 + X32 + P7: at most 5 functions with > 20 significant lines per repository, indexed."""
    f = _files(spark, sf_dir).filter(F.col("path").endswith(".py"))
    fn = C.significant(f.select("path", _significant(F.col("content")).alias("significant_lines")))
    fn = fn.withColumn("repo", X.repo_name(F.col("path")))
    return C.top_k_per_group(fn, ["repo"], ["path"], MAX_PER_REPO).select("repo", "path", "index",
                                                                           "significant_lines")


@register("found_counts", V.with_views([], f"""
SELECT repo, count(*) AS n_functions FROM (
  SELECT string_split(path, '/')[-2] AS repo,
         row_number() OVER (PARTITION BY string_split(path, '/')[-2] ORDER BY path) AS rn
  FROM files WHERE ends_with(path, '.py') AND {_significant_sql('content')} > 20) a
WHERE rn <= {MAX_PER_REPO} GROUP BY repo""", [FILES_CTE]))
def q_found_counts(spark, sf_dir):
    """Functions found per repository."""
    t = q_top_per_repo(spark, sf_dir)
    return t.groupBy("repo").agg(F.count(F.lit(1)).alias("n_functions"))


MIN_STARS, MAX_SIZE_KB, MIN_LINES = 10, 10_000_000, 30


@register("repo_filter", V.with_views([], f"""
SELECT r.repo, r.stars, r.size_kb, coalesce(l.long_file, false) AS long_file
FROM (SELECT string_split(path, '/')[-2] AS repo, count(*) AS stars, CAST(floor(sum(size) / 1000) AS BIGINT) AS size_kb,
             arg_max(lang, position) AS language
      FROM files GROUP BY 1) r
LEFT JOIN (SELECT string_split(path, '/')[-2] AS repo,
                  len(string_split_regex(arg_min(content, position), '\\r\\n|[\\n\\r]')) > {MIN_LINES} AS long_file
           FROM files WHERE ends_with(path, '.py') AND size > {MIN_LINES * 40} GROUP BY 1) l ON r.repo = l.repo
WHERE r.language = 'en' AND r.stars >= {MIN_STARS} AND r.size_kb <= {MAX_SIZE_KB}
ORDER BY r.stars DESC, r.repo LIMIT 100""", [FILES_CTE]))
def q_repo_filter(spark, sf_dir):
    """P5 + P8 + O4: eligible repositories (language, stars, size) with the long-file check; top 100 by stars."""
    f = _files(spark, sf_dir).withColumn("repo", X.repo_name(F.col("path")))
    repos = f.groupBy("repo").agg(F.count(F.lit(1)).alias("stars"),
                                  F.floor(F.sum("size") / 1000).cast("long").alias("size_kb"),
                                  F.max_by("lang", "position").alias("language"))
    ok = C.eligible_repos(repos, "en", MIN_STARS, MAX_SIZE_KB, size="size_kb")
    long_file = C.has_long_python_file(f, MIN_LINES)
    out = ok.join(long_file, "repo", "left").select(
        "repo", "stars", "size_kb", F.coalesce(F.col("long_file"), F.lit(False)).alias("long_file"))
    return out.orderBy(F.desc("stars"), "repo").limit(100)


PER_DAY = 100      # the search returns one page a day


@register("repos_by_day", f"""
SELECT created, repo, stars, CAST(rn - 1 AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY created ORDER BY stars DESC, repo) AS rn
  FROM (SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 7 AS INTEGER) AS DATE) AS created, doc_id AS repo, n_chars AS stars FROM documents) a
  WHERE stars >= {MIN_STARS} AND created >= DATE '2024-01-02') b WHERE rn <= {PER_DAY}""")
def q_repos_by_day(spark, sf_dir):
    """P8 + O4 + W1: the repositories created on each day, the 100 with most stars of each."""
    d = V.table(spark, sf_dir, "documents").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int")).alias("created"),
        F.col("doc_id").alias("repo"), F.col("n_chars").alias("stars"))
    ok = d.filter((F.col("stars") >= MIN_STARS) & (F.col("created") >= F.lit("2024-01-02").cast("date")))
    return C.top_repos_per_day(ok, PER_DAY).select("created", "repo", "stars", "rank")


@register("first_py", V.with_views([], """
SELECT repo, path, content FROM (
  SELECT string_split(path, '/')[-2] AS repo, arg_min(path, position) AS path, arg_min(content, position) AS content
  FROM files WHERE ends_with(path, '.py') GROUP BY 1) a WHERE content <> ''""", [FILES_CTE]))
def q_first_py(spark, sf_dir):
    """The first .py file of each repository, if not empty."""
    f = _files(spark, sf_dir).withColumn("repo", X.repo_name(F.col("path")))
    return C.first_python_file(f)


@register("functions_append", V.with_views([], f"""
SELECT string_split(path, '/')[-2] AS repo, path, 'old' AS origin, lang FROM files
UNION ALL
SELECT string_split(path, '/')[-2] AS repo, path, 'new' AS origin, NULL AS lang FROM files""",
    [FILES_CTE]))
def q_functions_append(spark, sf_dir):
    """U2 + P3: old records followed by new ones, duplicates kept; a column that only the old ones have is NULL in the new."""
    f = _files(spark, sf_dir).withColumn("repo", X.repo_name(F.col("path")))
    old = f.select("repo", "path", F.lit("old").alias("origin"), "lang")
    new = f.select("repo", "path", F.lit("new").alias("origin"))
    return C.union_optional([old, new])
