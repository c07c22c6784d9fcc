"""Rollout / conversation queries over ``turns`` (W2, W3, W5-W7, W9, J4, J7-J9,
A11, A18, A21, A24, X6, X28-X30, P14, P15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import history as H
from ..operators import prompts as PR
from . import views as V
from .catalogue import register

SEP = " ||| "
STRIP = "trim({}, (' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"


def _strip(x: str) -> str:
    return STRIP.format(x)


STEP_CODE_CTE = """sc AS (SELECT qid, sample, step, arg_max(text, turn) AS final_code
                     FROM turns WHERE role = 'assistant' GROUP BY 1, 2, 3)"""


@register("regroup_by_step", V.with_views(["turns"], f"""
SELECT qid, step, count(*) AS n_samples, string_agg(final_code, '{SEP}' ORDER BY sample) AS codes
FROM sc GROUP BY qid, step""", [STEP_CODE_CTE]))
def q_regroup_by_step(spark, sf_dir):
    """A24 + A11: per (problem, step) the final codes of all samples in sample order."""
    sc = H.step_code(V.turns(spark, sf_dir))
    return H.regroup_by_step(sc, sep=SEP)


@register("final_code", V.with_views(["turns"], f"""
SELECT p.qid, p.p_name, c.n_samples, c.code
FROM (SELECT CAST(p_partkey AS VARCHAR) AS qid, p_name FROM part) p
JOIN (SELECT qid, count(*) AS n_samples, string_agg(final_code, '{SEP}' ORDER BY sample) AS code
      FROM (SELECT qid, sample, arg_max(final_code, step) AS final_code, max(step) + 1 AS total_ir_steps
            FROM sc GROUP BY qid, sample) f
      GROUP BY qid) c ON p.qid = c.qid""", [STEP_CODE_CTE]))
def q_final_code(spark, sf_dir):
    """W5 + A18 + J7: last step's code per sample, collected per problem, joined to problem metadata."""
    finals = H.rollout_final(H.step_code(V.turns(spark, sf_dir)))
    codes = H.codes_by_sample(finals, sep=SEP)
    problems = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qid"), "p_name")
    return H.summary_record(problems, codes)


# The feedback classification labels.
LABELS = ["CORRECT", "CORRECT BUT SUBOPTIMAL", "PARTIALLY INCORRECT", "INCORRECT", "NONE OF THE ABOVE"]


def _label_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate(LABELS))
    raw = f"(text || chr(10) || 'Class: ' || CASE CAST(turn % 5 AS INTEGER) {cases} END)"
    return (f"CASE WHEN contains({raw}, 'Class:') THEN {_strip(f'split_part({raw}, {chr(39)}Class:{chr(39)}, 2)')} "
            f"ELSE {raw} END")


@register("sample_labels", V.with_views(["turns"], f"""
SELECT qid, sample, string_agg(label, ',' ORDER BY step) AS labels
FROM (SELECT qid, sample, step, arg_max(label, turn) AS label
      FROM (SELECT qid, sample, step, turn, {_label_sql()} AS label FROM turns WHERE role = 'assistant') l
      GROUP BY 1, 2, 3) s
GROUP BY qid, sample"""))
def q_sample_labels(spark, sf_dir):
    """A21 + X6: a model's classification reply per step is parsed into its label;
    the labels of steps 0-3 are listed in step order per sample."""
    t = V.turns(spark, sf_dir).filter(F.col("role") == "assistant")
    lab = F.try_element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("turn") % 5 + 1).cast("int"))
    reply = F.concat(F.col("text"), F.lit("\nClass: "), lab)
    t = t.withColumn("label", X.parse_class_label(reply))
    per_step = t.groupBy("qid", "sample", "step").agg(F.max_by("label", "turn").alias("label"))
    return H.labels_by_step(per_step, max_step=None).select("qid", "sample", F.array_join("labels", ",").alias("labels"))


def _drop_first_line_sql(x: str) -> str:
    return f"array_to_string(list_slice(string_split({_strip(x)}, chr(10)), 2, 1000000000), chr(10))"


@register("warm_start", V.with_views(["turns"], f"""
SELECT s.qid, s.sample, s.step, p.code AS prev_solution, {_drop_first_line_sql('p.feedback')} AS user_response
FROM st s LEFT JOIN st p ON s.qid = p.qid AND s.sample = p.sample AND s.step = p.step + 1""",
    ["""st AS (SELECT qid, sample, step,
                      arg_max(text, turn) FILTER (WHERE role = 'assistant') AS code,
                      arg_max(text, turn) FILTER (WHERE role = 'user') AS feedback
               FROM turns GROUP BY 1, 2, 3)"""]))
def q_warm_start(spark, sf_dir):
    """J4 + W6: previous step's code and feedback (first line dropped) carried into each step."""
    return H.warm_start(H.step_feedback(V.turns(spark, sf_dir)))


PREFILL = "```python"


@register("chat_history", V.with_views([], f"""
SELECT conv_id, CAST(-1 AS BIGINT) AS request, CAST(turn + 1 AS BIGINT) AS msg_idx, role, text AS content
FROM conversations WHERE role <> 'system'
UNION ALL
SELECT conv_id, -1, 0, 'system', arg_min(text, turn) FROM conversations WHERE role = 'system' GROUP BY conv_id
UNION ALL
SELECT conv_id, -1, max(turn) + 2, 'assistant', '{PREFILL}' FROM conversations GROUP BY conv_id"""))
def q_chat_history(spark, sf_dir):
    """W2 with history: the pending request of each conversation, in message order, plus prefill."""
    return H.chat_messages(V.table(spark, sf_dir, "conversations"), include_history=True, prefill=PREFILL)


@register("chat_requests_merged", V.with_views([], """
SELECT u.conv_id, u.turn AS request, CAST(0 AS BIGINT) AS msg_idx, 'user' AS role,
       coalesce(s.sys, '') || chr(10) || chr(10) || u.text AS content
FROM conversations u
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS sys FROM conversations WHERE role = 'system' GROUP BY conv_id) s
  ON u.conv_id = s.conv_id
WHERE u.role = 'user'"""))
def q_chat_requests_merged(spark, sf_dir):
    """W2 without history, system merged into the user message (Gemma/Reka form)."""
    return H.chat_messages(V.table(spark, sf_dir, "conversations"), include_history=False, merge_system=True)


_PIECE = "CASE WHEN role = 'assistant' THEN text WHEN role = 'user' THEN chr(10) || text ELSE '' END"


@register("context_pieces", V.with_views([], f"""
SELECT conv_id, turn, {_PIECE} AS piece FROM conversations"""))
def q_context_pieces(spark, sf_dir):
    """What each turn adds to the running context (code as is, comments after a newline)."""
    return H.context_pieces(V.table(spark, sf_dir, "conversations"))


@register("context_offsets", V.with_views([], f"""
SELECT conv_id, turn, CAST(sum(length({_PIECE})) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_offset
FROM conversations"""))
def q_context_offsets(spark, sf_dir):
    """Where the running context ends after each turn."""
    return H.context_offsets(V.table(spark, sf_dir, "conversations"))


# Generation loops of one step: a document's lines as pieces, then doc_id mod 13 blank ones; the
# loop of every third document ends with a code fence.
LOOPS_CTE = """loops AS (
  SELECT CAST(doc_id AS VARCHAR) AS qid, 0 AS sample, CAST(0 AS BIGINT) AS step, 'assistant' AS role, turn, text FROM (
    SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS turn FROM (
      SELECT doc_id, list_concat(list_concat(list_transform(string_split(text, chr(10)), lambda x: x || chr(10)),
                                             list_transform(range(doc_id % 13), lambda x: ' ' || chr(10))),
                                 CASE WHEN doc_id % 3 = 0 THEN ['```'] ELSE []::VARCHAR[] END) AS l FROM documents) a) b)"""


def _loops(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    blanks = F.array_repeat(F.lit(" \n"), (F.col("doc_id") % 13).cast("int"))
    fence = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("```"))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(F.transform(F.split("text", "\n", -1), lambda l: F.concat(l, F.lit("\n"))), blanks, fence)
    return d.select(F.col("doc_id").cast("string").alias("qid"), F.lit(0).alias("sample"), F.lit(0).cast("long").alias("step"),
                    F.lit("assistant").alias("role"), F.posexplode(pieces).alias("turn", "text"))


_NS = f"(count(*) FILTER (WHERE {_strip('text')} = '') - arg_min(CAST({_strip('text')} = '' AS INTEGER), turn))"


@register("stuck_runs", V.with_views([], f"""
SELECT qid, sample, step, count(*) AS n_turns, {_NS} AS n_stuck,
       CAST({_NS} >= 10 AS INTEGER) AS given_up,
       CASE WHEN {_NS} >= 10 THEN '' ELSE string_agg(text, '' ORDER BY turn) END AS final_code
FROM loops WHERE role = 'assistant' GROUP BY 1, 2, 3""", [LOOPS_CTE]))
def q_stuck_runs(spark, sf_dir):
    """Blank continuations counted per step; at 10 the sample is given up, else its accumulated code."""
    return H.stuck_runs(_loops(spark, sf_dir))


#: Characters of a chunk in the queries below.
QUERY_CHUNK = 1000


@register("final_code_chunks", V.with_views([], f"""
SELECT qid, sample, step, CAST(chunk AS BIGINT) AS chunk, substr(code, CAST(chunk * {QUERY_CHUNK} + 1 AS INTEGER), {QUERY_CHUNK}) AS chars FROM (
  SELECT qid, sample, step, code, unnest(range(CAST(ceil(length(code) / {QUERY_CHUNK}.0) AS BIGINT))) AS chunk FROM (
    SELECT qid, sample, step, string_agg(text, '' ORDER BY turn) AS code FROM loops
    WHERE role = 'assistant' GROUP BY 1, 2, 3 HAVING {_NS} < 10) c) x""", [LOOPS_CTE]))
def q_final_code_chunks(spark, sf_dir):
    """The accumulated code of every step that was not given up, in chunks; no row holds a whole step."""
    return H.final_code_chunks(_loops(spark, sf_dir), size=QUERY_CHUNK)


@register("running_text", V.with_views([], f"""
SELECT conv_id, turn, CAST(chunk AS BIGINT) AS chunk, substr(code, CAST(chunk * {QUERY_CHUNK} + 1 AS INTEGER), {QUERY_CHUNK}) AS chars FROM (
  SELECT conv_id, turn, code, unnest(range(CAST(ceil(length(code) / {QUERY_CHUNK}.0) AS BIGINT))) AS chunk FROM (
    SELECT conv_id, turn, string_agg({_PIECE}, '') OVER (PARTITION BY conv_id ORDER BY turn) AS code,
           max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) c
  WHERE turn = last OR turn = 2) x"""))
def q_running_text(spark, sf_dir):
    """The running context after turn 2 and after the last turn of every conversation, in chunks."""
    t = V.table(spark, sf_dir, "conversations")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    chosen = last.unionByName(t.filter("turn = 2").select("conv_id", "turn")).distinct()
    return H.running_text(t, chosen, size=QUERY_CHUNK)


@register("rounds", V.with_views([], """
SELECT t.turn, t.qid, t.sample, t.step, CAST(t.turn - f.first_turn AS INTEGER) AS round_idx,
       CAST(contains(t.text, '```') AS INTEGER) AS is_finished
FROM loops t JOIN (SELECT qid, sample, step, min(turn) AS first_turn FROM loops GROUP BY 1, 2, 3) f
  ON t.qid = f.qid AND t.sample = f.sample AND t.step = f.step""", [LOOPS_CTE]))
def q_rounds(spark, sf_dir):
    """W7 + X30: round index inside each step and the finished flag per turn."""
    r = H.number_rounds(_loops(spark, sf_dir))
    return r.select("turn", "qid", "sample", "step", "round_idx",
                    H.finished(F.col("text")).cast("int").alias("is_finished"))


@register("round_counts", V.with_views([], """
SELECT qid, sample, step, count(*) AS n_rounds, count(*) + 1 AS total_rounds,
       CAST(max(CAST(contains(text, '```') AS INTEGER)) AS INTEGER) AS is_finished
FROM loops GROUP BY 1, 2, 3""", [LOOPS_CTE]))
def q_round_counts(spark, sf_dir):
    """Rounds per step; the recorded count is rounds + 1."""
    return H.round_summary(_loops(spark, sf_dir))


# ------------------------------------------------------------------ P4 P9 P16 P17
@register("single_problem", V.with_views(["turns"], "SELECT qid, sample, step, turn FROM turns WHERE qid = '3'"))
def q_single_problem(spark, sf_dir):
    """The turns of one problem."""
    from ..operators import corpus as C
    return C.single_problem(V.turns(spark, sf_dir), "3").select("qid", "sample", "step", "turn")


@register("existing_steps", V.with_views(["turns"], """
SELECT t.qid, t.sample, t.step, t.turn FROM turns t
WHERE EXISTS (SELECT 1 FROM turns u WHERE u.role = 'assistant' AND u.qid = t.qid AND u.sample = t.sample AND u.step = t.step)"""))
def q_existing_steps(spark, sf_dir):
    """P9 + P16: only (problem, sample, step) that have a generation."""
    from ..operators import corpus as C
    t = V.turns(spark, sf_dir)
    return C.existing_steps(t.select("qid", "sample", "step", "turn"), t.filter("role = 'assistant'"))


@register("complete_samples", V.with_views(["turns"], """
SELECT t.qid, t.step, t.sample, t.turn, CAST(g.n >= 4 AS INTEGER) AS complete
FROM turns t JOIN (SELECT qid, step, count(DISTINCT sample) AS n FROM turns GROUP BY 1, 2) g ON t.qid = g.qid AND t.step = g.step"""))
def q_complete_samples(spark, sf_dir):
    """Groups with all samples, and the quarantined rest."""
    from ..operators import corpus as C
    return C.mark_complete(V.turns(spark, sf_dir).select("qid", "step", "sample", "turn"), 4)


# ------------------------------------------------------------------ prompts
# Fixed parameters: a small prompt config used by the prompt-rendering query.
PROMPT_CONFIG = {
    "asst_code_sys": "You write Python code that solves the problem.  \n",
    "asst_code_apps_sys_suffix": "Print the answer to standard output.",
    "asst_initial_code_query": "Problem:\n{underspec_question}\n{starter}\n",
    "asst_code_query": "Problem:\n{underspec_question}\nCode so far:\n{partial_solution}\n{starter}",
    "asst_code_prefill": "```python\n{partial_solution}",
}
PROMPT_TYPES = ["asst_initial_code", "asst_code"]
TASKS = ["apps", "livecodebench"]
FEEDBACK_TYPE = "input_refinement"


def _prompt_rows(spark, sf_dir):
    t = V.turns(spark, sf_dir)
    users = t.filter(F.col("role") == "user")
    first_q = users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    prev = t.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("partial_solution"))
    task = F.when(F.col("conv_id") % 2 == 0, F.lit("apps")).otherwise(F.lit("livecodebench"))
    starter = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("def solve_"), F.col("qid"), F.lit("():")))
    return (users.join(first_q, "conv_id").join(prev, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "step",
                    X.prompt_type(F.col("step")).alias("prompt_type"), task.alias("task"),
                    X.effective_question(F.lit(FEEDBACK_TYPE), F.col("step"), F.col("text"), F.col("question"))
                    .alias("underspec_question"),
                    F.coalesce(F.col("partial_solution"), F.lit("")).alias("partial_solution"),
                    X.starter_block(task, starter).alias("starter")))


def _sql_lit(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _prompt_sql() -> str:
    rows = PR.template_rows(PROMPT_CONFIG, PROMPT_TYPES, TASKS)

    def v(x):
        return "NULL" if x is None else _sql_lit(x)
    tmpl = " UNION ALL ".join(
        f"SELECT '{pt}' AS prompt_type, '{tk}' AS task, {v(s)} AS sys, {v(q)} AS query, {v(p)} AS prefill, "
        f"{v(sx)} AS sys_suffix" for pt, tk, s, q, p, sx in rows)

    def fill(x):
        out = x
        for slot in ("underspec_question", "partial_solution", "starter"):
            out = f"replace({out}, '{{{slot}}}', {slot})"
        return out
    sys_ = (f"CASE WHEN sys_suffix IS NULL THEN {fill('sys')} ELSE "
            f"rtrim({fill('sys')}, (' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) || ' ' || {fill('sys_suffix')} END")
    starter_txt = "CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'def solve_' || qid || '():' END"
    starter = (f"CASE WHEN task = 'livecodebench' AND {starter_txt} <> '' THEN "
               f"'Here is the starter code that you must continue:' || chr(10) || chr(10) || '```python' || chr(10) "
               f"|| {starter_txt} || chr(10) || chr(10) || '```' ELSE '' END")
    rows_cte = """rows AS (
  SELECT u.conv_id, u.turn, u.step, CASE WHEN u.step = 0 THEN 'asst_initial_code' ELSE 'asst_code' END AS prompt_type,
         CASE WHEN u.conv_id % 2 = 0 THEN 'apps' ELSE 'livecodebench' END AS task, u.qid,
         CASE WHEN u.step > 0 THEN u.text ELSE q.question END AS underspec_question,
         coalesce(a.text, '') AS partial_solution
  FROM turns u
  JOIN (SELECT conv_id, arg_min(text, turn) AS question FROM turns WHERE role = 'user' GROUP BY conv_id) q
    ON u.conv_id = q.conv_id
  LEFT JOIN (SELECT conv_id, turn + 1 AS turn, text FROM turns WHERE role = 'assistant') a
    ON u.conv_id = a.conv_id AND u.turn = a.turn
  WHERE u.role = 'user')"""
    body = f"""
SELECT conv_id, turn, step, prompt_type, task, underspec_question, partial_solution, starter,
       {_strip(sys_)} AS sys_prompt, {_strip(fill('query'))} AS query_prompt, {_strip(fill('prefill'))} AS prefill
FROM r2 LEFT JOIN tmpl USING (prompt_type, task)"""
    return V.with_views(["turns"], body, [f"tmpl AS ({tmpl})", rows_cte,
                                          f"r2 AS (SELECT *, {starter} AS starter FROM rows)"])


@register("prompt_render", _prompt_sql())
def q_prompt_render(spark, sf_dir):
    """J8 + X28 + X29 + P14 + P15: render the code prompt of every user turn."""
    rows = _prompt_rows(spark, sf_dir)
    tmpl = PR.templates(spark, PROMPT_CONFIG, PROMPT_TYPES, TASKS)
    slots = {s: F.col(s) for s in ("underspec_question", "partial_solution", "starter")}
    return PR.render_prompts(rows, tmpl, slots)


# Fixed parameters: the classification prompt (one template for all rows).
LABEL_TEMPLATE = "Step {step} feedback:\n{feedback}\nAnswer with Class: <label>."


@register("label_prompts", V.with_views(["turns"], """
SELECT conv_id, turn, """ + _strip("replace(replace(" + _sql_lit(LABEL_TEMPLATE)
                                   + ", '{step}', CAST(step AS VARCHAR)), '{feedback}', text)") + """ AS prompt
FROM turns WHERE role = 'user'"""))
def q_label_prompts(spark, sf_dir):
    """J9 + X28: one classification template filled for every feedback turn (no join needed)."""
    t = V.turns(spark, sf_dir).filter(F.col("role") == "user")
    return t.select("conv_id", "turn", PR.render_fixed(LABEL_TEMPLATE, {
        "step": F.col("step"), "feedback": F.col("text")}).alias("prompt"))


# ------------------------------------------------------------------ P13
RESHAPE = {"oracle": "code_completions_w_comments", "baseline": "code_completions_wo_comments"}


@register("record_reshape", V.with_views(["turns"], """
SELECT s.setting, a.qid, a.sample, a.step AS part, CASE WHEN s.setting = 'oracle' THEN st.q_last ELSE st.q_first END AS query,
       a.turn, a.text AS response
FROM turns a CROSS JOIN (SELECT unnest(['oracle', 'baseline']) AS setting) s JOIN st ON a.qid = st.qid AND a.sample = st.sample AND a.step = st.step
WHERE a.role = 'assistant'""", [
    """st AS (SELECT qid, sample, step, arg_max(text, turn) FILTER (WHERE role = 'user') AS q_last,
                      arg_min(text, turn) FILTER (WHERE role = 'user') AS q_first
               FROM turns GROUP BY 1, 2, 3)"""]))
def q_record_reshape(spark, sf_dir):
    """Old records carry one query per completion style; each new setting keeps its
    style's query and the responses, one long row per response."""
    from ..operators import corpus as C
    t = V.turns(spark, sf_dir)
    user = F.col("role") == "user"
    queries = t.groupBy("qid", "sample", "step").agg(
        F.max_by("text", F.when(user, F.col("turn"))).alias(RESHAPE["oracle"]),
        F.min_by("text", F.when(user, F.col("turn"))).alias(RESHAPE["baseline"]))
    responses = t.filter("role = 'assistant'").select("qid", "sample", "step", "turn", F.col("text").alias("response"))
    return C.reshape_records(responses.join(queries, ["qid", "sample", "step"]), RESHAPE).select(
        "setting", "qid", "sample", F.col("step").alias("part"), "query", "turn", "response")
