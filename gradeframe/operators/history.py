"""Conversation and rollout history.

Input is the long turn table ``turns(qid, sample, step, conv_id, turn, role,
text)``; ``turn`` is the dense position of a message inside its conversation
(as produced by ``posexplode`` of the message array).

Scale notes: neighbouring rows are reached with equi-joins on arithmetic of
the dense positions (``turn - 1``, ``step - 1``) instead of ordered windows,
so no task has to sort a whole hot conversation; per-group values (first,
last) are ``min_by``/``max_by`` aggregates with map-side partial aggregation.
Only lists bounded by the generation budget (samples per problem, steps per
rollout) are collected into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ROLLOUT = ("qid", "sample")
STEP = ("qid", "sample", "step")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ W7 X30
def finished(code) -> Column:
    """A solution is finished once it contains a code fence."""
    return F.contains(_c(code), F.lit("```"))


def should_stop(stopping_condition, query_needed=None) -> Column:
    """Stop for a user query when always asked to, or when the assistant wants one
    (the reference's assistant always wants one, the default here)."""
    sc = _c(stopping_condition)
    q = F.lit(True) if query_needed is None else _c(query_needed)
    return (sc == "always_stop") | ((sc == "ask_asst") & q)


def number_rounds(turns: DataFrame, keys: Sequence[str] = STEP, pos: str = "turn") -> DataFrame:
    """Round index inside each step (0-based) from the dense positions."""
    first = turns.groupBy(*keys).agg(F.min(pos).alias("_first"))
    return (turns.join(first, list(keys))
            .withColumn("round_idx", (F.col(pos) - F.col("_first")).cast("int")).drop("_first"))


def round_summary(turns: DataFrame, keys: Sequence[str] = STEP, text: str = "text") -> DataFrame:
    """W7 + X30: rounds per step; the recorded count is rounds + 1; finished flag."""
    return turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rounds"),
        (F.count(F.lit(1)) + 1).alias("total_rounds"),
        F.max(finished(F.col(text)).cast("int")).alias("is_finished"))


# ------------------------------------------------------------------ W5 A18 J7
def step_code(turns: DataFrame, keys: Sequence[str] = STEP, role: str = "assistant") -> DataFrame:
    """Final code of each step: the last ``role`` message of the step."""
    t = turns.filter(F.col("role") == role)
    return t.groupBy(*keys).agg(F.max_by("text", "turn").alias("final_code"))


def rollout_final(step_codes: DataFrame, keys: Sequence[str] = ROLLOUT, step: str = "step") -> DataFrame:
    """Final answer of a rollout = the last step's code; step count = last index + 1."""
    return step_codes.groupBy(*keys).agg(
        F.max_by("final_code", step).alias("final_code"),
        (F.max(step) + 1).alias("total_ir_steps"))


def codes_by_sample(finals: DataFrame, problem: str = "qid", sample: str = "sample",
                    code: str = "final_code", sep: str | None = None) -> DataFrame:
    """Final code per sample, collected in sample order (list bounded by samples per problem).

    With ``sep`` the list is returned as one text joined by ``sep``.
    """
    lst = F.transform(F.array_sort(F.collect_list(F.struct(F.col(sample), F.col(code)))),
                      lambda x: x[code])
    out = finals.groupBy(problem).agg(F.count(F.lit(1)).alias("n_samples"), lst.alias("code"))
    if sep is not None:
        out = out.withColumn("code", F.array_join("code", sep))
    return out


def summary_record(problems: DataFrame, codes: DataFrame, problem: str = "qid") -> DataFrame:
    """Problem metadata joined with its collected rollout codes."""
    return problems.join(codes, problem)


# ------------------------------------------------------------------ A24 A11
def regroup_by_step(step_codes: DataFrame, problem: str = "qid", step: str = "step",
                    sample: str = "sample", sep: str | None = None) -> DataFrame:
    """Per (problem, step), the codes over samples in sample order."""
    lst = F.transform(F.array_sort(F.collect_list(F.struct(F.col(sample), F.col("final_code")))),
                      lambda x: x["final_code"])
    out = step_codes.groupBy(problem, step).agg(F.count(F.lit(1)).alias("n_samples"), lst.alias("codes"))
    if sep is not None:
        out = out.withColumn("codes", F.array_join("codes", sep))
    return out


def regroup_results(graded: DataFrame, problem: str | Sequence[str] = "qid", pos: str = "position",
                    value: str = "result", meta: str | None = None) -> DataFrame:
    """Flat grading rows back into per-problem lists ordered by position;
    metadata kept as JSON text. Lists are built from one row per graded
    generation, so their length is the sample budget."""
    keys = [problem] if isinstance(problem, str) else list(problem)
    fields = [F.col(pos), F.col(value)] + ([F.to_json(F.col(meta)).alias("meta")] if meta else [])
    lst = F.array_sort(F.collect_list(F.struct(*fields)))
    out = graded.groupBy(*keys).agg(lst.alias("_l"))
    cols = [*keys, F.transform("_l", lambda x: x[value]).alias("results")]
    if meta:
        cols.append(F.transform("_l", lambda x: x["meta"]).alias("metadata"))
    return out.select(*cols)


# ------------------------------------------------------------------ A21 X6
def labels_by_step(labelled: DataFrame, keys: Sequence[str] = ROLLOUT, step: str = "step",
                   label: str = "label", *, max_step: int | None) -> DataFrame:
    """Labels of each sample as a list ordered by step (steps 0..max_step; None: all)."""
    t = labelled if max_step is None else labelled.filter(F.col(step) <= max_step)
    lst = F.transform(F.array_sort(F.collect_list(F.struct(F.col(step), F.col(label)))),
                      lambda x: x[label])
    return t.groupBy(*keys).agg(lst.alias("labels"))


# ------------------------------------------------------------------ J4 W6
def step_feedback(turns: DataFrame, keys: Sequence[str] = STEP) -> DataFrame:
    """Per step: last assistant message (code / query) and last user message (feedback)."""
    return turns.groupBy(*keys).agg(
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("code"),
        F.max_by(F.when(F.col("role") == "user", F.col("text")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("feedback"))


def drop_first_line(s) -> Column:
    """Feedback loses its first line: ``"\\n".join(s.strip().split("\\n")[1:])``."""
    st = X.py_strip(_c(s))
    return F.array_join(F.slice(F.split(st, "\n"), F.lit(2), F.size(F.split(st, "\n"))), "\n")


def warm_start(per_step: DataFrame, keys: Sequence[str] = ROLLOUT, step: str = "step") -> DataFrame:
    """J4 + W6: carry the previous step's code and feedback into each step.

    An equi-join on (qid, sample, step - 1): each side is unique per key.
    """
    prev = per_step.select(*keys, (F.col(step) + 1).alias(step),
                           F.col("code").alias("prev_solution"),
                           drop_first_line(F.col("feedback")).alias("user_response"))
    return per_step.select(*keys, step).join(prev, [*keys, step], "left")


# ------------------------------------------------------------------ W2
def chat_messages(turns: DataFrame, include_history: bool = True, merge_system: bool = False,
                  prefill: str | Column | None = None, conv: str = "conv_id",
                  pos: str = "turn", prefill_in_query: bool = False) -> DataFrame:
    """The message list sent to the model, in long form (conv, request, msg_idx, role, content).

    * include_history: one request per conversation holding every message in
      order (the pending call) - linear in the input, no per-turn copies.
    * no history: one request per user turn = [system, that user turn].
    * merge_system (Gemma/Reka): the system text is merged into the user
      message as ``sys + "\\n\\n" + query`` and no system message is sent;
      ``merge_system="all"`` merges it into every user message of the history.
    * prefill: appended as a last assistant message, or - ``prefill_in_query``,
      the OpenAI-style clients - added to the last user message after a blank line.
    """
    if prefill is not None and prefill_in_query:
        last_user = turns.filter(F.col("role") == "user").groupBy(conv).agg(F.max(pos).alias("_lu"))
        pf = F.lit(prefill) if isinstance(prefill, str) else prefill
        turns = (turns.join(last_user, conv, "left")
                 .withColumn("text", F.when(F.col(pos) == F.col("_lu"),
                                            F.concat(F.col("text"), F.lit("\n\n"), pf)).otherwise(F.col("text")))
                 .drop("_lu"))
        prefill = None
    sys_ = turns.filter(F.col("role") == "system").groupBy(conv).agg(
        F.min_by("text", pos).alias("_sys"))
    body = turns.filter(F.col("role") != "system").join(sys_, conv, "left")
    sys_text = F.coalesce(F.col("_sys"), F.lit(""))
    if include_history:
        first_user = body.filter(F.col("role") == "user").groupBy(conv).agg(F.min(pos).alias("_fu"))
        body = body.join(first_user, conv, "left")
        content = F.col("text")
        if merge_system == "all":      # Reka: every user message carries the system text
            content = F.when(F.col("role") == "user",
                             F.concat(sys_text, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
        elif merge_system:             # Gemma: only the first user message
            content = F.when(F.col(pos) == F.col("_fu"),
                             F.concat(sys_text, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
        msgs = body.select(conv, F.lit(-1).cast("long").alias("request"),
                           (F.col(pos) + 1).cast("long").alias("msg_idx"), "role", content.alias("content"))
        if not merge_system:
            sysm = sys_.select(conv, F.lit(-1).cast("long").alias("request"), F.lit(0).cast("long").alias("msg_idx"),
                               F.lit("system").alias("role"), F.col("_sys").alias("content"))
            msgs = msgs.unionByName(sysm)
        if prefill is not None:
            last = turns.groupBy(conv).agg(F.max(pos).alias("_last"))
            pf = last.select(conv, F.lit(-1).cast("long").alias("request"), (F.col("_last") + 2).cast("long").alias("msg_idx"),
                             F.lit("assistant").alias("role"),
                             (F.lit(prefill) if isinstance(prefill, str) else prefill).alias("content"))
            msgs = msgs.unionByName(pf)
        return msgs
    users = body.filter(F.col("role") == "user")
    if merge_system:
        return users.select(conv, F.col(pos).cast("long").alias("request"), F.lit(0).cast("long").alias("msg_idx"),
                            F.lit("user").alias("role"),
                            F.concat(sys_text, F.lit("\n\n"), F.col("text")).alias("content"))
    s = users.select(conv, F.col(pos).cast("long").alias("request"), F.lit(0).cast("long").alias("msg_idx"),
                     F.lit("system").alias("role"), sys_text.alias("content"))
    u = users.select(conv, F.col(pos).cast("long").alias("request"), F.lit(1).cast("long").alias("msg_idx"),
                     F.lit("user").alias("role"), F.col("text").alias("content"))
    return s.unionByName(u)


# ------------------------------------------------------------------ W9
def context_piece(role="role", text="text") -> Column:
    """What a turn adds to the running context: code is appended as is,
    a comment after a newline, anything else adds nothing."""
    r, t = _c(role), _c(text)
    return (F.when(r == "assistant", t)
            .when(r == "user", F.concat(F.lit("\n"), t))
            .otherwise(F.lit("")))


def context_pieces(turns: DataFrame, keys: Sequence[str] = ("conv_id",), pos: str = "turn") -> DataFrame:
    """What each turn adds to its conversation's running context (no row holds a whole conversation)."""
    return turns.select(*keys, pos, context_piece().alias("piece"))


def context_offsets(turns: DataFrame, keys: Sequence[str] = ("conv_id",), pos: str = "turn") -> DataFrame:
    """Where the running context ends after each turn.

    The running text after a turn is all pieces up to that offset; a copy per
    turn would be quadratic. The offsets are skew-safe running sums, so a
    conversation holding a third of all turns is still split over many tasks.
    """
    from .positions import group_cumsum
    lens = context_pieces(turns, keys, pos).select(*keys, pos, F.length("piece").cast("long").alias("_len"))
    return group_cumsum(lens, list(keys), [pos], "_len", "end_offset").select(*keys, pos, "end_offset")


#: Characters of a chunk of running text.
CHUNK = 4096


def text_chunks(pieces: DataFrame, keys: Sequence[str], pos: str, text: str, size: int = CHUNK) -> DataFrame:
    """The joined text of each key's pieces as rows (keys, chunk, chars) of ``size`` characters (the last: fewer).

    Offsets are skew-safe running sums of lengths; the texts meet them by (key,
    position) and are cut where chunks end, so pieces of one key go to as many
    tasks as it has chunks and no row holds more than a chunk. Keys whose pieces
    are all empty or null have no chunk; positions must be unique in a key.
    """
    from .positions import group_cumsum
    piece = F.coalesce(F.col(text), F.lit(""))
    lens = pieces.select(*keys, pos, F.length(piece).cast("long").alias("_len")).filter("_len > 0")
    ends = group_cumsum(lens, list(keys), [pos], "_len", "_end").select(*keys, pos, "_len", "_end")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, pos)]
    placed = (pieces.select(*keys, pos, piece.alias("_text")).alias("p").join(ends.alias("e"), same)
              .select(*[F.col(f"p.{k}").alias(k) for k in keys], "_text", (F.col("_end") - F.col("_len")).alias("_at"), "_end"))
    number = F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_end") - 1) / size)))
    parts = placed.select("*", number.alias("chunk")).withColumn("_from", F.greatest(F.col("_at"), F.col("chunk") * size))
    part = F.substring("_text", (F.col("_from") - F.col("_at") + 1).cast("int"),
                       (F.least(F.col("_end"), (F.col("chunk") + 1) * size) - F.col("_from")).cast("int"))
    # at most ``size`` parts, none of them empty
    return (parts.select(*keys, "chunk", "_from", part.alias("_part")).groupBy(*keys, "chunk")
            .agg(F.array_sort(F.collect_list(F.struct("_from", "_part"))).alias("_parts"))
            .select(*keys, "chunk", F.array_join(F.transform("_parts", lambda x: x["_part"]), "").alias("chars")))


def running_text(turns: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("conv_id",), pos: str = "turn",
                 size: int = CHUNK) -> DataFrame:
    """The running context after each chosen turn, in chunks: (keys, pos, chunk, chars).

    ``chosen`` has rows (keys, pos), each once. A conversation's chunks are made
    once however many of its turns are chosen; a chosen turn asks for its chunks
    by number (an equi-join), the last one cut where the turn's context ends. A
    turn whose context is empty, or that does not exist, has no row.
    """
    pieces = context_pieces(turns, keys, pos)
    wanted = chosen.select(*keys, pos).join(context_offsets(turns, keys, pos), [*keys, pos]).filter("end_offset > 0")
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end_offset") - 1) / size))).alias("chunk"))
    cut = F.substring("chars", F.lit(1), (F.col("end_offset") - F.col("chunk") * size).cast("int"))
    return (wanted.join(text_chunks(pieces, keys, pos, "piece", size), [*keys, "chunk"])
            .select(*keys, pos, "chunk", F.when((F.col("chunk") + 1) * size <= F.col("end_offset"), F.col("chars")).otherwise(cut).alias("chars")))


# ------------------------------------------------------------------ W3
def stuck_counts(turns: DataFrame, keys: Sequence[str] = STEP, limit: int = 10, role: str = "assistant") -> DataFrame:
    """(keys, n_turns, n_stuck, given_up). A generation loop is stuck when appending a turn leaves the
    stripped running code unchanged; at ``limit`` such turns the sample is given up.

    Appending a piece changes the stripped code exactly if the piece is not
    blank, so a count aggregate replaces the running text: the loop only reaches
    ``limit`` if the step has at least that many blank pieces.
    """
    t = turns.filter(F.col("role") == role)
    blank = X.py_strip(F.col("text")) == ""
    # the first turn has no previous code to compare with, so it never counts
    agg = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_turns"),
                               (F.count_if(blank) - F.min_by(blank.cast("int"), F.col("turn"))).alias("n_stuck"))
    return agg.select(*keys, "n_turns", "n_stuck", (F.col("n_stuck") >= limit).cast("int").alias("given_up"))


def final_code_chunks(turns: DataFrame, keys: Sequence[str] = STEP, limit: int = 10, role: str = "assistant", size: int = CHUNK) -> DataFrame:
    """The accumulated code of each step that was not given up, as rows (keys, chunk, chars)."""
    chunks = text_chunks(turns.filter(F.col("role") == role), keys, "turn", "text", size)
    return chunks.join(stuck_counts(turns, keys, limit, role).filter("given_up = 1").select(*keys), list(keys), "left_anti")


#: Turns whose pieces are joined first where a step's code becomes one row.
STRETCH = 1000


def stuck_runs(turns: DataFrame, keys: Sequence[str] = STEP, limit: int = 10, role: str = "assistant") -> DataFrame:
    """``stuck_counts`` with the accumulated code (empty where the sample was given up).

    The result's row holds a step's whole code. Its pieces are joined by stretches
    of turns first, so no row lists all of them. Turns that come twice are pieces
    twice, ordered by their text; null texts add nothing.
    """
    t = turns.filter(F.col("role") == role)
    blank = X.py_strip(F.col("text")) == ""
    in_order = lambda by, text: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(by, text))), lambda x: x[text]), "")
    parts = t.groupBy(*keys, F.floor(F.col("turn") / STRETCH).alias("_stretch")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(blank).alias("_blank"), F.min("turn").alias("_turn"),
        F.min_by(blank.cast("int"), F.col("turn")).alias("_first"), in_order("turn", "text").alias("_code"))
    agg = parts.groupBy(*keys).agg(
        F.sum("_n").alias("n_turns"), (F.sum("_blank") - F.min_by("_first", "_turn")).alias("n_stuck"),
        in_order("_stretch", "_code").alias("_all"))
    given_up = F.col("n_stuck") >= limit
    return agg.select(*keys, "n_turns", "n_stuck", given_up.cast("int").alias("given_up"),
                      F.when(given_up, F.lit("")).otherwise(F.col("_all")).alias("final_code"))
