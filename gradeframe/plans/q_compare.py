"""Output comparison queries (X19-X23, U5) over ``outputs`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compare as CMP
from . import views as V
from .catalogue import register
from .q_text import strip

LB = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def _forall(lst: str, pred: str) -> str:
    """DuckDB: every element satisfies ``pred`` (x is the element); true on empty lists."""
    return f"NOT list_contains(list_transform({lst}, lambda x: coalesce(NOT ({pred}), false)), true)"


def _ts(l: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex({l}, '\\s+'), lambda t: t <> '')))"


def _float(x: str) -> str:
    """DuckDB: Python's ``float(text)``, NULL where it would raise."""
    s = strip(x)
    return (f"CASE WHEN regexp_matches({s}, '{CMP.FLOAT_TEXT}') THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) "
            f"WHEN regexp_matches({s}, '{CMP.SPECIAL_FLOAT}') THEN CASE WHEN contains(lower({s}), 'nan') THEN 'nan'::DOUBLE "
            f"WHEN starts_with({s}, '-') THEN '-infinity'::DOUBLE ELSE 'infinity'::DOUBLE END END")


def _doubles(lst: str) -> str:
    return f"list_transform({lst}, lambda x: {_float('x')})"


def _close(a: str, b: str) -> str:
    """DuckDB: one pair of numpy.allclose."""
    return (f"CASE WHEN isnan({a}) OR isnan({b}) THEN false WHEN {a} = {b} THEN true WHEN isinf({a}) OR isinf({b}) THEN false "
            f"ELSE abs({a} - {b}) <= 1e-8 + 1e-5 * abs({b}) END")


def _round3(x: str) -> str:
    """DuckDB: Python's round(x, 3); the formatter rounds the exact binary value, ties to even."""
    return f"CASE WHEN isnan({x}) OR isinf({x}) THEN {x} ELSE CAST(format('{{:.3f}}', {x}) AS DOUBLE) + 0.0 END"


LADDER_CTES = [
    f"""s0 AS (SELECT doc_id, stdout, expected, string_split_regex(stdout, {LB}) AS parts FROM outputs)""",
    f"""s1 AS (SELECT doc_id, stdout, expected,
               CASE WHEN stdout = '' THEN []::VARCHAR[]
                    WHEN regexp_matches(stdout, '(' || {LB} || ')$') THEN list_slice(parts, 1, len(parts) - 1)
                    ELSE parts END AS out,
               list_transform(list_filter(string_split(expected, chr(10)), lambda x: x <> ''), lambda x: {strip('x')}) AS el
        FROM s0)""",
    """s2 AS (SELECT *, list_filter(out, lambda x: x <> '') AS ne FROM s1)""",
    f"""s3 AS (SELECT *, {_doubles('ne')} AS fa, {_doubles('el')} AS fb,
               list_sort(list_distinct(list_filter(list_transform(ne, lambda l: {_ts('l')}), lambda a: len(a) > 0))) AS tso,
               list_sort(list_distinct(list_transform(el, lambda l: {_ts('l')}))) AS tse
        FROM s2)""",
    f"""s4 AS (SELECT *,
      list_transform(list_filter(list_transform(ne, lambda l: {_ts('l')}), lambda a: len(a) > 0),
                     lambda a: list_transform(a, lambda t: {_round3(_float('t'))})) AS rso,
      list_transform(list_transform(el, lambda l: {_ts('l')}),
                     lambda a: list_transform(a, lambda t: {_round3(_float('t'))})) AS rse
      FROM s3)""",
    f"""lad AS (SELECT doc_id,
      {strip("array_to_string(out, chr(10))")} = {strip('expected')} AS c_exact,
      {strip("array_to_string(list_transform(out, lambda l: " + strip('l') + "), chr(10))")} = {strip('expected')} AS c_line_strip,
      len(out) = 1 AND out[1] = expected AS c_single,
      out = el AS c_lines,
      ne = el AS c_nonempty_lines,
      ({_forall('fa', 'x IS NOT NULL')}) AND ({_forall('fb', 'x IS NOT NULL')}) AND len(fa) = len(fb)
        AND NOT list_contains(list_transform(range(1, len(fa) + 1),
              lambda i: {_close('fa[i]', 'fb[i]')}), false) AS c_numeric,
      tso = tse AS c_token_sets,
      coalesce(CASE WHEN NOT list_contains(list_transform(rso, lambda a: list_contains(list_transform(a, lambda v: v IS NULL OR isnan(v)), true)), true)
                     AND NOT list_contains(list_transform(rse, lambda a: list_contains(list_transform(a, lambda v: v IS NULL OR isnan(v)), true)), true)
                    THEN list_sort(list_distinct(list_transform(rso, lambda a: list_sort(list_distinct(a)))))
                         = list_sort(list_distinct(list_transform(rse, lambda a: list_sort(list_distinct(a))))) END, false) AS c_rounded,
      NOT list_contains(list_transform(range(1, least(len(ne), len(el)) + 1),
              lambda i: regexp_matches(ne[i], '^[0-9]+$') AND regexp_matches(el[i], '^[0-9]+$')), false) AS all_int
      FROM s4)""",
]

RUNGS = ["exact", "line_strip", "single", "lines", "nonempty_lines", "numeric", "token_sets", "rounded"]


def _rung_sql() -> str:
    whens = " ".join(f"WHEN coalesce(c_{r}, false) THEN '{'rounded_sets' if r == 'rounded' else r}'" for r in RUNGS)
    return f"CASE {whens} ELSE 'fail' END"


_base = "c_exact OR c_line_strip OR c_single OR c_lines OR c_nonempty_lines"


@register("compare_stdout", V.with_views(["outputs"], f"""
SELECT doc_id,
       CAST(coalesce({_base} OR c_numeric OR c_token_sets OR c_rounded, false) AS INTEGER) AS passed_apps,
       CAST(coalesce({_base} OR (NOT all_int AND c_numeric), false) AS INTEGER) AS passed_lcb,
       {_rung_sql()} AS rung
FROM lad""", LADDER_CTES))
def q_compare_stdout(spark, sf_dir):
    """The APPS and LiveCodeBench stdout ladders and the first rung that accepts."""
    lad = CMP.with_ladder(V.outputs(spark, sf_dir))
    return lad.select("doc_id", F.col("passed_apps").cast("int").alias("passed_apps"),
                      F.col("passed_lcb").cast("int").alias("passed_lcb"), "rung")


@register("compare_numbers", V.with_views(["outputs"], """
SELECT doc_id, CAST(coalesce(c_numeric, false) AS INTEGER) AS is_close, CAST(all_int AS INTEGER) AS all_int FROM lad""",
                                         LADDER_CTES))
def q_compare_numbers(spark, sf_dir):
    """X19 numeric rung + X20 integer check over all lines of output and expectation."""
    o = CMP.with_lines(V.outputs(spark, sf_dir), "stdout", "out")
    o = o.select("doc_id", F.filter("out", lambda x: x != "").alias("ne"), CMP.expected_lines(F.col("expected")).alias("el"))
    return o.select("doc_id", CMP.all_close(F.col("ne"), F.col("el")).cast("int").alias("is_close"),
                    CMP.all_int_pairs(F.col("ne"), F.col("el")).cast("int").alias("all_int"))


@register("compare_sets", V.with_views(["outputs"], """
SELECT doc_id, CAST(tso = tse AS INTEGER) AS same_token_sets, CAST(len(tso) AS INTEGER) AS n_sets FROM s3""", LADDER_CTES[:4]))
def q_compare_sets(spark, sf_dir):
    """Set-of-token-sets equality of output and expectation."""
    o = CMP.with_lines(V.outputs(spark, sf_dir), "stdout", "out")
    o = o.select("doc_id", CMP.token_sets(F.filter("out", lambda x: x != ""), True).alias("tso"),
                 CMP.token_sets(CMP.expected_lines(F.col("expected")), False).alias("tse"))
    return o.select("doc_id", (F.col("tso") == F.col("tse")).cast("int").alias("same_token_sets"),
                    F.size("tso").alias("n_sets"))


# Fixed fixture: what a call returned and what was expected, by event_id mod 12; 'K' stands for the number in props.
CALL_CASES = (("{\"k\": K}", "{\"k\": K}"), ("[{\"k\":K}, 0]", "{\"k\": K}"), ("{\"k\": K}", "{\"k\": 1K}"), ("K", "[K]"),
              ("[100, true]", "[1e2, 1]"), ("{\"b\": 1.50, \"a\": false}", "{\"a\": 0, \"b\": 1.5}"), ("[]", "K"),
              ("\"1e2 true\"", "\"100 1\""), ("[9007199254740992K]", "[9007199254740993K]"), ("9007199254740993", "9007199254740992"),
              ("[[1K0000000000000000000000]]", "[[1K0000000000000000000001]]"), ("[9223372036854775808]", "[9223372036854775808.0]"))
CALL_MATCHES = (1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1)


def _case_sql(which: int) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c[which]}'" for i, c in enumerate(CALL_CASES))
    return f"replace(CASE event_id % {len(CALL_CASES)} {whens} END, 'K', json_extract_string(props, '$.k'))"


CALL_CTE = f"""c AS (SELECT event_id, user_id, event_type, props, {_case_sql(0)} AS expected, {_case_sql(1)} AS output FROM events)"""


# The twin states the outcome of each case by hand: DuckDB has no comparison that takes 1e2 for 100.
@register("compare_calls", V.with_views([], f"""
SELECT event_id, [{', '.join(map(str, CALL_MATCHES))}][event_id % {len(CALL_CASES)} + 1] AS matches,
       CAST(len(list_filter(string_split(args, chr(10)), lambda l: json_valid(l))) AS INTEGER) AS n_args,
       event_type AS restored, CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS kept_key,
       event_type AS last_of_equal, CAST(user_id + 1 AS VARCHAR) || '99999999999999999999' AS long_key
FROM (SELECT *, props || chr(10) || CAST(user_id AS VARCHAR) || chr(10) || CASE WHEN event_id % 5 = 0 THEN event_type
                   ELSE '"' || event_type || '"' END AS args FROM c) a""", [CALL_CTE]))
def q_compare_calls(spark, sf_dir):
    """X21 (call result = expected or its first element), X22 (one JSON argument per
    line, some invalid), X23 (integer map keys of any size restored, of equal ones the last; kept as they are where one is no integer)."""
    ev = V.table(spark, sf_dir, "events")
    expected, output = (F.expr(_case_sql(w).replace("json_extract_string", "get_json_object")) for w in (0, 1))
    word = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    args = F.concat_ws("\n", F.col("props"), F.col("user_id").cast("string"), word)
    user = F.col("user_id").cast("string")
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), user)).otherwise(F.concat(F.lit(" 0"), user))
    restored = CMP.int_keys(F.create_map(F.concat(F.lit("0"), user), F.col("event_type")))
    twice = F.create_map(F.concat(F.lit(" "), user), F.lit("first"), F.concat(F.lit("+00"), user), F.col("event_type"))
    large = F.create_map(F.concat((F.col("user_id") + 1).cast("string"), F.lit("99999999999999999999")), F.col("event_type"))
    return ev.select(
        "event_id",
        CMP.call_result_matches(output, expected).cast("int").alias("matches"),
        F.size(F.filter(CMP.parse_call_args(args), lambda v: v.isNotNull())).alias("n_args"),
        F.try_element_at(restored, F.col("user_id").cast("decimal(38,0)")).alias("restored"),
        F.map_keys(CMP.int_keys_or_original(F.create_map(key, F.col("event_type"))))[0].alias("kept_key"),
        F.map_values(CMP.int_keys_or_original(twice))[0].alias("last_of_equal"), F.map_keys(CMP.int_keys_or_original(large))[0].alias("long_key"))
