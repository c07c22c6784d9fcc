"""Queries for the Python-backed jobs (T1-T3, with P7, W1, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import pyjobs as PJ
from . import views as V
from .catalogue import register


# Fixed fixture: replies by turn mod 4: code that ends where the prose begins (whatever follows an open
# bracket on the first prose line, nothing parses with it), so the longest prefix is known.
CODE = ("x = {n}\ny = x + 1", "def f(a):\n    return a\n\nprint(f({n}))", "z = [1,\n     2]\n# done", "if True:\n    w = {n}")


def _code(sql: bool):
    parts = [c.split("{n}") for c in CODE]
    if sql:
        text = ["'" + ("' || CAST(conv_id AS VARCHAR) || '".join(p)).replace("\n", "' || chr(10) || '") + "'" for p in parts]
        return "CASE turn % 4 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(text)) + " END"
    cols = [F.concat(F.lit(p[0]), *([F.col("conv_id").cast("string"), F.lit(p[1])] if len(p) > 1 else [])) for p in parts]
    return F.element_at(F.array(*cols), (F.col("turn") % 4 + 1).cast("int"))


@register("clean_generations", f"""
WITH t AS (SELECT CAST(CAST(floor(conv_id / 4) AS BIGINT) AS VARCHAR) AS qid, CAST(conv_id % 4 AS INTEGER) AS sample,
                  CAST(floor(turn / 2) AS BIGINT) AS step, turn, {_code(True)} AS code FROM conversations)
SELECT qid, sample, step, turn, code FROM t""")
def q_clean_generations(spark, sf_dir):
    """X9 + T1: the longest prefix of each generated reply that parses as Python: a fenced
    program followed by the turn's whole text as prose."""
    reply = F.concat(F.lit("```python\n"), _code(False), F.lit("\n(((open ends here: "), F.col("text"), F.lit("\n```"))
    return V.turns(spark, sf_dir).select("qid", "sample", "step", "turn", PJ.clean_generation(reply).alias("code"))


@register("private_tests", """
SELECT doc_id, 0 AS test_idx, lang AS input, source AS output, 'stdin' AS testtype FROM documents
UNION ALL
SELECT doc_id, 1, text, CAST(n_chars AS VARCHAR), 'functional' FROM documents""")
def q_private_tests(spark, sf_dir):
    """T2 + U1: public tests followed by the private ones (base64/zlib/pickle blobs
    for even documents, plain JSON for odd ones), one row per test."""
    d = V.table(spark, sf_dir, "documents")
    public = F.array(F.struct(F.col("lang").alias("input"), F.col("source").alias("output"),
                              F.lit("stdin").alias("testtype")))
    priv_json = F.to_json(F.array(F.struct(F.col("text").alias("input"),
                                           F.col("n_chars").cast("string").alias("output"),
                                           F.lit("functional").alias("testtype"))))
    blob = F.when(F.col("doc_id") % 2 == 0, PJ.encode_private_tests_udf(priv_json)).otherwise(priv_json)
    rows = d.select("doc_id", public.alias("public"), blob.alias("priv"))
    return PJ.expand_tests(rows, "public", "priv", ["doc_id"])


def quoted(line):
    """A text as a Python string literal (JSON's escapes are Python's)."""
    j = F.to_json(F.array(line))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _module():
    """A module around a text: every line of it a statement, with a form feed before the
    function, a comment, a docstring, and a last line beyond ASCII."""
    body = F.array_join(F.transform(F.split(F.col("text"), "\n", -1), lambda l: F.concat(F.lit("    v = "), quoted(l))), "\n")
    doc = F.col("doc_id").cast("string")
    return F.concat(F.lit("import os\n\x0c\n\ndef f_"), doc, F.lit('():\n    """Docstring."""\n    # comment\n'), body,
                    F.lit("\n    return v, 'é"), doc, F.lit("'\n\n\ndef g_"), doc, F.lit("(): return 'ü'  # rest\nx = 1\n"))


MAX_PER_REPO = 5


# The twin has the function's text from its first and last line; the lines between are the document's.
@register("extracted_functions", f"""
SELECT repo, path, name, significant_lines, first_line, last_line, n_lines FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, name) AS rn
  FROM (SELECT source AS repo, 'repos/' || source || '/mod_' || CAST(doc_id AS VARCHAR) || '.py' AS path,
               'f_' || CAST(doc_id AS VARCHAR) AS name, CAST(len(string_split(text, chr(10))) + 1 AS INTEGER) AS significant_lines,
               'def f_' || CAST(doc_id AS VARCHAR) || '():' AS first_line, '    return v, ' || chr(39) || 'é' || CAST(doc_id AS VARCHAR) || chr(39) AS last_line,
               CAST(len(string_split(text, chr(10))) + 4 AS INTEGER) AS n_lines
        FROM documents) a
  WHERE significant_lines > 20) b
WHERE rn <= {MAX_PER_REPO}""")
def q_extracted_functions(spark, sf_dir):
    """T3 + P7 + W1: top-level functions parsed from every module, more than 20
    significant lines, at most 5 per repository."""
    fn = C.significant(PJ.function_rows(_files(spark, sf_dir)))
    top = C.top_k_per_group(fn, ["repo"], ["path", "name"], MAX_PER_REPO)
    lines = F.split("body", "\n", -1)
    return top.select("repo", "path", "name", "significant_lines", lines[0].alias("first_line"),
                      F.element_at(lines, -1).alias("last_line"), F.size(lines).alias("n_lines"))


def _files(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("repos/"), F.col("source"), F.lit("/mod_"), F.col("doc_id").cast("string"),
                             F.lit(".py")).alias("path"), F.col("source").alias("repo"), _module().alias("content"))


@register("all_functions", """
SELECT 'repos/' || source || '/mod_' || CAST(doc_id AS VARCHAR) || '.py' AS path, 'f_' || CAST(doc_id AS VARCHAR) AS name,
       CAST(len(string_split(text, chr(10))) + 1 AS INTEGER) AS significant_lines, false AS one_line FROM documents
UNION ALL
SELECT 'repos/' || source || '/mod_' || CAST(doc_id AS VARCHAR) || '.py', 'g_' || CAST(doc_id AS VARCHAR), 1, true FROM documents""")
def q_all_functions(spark, sf_dir):
    """Every top-level function of every module."""
    fn = PJ.function_rows(_files(spark, sf_dir))
    one = F.col("body") == F.concat(F.lit("def "), F.col("name"), F.lit("(): return 'ü'"))
    return fn.select("path", "name", "significant_lines", one.alias("one_line"))
