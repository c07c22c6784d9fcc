"""Text-operator queries over ``documents`` (and ``labels``/``events`` where noted).

Documents hold prose, not code, so code-shaped inputs are made by wrapping
each whole text in fences, class skeletons or reply markers; the wrapping is
the same expression on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import verdict as VD
from ..operators import corpus as C
from . import views as V
from .catalogue import register

NL = "chr(10)"


WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {WS})"


def lstrip(x: str) -> str:
    return f"ltrim({x}, {WS})"


def lit(s: str) -> str:
    """A SQL string literal; newlines become chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def nl(*parts) -> F.Column:
    """Spark: parts joined by newlines (strings become literals)."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    out = []
    for i, c in enumerate(cols):
        if i:
            out.append(F.lit("\n"))
        out.append(c)
    return F.concat(*out)


def s_nl(*parts: str) -> str:
    """SQL twin of :func:`nl` (parts are SQL expressions)."""
    return f" || {NL} || ".join(parts)


# ------------------------------------------------------------------ X3 O10
MASK_RATE, SEED = 0.3, 0


@register("masked_words", f"""
SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN list_contains(ch, i - 1)
                               THEN repeat('#', length(x)) ELSE x END), ' ') AS masked
FROM (SELECT doc_id, w, list_transform(list_slice(list_sort(list_transform(range(len(w)), lambda i:
             {{'h': md5('{SEED}|' || CAST(doc_id AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 'i': i}})),
             1, CAST(floor(len(w) * {MASK_RATE}) AS BIGINT)), lambda x: x.i) AS ch
      FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) a) b""")
def q_masked_words(spark, sf_dir):
    """X3 + O10: mask 30% of the words, chosen by a seeded md5 rank (no replacement)."""
    d = _docs(spark, sf_dir)
    return X.mask_text(d.select("doc_id", "text"), "text", MASK_RATE, SEED, "doc_id").select("doc_id", "masked")


# ------------------------------------------------------------------ O1 O2 O3
N_EXAMPLES = 100


@register("shuffled", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS INTEGER) AS shuffle_rank
FROM documents""")
def q_shuffled(spark, sf_dir):
    """O1: the seeded shuffle of the whole corpus."""
    return C.seeded_shuffle(_docs(spark, sf_dir).select("doc_id"), SEED, "doc_id")


@register("head", f"""
SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT {N_EXAMPLES}""")
def q_head(spark, sf_dir):
    """O2 + O3: the first n examples by key (a distributed top-k; the limit is the feature)."""
    return C.first_n(_docs(spark, sf_dir).select("doc_id", "source"), N_EXAMPLES, "doc_id")


@register("head_all", "SELECT doc_id, source FROM documents")
def q_head_all(spark, sf_dir):
    """O3: n = -1 keeps every example."""
    return C.first_n(_docs(spark, sf_dir).select("doc_id", "source"), -1, "doc_id")


# ------------------------------------------------------------------ X4 X5
HEADER_WRAP_SQL = (f"CASE doc_id % 4 WHEN 0 THEN '###SUMMARY' || {NL} || text "
                   f"WHEN 1 THEN '### SUMMARY ' || {NL} || text "
                   f"WHEN 2 THEN 'SUMMARY' || {NL} || 'SUMMARY ' || {NL} || text "
                   f"ELSE text || {NL} || 'SUMMARY: ' || lang END")


def _header_wrap():
    k = F.col("doc_id") % 4
    return (F.when(k == 0, nl("###SUMMARY", F.col("text")))
            .when(k == 1, nl("### SUMMARY ", F.col("text")))
            .when(k == 2, nl("SUMMARY", "SUMMARY ", F.col("text")))
            .otherwise(nl(F.col("text"), F.concat(F.lit("SUMMARY: "), F.col("lang")))))


def _header_regex_sql() -> str:
    return "'^" + "".join("(?:" + h.replace("\n", "\\n") + ")?" for h in X.SUMMARY_HEADERS) + "'"


@register("header_strip", f"""
SELECT doc_id, string_split(regexp_replace(w, {_header_regex_sql()}, ''), 'SUMMARY')[-1] AS summary
FROM (SELECT doc_id, {HEADER_WRAP_SQL} AS w FROM documents) d""")
def q_header_strip(spark, sf_dir):
    """Summary header spellings removed in order, then the text after the last SUMMARY."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", X.strip_summary_header(_header_wrap()).alias("summary"))


QUESTION_CAP = 12000


@register("capped_question", f"""
SELECT doc_id, substring(text, 1, {QUESTION_CAP}) AS question, length(text) > {QUESTION_CAP} AS was_capped
FROM documents""")
def q_capped_question(spark, sf_dir):
    """The question handed to the summariser is capped at 12,000 characters (the
    reference's input rule); every document is read whole to apply it."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", X.cap_length("text", QUESTION_CAP).alias("question"),
                    (F.length("text") > QUESTION_CAP).alias("was_capped"))


# ------------------------------------------------------------------ X16 X17 X18
@register("truncated", """
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text
                    ELSE substring(text, 1, 150) || '...(truncated) ...' || right(text, 150) END AS short
FROM documents""")
def q_truncated(spark, sf_dir):
    """X18"""
    return _docs(spark, sf_dir).select("doc_id", X.truncate_middle("text", 300).alias("short"))


@register("n_lines", """
SELECT doc_id, CASE WHEN len(p) >= 3 THEN array_to_string(list_slice(l, 1, p[3]), chr(10))
                    ELSE text END AS head
FROM (SELECT doc_id, text, l, list_filter(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '[\\pL\\pN]')
                                                          THEN i ELSE 0 END), lambda i: i > 0) AS p
      FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) a) b""")
def q_n_lines(spark, sf_dir):
    """Lines up to the third one that has a letter or digit."""
    return _docs(spark, sf_dir).select("doc_id", X.first_n_lines("text", 3).alias("head"))


@register("starter", """
SELECT doc_id, array_to_string(list_slice(l, 1, CAST(floor(len(l) * 0.5) AS BIGINT)), chr(10)) AS starter
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a""")
def q_starter(spark, sf_dir):
    """The first half of the solution's lines as starter code."""
    return _docs(spark, sf_dir).select("doc_id", X.starter_code("text", 0.5).alias("starter"))


# ------------------------------------------------------------------ X9 X10
FENCE_WRAP_SQL = (f"CASE doc_id % 3 WHEN 0 THEN '```python' || {NL} || text || {NL} || '```' "
                  f"WHEN 1 THEN 'Here is the python code:' || {NL} || text "
                  f"ELSE text || {NL} || '```' || {NL} || 'Explanation: ' || lang END")


def _fence_wrap():
    k = F.col("doc_id") % 3
    return (F.when(k == 0, nl("```python", F.col("text"), "```"))
            .when(k == 1, nl("Here is the python code:", F.col("text")))
            .otherwise(nl(F.col("text"), "```", F.concat(F.lit("Explanation: "), F.col("lang")))))


@register("fence_clean", f"""
SELECT doc_id, split_part(CASE WHEN contains(string_split(r, {NL})[1], 'python')
                               THEN array_to_string(list_slice(string_split(r, {NL}), 2, 1000000000), {NL})
                               ELSE r END, '```', 1) AS code,
       {rstrip("replace(w, '```', '')")} AS answer
FROM (SELECT doc_id, w, regexp_replace(w, '(?m)^```python\\s*|```$', '', 'g') AS r
      FROM (SELECT doc_id, {FENCE_WRAP_SQL} AS w FROM documents) a) b""")
def q_fence_clean(spark, sf_dir):
    """X9 (fence removal, 'python' first line, cut at the next fence) and X10."""
    w = _fence_wrap()
    code = X.cut_at_fence(X.drop_python_first_line(X.remove_fences(w)))
    return _docs(spark, sf_dir).select("doc_id", code.alias("code"), X.clean_answer(w).alias("answer"))


# ------------------------------------------------------------------ X14 X15
IMPORT_WRAP_SQL = (f"CASE doc_id % 2 WHEN 0 THEN 'import os' || {NL} || 'from a.b import c' || {NL} || '    ' || text "
                   f"ELSE '  ' || text || {NL} || 'x = 1 from y import z' END")


def _import_wrap():
    return F.when(F.col("doc_id") % 2 == 0,
                  nl("import os", "from a.b import c", F.concat(F.lit("    "), F.col("text")))) \
        .otherwise(nl(F.concat(F.lit("  "), F.col("text")), "x = 1 from y import z"))


@register("imports", f"""
SELECT doc_id, array_to_string(regexp_extract_all(w, '(?m)^import\\s.*$|from\\s.*\\simport.*$'), ';') AS imports,
       CAST(length(w) - length({lstrip('w')}) AS INTEGER) AS leading
FROM (SELECT doc_id, {IMPORT_WRAP_SQL} AS w FROM documents) a""")
def q_imports(spark, sf_dir):
    """X14 + X15"""
    w = _import_wrap()
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.extract_imports(w), ";").alias("imports"),
                                       X.leading_spaces(w).alias("leading"))


# ------------------------------------------------------------------ X12
def _class_skeleton_parts():
    return ["class C:", "    @staticmethod", "    def a(x):", "        return x", "    def b(self, y):"]


def _static_sql(x: str) -> str:
    return f"""array_to_string(flatten(list_transform(list_filter(string_split({x}, {NL}), lambda l: NOT contains(l, '@staticmethod')),
         lambda l: CASE WHEN starts_with({strip('l')}, 'def ') AND NOT contains(l, 'self') AND NOT contains(l, 'cls')
                             AND length(l) - length({lstrip('l')}) = 4
                        THEN ['    @staticmethod', l] ELSE [l] END)), {NL})"""


@register("static_methods", f"""
SELECT doc_id, {_static_sql('w')} AS code
FROM (SELECT doc_id, {s_nl(*[lit(p) for p in _class_skeleton_parts()], 'text', lit('    def c(cls):'),
                            lit('        pass'), lit('    def d():'))} AS w FROM documents) a""")
def q_static_methods(spark, sf_dir):
    """X12"""
    w = nl(*_class_skeleton_parts(), F.col("text"), "    def c(cls):", "        pass", "    def d():")
    return _docs(spark, sf_dir).select("doc_id", X.add_static_methods(w).alias("code"))


# ------------------------------------------------------------------ X8
DOC_SKELETON = ["class K:", "    def f(self, a):", '        """old f doc"""', "    def g(self):",
                "        '''old g doc'''", "    def h(self):"]


def _doc_pattern_sql(fn: str) -> str:
    return ("'(def\\s+" + fn + "\\s*\\([^)]*\\)\\s*:)\\s*?(\"\"\"[\\s\\S]*?\"\"\")|(''''''[\\s\\S]*?'''''')'")


def _replace_sql(t: str, fn: str, new: str) -> str:
    pat = _doc_pattern_sql(fn)
    doc = (f"(CASE WHEN regexp_extract({t}, {pat}, 2) <> '' THEN regexp_extract({t}, {pat}, 2) "
           f"ELSE regexp_extract({t}, {pat}, 3) END)")
    return f"CASE WHEN regexp_matches({t}, {pat}) AND {doc} <> '' THEN replace({t}, {doc}, {new}) ELSE {t} END"


Q3 = '"' * 3
SQ3 = "''" * 3  # three single quotes inside a SQL literal
DOCSTRING_ANY_SQL = "'(?:" + SQ3 + "[\\s\\S]*?" + SQ3 + ")|(" + Q3 + "[\\s\\S]*?" + Q3 + ")'"


def _docstrings_sql() -> str:
    new_f = "'" + Q3 + "' || lang || '" + Q3 + "'"
    new_h = "'" + Q3 + "' || source || '" + Q3 + "'"
    sk = s_nl(*[lit(p) for p in DOC_SKELETON], "'        " + Q3 + "' || text || '" + Q3 + "'")
    listed = (f"array_to_string(list_transform(list_filter(regexp_extract_all(r2, {DOCSTRING_ANY_SQL}, 1), "
              f"lambda x: x IS NOT NULL AND x <> ''), lambda x: {strip('x')}), ' | ')")
    return f"""
SELECT doc_id, r2 AS class_text, {listed} AS docstrings
FROM (SELECT doc_id, {_replace_sql('r1', 'h', new_h)} AS r2
      FROM (SELECT doc_id, source, {_replace_sql('sk', 'f', new_f)} AS r1
            FROM (SELECT doc_id, lang, source, {sk} AS sk FROM documents) a) b) c"""


@register("docstrings", _docstrings_sql())
def q_docstrings(spark, sf_dir):
    """Method docstrings replaced (folded over the methods), remaining docstrings listed."""
    d = _docs(spark, sf_dir)
    sk = nl(*DOC_SKELETON, F.concat(F.lit('        """'), F.col("text"), F.lit('"""')))
    methods = F.array(F.struct(F.lit("f").alias("method_name"), F.col("lang").alias("method_description")),
                      F.struct(F.lit("h").alias("method_name"), F.col("source").alias("method_description")))
    r = X.replace_docstrings(sk, methods)
    return d.select("doc_id", r.alias("class_text")).select(
        "doc_id", "class_text", F.array_join(X.list_docstrings("class_text"), " | ").alias("docstrings"))


# ------------------------------------------------------------------ X11 X13
IMPORTS = ["import math", "import sys"]


def _reply_wrap():
    k = F.col("doc_id") % 6
    t = F.col("text")
    return (F.when(k == 0, nl("### Response:", "```python", t, "```"))
            .when(k == 1, nl("Sure.", F.concat(F.lit("```python"), t)))
            .when(k == 2, F.concat(F.lit("[PYTHON]"), t, F.lit("[/PYTHON]")))
            .when(k == 3, nl("import os", F.concat(F.lit("note "), F.col("lang")), "class A:", "    x = 1", t))
            .when(k == 4, nl("from x import y", "junk", "  class B:", "      y = 2", t))
            .otherwise(nl("```", t, "```")))


REPLY_WRAP_SQL = (f"CASE doc_id % 6 WHEN 0 THEN {s_nl(lit('### Response:'), lit('```python'), 'text', lit('```'))} "
                  f"WHEN 1 THEN {s_nl(lit('Sure.'), lit('```python') + ' || text')} "
                  f"WHEN 2 THEN '[PYTHON]' || text || '[/PYTHON]' "
                  f"WHEN 3 THEN {s_nl(lit('import os'), lit('note ') + ' || lang', lit('class A:'), lit('    x = 1'), 'text')} "
                  f"WHEN 4 THEN {s_nl(lit('from x import y'), lit('junk'), lit('  class B:'), lit('      y = 2'), 'text')} "
                  f"ELSE {s_nl(lit('```'), 'text', lit('```'))} END")


def _extract_code_sql() -> str:
    t0 = rstrip("w")
    marks = f"""CASE WHEN contains(t0, '### Response:') THEN split_part(t0, '### Response:', 2)
                     WHEN contains(t0, '@@ Response:') THEN split_part(t0, '@@ Response:', 2)
                     WHEN contains(t0, '[/INST]') THEN split_part(t0, '[/INST]', 2) ELSE t0 END"""
    pats = [p.replace("'", "''") for p in X.CODE_PATTERNS]
    fence = " ".join(f"WHEN regexp_matches(t, '(?s){p}') THEN regexp_extract(t, '(?s){p}', 1)" for p in pats)
    is_cls = f"starts_with({strip('l')}, 'class')"
    return f"""
fb0 AS (SELECT doc_id, t, string_split(t, {NL}) AS lines,
               list_position(list_transform(string_split(t, {NL}), lambda l: {is_cls}), true) AS fc
        FROM (SELECT doc_id, {marks} AS t FROM (SELECT doc_id, {t0} AS t0 FROM w0) a) b),
fb1 AS (SELECT doc_id, t, lines,
               list_filter(CASE WHEN fc IS NULL THEN lines ELSE list_slice(lines, 1, fc - 1) END,
                           lambda l: NOT (starts_with({strip('l')}, 'import') OR starts_with({strip('l')}, 'from'))) AS removed
        FROM fb0),
fb2 AS (SELECT doc_id, t, list_filter(lines, lambda l: NOT list_contains(removed, l)) AS kept FROM fb1),
fb3 AS (SELECT doc_id, t, kept, coalesce(length(cl) - length({lstrip('cl')}), 0) AS ind
        FROM (SELECT doc_id, t, kept, list_filter(kept, lambda l: {is_cls})[1] AS cl FROM fb2) c),
ex AS (SELECT doc_id, CASE {fence} ELSE array_to_string(CASE WHEN ind <> 0 THEN list_transform(kept, lambda l:
                 repeat(' ', greatest(length(l) - length({lstrip('l')}) - ind, 0)) || {lstrip('l')}) ELSE kept END, {NL}) END AS code
       FROM fb3)"""


@register("extract_code", f"""WITH w0 AS (SELECT doc_id, {REPLY_WRAP_SQL} AS w FROM documents),
{_extract_code_sql()}
SELECT doc_id, code, {lit(chr(10).join(IMPORTS))} || {NL} || {_static_sql("string_split(code, 'python')[-1]")} AS program
FROM ex""")
def q_extract_code(spark, sf_dir):
    """X11 + X12 + X13: code pulled out of a model reply, static methods marked, then
    the import lines put in front."""
    d = X.extract_code(_docs(spark, sf_dir).select("doc_id", _reply_wrap().alias("reply")), "reply")
    imports = F.array(*[F.lit(i) for i in IMPORTS])
    return d.select("doc_id", "code", X.classeval_program(F.col("code"), imports).alias("program"))


# ------------------------------------------------------------------ X36 P12
TEST_SQL = (f"'import unittest' || {NL} || 'class T' || CAST(doc_id AS VARCHAR) || '(unittest.TestCase):' || {NL} "
            f"|| '    pass'")


@register("class_program", f"""
SELECT 'ClassEval_' || CAST(doc_id AS VARCHAR) AS task_id, text || {NL} || {TEST_SQL} AS program,
       '```python' || {NL} || text || {NL} || '```' AS predict, 'import unittest' AS import_statement
FROM documents""")
def q_class_program(spark, sf_dir):
    """P12 + X36: ClassEval record (task id, fenced prediction, imports) and its test program."""
    d = _docs(spark, sf_dir)
    test = nl("import unittest", F.concat(F.lit("class T"), F.col("doc_id").cast("string"),
                                          F.lit("(unittest.TestCase):")), "    pass")
    return d.select(F.concat(F.lit("ClassEval_"), F.col("doc_id").cast("string")).alias("task_id"),
                    X.class_program(F.col("text"), test).alias("program"),
                    nl("```python", F.col("text"), "```").alias("predict"),
                    F.lit("import unittest").alias("import_statement"))


# ------------------------------------------------------------------ P2 X31 O7 P1
# Fixed fixture: solutions as they are stored by doc_id mod 9 ({s}, {l}, {t}: source, lang, text), and the first and number of what is read.
SOLUTIONS = (('["{s}", "{l}"]', "{s}", 2), ("('{s}', '{l}')", "{s}", 2), ("['{s}', None, True]", "{s}", 3),
             ("['it\\'s \\\\ \"{s}\"', \"'{l}'\"]", "it's \\ \"{s}\"", 2), ("(1, 2, -3)", "1", 3),
             ('[@@@def {l}:\n  \'a\', "b"@@@, "\\x41\\t" \'z\']', 'def {l}:\n  \'a\', "b"', 2), ("('{s}')", "('{s}')", 1),
             ("print('{s}')  # ['x']", "print('{s}')  # ['x']", 1), ("{t}", "{t}", 1))


def _solution(which: int, sql: bool):
    import re
    columns = {"{s}": "source", "{l}": "lang", "{t}": "text"}
    parts = [[x for x in re.split(r"(\{[slt]\})", c[which].replace("@", "'")) if x] for c in SOLUTIONS]
    if sql:
        text = [" || ".join(columns[x] if x in columns else lit(x) for x in p) for p in parts]
        return f"CASE doc_id % {len(SOLUTIONS)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(text)) + " END"
    texts = [F.concat(*[F.col(columns[x]) if x in columns else F.lit(x) for x in p]) for p in parts]
    return F.element_at(F.array(*texts), (F.col("doc_id") % len(SOLUTIONS) + 1).cast("int"))


@register("solution_info", f"""
SELECT doc_id, mode, CASE WHEN mode = 'no_solution' THEN {lit(C.NO_SOLUTION)} ELSE first END AS solution_info, n_solutions
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'full_solution' ELSE 'no_solution' END AS mode, {_solution(1, True)} AS first,
             CAST([{', '.join(str(c[2]) for c in SOLUTIONS)}][doc_id % {len(SOLUTIONS)} + 1] AS INTEGER) AS n_solutions FROM documents) b""")
def q_solution_info(spark, sf_dir):
    """P2 + X31 + O7: parse the solution list (JSON, Python list or tuple, plain code), then pick the first solution or the fixed sentence."""
    d = _docs(spark, sf_dir)
    mode = F.when(F.col("doc_id") % 2 == 0, F.lit("full_solution")).otherwise(F.lit("no_solution"))
    return d.select("doc_id", mode.alias("mode"), X.parse_solutions(_solution(0, False)).alias("sols")).select(
        "doc_id", "mode", C.solution_info("mode", "sols").alias("solution_info"),
        F.size("sols").alias("n_solutions"))


@register("effective_input", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Summary of ' || source END AS question
FROM documents""")
def q_effective_input(spark, sf_dir):
    """The vanilla transformation uses the original text."""
    d = _docs(spark, sf_dir)
    tr = F.when(F.col("doc_id") % 2 == 0, F.lit("vanilla")).otherwise(F.lit("plain_summary"))
    return d.select("doc_id", C.effective_input(tr, F.col("text"),
                                                F.concat(F.lit("Summary of "), F.col("source"))).alias("question"))


# ------------------------------------------------------------------ X38
@register("solution_merge", f"""
SELECT doc_id, CASE WHEN contains(code, partial) THEN code ELSE partial || {NL} || code END AS merged
FROM (SELECT doc_id, partial,
             {strip("replace('```python' || " + NL + " || '# start ' || source, '```python', '')")}
               || split_part(text || '```' || {NL} || 'trailing notes', '```', 1) AS code
      FROM (SELECT doc_id, source, text,
                   CASE WHEN doc_id % 2 = 0 THEN '# start ' || source
                        ELSE 'def helper_' || CAST(doc_id AS VARCHAR) || '():' END AS partial
            FROM documents) a) b""")
def q_solution_merge(spark, sf_dir):
    """Starter + completion, with the partial solution put in front when missing."""
    d = _docs(spark, sf_dir)
    completion = F.concat(F.col("text"), F.lit("```"), F.lit("\n"), F.lit("trailing notes"))
    starter = nl("```python", F.concat(F.lit("# start "), F.col("source")))
    partial = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# start "), F.col("source"))) \
        .otherwise(F.concat(F.lit("def helper_"), F.col("doc_id").cast("string"), F.lit("():")))
    return d.select("doc_id", X.merge_partial(completion, starter, partial).alias("merged"))


# ------------------------------------------------------------------ X34 X35
def _py_list_sql(a: str) -> str:
    return f"'[' || array_to_string(list_transform({a}, lambda x: '''' || x || ''''), ', ') || ']'"


@register("report_text", f"""
SELECT doc_id,
  'Solve the following problem:' || {NL} || ' ' || text || {NL} || {NL}
  || CASE WHEN len(ex) > 0 THEN 'Given the following examples:' || {NL} || ' ' || {_py_list_sql('ex')} || {NL} || {NL} ELSE '' END
  || CASE WHEN len(co) > 0 THEN 'Given the following constraint(s):' || {NL} || ' ' || {_py_list_sql('co')} || {NL} || {NL} ELSE '' END
  || 'A summary of the solution is:' || {NL} || ' ' || lang AS solve_prompt,
  'Question: ' || text || {NL} || {NL} || {NL} || 'Summarized Question: ' || lang || {NL} || {NL} || {NL}
  || '################FULL GROUND TRUTH SOLUTION ################' || {NL} || {NL} || {NL} || source
  || {NL} || {NL} || '################SOLUTION SUMMARY################' || {NL} || {NL} || {NL} || lang || {NL} || {NL} || {NL}
  || '################PARTIAL SOLUTION 0: ################' || {NL} || {NL} || {NL} || 'Starter Code: ' || {NL} || 's0'
  || {NL} || '--------------------------------------' || {NL} || text || {NL} || '---------' || {NL} || source || {NL}
  || '################PARTIAL SOLUTION 1: ################' || {NL} || {NL} || {NL} || 'Starter Code: ' || {NL} || 's1'
  || {NL} || '--------------------------------------' || {NL} || lang AS report
FROM (SELECT doc_id, text, lang, source, string_split(source || ',' || lang, ',') AS ex,
             CASE WHEN doc_id % 2 = 0 THEN []::VARCHAR[] ELSE ['n <= ' || CAST(n_chars AS VARCHAR)] END AS co
      FROM documents) a""")
def q_report_text(spark, sf_dir):
    """X34 solve prompt and X35 report text."""
    d = _docs(spark, sf_dir)
    ex = F.split(F.concat(F.col("source"), F.lit(","), F.col("lang")), ",", -1)
    co = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")) \
        .otherwise(F.array(F.concat(F.lit("n <= "), F.col("n_chars").cast("string"))))
    responses = F.array(F.array(F.col("text"), F.col("source")), F.array(F.col("lang")))
    return d.select("doc_id",
                    X.solve_prompt(F.col("text"), ex, co, F.col("lang"), True).alias("solve_prompt"),
                    X.report_text(F.col("text"), F.col("lang"), F.col("source"), F.col("lang"),
                                  F.array(F.lit("s0"), F.lit("s1")), responses).alias("report"))


# ------------------------------------------------------------------ X33 X37
@register("test_programs", f"""
SELECT doc_id, code, fn, 'assert ' || fn || '(' || replace(lang || {NL} || source, {NL}, ',') || ') == '
                          || CAST(n_chars AS VARCHAR) AS assertion
FROM (SELECT doc_id, lang, source, n_chars, code, split_part(split_part(code, 'def ', 2), '(', 1) AS fn
      FROM (SELECT doc_id, lang, source, n_chars,
                   CASE WHEN contains(r, '```') THEN
                          CASE WHEN length(split_part(r, 'python', 2)) > 4
                               THEN substring(split_part(r, 'python', 2), 2, length(split_part(r, 'python', 2)) - 4)
                               ELSE '' END
                        ELSE r END AS code
            FROM (SELECT doc_id, lang, source, n_chars,
                         CASE WHEN doc_id % 2 = 0 THEN '```python' || {NL} || 'def f_' || CAST(doc_id AS VARCHAR)
                                   || '(a, b):' || {NL} || '    return a' || {NL} || '```'
                              ELSE 'def g_' || CAST(doc_id AS VARCHAR) || '(x): ' || text END AS r
                  FROM documents) a) b) c""")
def q_test_programs(spark, sf_dir):
    """X33 + X37: code and function name from a reply, then an assertion line per test."""
    d = _docs(spark, sf_dir)
    r = F.when(F.col("doc_id") % 2 == 0,
               nl("```python", F.concat(F.lit("def f_"), F.col("doc_id").cast("string"), F.lit("(a, b):")),
                  "    return a", "```")) \
        .otherwise(F.concat(F.lit("def g_"), F.col("doc_id").cast("string"), F.lit("(x): "), F.col("text")))
    code = X.reply_code(r)
    return (d.select("doc_id", "lang", "source", "n_chars", code.alias("code"))
            .select("doc_id", "code", X.function_name(F.col("code")).alias("fn"), "lang", "source", "n_chars")
            .select("doc_id", "code", "fn", X.assertion_line(F.col("fn"), nl(F.col("lang"), F.col("source")),
                                                             F.col("n_chars").cast("string")).alias("assertion")))


# ------------------------------------------------------------------ P20
@register("test_mode", """
SELECT event_id, fn_name, CASE WHEN fn_name IS NULL THEN 'stdin' ELSE 'call' END AS mode
FROM (SELECT event_id, json_extract_string(CASE WHEN event_id % 2 = 0
              THEN '{"func_name": "f_' || CAST(user_id AS VARCHAR) || '"}' ELSE props END, '$.func_name') AS fn_name
      FROM events) a""")
def q_test_mode(spark, sf_dir):
    """P20: call-based when the metadata names a function, else standard input."""
    ev = V.table(spark, sf_dir, "events")
    meta = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"func_name": "f_'), F.col("user_id").cast("string"),
                                                      F.lit('"}'))).otherwise(F.col("props"))
    fn = F.get_json_object(meta, "$.func_name")
    return ev.select("event_id", fn.alias("fn_name"), C.test_mode(fn).alias("mode"))


# ------------------------------------------------------------------ X6 X7 X2
@register("label_parse", f"""
SELECT d.doc_id, CASE WHEN contains(r, 'Class:') THEN {strip("split_part(r, 'Class:', 2)")} ELSE r END AS label
FROM (SELECT d.doc_id, d.text || {NL} || 'Class: ' || CASE WHEN l.quality = 1 THEN 'CORRECT' ELSE 'INCORRECT' END
             || CASE WHEN l.toxic = 1 THEN ' Class: extra' ELSE '' END AS r
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) d""")
def q_label_parse(spark, sf_dir):
    """X6 over documents joined with their labels."""
    d = _docs(spark, sf_dir).join(V.table(spark, sf_dir, "labels"), "doc_id")
    r = F.concat(F.col("text"), F.lit("\nClass: "),
                 F.when(F.col("quality") == 1, F.lit("CORRECT")).otherwise(F.lit("INCORRECT")),
                 F.when(F.col("toxic") == 1, F.lit(" Class: extra")).otherwise(F.lit("")))
    return d.select("doc_id", X.parse_class_label(r).alias("label"))


@register("confidence_parse", f"""
SELECT doc_id, split_part(r, {NL}, 1) AS description, split_part(string_split(r, 'Confidence: ')[-1], {NL}, 1) AS confidence
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text
                          ELSE 'Verdict ' || CAST(doc_id AS VARCHAR) || {NL} || 'Confidence: '
                               || CAST(n_chars % 100 AS VARCHAR) || {NL} || text END AS r FROM documents) a""")
def q_confidence_parse(spark, sf_dir):
    """X7"""
    d = _docs(spark, sf_dir)
    r = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
        nl(F.concat(F.lit("Verdict "), F.col("doc_id").cast("string")),
           F.concat(F.lit("Confidence: "), (F.col("n_chars") % 100).cast("string")), F.col("text")))
    return d.select("doc_id", X.first_line(r).alias("description"), X.parse_confidence(r).alias("confidence"))


def _key_sql(x: str) -> str:
    codes = f"array_to_string(list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS VARCHAR)), '')"
    plain = f"replace({strip(x)}, '_', '')"
    digits = f"coalesce(nullif(ltrim(ltrim({plain}, '+-'), '0'), ''), '0')"
    return (f"CASE WHEN NOT regexp_matches({x}, '^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$') THEN {codes} "
            f"WHEN starts_with({plain}, '-') AND {digits} <> '0' THEN '-' || {digits} ELSE {digits} END")


# Names that stress the key: seven digits and more, signs, leading zeros, underscores, white space.
ODD_NAMES = ("'ClassEval_' || CAST(doc_id + 1000000 AS STRING)", "'-00' || CAST(doc_id AS STRING)",
             "' +0' || CAST(doc_id AS STRING) || '_000 '")


@register("qid_key", f"""
SELECT doc_id, {_key_sql('source')} AS source_key, {_key_sql('CAST(doc_id AS VARCHAR)')} AS id_key,
       {_key_sql("'ClassEval_' || CAST(doc_id AS VARCHAR)")} AS task_key,
       {_key_sql(ODD_NAMES[0])} AS long_key, {_key_sql(ODD_NAMES[1])} AS negative_key, {_key_sql(ODD_NAMES[2])} AS padded_key
FROM documents""")
def q_qid_key(spark, sf_dir):
    """Numeric problem keys (int of the name, else concatenated character codes)."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", VD.numeric_problem_key(F.col("source")).alias("source_key"),
                    VD.numeric_problem_key(F.col("doc_id").cast("string")).alias("id_key"),
                    VD.numeric_problem_key(F.concat(F.lit("ClassEval_"), F.col("doc_id").cast("string")))
                    .alias("task_key"),
                    *[VD.numeric_problem_key(F.expr(x)).alias(n)
                      for x, n in zip(ODD_NAMES, ("long_key", "negative_key", "padded_key"), strict=True)])
