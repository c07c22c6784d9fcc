"""Text and code-cleaning column expressions.

All are built-in Spark expressions (higher-order array functions and Java
regexes), so they run inside whole-stage code generation with no Python per
row. Regex notes: ``(?d)`` (UNIX_LINES) makes ``^``/``$``/``.`` treat only
``\\n`` as a line end, like Python's ``re``; Python's ``str.strip()`` removes
all white space, which ``py_strip`` reproduces with a regex (Spark's ``trim``
removes blanks only).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _q(s: str) -> str:
    """Quote a literal for use as a Java regex (split/regexp)."""
    return "\\Q" + s + "\\E"


def split_lit(s, delim: str) -> Column:
    """Python ``s.split(delim)`` for a literal delimiter (all pieces, empties kept)."""
    return F.split(_c(s), _q(delim), -1)


# ------------------------------------------------------------------ strip family
# The white space removed by the strip helpers (Java's \s set).
WHITESPACE = " \t\n\x0b\x0c\r"


def py_strip(s) -> Column:
    """Python ``str.strip()`` for ASCII white space, as a character-set trim (no regex)."""
    return F.trim(_c(s), F.lit(WHITESPACE))


def py_rstrip(s) -> Column:
    return F.rtrim(_c(s), F.lit(WHITESPACE))


def py_lstrip(s) -> Column:
    return F.ltrim(_c(s), F.lit(WHITESPACE))


def leading_spaces(s) -> Column:
    """``len(s) - len(s.lstrip())``."""
    c = _c(s)
    return F.length(c) - F.length(py_lstrip(c))


# ------------------------------------------------------------------ X3 O10
def seeded_rank_key(seed, *parts) -> Column:
    """Deterministic pseudo-random key: md5 of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))


def mask_text(df, text: str, rate: float, seed, key: str, out: str = "masked"):
    """X3 + O10: mask ``floor(n_words * rate)`` words chosen by md5 rank.

    The chosen words are those whose hash is at most the k-th smallest hash
    (hashes of distinct positions differ), so one sort per text is enough.
    A DataFrame step: the per-word hashes are staged once as a column.
    """
    cols = df.columns
    words = F.split(F.col(text), " ", -1)
    # md5("<seed>|<key>|<position>"): the per-row prefix is built once, each word adds its position
    prefix = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"))
    st = df.withColumn("_w", words).withColumn("_p", prefix).withColumn("_h", F.transform(
        F.sequence(F.lit(0), F.size("_w") - 1),
        lambda i: F.md5(F.concat(F.col("_p"), i.cast("string")))))
    n = F.size("_w")
    k = F.floor(n * F.lit(float(rate))).cast("int")
    thr = F.when(k > 0, F.try_element_at(F.array_sort("_h"), k))
    z = F.arrays_zip(F.col("_w").alias("w"), F.col("_h").alias("h"), F.array_repeat(thr, n).alias("t"))
    masked = F.array_join(F.transform(z, lambda x: F.when(
        x["h"] <= x["t"], F.repeat(F.lit("#"), F.length(x["w"]))).otherwise(x["w"])), " ")
    return st.select(*cols, masked.alias(out))


# ------------------------------------------------------------------ X4 X5
# Summary header spellings removed in this order.
SUMMARY_HEADERS = ("###SUMMARY\n", "###SUMMARY \n", "### SUMMARY\n", "### SUMMARY \n",
                   "SUMMARY\n", "SUMMARY \n")


def header_regex(headers: Sequence[str] = SUMMARY_HEADERS) -> str:
    """Removing prefixes one after the other equals one anchored regex of
    optional groups in the same order (greedy, never fails, so no backtracking)."""
    return "^" + "".join("(?:" + _q(h) + ")?" for h in headers)


def strip_summary_header(s, headers: Sequence[str] = SUMMARY_HEADERS,
                         after_last_summary: bool = True) -> Column:
    """Remove header spellings in sequence; then keep the text after the last 'SUMMARY'."""
    c = F.regexp_replace(_c(s), header_regex(headers), "")
    if after_last_summary:
        c = F.try_element_at(split_lit(c, "SUMMARY"), F.lit(-1))
    return c


def cap_length(s, n: int) -> Column:
    """The question is capped at ``n`` characters before summarising."""
    return F.substring(_c(s), 1, n)


# ------------------------------------------------------------------ X6 X7
def parse_class_label(s) -> Column:
    """Text after the first 'Class:' up to the next one, stripped; else the whole text."""
    c = _c(s)
    return F.when(F.contains(c, F.lit("Class:")),
                  py_strip(F.try_element_at(split_lit(c, "Class:"), F.lit(2)))).otherwise(c)


def parse_confidence(s) -> Column:
    """``s.split('Confidence: ')[-1].split('\\n')[0]``."""
    return F.substring_index(F.substring_index(_c(s), "Confidence: ", -1), "\n", 1)


def first_line(s) -> Column:
    """X7 description: ``s.split('\\n')[0]``."""
    return F.substring_index(_c(s), "\n", 1)


# ------------------------------------------------------------------ X8
# The docstring patterns, whole, as their quirks decide what is replaced and listed. In the first,
# {f} is a method's name; group 2 is the block after its header, group 3 a single-quoted block anywhere. In the
# second, group 1 is a double-quoted block.
METHOD_DOCSTRING = r"""(def\s+{f}\s*\([^)]*\)\s*:)\s*?(\"\"\"[\s\S]*?\"\"\")|(\'\'\'[\s\S]*?\'\'\')"""
ANY_DOCSTRING = r"""(?:\'\'\'[\s\S]*?\'\'\')|(\"\"\"[\s\S]*?\"\"\")"""


def docstring_of(class_text, fn) -> Column:
    """The block that counts as the docstring of ``fn``: the first match of METHOD_DOCSTRING; empty if there is none."""
    before, after = METHOD_DOCSTRING.split("{f}")
    pattern = F.concat(F.lit(before), _c(fn), F.lit(after))
    group = lambda n: F.call_function("regexp_extract", _c(class_text), pattern, F.lit(n))
    return F.when(group(2) != "", group(2)).otherwise(group(3))


def replace_docstring(class_text, fn, new_doc) -> Column:
    """Find the docstring of ``fn`` and replace *every* equal text by ``new_doc``."""
    t = _c(class_text)
    doc = docstring_of(t, fn)
    return F.when(doc != "", F.replace(t, doc, _lit(new_doc))).otherwise(t)


def replace_docstrings(skeleton, methods, name_field: str = "method_name",
                       doc_field: str = "method_description", quote: bool = True) -> Column:
    """X8 folded over all methods of a class (``aggregate`` over the method array)."""
    def step(acc, m):
        d = m[doc_field]
        if quote:
            d = F.concat(F.lit('"""'), d, F.lit('"""'))
        return replace_docstring(acc, m[name_field], d)
    return F.aggregate(_c(methods), _c(skeleton), step)


def list_docstrings(class_text) -> Column:
    """Group 1 of every match of ANY_DOCSTRING, stripped; single-quoted blocks are passed over whole."""
    found = F.regexp_extract_all(_c(class_text), F.lit(ANY_DOCSTRING), 1)
    return F.transform(F.filter(found, lambda b: b != ""), lambda b: py_strip(b))


# ------------------------------------------------------------------ X9 X10 X30
def remove_fences(s) -> Column:
    """``re.sub(r'^```python\\s*|```$', '', s, flags=re.M)``."""
    return F.regexp_replace(_c(s), r"(?md)^```python\s*|```$", "")


def drop_python_first_line(s) -> Column:
    """A first line that mentions 'python' is dropped."""
    c = _c(s)
    lines = F.split(c, "\n", -1)
    return F.when(F.contains(F.try_element_at(lines, F.lit(1)), F.lit("python")),
                  F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")).otherwise(c)


def cut_at_fence(s) -> Column:
    """``s.split('```')[0]``."""
    return F.substring_index(_c(s), "```", 1)


def clean_answer(s) -> Column:
    """Drop all fences, strip the right side."""
    return py_rstrip(F.replace(_c(s), F.lit("```"), F.lit("")))


# ------------------------------------------------------------------ X11 - X15
# Response markers and fenced-code patterns, tried in order.
RESPONSE_MARKERS = ("### Response:", "@@ Response:", "[/INST]")
CODE_PATTERNS = (r"```python(.*?)```", r"```ruby(.*?)```", r"```scss(.*?)```",
                 r"```python(.*?)", r"```(.*?)```", r"\[PYTHON\](.*?)\[/PYTHON\]")


def _strip_startswith(line, word: str) -> Column:
    return py_strip(line).startswith(word)


def _markers(text) -> Column:
    """The text after the first marker (in the order of the list) that occurs, up to its next occurrence."""
    t = py_rstrip(_c(text))
    out = t
    for m in reversed(RESPONSE_MARKERS):
        out = F.when(F.contains(t, F.lit(m)), F.try_element_at(split_lit(t, m), F.lit(2))).otherwise(out)
    return out


def extract_code(df, text: str, out: str = "code", model_name: str | None = None):
    """X11: response markers, then the first matching fence pattern (group 1, dot
    matches newline), else a line filter up to the class line with relative
    dedent of a class that is not at column 0.

    A DataFrame step (not a single expression): the marker-cleaned text and
    the line arrays are staged as columns, because each is read many times.
    """
    cols = df.columns
    st = df.withColumn("_t", _markers(F.col(text)))
    st = st.withColumn("_lines", F.split(F.col("_t"), "\n", -1))
    fc = F.array_position(F.transform("_lines", lambda l: _strip_startswith(l, "class")), F.lit(True))
    is_import = lambda l: _strip_startswith(l, "import") | _strip_startswith(l, "from")
    # lines above the class that import nothing go, and with them every equal line below; without a class line
    # all lines are above it, so a line stays exactly if it imports
    head = F.when(fc > 1, F.slice("_lines", 1, (fc - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    removed = F.array_distinct(F.filter(head, lambda l: ~is_import(l)))
    z = F.arrays_zip(F.col("_lines").alias("l"), F.array_repeat(removed, F.size("_lines")).alias("r"))
    by_class = F.transform(F.filter(z, lambda x: ~F.array_contains(x["r"], x["l"])), lambda x: x["l"])
    st = st.withColumn("_kept", F.when(F.coalesce(fc, F.lit(0)) == 0, F.filter("_lines", is_import)).otherwise(by_class))
    k_class = F.filter("_kept", lambda l: _strip_startswith(l, "class"))
    st = st.withColumn("_ind", F.coalesce(leading_spaces(F.try_element_at(k_class, F.lit(1))), F.lit(0)))
    zd = F.arrays_zip(F.col("_kept").alias("l"), F.array_repeat(F.col("_ind"), F.size("_kept")).alias("d"))
    dedented = F.transform(zd, lambda x: F.concat(
        F.repeat(F.lit(" "), F.greatest(leading_spaces(x["l"]) - x["d"], F.lit(0))), py_lstrip(x["l"])))
    fallback = F.array_join(F.when(F.col("_ind") != 0, dedented).otherwise(F.col("_kept")), "\n")
    res = fallback
    for p in reversed(CODE_PATTERNS):
        rp = "(?s)" + p
        res = F.when(F.col("_t").rlike(rp), F.regexp_extract(F.col("_t"), rp, 1)).otherwise(res)
    if model_name is not None:
        incoder = F.try_element_at(split_lit(F.col("_t"), "<|/ file |>"), F.lit(1))
        res = F.when(F.contains(F.col(model_name), F.lit("incoder")), incoder).otherwise(res)
    return st.select(*cols, res.alias(out))


def add_static_methods(code) -> Column:
    """Drop lines with '@staticmethod', then add it above 4-space ``def`` lines
    that mention neither ``self`` nor ``cls``."""
    lines = F.filter(F.split(_c(code), "\n", -1), lambda l: ~F.contains(l, F.lit("@staticmethod")))
    need = lambda l: (_strip_startswith(l, "def ") & ~F.contains(l, F.lit("self"))
                      & ~F.contains(l, F.lit("cls")) & (leading_spaces(l) == 4))
    return F.array_join(F.flatten(F.transform(lines, lambda l: F.when(
        need(l), F.array(F.lit("    @staticmethod"), l)).otherwise(F.array(l)))), "\n")


def classeval_program(code, imports) -> Column:
    """X11 output -> text after the last 'python' -> X12 static methods -> X13 imports
    (the order in which ClassEval predictions become programs)."""
    piece = F.try_element_at(split_lit(_c(code), "python"), F.lit(-1))
    return F.concat(F.array_join(_c(imports), "\n"), F.lit("\n"), add_static_methods(piece))


# Fixed value: the lines (or their ends) that count as imports.
IMPORT_LINES = r"^import\s.*$|from\s.*\simport.*$"


def extract_imports(code) -> Column:
    """The import statements of a code, one per match of IMPORT_LINES in multi-line mode."""
    return F.regexp_extract_all(_c(code), F.lit(f"(?md){IMPORT_LINES}"), 0)


def class_program(code, test) -> Column:
    """Program text = code + newline + test source."""
    return F.concat(_c(code), F.lit("\n"), _c(test))


# ------------------------------------------------------------------ X16 - X18
def starter_code(solution, fraction: float) -> Column:
    """The first ``int(n_lines * fraction)`` lines of the solution."""
    lines = F.split(_c(solution), "\n", -1)
    k = F.floor(F.size(lines) * F.lit(float(fraction))).cast("int")
    return F.array_join(F.slice(lines, 1, k), "\n")


ALNUM = r"[\p{L}\p{N}]"


def first_n_lines(s, n: int) -> Column:
    """Lines up to and including the n-th line that has a letter or digit."""
    lines = F.split(_c(s), "\n", -1)
    alnum_pos = F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(ALNUM), i).otherwise(F.lit(-1))),
                         lambda i: i >= 0)
    cut = F.try_element_at(alnum_pos, F.lit(n))
    keep = F.when(F.size(alnum_pos) >= n, F.slice(lines, 1, cut + 1)).otherwise(lines)
    return F.array_join(keep, "\n")


# Fixed value: what stands for the part cut out.
CUT_MARK = "...(truncated) ..."


def truncate_middle(s, length: int | Column) -> Column:
    """A text longer than ``length`` keeps its first half and its last half of that
    length (the larger half at the end; a length of 0 keeps the whole text after the mark)."""
    c = _c(s)
    n = F.lit(length) if isinstance(length, int) else length
    head = F.substring(c, F.lit(1), F.floor(n / 2).cast("int"))
    tail = F.when(n == 0, c).otherwise(F.right(c, F.ceil(n / 2).cast("int")))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(head, F.lit(CUT_MARK), tail))


def truncate_lines(s, total: int) -> Column:
    """X18, call-based: every line of the stripped text is cut to its share of ``total``."""
    c = _c(s)
    lines = F.split(py_strip(c), "\n", -1)
    share = F.floor(F.lit(total) / F.size(F.split(c, "\n", -1))).cast("int")
    z = F.arrays_zip(lines.alias("l"), F.array_repeat(share, F.size(lines)).alias("n"))
    return F.array_join(F.transform(z, lambda x: truncate_middle(x["l"], x["n"])), "\n")


# Texts that prompts and feedback must carry.
COMPILE_FEEDBACK = '"Code failed to compile."'
RUNTIME_FEEDBACK = '"Runtime error.\n\nInput:\n'
FAILED_FEEDBACK = '"Test case failed.\n\nInput:\n'
EXPECTED_FEEDBACK = "\nExpected Output:\n"
STARTER_HEAD = "Here is the starter code that you must continue:\n\n```python\n"
SOLVE_HEAD = "Solve the following problem:\n "
EXAMPLES_HEAD = "Given the following examples:\n "
CONSTRAINTS_HEAD = "Given the following constraint(s):\n "
SUMMARY_HEAD = "A summary of the solution is:\n "


# ------------------------------------------------------------------ X25
def failure_message(first_verdict, first_runtime_input, first_runtime_output,
                    any_runtime, random_input, random_output) -> Column:
    """Compile error / first runtime error / a (random) failed test, quoted."""
    return (F.when(_c(first_verdict) == -2, F.lit(COMPILE_FEEDBACK))
            .when(_c(any_runtime), F.concat(F.lit(RUNTIME_FEEDBACK), _c(first_runtime_input),
                                            F.lit(EXPECTED_FEEDBACK), _c(first_runtime_output), F.lit('"')))
            .otherwise(F.concat(F.lit(FAILED_FEEDBACK), _c(random_input),
                                F.lit(EXPECTED_FEEDBACK), _c(random_output), F.lit('"'))))


# ------------------------------------------------------------------ X28 X29 P14 P15
def fill_slots(body, slots: Mapping[str, Column | str]) -> Column:
    """Replace every ``{name}`` slot by its column value."""
    c = _c(body)
    for name, val in slots.items():
        v = _lit(val) if isinstance(val, str) else val
        c = F.replace(c, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("None")))
    return c


def join_suffix(sys_prompt, suffix) -> Column:
    """``" ".join([sys.rstrip(), suffix])`` when a task suffix exists."""
    s, x = _c(sys_prompt), _c(suffix)
    return F.when(x.isNull(), s).otherwise(F.concat(py_rstrip(s), F.lit(" "), x))


def prompt_type(step) -> Column:
    """Step 0 uses the initial-code prompt, later steps the feedback prompt."""
    return F.when(_c(step) == 0, F.lit("asst_initial_code")).otherwise(F.lit("asst_code"))


# Feedback types answered without a model query.
NO_QUERY_FEEDBACK = ("comment", "code", "code_or_comment", "nl_feedback", "test_case", "input_refinement")


def needs_user_query(feedback_type) -> Column:
    """X29"""
    return ~_c(feedback_type).isin(*NO_QUERY_FEEDBACK)


def starter_block(task, starter) -> Column:
    """LiveCodeBench rows with a starter get the 'continue this code' block."""
    st = _c(starter)
    return F.when((_c(task) == "livecodebench") & (st != ""), F.concat(
        F.lit(STARTER_HEAD), st,
        F.lit("\n\n```"))).otherwise(F.lit(""))


def effective_question(feedback_type, step, user_response, question) -> Column:
    """From step 1 on, input refinement replaces the question by the user's rewrite."""
    return F.when((_c(feedback_type) == "input_refinement") & (_c(step) > 0),
                  _c(user_response)).otherwise(_c(question))


# ------------------------------------------------------------------ X31 X32
# Python literals, as far as lists of solutions have them. All repetitions are possessive: they never go back,
# so long texts need no deep recursion.
_TEXT = (r"[uU]?(?:\'\'\'(?s:[^'\\]|\\.|'(?!''))*+\'\'\'|\"\"\"(?s:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\""
         r"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\(?s:.)[^\"\\\n]*+)*+\")")
_ITEM = rf"(?:{_TEXT}(?:\s*+{_TEXT})*+|[-+]?[0-9][0-9_]*+(?:\.[0-9]*+)?(?:[eE][-+]?[0-9]++)?|None|True|False)"
_ITEMS = rf"{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+"
_LIST = rf"^\s*+(?:\[\s*+(?:{_ITEMS},?\s*+)?+\]|\((?:\s*+|\s*+{_ITEM}\s*+,\s*+(?:{_ITEMS},?\s*+)?+)\))\s*+$"
_ESCAPE = r"(?s)\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)|[^\\]++"
#: The single letters of Python's escapes and what they stand for.
_ESCAPED = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\\\": "\\", "\\'": "'", '\\"': '"', "\\a": "\x07", "\\b": "\x08", "\\f": "\x0c",
            "\\v": "\x0b", "\\\n": ""}


def _unescaped(piece: Column) -> Column:
    """The text of one piece of a Python text: an escape, or characters without one."""
    code = lambda hexed, width, name: F.decode(F.unhex(F.lpad(hexed, width, "0")), name)
    out = F.when(~piece.startswith("\\"), piece)
    for escape, value in _ESCAPED.items():
        out = out.when(piece == F.lit(escape), F.lit(value))
    rest = F.substring(piece, F.lit(3), F.length(piece))
    return (out.when(piece.rlike(r"^\\[xu][0-9a-fA-F]{2}"), code(rest, 4, "UTF-16BE"))
            .when(piece.rlike(r"^\\U[0-9a-fA-F]{8}"), code(rest, 8, "UTF-32"))
            .when(piece.rlike(r"^\\[0-7]"), code(F.conv(F.substring(piece, F.lit(2), F.length(piece)), 8, 16), 4, "UTF-16BE"))
            .otherwise(piece))


def _text_value(literal: Column) -> Column:
    """The text of one quoted Python literal."""
    bare = F.regexp_replace(literal, r"^[uU](?=['\"])", "")
    width = F.when(bare.rlike(r"^('''|\"\"\")"), 3).otherwise(1)
    inner = F.substring(bare, width + 1, F.length(bare) - 2 * width)
    return F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(_ESCAPE), 0), _unescaped), "")


def parse_solutions(s) -> Column:
    """The elements of a list of solutions as texts, else the value itself as a one-element list.

    Read are JSON lists and the Python lists and tuples of plain values that
    ``eval`` reads: texts with any quotes, escapes and neighbours that join,
    numbers, ``None`` (null), ``True`` and ``False``.
    """
    c = _c(s)
    texts = lambda item: F.array_join(F.transform(F.regexp_extract_all(item, F.lit(_TEXT), 0), _text_value), "")
    item = lambda x: (F.when(x == "None", F.lit(None).cast("string")).when(x.rlike(r"^[uU]?['\"]"), texts(x))
                      .otherwise(F.replace(F.regexp_replace(x, r"^\+", ""), F.lit("_"), F.lit(""))))
    listed = F.when(c.rlike(r"^\s*+[\[(]") & c.rlike(_LIST), F.transform(F.regexp_extract_all(c, F.lit(_ITEM), 0), item))
    # as a field: read alone, what follows a list would be left out
    read = F.from_json(F.concat(F.lit('{"s":'), c, F.lit("}")), "s array<string>, _corrupt_record string")
    return F.coalesce(F.when(read["_corrupt_record"].isNull(), read["s"]), listed, F.array(c))


def repo_name(path) -> Column:
    """Parent directory name of a path."""
    return F.try_element_at(F.split(_c(path), "/", -1), F.lit(-2))


# ------------------------------------------------------------------ X33 - X38
def reply_code(reply) -> Column:
    """With a fence, the text after the first 'python' minus its first and last 3 chars."""
    c = _c(reply)
    after = F.try_element_at(split_lit(c, "python"), F.lit(2))
    inner = F.when(F.length(after) > 4, F.substring(after, 2, F.length(after) - 4)).otherwise(F.lit(""))
    return F.when(F.contains(c, F.lit("```")), inner).otherwise(c)


def function_name(code) -> Column:
    """Name between the first 'def ' and the next '('."""
    return F.substring_index(F.try_element_at(split_lit(_c(code), "def "), F.lit(2)), "(", 1)


def assertion_line(fn, test_input, expected) -> Column:
    """``assert fn(args) == expected``; newlines in the arguments become commas."""
    return F.concat(F.lit("assert "), _c(fn), F.lit("("), F.replace(_c(test_input), F.lit("\n"), F.lit(",")),
                    F.lit(") == "), _c(expected))


def py_list_repr(arr) -> Column:
    """``str(list_of_strings)`` for strings without quotes inside."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), lambda x: F.concat(F.lit("'"), x, F.lit("'"))),
                                             ", "), F.lit("]"))


def solve_prompt(question, examples, constraints, summary, with_summary: bool) -> Column:
    """Question, optional examples, optional constraints, optional summary."""
    ex, co = _c(examples), _c(constraints)
    parts = [F.lit(SOLVE_HEAD), _c(question), F.lit("\n\n"),
             F.when(F.size(ex) > 0, F.concat(F.lit(EXAMPLES_HEAD), py_list_repr(ex),
                                            F.lit("\n\n"))).otherwise(F.lit("")),
             F.when(F.size(co) > 0, F.concat(F.lit(CONSTRAINTS_HEAD), py_list_repr(co),
                                            F.lit("\n\n"))).otherwise(F.lit(""))]
    if with_summary:
        parts += [F.lit(SUMMARY_HEAD), _c(summary)]
    return F.concat(*parts)


# The headings of the text report, in order.
RESPONSE_SEP = "\n---------\n"
REPORT_QUESTION, REPORT_SUMMARIZED = "Question: ", "\n\n\nSummarized Question: "
REPORT_SOLUTION = "\n\n\n################FULL GROUND TRUTH SOLUTION ################\n\n\n"
REPORT_SUMMARY = "\n\n################SOLUTION SUMMARY################\n\n\n"
REPORT_PARTIAL = ("################PARTIAL SOLUTION ", ": ################\n\n\nStarter Code: \n")
REPORT_RESPONSES = "\n--------------------------------------\n"


def report_text(question, summarized, solution, summary, starters, responses) -> Column:
    """Question, summary, full solution and each partial solution with its responses.

    ``starters`` is an array of starter codes, ``responses`` an array (same
    order) of response arrays.
    """
    both = F.arrays_zip(_c(starters).alias("s"), _c(responses).alias("r"))
    before, after = map(F.lit, REPORT_PARTIAL)
    parts = F.transform(both, lambda x, i: F.concat(before, i.cast("string"), after, x["s"], F.lit(REPORT_RESPONSES),
                                                    F.array_join(x["r"], RESPONSE_SEP)))
    return F.concat(F.lit(REPORT_QUESTION), _c(question), F.lit(REPORT_SUMMARIZED), _c(summarized), F.lit(REPORT_SOLUTION),
                    _c(solution), F.lit(REPORT_SUMMARY), _c(summary), F.lit("\n\n\n"), F.array_join(parts, "\n"))


def merge_partial(completion, starter, partial) -> Column:
    """Cut the completion at its fence, prefix the cleaned starter, and put the
    partial solution in front when the result does not already contain it."""
    code = F.concat(py_strip(F.replace(_c(starter), F.lit("```python"), F.lit(""))), cut_at_fence(completion))
    return F.when(F.contains(code, _c(partial)), code).otherwise(F.concat(_c(partial), F.lit("\n"), code))
