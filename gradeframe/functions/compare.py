"""Output comparison ladder (X19-X23, U5) as column expressions.

A captured stdout is compared with the expected text by a sequence of ever
looser checks; the first that holds decides a pass. Everything is a built-in
array/regex expression, evaluated per row inside code generation - no Python.

APPS ladder (stdout lines = ``splitlines()`` of the captured text):
  1. stripped joined lines == stripped expected
  2. joined stripped lines, stripped == stripped expected
  3. lines == [expected]
  4. lines == non-empty stripped expected lines
  5. non-empty lines == those expected lines
  6. all lines numbers, same count, |a - b| <= 1e-8 + 1e-5 * |b|
  7. set of per-line token sets equal (order and repeats ignored)            (U5)
  8. the same with every token rounded to 3 decimals
LiveCodeBench uses 1-6 and skips 6 when every compared pair is an integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip
from .verdict import ascii_digits, numeric_problem_key

# Numpy ``allclose`` defaults.
RTOL = 1e-5
ATOL = 1e-8
def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Single-character line boundaries besides "\n" (and the "\r\n" pair).
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


OTHER_BREAKS_CLASS = "[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _normalize_breaks(c: Column) -> Column:
    """Every line boundary becomes "\n" ("\r\n" counts once). The translate
    pass only runs when a rare boundary character is present."""
    return F.when(c.rlike(OTHER_BREAKS_CLASS),
                  F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), OTHER_BREAKS,
                              "\n" * len(OTHER_BREAKS))).otherwise(c)


def _drop_last_if_break(norm: Column, parts: Column, orig: Column) -> Column:
    return (F.when(orig == "", F.array().cast("array<string>"))
            .when(F.right(norm, F.lit(1)) == "\n", F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def splitlines(s) -> Column:
    """Python ``str.splitlines()``: no trailing empty piece, [] for ''.

    Column form; inside larger plans prefer :func:`with_lines`, which stages
    the normalised text once."""
    c = _c(s)
    norm = _normalize_breaks(c)
    return _drop_last_if_break(norm, F.split(norm, "\n", -1), c)


def with_lines(df, col: str, out: str):
    """DataFrame step: ``out`` = ``splitlines(col)``, with the normalised text
    and the split pieces staged as columns so each is computed once."""
    cols = df.columns
    st = df.withColumn("_norm_" + out, _normalize_breaks(F.col(col)))
    st = st.withColumn("_parts_" + out, F.split(F.col("_norm_" + out), "\n", -1))
    res = _drop_last_if_break(F.col("_norm_" + out), F.col("_parts_" + out), F.col(col))
    return st.select(*cols, res.alias(out))


def expected_lines(expected) -> Column:
    """``[x.strip() for x in expected.split('\\n') if x]``."""
    return F.transform(F.filter(F.split(_c(expected), "\n", -1), lambda x: x != ""), py_strip)


# What Python's ``float()`` reads, apart from the special names: digits with single underscores
# between them, a point, an exponent. (A cast alone would also take Java's "1f" and "1d".)
FLOAT_TEXT = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
SPECIAL_FLOAT = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def maybe_number(x) -> Column:
    """Text that ``float()`` accepts."""
    s = py_strip(_c(x))
    return s.rlike(FLOAT_TEXT) | s.rlike(SPECIAL_FLOAT)


def py_float(x) -> Column:
    """``float(text)``; NULL where it would raise. The cast only runs on texts that fit,
    as a failing cast raises and catches an exception per value."""
    s = py_strip(_c(x))
    special = (F.when(F.lower(s).contains("nan"), F.lit(float("nan")))
               .when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return (F.when(s.rlike(FLOAT_TEXT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
            .when(s.rlike(SPECIAL_FLOAT), special))


def _as_doubles(arr) -> Column:
    return F.transform(arr, py_float)


def near(x: Column, y: Column) -> Column:
    """One pair of ``numpy.allclose``: NaN is near nothing, an infinity only itself."""
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(x) | F.isnan(y), F.lit(False)).when(x == y, F.lit(True))
            .when((F.abs(x) == inf) | (F.abs(y) == inf), F.lit(False))
            .otherwise(F.abs(x - y) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(y)))


def all_close(a, b) -> Column:
    """X19 numeric check: equal length and every pair within tolerance (asymmetric in b)."""
    fa, fb = _as_doubles(a), _as_doubles(b)
    parsed = F.forall(fa, lambda x: x.isNotNull()) & F.forall(fb, lambda x: x.isNotNull())
    close = F.forall(F.zip_with(fa, fb, near), lambda ok: ok)
    quick = (F.size(a) == F.size(b)) & F.forall(a, maybe_number) & F.forall(b, maybe_number)
    return F.when(quick, parsed & close).otherwise(F.lit(False))


def py_round(x: Column, digits: int) -> Column:
    """Python's ``round(x, digits)``: to the nearest multiple of 10^-digits of the exact binary value, ties to even.

    The product with 10^digits is rounded itself; where it falls on a half, the
    rounding error of the product (found by splitting the factor into two
    halves whose products are exact) says on which side the value really is.
    """
    scale = float(10 ** digits)
    big = F.lit(134217729.0) * x
    high = big - (big - x)
    twice = x * (2.0 * scale)
    error = (high * (2.0 * scale) - twice) + (x - high) * (2.0 * scale)
    half = (twice % 2.0 != 0) & (F.floor(twice).cast("double") == twice)
    down = (twice - 1.0) / 2.0
    whole = (F.when(half & (error > 0), down + 1.0).when(half & (error < 0), down).otherwise(F.rint(x * scale)))
    return F.when(F.isnan(x) | (F.abs(x) >= 1e18 / scale), x).otherwise(whole / scale)


def round_three(x: Column) -> Column:
    """Python's ``round(x, 3)``."""
    return py_round(x, 3)


def is_int_text(x) -> Column:
    """``str.isdigit()`` for ASCII digits."""
    return _c(x).rlike("^[0-9]+$")


def all_int_pairs(a, b) -> Column:
    """X20 over ``zip(a, b)``: pairs up to the shorter length are all integer text."""
    n = F.least(F.size(a), F.size(b))
    return F.forall(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n),
                               lambda x, y: is_int_text(x) & is_int_text(y)), lambda ok: ok)


# White space other than the blank that separates tokens (Java's \s set).
_WS_OTHER = "\t\n\x0b\x0c\r"


def token_set(line) -> Column:
    """Tokens of one line (``line.split()``) as a sorted distinct array.

    White space is mapped to blanks and split on the single blank (no regex)."""
    blanks = F.translate(_c(line), _WS_OTHER, " " * len(_WS_OTHER))
    return F.array_sort(F.array_distinct(F.filter(F.split(blanks, " ", -1), lambda t: t != "")))


def token_set_key(line) -> Column:
    """A line's token set as one text: its sorted distinct tokens joined by a blank.
    Tokens never contain blanks, so equal keys mean equal sets."""
    return F.array_join(token_set(line), " ")


def token_sets(lines, drop_empty: bool) -> Column:
    """Set of per-line token sets, as a sorted distinct array of set keys
    (strings sort and hash much faster than nested arrays)."""
    s = F.transform(lines, token_set_key)
    if drop_empty:
        s = F.filter(s, lambda k: k != "")
    return F.array_sort(F.array_distinct(s))


# ------------------------------------------------------------------ X21 - X23
# Values of a parsed JSON text on one scale: Python holds 1e2 == 100 == 100.0 and true == 1.
_NUMBER_TOKEN = r"(?<![\w.\"+-])-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.\"])"


#: Magnitudes from which a double has no whole part in a long, and in a long times 2^53.
_LONG, _TWO_LONGS = 2.0 ** 63, 2.0 ** 116


def canonical_number(n: Column) -> Column:
    """One text for equal Python numbers: integers by their digits, whole doubles as the
    integer they are, other doubles by their value (integers are never rounded)."""
    whole = F.regexp_replace(n, r"^-(?=0+$)", "")
    d = n.cast("double")
    high = F.floor(d / F.lit(2.0 ** 53)).cast("long")
    low = (d - high.cast("double") * F.lit(2.0 ** 53)).cast("long")
    wide = high.cast("decimal(19,0)") * F.lit(2 ** 53).cast("decimal(17,0)") + low.cast("decimal(17,0)")
    return (F.when(~n.rlike(r"[.eE]"), whole)
            .when((F.abs(d) < _LONG) & (F.floor(d).cast("double") == d), d.cast("long").cast("string"))
            .when((F.abs(d) >= _LONG) & (F.abs(d) < _TWO_LONGS), wide.cast("string"))
            .otherwise((d + 0.0).cast("string")))


def canonical_values(j: Column) -> Column:
    """Canonical text of a value given as JSON text in Spark's form.

    Strings are set aside, then numbers are written in one form
    (:func:`canonical_number`) and true/false as 1/0, so equal Python values
    have equal texts.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    strings = F.when(F.contains(j, F.lit('"')), F.array_join(F.regexp_extract_all(j, F.lit(string), 0), "\x02")).otherwise("")
    rest = F.when(F.contains(j, F.lit('"')), F.regexp_replace(j, string, '"')).otherwise(j)
    rest = F.replace(F.replace(rest, F.lit("true"), F.lit("1")), F.lit("false"), F.lit("0"))
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(_NUMBER_TOKEN), 0), canonical_number)
    return F.concat_ws("\x01", F.regexp_replace(rest, _NUMBER_TOKEN, "#"), F.array_join(numbers, "\x02"), strings)


def call_result_matches(output, expected) -> Column:
    """The returned value equals the expected value, or its first element
    when the expected value is a non-empty list (tuples arrive as JSON lists).

    Both values are parsed once (bound through an array of one); equal texts
    decide most calls, and only the others are written in canonical form.
    """
    e = F.try_parse_json(_c(expected))
    first = F.when(F.schema_of_variant(e).startswith("ARRAY"), F.to_json(F.try_variant_get(e, "$[0]", "variant")))
    bound = F.array(F.struct(F.to_json(F.try_parse_json(_c(output))).alias("o"), F.to_json(e).alias("e"), first.alias("f")))

    def same(x):
        plain = (x["o"] == x["e"]) | F.coalesce(x["o"] == x["f"], F.lit(False))
        own = canonical_values(x["o"])
        by_first = F.when(x["f"].isNotNull(), own == canonical_values(x["f"])).otherwise(False)
        return (F.when(x["o"].isNull() | x["e"].isNull(), False).when(plain, True)
                .otherwise((own == canonical_values(x["e"])) | by_first))

    return F.coalesce(F.transform(bound, same)[0], F.lit(False))


def parse_call_args(text) -> Column:
    """One JSON value per input line (``array<variant>``)."""
    return F.transform(F.split(_c(text), "\n", -1), lambda l: F.try_parse_json(l))


#: Fixed value: texts that ``int()`` reads.
INT_TEXT = r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"


def _last_of_equal(entries: Column) -> Column:
    """A map of the entries in the order of their keys' first, each with its last value, as a dict is built."""
    def of(bound):
        keys = F.transform(bound, lambda e: e["key"])
        merged = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(
            F.filter(bound, lambda e: e["key"] == k), -1)["value"].alias("value")))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), bound).otherwise(merged))
    return F.transform(F.array(entries), of)[0]


def int_keys_or_original(m) -> Column:
    """X23 with one result type: keys as the canonical text of ``int(k)`` (' 07' -> '7', of any
    size) when every key is one, of equal keys the last, else the original map - as the
    reference keeps the dict when the conversion fails."""
    mc = _c(m)
    ok = F.forall(F.map_keys(mc), lambda k: ascii_digits(k).rlike(INT_TEXT))
    norm = F.transform(F.map_entries(mc), lambda e: F.struct(numeric_problem_key(e["key"]).alias("key"), e["value"].alias("value")))
    return F.when(ok, _last_of_equal(norm)).otherwise(mc)


def int_keys(m) -> Column:
    """Restore integer map keys (``{int(k): v}``, of equal keys the last) as ``decimal(38,0)``;
    NULL when a key is no integer of at most 38 digits (:func:`int_keys_or_original` has no bound)."""
    mc = _c(m)
    ok = F.forall(F.map_keys(mc), lambda k: F.coalesce(ascii_digits(k).rlike(INT_TEXT) & (F.length(numeric_problem_key(k)) <= 38), F.lit(False)))
    return F.when(ok, _last_of_equal(F.transform(F.map_entries(mc), lambda e: F.struct(
        numeric_problem_key(e["key"]).try_cast("decimal(38,0)").alias("key"), e["value"].alias("value")))))


# ------------------------------------------------------------------ staged form
def with_ladder(df, stdout: str = "stdout", expected: str = "expected"):
    """DataFrame form of the ladder.

    The line arrays are staged as columns (several rungs read them). The rung is
    a lazy CASE: the token sets are only built for outputs that the line rungs
    rejected, once for both set rungs. Adds ``rung``, ``passed_apps`` and
    ``passed_lcb``.
    """
    cols = df.columns
    st = (with_lines(df, stdout, "_out")
            .withColumn("_el", expected_lines(F.col(expected)))
            .withColumn("_sexp", py_strip(F.col(expected))))
    st = st.withColumn("_ne", F.filter("_out", lambda x: x != ""))
    out, el, ne = F.col("_out"), F.col("_el"), F.col("_ne")
    # bound once through an array of one, so that each rung reads what the ladder has computed
    tso = F.filter(F.transform(ne, token_set), lambda a: F.size(a) > 0)
    tse = F.transform(el, token_set)

    def keys(sets):
        return F.array_sort(F.array_distinct(F.transform(sets, lambda a: F.array_join(a, " "))))

    def rounded(sets):
        quick = F.forall(sets, lambda a: F.forall(a, maybe_number))
        r = F.transform(sets, lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda t: round_three(py_float(t))))))
        # a NaN is equal to nothing, not even in a set of numbers read apart
        no_nan = F.forall(r, lambda a: ~F.exists(a, F.isnan))
        return F.when(quick, F.when(no_nan, F.array_sort(F.array_distinct(r))))

    def same_sets(o, e):
        return (F.when(keys(o) == keys(e), F.lit("token_sets"))
                .when(F.coalesce(rounded(o) == rounded(e), F.lit(False)), F.lit("rounded_sets")).otherwise(F.lit("fail")))

    by_sets = F.transform(F.array(F.struct(tso.alias("o"), tse.alias("e"))), lambda x: same_sets(x["o"], x["e"]))[0]
    rungs = [
        ("exact", py_strip(F.array_join(out, "\n")) == F.col("_sexp")),
        ("line_strip", py_strip(F.array_join(F.transform(out, py_strip), "\n")) == F.col("_sexp")),
        ("single", (F.size(out) == 1) & (F.try_element_at(out, F.lit(1)) == F.col(expected))),
        ("lines", out == el),
        ("nonempty_lines", ne == el),
        ("numeric", all_close(ne, el)),
    ]
    rung = by_sets                       # only evaluated where the cheaper rungs reject
    for name, cond in reversed(rungs):
        rung = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(rung)
    st = st.withColumn("rung", rung)
    base = F.col("rung").isin("exact", "line_strip", "single", "lines", "nonempty_lines")
    lcb = base | ((F.col("rung") == "numeric") & ~F.coalesce(all_int_pairs(ne, el), F.lit(True)))
    return st.select(*cols, "rung", (F.col("rung") != "fail").alias("passed_apps"), lcb.alias("passed_lcb"))
