"""Column expressions for verdict codes and problem keys.

Verdict codes (fixed values of the grading protocol):
    -2  compile error
    -1  runtime error
     0  test failed   (False)
     1  test passed   (True)
A verdict counts as a pass when it is > 0.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four verdict codes.
COMPILE_ERROR = -2
RUNTIME_ERROR = -1
FAILED = 0
PASSED = 1
VALID_CODES = (COMPILE_ERROR, RUNTIME_ERROR, FAILED, PASSED)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_verdict(raw) -> Column:
    """Mixed bool/int verdict text ('true', 'False', '-1', '1.0') -> int code.

    Only the four codes come out; any other text or number becomes NULL
    (never an exception, never a pass) and is left to :func:`quarantine`.
    """
    s = F.lower(F.trim(_c(raw).cast("string")))
    num = s.try_cast("double")
    code = F.when(num.isin(*[float(c) for c in VALID_CODES]), num.cast("int"))
    return F.when(s == "true", F.lit(1)).when(s == "false", F.lit(0)).otherwise(code)


def is_compile_error(v="verdict") -> Column:
    """P10"""
    return _c(v) == COMPILE_ERROR


def is_runtime_error(v="verdict") -> Column:
    """P10"""
    return _c(v) == RUNTIME_ERROR


def is_pass(v="verdict") -> Column:
    """P10: truth of a verdict is ``> 0``."""
    return _c(v) > 0


def is_valid_code(v="verdict") -> Column:
    """Only the four codes are accepted."""
    return F.coalesce(_c(v).isin(*VALID_CODES), F.lit(False))


def quarantine(verdicts, verdict: str = "verdict"):
    """(rows with one of the four codes, the rest): statistics read the first, the rest is kept for inspection."""
    ok = is_valid_code(verdict)
    return verdicts.filter(ok), verdicts.filter(~ok)


@cache
def _digits() -> tuple[str, str]:
    """The decimal digits of all scripts but ASCII, and the ASCII digits they stand for."""
    found = [c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def ascii_digits(c: Column) -> Column:
    """The text with the decimal digits of any script as 0-9, as ``int()`` reads them."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, *_digits())).otherwise(c)


def numeric_problem_key(qid="qid") -> Column:
    """Int of the name, else the concatenated decimal character codes, as text.

    The integer has no bound ('ClassEval_1000000' has 39 digits), so it stays
    text in canonical form: no plus sign, no leading zeros. Order by
    :func:`numeric_order`.
    """
    name = _c(qid).cast("string")
    s = ascii_digits(name)
    plain = F.regexp_replace(s, r"^\s+|\s+$|_", "")
    sign = F.when(plain.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(plain, r"^[+-]", ""), r"^0+(?=[0-9])", "")
    direct = F.when(digits == "0", F.lit("0")).otherwise(F.concat(sign, digits))
    codes = F.array_join(F.transform(F.split(name, ""), lambda ch: F.ascii(ch).cast("string")), "")
    return F.when(s.rlike(r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"), direct).otherwise(codes)


def numeric_order(key="qid_key") -> list[Column]:
    """Sort columns that put the text keys of :func:`numeric_problem_key` in the order of their numbers."""
    k = _c(key)
    negative = k.startswith("-")
    size = F.length(k)
    return [F.when(negative, -size).otherwise(size), F.when(negative, F.translate(k, "0123456789", "9876543210")).otherwise(k)]
