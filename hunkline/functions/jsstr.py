"""JavaScript string semantics as Spark Column expressions.

The reference counts string length in UTF-16 code units, trims with the
ECMAScript whitespace set, and uses ``||`` fall-through on empty values.
Spark differs on each point; these helpers close the gaps while staying
inside whole-stage codegen (plain built-in functions, no UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript String.prototype.trim removes
# (WhiteSpace plus LineTerminator), as a Java regex character class.
JS_SPACE = (r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")

_JS_TRIM = r"\A" + JS_SPACE + r"+|" + JS_SPACE + r"+\z"
_NOT_SPACE = JS_SPACE[0] + "^" + JS_SPACE[1:]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a, b) -> Column:
    """Integral division ``a div b`` (both non-negative integers)."""
    a, b = _c(a), _c(b) if not isinstance(b, int) else F.lit(b)
    return ((a - a % b) / b).cast("bigint")


def utf16_length(c) -> Column:
    """``String.length`` in JavaScript: UTF-16 code units, not code points."""
    return F.shiftright(F.octet_length(F.encode(_c(c), "UTF-16BE")), 1).cast("bigint")


def estimate_tokens(c) -> Column:
    """``ceil(utf16_length / 2.5)`` in exact integer arithmetic: (2n + 4) div 5."""
    return int_div(utf16_length(c) * 2 + 4, 5)


def js_trim(c) -> Column:
    """``String.prototype.trim``: strips the whole ECMAScript whitespace set."""
    return F.regexp_replace(_c(c), _JS_TRIM, "")


def js_has_text(c) -> Column:
    """``s.trim().length > 0`` without materialising the trimmed copy."""
    return _c(c).rlike(_NOT_SPACE)


def strip_one_quote(c) -> Column:
    """``s.replace(/^["']|["']$/g, '')``: at most one quote off each end."""
    return F.regexp_replace(_c(c), r"""\A["']|["']\z""", "")


def js_replace_first(c, literal: str, replacement: str = "") -> Column:
    """``s.replace(literal, replacement)`` with a string pattern: first hit only."""
    pat = r"(?s)\A(.*?)\Q" + literal + r"\E"
    return F.regexp_replace(_c(c), pat, "$1" + replacement.replace("$", r"\$"))


def js_or(a, b) -> Column:
    """``a || b`` where ``a`` is a string or number: '' / 0 / NULL fall through."""
    a = _c(a)
    return F.coalesce(F.nullif(a, F.lit("")), _c(b))


def plural(n, word: str) -> Column:
    """``${n} word${n !== 1 ? 's' : ''}``"""
    n = _c(n)
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
