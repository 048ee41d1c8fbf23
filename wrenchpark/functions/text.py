"""Text helpers as Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- Fixed values: the characters String.prototype.trim removes (ECMAScript
# WhiteSpace and LineTerminator: tab, VT, FF, space, NBSP, BOM, the Zs space
# separators, LF, CR, LS, PS).  Spark's plain trim removes only the blank. ---
JS_WHITESPACE = ("\u0009\u000b\u000c\u0020\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u000a\u000d\u2028\u2029")
# --- end of fixed values ---


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: ColumnOrName) -> Column:
    """Trim with JavaScript's white-space set (a character-set trim, no regex)."""
    return F.trim(_c(c), F.lit(JS_WHITESPACE))


def trim_to_null(c: ColumnOrName) -> Column:
    """Trimmed text, or NULL when the value is NULL or only white space."""
    t = utrim(c)
    return F.when(F.length(t) > 0, t)


def is_non_empty(c: ColumnOrName) -> Column:
    """True when the trimmed text has at least one character (NULL is false)."""
    return F.coalesce(F.length(utrim(c)) > 0, F.lit(False))


def preview(c: ColumnOrName, n: int = 200) -> Column:
    return F.substring(_c(c), 1, n)


def provider_key(c: ColumnOrName, blank_label: str) -> Column:
    """Provider grouping key: blank-trimmed name, NULL or blank as ``blank_label``.

    Matches ISNULL(NULLIF(LTRIM(RTRIM(x)), ''), label): only ASCII blanks are
    trimmed, like the source SQL.
    """
    return F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), F.lit(blank_label))


def lower_eq(c: ColumnOrName, value: str) -> Column:
    return F.lower(_c(c)) == F.lit(value.lower())


def first_forwarded(c: ColumnOrName, fallback: ColumnOrName | None = None) -> Column:
    """First address of a comma-separated forwarded-for list, trimmed."""
    first = F.trim(F.split(_c(c), ",").getItem(0))
    first = F.when(F.length(first) > 0, first)
    return F.coalesce(first, _c(fallback)) if fallback is not None else first


def cut(c: ColumnOrName, n: int) -> Column:
    return F.substring(_c(c), 1, n)
