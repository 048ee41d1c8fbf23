"""Contains-search with the source system's LIKE semantics.

The user text is placed between two ``%`` and matched case-insensitively;
``%`` and ``_`` typed by the user stay wildcards and ``[..]`` is a character
set, as in T-SQL.  Spark's LIKE treats ``[`` literally and uses ``\\`` as
escape, so:

* without ``[``: ``ilike`` after doubling ``\\`` (stays a LIKE, which Spark
  can turn into fast string search);
* with ``[``: the pattern is translated to a regular expression for ``rlike``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c


def like_to_regex(pattern: str) -> str:
    """T-SQL LIKE pattern (without anchors) to a Java regular expression."""
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch == "[":
            close = pattern.find("]", i + 2 if pattern[i + 1:i + 2] == "^" else i + 1)
            if close == -1:
                out.append(re.escape(ch))
            else:
                body = pattern[i + 1:close]
                neg = body.startswith("^")
                if neg:
                    body = body[1:]
                parts = []
                for j, b in enumerate(body):
                    if b == "-" and 0 < j < len(body) - 1:
                        parts.append("-")
                    else:
                        parts.append("\\" + b if not b.isalnum() else b)
                out.append("[" + ("^" if neg else "") + "".join(parts) + "]")
                i = close
        else:
            out.append(re.escape(ch) if not ch.isalnum() else ch)
        i += 1
    return "".join(out)


def search_predicate(text: str | None, columns: list[str], null_safe: bool = False) -> Column | None:
    """OR of contains-matches of ``text`` over ``columns``; None when no text.

    ``null_safe`` wraps each column in ``coalesce(col, '')`` (the report form);
    the result is the same for a non-empty pattern, it only keeps the
    predicate from being NULL.
    """
    if text is None:
        return None
    cols = [F.coalesce(F.col(c), F.lit("")) if null_safe else F.col(c) for c in columns]
    if "[" in text:
        rx = "(?is)" + like_to_regex(text)
        preds = [c.rlike(rx) for c in cols]
    else:
        pat = "%" + text.replace("\\", "\\\\") + "%"
        preds = [c.ilike(pat) for c in cols]
    return reduce(lambda a, b: a | b, preds)


def matches(c: ColumnOrName, text: str) -> Column:
    """Single-column form of :func:`search_predicate`."""
    col = _c(c)
    if "[" in text:
        return col.rlike("(?is)" + like_to_regex(text))
    return col.ilike("%" + text.replace("\\", "\\\\") + "%")
