"""Fixed patterns of form text, and the text form of amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c, utrim

# --- Fixed patterns that must equal the source system's checks ---
ISO_DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
#: Decimal text that JavaScript's Number() reads.
DECIMAL_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# --- end of fixed patterns ---


def decimal_text(c: ColumnOrName) -> Column:
    """Form text of an amount with the decimal comma read as a point."""
    return utrim(F.replace(_c(c), F.lit(","), F.lit(".")))
