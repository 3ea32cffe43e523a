"""Character-level expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def narrow(c: Column) -> Column:
    """Full-width ASCII forms and the ideographic space to their ordinary forms."""
    return F.translate(c, _WIDE, _NARROW)


def trim_all(c: Column) -> Column:
    """Strip every kind of white space at both ends (``trim`` strips only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(c: Column) -> Column:
    """True for NULL, empty, white space and the word ``nan``."""
    return c.isNull() | F.lower(trim_all(c)).isin("", "nan")


def safe_text(c: Column) -> Column:
    """NULL and ``nan`` become empty, all else is trimmed."""
    return F.when(blank(c), F.lit("")).otherwise(trim_all(c))
