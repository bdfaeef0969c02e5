"""Text expressions with Python ``str`` semantics, built from built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python's str.strip() removes (derived by rule, not typed in).
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def computed_once(value: Column, fn) -> Column:
    """``fn(value)``, where ``fn`` names its argument more than once. Written out
    twice, a long expression is also computed twice."""
    return F.transform(F.array(value), fn).getItem(0)


def ustrip(col) -> Column:
    """``str.strip()``: trim all Unicode whitespace (Spark ``trim`` only trims spaces)."""
    return F.trim(_c(col), F.lit(WHITESPACE))


def clean_string(col) -> Column:
    """Strip; blank becomes NULL."""
    return F.nullif(ustrip(_c(col).cast("string")), F.lit(""))


def lower_strip(col) -> Column:
    """``value.strip().lower()``."""
    return F.lower(ustrip(col))


def title_case(col) -> Column:
    """``str.title()`` for the letters Spark knows: a letter is upper-cased when
    it follows a non-letter, every other letter is lower-cased.

    Spark ``initcap`` only capitalises after a space ("Cafe's North-indian");
    here the string is cut at letter/non-letter boundaries and rebuilt.
    """
    c = _c(col)
    # Runs of letters and runs of non-letters, in order.
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    titled = F.transform(
        parts,
        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))),
    )
    return F.when(c.isNull(), F.lit(None)).otherwise(F.array_join(titled, ""))
