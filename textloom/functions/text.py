"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even if lambdas in it use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_share(c: Column) -> Column:
    """Share of code points below 128; null if empty."""
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.nullif(F.length(c), F.lit(0))


def is_english_line(c: Column) -> Column:
    """At least four characters after stripping, over 70 % of them ASCII."""
    s = stripped(c)
    # (least evaluates both sides, so the stripped text is made once)
    return F.coalesce(F.least(F.length(s) >= 4, ascii_share(s) > 0.7), F.lit(False))


def tidied(c: Column) -> Column:
    """Runs of blanks become one, blanks before closing punctuation go, and so do those at both ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), " ([,.;:!?])", "$1"))


def escaped(c: Column) -> Column:
    """Markup escapes of the ampersand and the angle brackets."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
