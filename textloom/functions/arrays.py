"""Column functions on arrays of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import stripped


def first_index(items: Column, holds: Callable[..., Column]) -> Column:
    """Where a condition on (element) or (element, index) first holds, from 0; null if nowhere."""
    return F.nullif(F.array_position(F.transform(items, holds), True), F.lit(0)).cast("int") - 1


def from_index(items: Column, start: Column) -> Column:
    """The elements from an index on."""
    return F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(0)))


def before_index(items: Column, end: Column) -> Column:
    """The elements before an index; all if it is null."""
    return F.slice(items, F.lit(1), F.coalesce(end, F.size(items)))


def between(items: Column, start: Column, end: Column) -> Column:
    """The elements from one index up to another; none if it is not greater."""
    return F.slice(items, start + 1, F.greatest(end - start, F.lit(0)))


def block(items: Column) -> Column:
    """Lines as one stripped text."""
    return stripped(F.array_join(items, "\n"))
