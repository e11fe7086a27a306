"""Segmentation and order: gaps and islands, sessions, first and last wins, carry-forward.

Every operator takes its partition and order columns by name and plans one
shuffle on the partition columns; windows that follow on the same key reuse it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): lines in order, from 0.  Null texts have none."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def leading_segments(df: DataFrame, keys: list[str], order: list[str], is_header: Column, name: str = "segment") -> DataFrame:
    """Number segments that begin at a header row; rows before the first header are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(is_header.cast("int")).over(w)).where(F.col(name) > 0)


def trailing_segments(df: DataFrame, keys: list[str], order: list[str], is_end: Column, name: str = "segment") -> DataFrame:
    """Number segments that close with an end row; rows after the last end row are dropped."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn(name, F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0)))
    return out.withColumn("__open", F.max(is_end.cast("int")).over(after)).where("__open = 1").drop("__open")


def islands(df: DataFrame, keys: list[str], order: str, keep: Column, name: str = "island") -> DataFrame:
    """Rows that fulfil ``keep``, numbered by maximal runs of neighbours in ``order``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum((~keep).cast("int")).over(w)).where(keep)


def chained_groups(df: DataFrame, keys: list[str], order: str | list[str], value: Column, gap: Column | float, name: str = "chain") -> DataFrame:
    """Sessions: a row joins the one before it if their values are within ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((value - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def anchors(values: Column, tolerance: float) -> Column:
    """The first values of the groups of a sorted array in which each is within tolerance of its group's first."""
    empty = F.array().cast("array<double>")
    return F.aggregate(values, empty, lambda a, v: F.when((F.size(a) == 0) | (v - F.get(a, F.size(a) - 1) > tolerance), F.array_append(a, v)).otherwise(a))


def wins(df: DataFrame, keys: list[str], order: list[str], columns: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) in order.  A grouped minimum, with map-side combine."""
    pick = (F.max if last else F.min)(F.struct(*order, *[c for c in columns if c not in order]))
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in columns])


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_bound(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The value of the following row, null at the end."""
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
