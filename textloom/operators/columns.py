"""Columns of a page from the horizontal places of its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gutters(words: DataFrame, keys: list[str], min_column: int = 120, min_gap: int = 10) -> DataFrame:
    """(keys, gutters): middles of the blank strips that part the columns of a page.

    ``words`` has x0, x1 and page_width.  Places count in whole pixels, both
    ends included.  A strip between words of at least ``min_gap`` is a gutter
    if both columns beside it, up to the next strip of that kind or the margin,
    are at least ``min_column`` wide.  A page with fewer than two blank strips,
    margins included, has none.  One sort of a page's words and a running
    maximum find the strips; no pixel is a row.
    """
    width = F.col("page_width").cast("int") + 1
    w = words.select(*keys, width.alias("w"), F.greatest(F.lit(0), F.col("x0").cast("int")).alias("a"), F.least(width - 1, F.col("x1").cast("int")).alias("b")).where("w > 1 and b >= a")
    before = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("from", F.max("b").over(before) + 1).withColumn("blank", F.coalesce(F.col("a") > F.col("from"), F.lit(False)))
    wide = F.when(F.col("blank") & (F.col("a") - F.col("from") >= min_gap), (F.col("from") + F.col("a")) / 2)
    page = w.groupBy(*keys).agg(F.max("w").alias("w"), F.min("a").alias("left"), (F.max("b") + 1).alias("right"), F.count_if("blank").alias("blanks"), F.array_sort(F.collect_list(wide)).alias("m"))
    page = page.withColumn("e", F.concat(F.array(F.col("left").cast("double")), "m", F.array(F.col("right").cast("double"))))
    blanks = F.col("blanks") + (F.col("left") > 0).cast("int") + (F.col("right") < F.col("w")).cast("int")
    kept = F.filter("m", lambda x, i: (x - F.get("e", i) >= min_column) & (F.get("e", i + 2) - x >= min_column))
    return page.select(*keys, F.when(blanks >= 2, kept).otherwise(F.array().cast("array<double>")).alias("gutters"))


def column_of(gutters: Column, x0: Column, x1: Column) -> Column:
    """The column, from 0, of a word by its middle."""
    return F.size(F.filter(gutters, lambda g: (x0 + x1) / 2 > g))
