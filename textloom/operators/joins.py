"""Joins of ordered text: override, full outer, positional, and range attach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_override(left: DataFrame, right: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left join in which columns of ``right`` replace those of ``left`` where a partner exists; ``flag`` tells if one does."""
    r = right.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in right.columns if c not in keys], F.lit(True).alias(flag))
    out = left.join(r, keys, "left")
    for c in right.columns:
        if c in keys:
            continue
        mine = F.when(F.col(flag), F.col(f"__r_{c}")).otherwise(F.col(c)) if c in left.columns else F.col(f"__r_{c}")
        out = out.withColumn(c, mine).drop(f"__r_{c}")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)))


def positional_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], position: str = "position") -> DataFrame:
    """Left join of the n-th rows of each key, from 1."""
    rank = lambda o: F.row_number().over(Window.partitionBy(*keys).orderBy(*o))
    return left.withColumn(position, rank(left_order)).join(right.withColumn(position, rank(right_order)), [*keys, position], "left")


def range_attach(df: DataFrame, keys: list[str], order: list[str], is_marker: Column, reach: int, same: str, marker_id: str) -> DataFrame:
    """(keys, marker, attached, distance): rows up to ``reach`` after a marker, up to the first with another value of ``same``."""
    n = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("__marker", is_marker)
    m = n.where("__marker").select(*keys, F.col(marker_id).alias("marker"), F.col(same).alias("__same"), F.explode(F.sequence(F.col("__n") + 1, F.col("__n") + reach)).alias("__n"), F.col("__n").alias("__from"))
    both = m.join(n.select(*keys, "__n", F.col(marker_id).alias("attached"), F.col(same).alias("__other")), [*keys, "__n"])
    run = Window.partitionBy(*keys, "marker").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__ok", F.min((F.col("__same").eqNullSafe(F.col("__other"))).cast("int")).over(run)).where("__ok = 1")
    return both.select(*keys, "marker", "attached", (F.col("__n") - F.col("__from")).cast("long").alias("distance"))
