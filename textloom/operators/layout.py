"""Layout tables: pages and slots, answer rows, positioned words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paged(df: DataFrame, position: str, per_page: int, per_column: int) -> DataFrame:
    """Page, column and row, from 0, of a position from 0."""
    p = F.col(position)
    return df.withColumn("page", F.floor(p / per_page)).withColumn("column", F.floor(F.pmod(p, F.lit(per_page)) / per_column)).withColumn("row", F.pmod(p, F.lit(per_column)).cast("long"))


def answer_rows(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 10) -> DataFrame:
    """Values in rows of ``width``: (keys, chunk, a1..)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    cells = df.withColumn("__n", n).withColumn("chunk", F.floor(F.col("__n") / width)).withColumn("__slot", F.pmod("__n", F.lit(width)))
    return cells.groupBy(*keys, "chunk").agg(*[F.max(F.when(F.col("__slot") == k, F.col(value))).alias(f"a{k + 1}") for k in range(width)])


def positioned_words(lines: DataFrame, keys: list[str], line_col: str = "line", char_width: int = 6) -> DataFrame:
    """(keys, word_no, word, x0, x1): words of lines set in a fixed pitch."""
    words = lines.select(*keys, F.posexplode(F.split(line_col, " ")).alias("word_no", "word"))
    before = F.coalesce(F.sum(F.length("word") + 1).over(Window.partitionBy(*keys).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("x0", before * char_width).withColumn("x1", F.col("x0") + F.length("word") * char_width)
