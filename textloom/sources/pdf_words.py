"""Placed words of PDF files, for ``operators.lines``.

The reader is a parameter: a function that makes one, called once in each
Python worker.  A reader takes the bytes of a file and gives its pages: their
width and their words (x0, y0, x1, y1, text) in reading order.  A file is one
row, so it must fit into a task's memory; its pages are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Word = tuple[float, float, float, float, str]
Reader = Callable[[bytes], Iterable[tuple[float, Iterable[Word]]]]
Maker = Callable[[], Reader]

SCHEMA = "doc string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string, page_width double"


@cache
def installed() -> Reader:
    """The PDF package of the worker; an ImportError where there is none."""
    import fitz

    def read(content: bytes) -> Iterator[tuple[float, list[Word]]]:
        with fitz.open(stream=content, filetype="pdf") as book:
            for page in book:
                yield page.rect.width, [tuple(w[:5]) for w in page.get_text("words")]

    return read


def words(files: DataFrame, maker: Maker = installed, doc: str = "path", content: str = "content") -> DataFrame:
    """(doc, page, word_no, x0, y0, x1, y1, text, page_width) of files given as bytes; pages count from 1, words from 0.

    Blank words are left out.  Null or empty contents have no pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = maker()
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.float64()]
        for b in batches:
            for name, data in zip(b["doc"].to_pylist(), b["content"], strict=True):
                for page, (width, found) in enumerate(read(data.as_py()) if data.as_py() else (), 1):
                    rows = [(name, page, k, float(x0), float(y0), float(x1), float(y1), text, float(width)) for k, (x0, y0, x1, y1, text) in enumerate(w for w in found if w[4].strip())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select(F.col(doc).cast("string").alias("doc"), F.col(content).alias("content")).mapInArrow(run, SCHEMA)


def read_words(spark: SparkSession, path: str, maker: Maker = installed) -> DataFrame:
    """``words`` of the PDF files of a path or pattern, one task for about each file."""
    files = spark.read.format("binaryFile").load(path)
    return words(files, maker)


def plain_lines(words: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, line_no, text): words of each page in reading order, a new line where one begins left of or well below the one before."""
    at = "page, word_no"
    rows = words.selectExpr("*", f"lag(x0) over (partition by {doc}, page order by word_no) as __x", f"lag(y0) over (partition by {doc}, page order by word_no) as __y", "y1 - y0 as __h")
    rows = rows.withColumn("__new", F.coalesce((F.col("x0") < F.col("__x")) | (F.abs(F.col("y0") - F.col("__y")) > F.col("__h") / 2), F.lit(True)).cast("int"))
    rows = rows.withColumn("line_no", F.expr(f"sum(__new) over (partition by {doc} order by {at})").cast("long") - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"])
    return rows.groupBy(doc, "page", "line_no").agg(F.array_join(texts, " ").alias("text"))
