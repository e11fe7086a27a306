"""Command line: ``python -m textloom passages|mock|textbook|vocabulary ...``.

Every command reads and writes by Spark paths, so folders and patterns of books
are one run.  PDF files need a PDF package where the executors run.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import exams, items, lines, sheets, textbook
from textloom.sources import pdf, pdf_words, study

Maker = pdf_words.Maker


def passages(spark: SparkSession, books: str, folder: str, maker: Maker = pdf_words.installed) -> DataFrame:
    """Writes a passage book for each PDF file; returns (doc, items)."""
    placed = lines.page_lines(pdf_words.read_words(spark, books, maker), "doc", "page").cache()
    kept = items.printable(items.extracted(items.classified(items.items(placed, "doc")), "doc"), "doc").cache()
    made = pdf.rendered(sheets.passage_book_lines(kept, items.lesson_names(placed, "doc"), "doc"), "doc")
    pdf.save(made.withColumn("name", F.concat(F.regexp_extract("doc", r"([^/]*?)(?:\.[Pp][Dd][Ff])?$", 1), F.lit("_passages.pdf"))), "name", folder)
    return kept.groupBy("doc").agg(F.count("*").alias("items"))


def _one_book(words: DataFrame) -> DataFrame:
    # the files of a run are one book, in order of their names
    return lines.page_lines(words, "doc", "page", by_density=True).withColumn("doc", F.lit("book"))


def mock(spark: SparkSession, questions: str, answers: str, out: str, maker: Maker = pdf_words.installed) -> DataFrame:
    """Writes the questions of a mock exam with their answers as JSON; returns them."""
    asked = exams.questions(_one_book(pdf_words.read_words(spark, questions, maker)), "doc")
    study.write_json(exams.merged(asked, exams.answers(_one_book(pdf_words.read_words(spark, answers, maker)), "doc"), "doc"), out)
    return spark.read.json(out)


def textbooks(spark: SparkSession, book: str, solution: str, out: str, lesson: int | None = None, maker: Maker = pdf_words.installed) -> DataFrame:
    """Writes the problems of a textbook with their solutions as JSON; returns them."""
    pages = pdf_words.plain_lines(pdf_words.read_words(spark, book, maker)).withColumn("doc", F.lit("book")).cache()
    last = pages.agg(F.max("page")).first()[0] or 0
    found = textbook.lesson_pages(textbook.contents(pages.where(F.col("page").isin(*textbook.CONTENTS_PAGES)), "doc"), "doc", F.lit(last))
    both = textbook.merged(textbook.problems(pages, found, "doc"), *textbook.solutions(_one_book(pdf_words.read_words(spark, solution, maker)), "doc"), "doc")
    study.write_json(both.where(F.col("lesson") == lesson) if lesson else both, out)
    return spark.read.json(out)


def vocabulary(spark: SparkSession, data: str, folder: str) -> DataFrame:
    """Writes a vocabulary test as PDF for each JSON file; returns (file, output)."""
    tests = study.read_vocabularies(spark, data).select("file", "meta", F.coalesce("meta.words_per_col", F.lit(sheets.PER_COLUMN)).alias("per"), "words").cache()
    out = None
    # one plan for each size of column in use
    for r in tests.select("per").distinct().toLocalIterator():
        words = tests.where(F.col("per") == r["per"]).select("file", F.posexplode("words").alias("at", "w")).select("file", "at", "w.*")
        rows = sheets.vocabulary_rows(words, "file", "at", r["per"])
        text = F.concat_ws("  ", F.concat(F.col("num").cast("string"), F.lit(".")), "en", "ko")
        heads = rows.select("file", "page", "heading").distinct().join(tests.select("file", "meta"), "file")
        head = heads.select("file", "page", F.lit(-1).alias("row"), F.concat_ws("  |  ", "meta.source_label", F.nullif("meta.lesson_title", F.lit("")), "heading").alias("text"))
        set_ = head.unionByName(rows.select("file", "page", (F.col("column") * r["per"] + F.col("row")).cast("int").alias("row"), text.alias("text")))
        out = set_ if out is None else out.unionByName(set_)
    names = tests.select("file", F.col("meta.output_filename").alias("output"))
    if out is not None:
        pdf.save(pdf.rendered(out, "file").join(names, "file"), "output", folder)
    return names


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("passages", ["books"]), ("mock", ["questions", "answers"]), ("textbook", ["book", "solution"]), ("vocabulary", ["data"])):
        p = commands.add_parser(name)
        for place in places:
            p.add_argument(place)
        p.add_argument("--output", default="output")
        if name == "textbook":
            p.add_argument("--lesson", type=int)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"textloom {a.command}").getOrCreate()
    if a.command == "passages":
        made = passages(spark, a.books, a.output)
    elif a.command == "mock":
        made = mock(spark, a.questions, a.answers, a.output)
    elif a.command == "textbook":
        made = textbooks(spark, a.book, a.solution, a.output, a.lesson)
    else:
        made = vocabulary(spark, a.data, a.output)
    print(f"{made.count()} written to {a.output}")


if __name__ == "__main__":
    main()
