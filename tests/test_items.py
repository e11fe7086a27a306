"""Items of a small book, one for each type."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import items
from textloom.plans.fixtures import BOOK, LONG, head
from textloom.plans.fixtures import ITEMS as CASES


@pytest.fixture(scope="module")
def book(spark):
    df = spark.createDataFrame([("d", k, t, False) for k, t in enumerate(BOOK)], "doc string, line_no bigint, text string, is_break boolean")
    return df


def test_types_and_passages(book):
    got = items.extracted(items.classified(items.items(book, "doc")), "doc").orderBy("item").collect()
    assert len(got) == len(CASES) + 5
    for r, (kind, (_, passage)) in zip(got, CASES.items(), strict=False):
        if kind == "SKIP":  # its lines go on to the next header, so the longest block is that of the set after it
            passage = f"{LONG} It was (a) good and then (b) bad in the end."
        assert (r.type, r.passage, r.topic, r.lesson, r.set_size) == (kind, passage, "사람의 생각", "01", 0), kind
    told = {r.type: r.translation for r in got[: len(CASES)]}
    assert told["REMOVE"] == "하나이다. 둘이다." and told["REORDER"] == "둘 셋 하나" and told["SUMMARY"] == "글이다.\n\n→ 요약이다." and told["AS_IS"] == "이것은 해석이다."
    two, three = got[len(CASES) : len(CASES) + 2], got[len(CASES) + 2 :]
    assert [r.passage for r in two] == [f"{LONG} It was good and then bad in the end.", f"{LONG} It was good and then fine in the end."]
    assert {r.translation for r in two} == {"그것은 좋은 것이다."} and {r.set_size for r in two} == {2}
    assert {(r.passage, r.translation) for r in three} == {("First there was one thing.\n\nDogs came last.\n\nBees came next.\n\nCats came after.", "하나\n\n개\n\n벌\n\n고양이")}


def test_lesson_names_and_printable(book):
    assert [(r.lesson, r.title) for r in items.lesson_names(book, "doc").collect()] == [("01", "글의 목적")]
    done = items.printable(items.extracted(items.classified(items.items(book, "doc")), "doc"), "doc")
    assert done.where("item = 8").count() == 0 and done.count() == 12


def test_a_set_ends_at_the_first_item_that_does_not_fit(spark):
    lines = [head(9), "# 강 01 # 쪽 1 # 번 1~3 # 문항코드", "shared", head(1), head(2, lesson="02"), head(3)]
    got = items.items(spark.createDataFrame([("d", k, t, None) for k, t in enumerate(lines)], "doc string, line_no bigint, text string, is_break boolean"), "doc").orderBy("item").collect()
    assert [r.set_size for r in got] == [0, 3, 0, 0]
    assert [x.text for x in got[1].shared] == lines[1:3]


def test_fallback_types(spark):
    rows = [(["(A) x", "(B) y", "(C) z"], "REORDER"), (["a ___ b"], "FILL"), (["plain"], "AS_IS"), ([], "AS_IS"), (["[문제]", "grammar", "This is the long text and it has ① one marker in it.", "x"], "REPLACE"), (["[문제]", "다음 글을 읽고, 물음에 답하시오."], "LONG1")]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "i int, lines array<string>")
    got = df.select("i", items.item_type(F.col("lines"), items.instruction(F.col("lines"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [t for _, t in rows]


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc string, line_no bigint, text string, is_break boolean")
    assert items.extracted(items.classified(items.items(none, "doc")), "doc").count() == 0
