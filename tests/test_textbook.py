"""A small textbook and its solution book."""

from pyspark.sql import functions as F

from textloom.operators import textbook
from textloom.plans.fixtures import SOLUTION, SOLVED, TEXTBOOK, TEXTBOOK_MERGED, TEXTBOOK_PROBLEMS


def lines(spark, rows):
    return spark.createDataFrame(rows, "doc string, page int, line_no bigint, text string")


def book(spark):
    return lines(spark, [("d", p, k, t) for p, ts in TEXTBOOK.items() for k, t in enumerate(ts)])


def solution(spark):
    return lines(spark, [("d", 1, k, t) for k, t in enumerate(SOLUTION)])


def pages_of(spark):
    return textbook.lesson_pages(textbook.contents(book(spark).where("page = 6"), "doc"), "doc", F.lit(10))


def test_contents(spark):
    assert sorted((r.lesson, r.title, r.start_page, r.end_page) for r in pages_of(spark).collect()) == [(1, "글의 목적 파악", 8, 9), (2, "장문 독해", 10, 10)]


def test_last_lesson_of_the_second_part_has_four_pages(spark):
    toc = spark.createDataFrame([("d", 29, "a", 100), ("d", 30, "b", 104)], "doc string, lesson int, title string, start_page int")
    assert sorted(r.end_page for r in textbook.lesson_pages(toc, "doc", F.lit(200)).collect()) == [103, 107]


def test_problems(spark):
    got = textbook.problems(book(spark), pages_of(spark), "doc").collect()
    assert sorted((r.lesson, r.position, r.qid, r.instruction, r.body, r.choices, r.vocab, r.footnote) for r in got) == TEXTBOOK_PROBLEMS


def test_solutions(spark):
    lessons, solved = textbook.solutions(solution(spark), "doc")
    assert {r.lesson: (r.title, r.gateway_answer, r.gateway_answer_map, r.exercises_answers) for r in lessons.collect()} == {
        1: ("글의 목적 파악", "②", {}, {"01": "③", "02": "⑤", "03": "①"}),
        2: ("장문 독해", "②,⑤", {"01": "②", "02": "⑤"}, {"01": "①", "02": "②"}),
    }
    got = {(r.lesson, r.problem, r.answer, r.sozae, r.korean_translation, r.solution_guide, r.structure_in_focus, r.body_ref_page) for r in solved.collect()}
    assert got == set(SOLVED)


def test_merged(spark):
    got = textbook.merged(textbook.problems(book(spark), pages_of(spark), "doc"), *textbook.solutions(solution(spark), "doc"), "doc").collect()
    rows = {(r.lesson, r.position, r.ex_number, r.answer_number, r.body, r.korean_translation) for r in got}
    assert rows == set(TEXTBOOK_MERGED) and len(got) == len(TEXTBOOK_MERGED)
    assert {r.lesson: r.title for r in got} == {1: "글의 목적 파악", 2: "장문 독해"}


def test_no_lines(spark):
    none = book(spark).where("false")
    lessons, solved = textbook.solutions(none, "doc")
    assert textbook.merged(textbook.problems(none, textbook.lesson_pages(textbook.contents(none, "doc"), "doc", F.lit(1)), "doc"), lessons, solved, "doc").count() == 0
