"""Questions and answers of a small mock exam."""

from pyspark.sql import functions as F

from textloom.operators import exams
from textloom.plans.fixtures import EXAM, EXAM_ANSWERS, EXAM_KEY, EXAM_QUESTIONS


def frame(spark, lines):
    return spark.createDataFrame([("d", k, t) for k, t in enumerate(lines)], "doc string, line_no bigint, text string")


def test_questions(spark):
    got = exams.questions(frame(spark, EXAM), "doc").collect()
    assert sorted((r.n, r.instruction, r.body, r.choices) for r in got) == EXAM_QUESTIONS


def test_answers_and_merge(spark):
    got = exams.answers(frame(spark, EXAM_KEY), "doc").collect()
    assert sorted((r.n, r.answer_number, r.korean_translation, r.solution) for r in got) == EXAM_ANSWERS
    both = exams.merged(exams.questions(frame(spark, EXAM), "doc"), exams.answers(frame(spark, EXAM_KEY), "doc"), "doc")
    rows = {r.n: (r.answer_number, r.is_easy_type, r.answered) for r in both.collect()}
    assert rows[18] == ("①", True, True) and rows[31] == (None, False, False) and len(rows) == 6


def test_lone_vocabulary_line_is_text_unless_last(spark):
    df = spark.createDataFrame([(1, ["해석", "a 단어", "또 해석"]), (2, ["해석", "a 단어"]), (3, [])], "i int, ls array<string>")
    got = df.select("i", exams.translation_of(F.col("ls")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [["해석", "a 단어", "또 해석"], ["해석"], []]


def test_no_lines(spark):
    none = frame(spark, ["x"]).where("false")
    assert exams.merged(exams.questions(none, "doc"), exams.answers(none, "doc"), "doc").count() == 0
