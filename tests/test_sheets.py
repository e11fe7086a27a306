"""Sheets from their data to files."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import markup, sheets
from textloom.sources import pdf, study
from textloom.streaming import arrivals


def test_sentence_rows(spark):
    rows = [("a", "s1", False, False), ("b", None, False, False), ("", None, True, False), ("c", "s1", False, False), ("d", "s2", False, False), ("", None, False, True), ("e", "s2", False, False), ("f", "s3", False, False)]
    df = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc string, pos int, en string, section string, spacer boolean, divider boolean")
    got = [(r.page, r.kind, r.new_section, r.num) for r in sheets.sentence_rows(df, "doc", "pos").orderBy("pos").collect()]
    assert got == [(1, "sentence", True, "01"), (1, "sentence", False, "02"), (1, "spacer", False, None), (1, "sentence", False, "03"), (2, "sentence", True, "01"), (3, "divider", False, None), (3, "sentence", True, "01"), (4, "sentence", True, "01")]


@pytest.mark.parametrize("n,pages", [(1, 1), (20, 1), (40, 1), (41, 2)])
def test_vocabulary_rows(spark, n, pages):
    df = spark.createDataFrame([("d", k, f"w{k}", f"낱말{k}") for k in range(n)], "doc string, num int, en string, ko string")
    got = sheets.vocabulary_rows(df, "doc", "num").collect()
    assert len(got) == 3 * n and max(r.page for r in got) == 3 * pages
    last = [r for r in got if r.num == n - 1]
    assert sorted((r.en, r.ko) for r in last) == sorted([(f"w{n - 1}", ""), ("", f"낱말{n - 1}"), (f"w{n - 1}", f"낱말{n - 1}")])
    assert all(r.column == (n - 1) % 40 // 20 and r.row == (n - 1) % 20 for r in last)
    assert {r.heading.endswith("(계속)") for r in last} == {pages > 1}


QUESTIONS = [
    {"num": 1, "type": "지칭", "question": '밑줄 친 "the idea"가 뜻하는 것은?', "choices": ["① a", "② b"], "answer": "2", "explanation": "하나\n\n둘 "},
    {"num": 2, "type": "어법_ABC", "question": "알맞은 것은?", "choices": ["① is — was — be"], "answer": "1", "passage_abc": "own text"},
    {"num": 3, "type": "어휘", "question": "밑줄 친 부분 중 틀린 것은?", "choices": ["① good", "② bad"], "answer": "1"},
    {"num": 4, "type": "조건_영작", "question": "영작", "answer": "It is.", "answer_display": "서술형", "korean": "그것이다", "conditions": ["세 낱말"]},
]


def exam_file(tmp_path, **more):
    data = {"info": {"source_label": "s"}, "sections": [{"label": "l", "passage": "① good idea\nthe idea is the idea", "questions": QUESTIONS}]} | more
    path = tmp_path / "exam_data_x.json"
    path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_exam_rows(spark, tmp_path):
    exams = study.read_exams(spark, exam_file(tmp_path))
    got = sheets.exam_rows(exams, "file").orderBy("position").collect()
    assert [r.passage for r in got] == [["① <u>good</u> idea", "<u>the idea</u> is the idea"], ["own text"], [], []]
    assert [r.answer_shown for r in got] == ["②", "①", "①", "서술형"] and got[3].model_answer == "It is."
    assert got[1].choices == [" | (A) | (B) | (C)", "① | is | was | be"] and got[0].explanation == ["하나", "둘"]
    assert got[3].choices == ["▶ 그것이다", "＜조건＞", "  • 세 낱말", *["_" * 58] * 3]
    assert sheets.bad_exam_answers(exams, "file").count() == 0


def test_exam_checks(spark, tmp_path):
    lone = study.read_exams(spark, exam_file(tmp_path, sections=None, passage="p", questions=QUESTIONS[:1] + [QUESTIONS[0] | {"num": 9, "answer": "6"}]))
    assert lone.select(F.explode("sections.label")).first()[0] == study.LONE_SECTION
    assert [(r.num, r.answer) for r in sheets.bad_exam_answers(lone, "file").collect()] == [(9, "6")]
    for wrong in ({"info": {}}, {"sections": []}, {"sections": [{"label": "l"}]}):
        with pytest.raises(Exception, match="missing|lacks"):
            study.read_exams(spark, exam_file(tmp_path, **wrong)).collect()


def test_other_checks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"lesson_title": "t"}, "sentences": []}))
    with pytest.raises(Exception, match="badge_label is missing"):
        study.read_analyses(spark, str(tmp_path / "a.json")).collect()
    (tmp_path / "v.json").write_text(json.dumps({"meta": {"source_label": "s", "lesson_title": "l", "output_filename": "o"}, "words": [{"num": 1, "en": "a"}]}))
    with pytest.raises(Exception, match="a word lacks"):
        study.read_vocabularies(spark, str(tmp_path / "v.json")).collect()


def test_output_name(spark):
    df = spark.createDataFrame([("exam_data_A", None, "2"), ("B", "my.pdf", None), ("B", "my_학생용.pdf", None)], "s string, g string, r string")
    names = lambda student: [r[0] for r in df.select(sheets.output_name(F.col("s"), F.col("g"), F.col("r"), student)).collect()]
    assert names(False) == ["A_예상문제_2회.pdf", "my.pdf", "my_학생용.pdf"]
    assert names(True) == ["A_예상문제_2회_학생용.pdf", "my_학생용.pdf", "my_학생용.pdf"]


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("가", None), ("", "b")], "a string, b string")
    study.write_json(df, str(tmp_path / "out"))
    assert sorted(spark.read.schema("a string, b string").json(str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_pdf(spark, tmp_path):
    lines = spark.createDataFrame([("a.pdf", 1, 0, "제목"), ("a.pdf", 2, 0, "x"), *[("b.pdf", 1, k, str(k)) for k in range(60)], ("c.pdf", 1, 0, None)], "doc string, page int, row int, text string")
    pdf.save(pdf.rendered(lines, "doc"), "doc", str(tmp_path))
    pages = {n: (tmp_path / n).read_bytes() for n in ("a.pdf", "b.pdf", "c.pdf")}
    assert {n: b.count(b"/Type /Page ") for n, b in pages.items()} == {"a.pdf": 2, "b.pdf": 2, "c.pdf": 1}
    a = pages["a.pdf"]
    assert "제목".encode("utf-16-be").hex().encode() in a and a[int(a.split(b"startxref\n")[1].split()[0]) :].startswith(b"xref")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "b.pdf", "c.pdf"]


def test_arrivals(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    arrivals.applied(stream, lambda d: d.where("id > 1"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_wrapped():
    words = " ".join(["word"] * 60)
    for line in (words, "가" * 200, "a", "", f"{'x' * 150} {words} {'나' * 60}"):
        pieces = pdf.wrapped(line)
        assert all(sum(1 + (c >= "\x80") for c in x) <= 102 for x in pieces)
        assert "".join(pieces).replace(" ", "") == line.replace(" ", "")
    assert pdf.wrapped(words)[0] == " ".join(["word"] * 20)


def test_english_markup(spark):
    rows = [
        ("A <b> of the old & new", True, [("of the old", "blue", "a"), ("old", "red", "b"), ("gone", "green", None)]),
        ("plain & simple", False, []),
        ("the “man.” and man", None, [("the “man”", "pink", "c"), ("man", "red", "d"), ("man", "red", "d"), ("man", "red", "d")]),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, en string, star boolean, h array<struct<phrase:string,color:string,label:string>>")
    df = markup.highlighted(df.withColumn("p", F.transform("h", lambda x: F.struct(x["phrase"], x["color"]))), "en", "p")
    got = df.select("i", sheets.english_markup(F.col("en"), F.col("runs"), F.col("star")).alias("m"), sheets.label_row(F.col("h")).alias("l"), sheets.highlight_misses(F.col("en"), F.col("h")).alias("x")).orderBy("i").collect()
    assert [r.m for r in got] == [
        '<font color="#cc0000">★ </font>A &lt;b&gt; <font color="#1a56cc"><b>of the </b></font><font color="#cc0000"><b>old</b></font> &amp; new',
        "plain &amp; simple",
        '<font color="#000000"><b>the “</b></font><font color="#cc0000"><b>man</b></font><font color="#000000"><b>.”</b></font> and <font color="#cc0000"><b>man</b></font>',
    ]
    assert [r.x for r in got] == [["gone"], [], ["man"]] and got[1].l is None
    assert got[2].l.startswith('<font color="#000000" size="6.5"><b>[c]</b></font>  <font color="#cc0000" size="6.5"><b>[d]')


def test_passage_book_lines(spark):
    items = spark.createDataFrame([("d", 2, "01", "003", "소재", "One.\n\nTwo.", "하나."), ("d", 5, "02", "001", "", "Only.", "")], "doc string, item bigint, lesson string, number string, topic string, passage string, translation string")
    names = spark.createDataFrame([("d", "01", "목적")], "doc string, lesson string, title string")
    got = [(r.page, r.row, r.text) for r in sheets.passage_book_lines(items, names, "doc").orderBy("page", "row").collect()]
    assert got == [(2, 0, "01강 목적 003번"), (2, 1, "소재"), (2, 2, "One."), (2, 3, "Two."), (2, 4, "하나."), (5, 0, "02강 001번"), (5, 1, "Only.")]
