"""Words of PDF files and the commands, with a reader of small files that list their words."""

import json

import pytest

from textloom import __main__ as commands
from textloom.plans import fixtures
from textloom.sources import pdf_words


def small():
    """A reader of files that are JSON: pages of a width and words."""
    return lambda content: [(p["width"], [tuple(w) for w in p["words"]]) for p in json.loads(content)]


def page(lines, width=612.0):
    """Lines set one below the other, words 6 points a letter (marks and Hangul too)."""
    words = []
    for k, line in enumerate(lines):
        x = 60.0
        for w in line.split(" "):
            words.append((x, 200.0 + 20 * k, x + 6 * len(w), 210.0 + 20 * k, w))
            x += 6 * len(w) + 6
    return {"width": width, "words": words}


def save(path, pages):
    path.write_text(json.dumps([page(p) for p in pages], ensure_ascii=False))
    return f"file://{path}"


def test_words(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(json.dumps([{"width": 500, "words": [[1, 2, 3, 4, "a"], [5, 2, 6, 4, " "], [7, 2, 9, 4, "b"]]}, {"width": 400, "words": []}, {"width": 300, "words": [[1, 1, 2, 2, "c"]]}]))
    (tmp_path / "empty.pdf").write_text("")
    got = pdf_words.read_words(spark, f"file://{tmp_path}/*.pdf", small)
    assert sorted((r.doc[-5:], *tuple(r)[1:]) for r in got.collect()) == [("a.pdf", 1, 0, 1, 2, 3, 4, "a", 500), ("a.pdf", 1, 1, 7, 2, 9, 4, "b", 500), ("a.pdf", 3, 0, 1, 1, 2, 2, "c", 300)]
    assert got.dtypes == pdf_words.words(spark.createDataFrame([(None, None)], "path string, content binary"), small).dtypes
    assert pdf_words.words(spark.createDataFrame([("x", None)], "path string, content binary"), small).count() == 0


def test_lines_of_plain_text(spark):
    rows = [("d", 1, 0, 10.0, 0.0, 20.0, 10.0, "one"), ("d", 1, 1, 25.0, 1.0, 30.0, 11.0, "line"), ("d", 1, 2, 10.0, 12.0, 20.0, 22.0, "next"), ("d", 2, 0, 50.0, 0.0, 60.0, 10.0, "page")]
    got = pdf_words.plain_lines(spark.createDataFrame(rows, "doc string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")).orderBy("line_no").collect()
    assert [(r.page, r.line_no, r.text) for r in got] == [(1, 0, "one line"), (1, 1, "next"), (2, 2, "page")]


def test_without_a_reader():
    with pytest.raises(ImportError):
        pdf_words.installed()


def test_passages(spark, tmp_path):
    save(tmp_path / "book.pdf", [fixtures.BOOK[k : k + 25] for k in range(0, len(fixtures.BOOK), 25)])
    made = commands.passages(spark, f"file://{tmp_path}/*.pdf", f"{tmp_path}/out", small)
    assert [r["items"] for r in made.collect()] == [12]
    assert (tmp_path / "out" / "book_passages.pdf").read_bytes().startswith(b"%PDF")


def test_mock(spark, tmp_path):
    asked, key = save(tmp_path / "q.pdf", [fixtures.EXAM]), save(tmp_path / "a.pdf", [fixtures.EXAM_KEY])
    got = commands.mock(spark, asked, key, f"{tmp_path}/mock", small).collect()
    assert {r.n for r in got} == {18, 20, 31, 32, 41, 42} and {r.n: r.answer_number for r in got}[20] == "②"


def test_textbook(spark, tmp_path):
    pages = [fixtures.TEXTBOOK.get(p, ["x"]) for p in range(1, 11)]
    book, solution = save(tmp_path / "b.pdf", [[x for x in p if x] for p in pages]), save(tmp_path / "s.pdf", [fixtures.SOLUTION])
    got = commands.textbooks(spark, book, solution, f"{tmp_path}/all", maker=small).collect()
    assert {(r.lesson, r.position, r.ex_number, r.answer_number) for r in got} == {(a, b, c, d) for a, b, c, d, _, _ in fixtures.TEXTBOOK_MERGED}
    assert {r.lesson for r in commands.textbooks(spark, book, solution, f"{tmp_path}/one", 2, small).collect()} == {2}


def test_vocabulary(spark, tmp_path):
    for name, per in (("a", 3), ("b", None)):
        words = [{"num": k + 1, "en": f"word{k}", "ko": "낱말"} for k in range(8)]
        (tmp_path / f"{name}.json").write_text(json.dumps({"meta": {"source_label": "S", "lesson_title": "L", "output_filename": f"{name}.pdf"} | ({"words_per_col": per} if per else {}), "words": words}, ensure_ascii=False))
    made = commands.vocabulary(spark, f"file://{tmp_path}/*.json", f"{tmp_path}/out")
    assert sorted(r.output for r in made.collect()) == ["a.pdf", "b.pdf"]
    # three parts of two pages, and of one
    assert [(tmp_path / "out" / f"{n}.pdf").read_bytes().count(b"/Type /Page ") for n in "ab"] == [6, 3]


def test_arguments(capsys):
    with pytest.raises(SystemExit):
        commands.main(["nothing"])
    assert "passages" in capsys.readouterr().err
