"""Queries that read small books of ``fixtures``, one copy for each nation or region.

SQL computes the same where it can; the longer texts of the book operators are
compared with what ``fixtures`` says that they are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import morphology
from textloom.functions.korean import PARTICLES, TERMINALS, UNITS, loose_spacing, safe_spacing
from textloom.operators import exams, items, lines, markup, textbook
from textloom.plans import fixtures
from textloom.plans.registry import query


def _beside(read, table: str, key: str, schema: str, rows: list[tuple]) -> DataFrame:
    """``rows`` once for each row of a table, whose key is called doc."""
    names = [c.split()[0] for c in schema.split(", ")]
    listed = json.dumps([dict(zip(names, r, strict=True)) for r in rows], ensure_ascii=False)
    return read(table).select(F.col(key).alias("doc"), F.inline(F.from_json(F.lit(listed), f"array<struct<{schema}>>")))


def _literal(v) -> str:
    if v is None or isinstance(v, bool):
        return str(v).upper().replace("NONE", "NULL")
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(_literal, v))}]"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _values(names: str, rows: list[tuple], alias: str = "t") -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS {alias}({names})"


def _numbered(texts: list[str]) -> list[tuple]:
    return list(enumerate(texts))


_SPACED = "text"
for _left, _words, _right in (
    ("([A-Za-z0-9])", PARTICLES, "[\\s,.!?:;\"''’”)\\]]"),
    ("([0-9])", UNITS, "[\\s,.!?:;]"),
    ("([)\\]}”’\"''])", PARTICLES, "[\\s,.!?:;\"''’”)\\]]"),
    ("((?:^|[^가-힣])[가-힣]{1,4})", TERMINALS, "[.?!,;:)\\]\"''’”]"),
):
    _SPACED = f"regexp_replace({_SPACED}, '{_left}\\s+({'|'.join(_words)})({_right}|$)', '\\1\\2\\3', 'g')"


@query(f"SELECT n_nationkey AS doc, i, {_SPACED} AS fixed FROM nation, {_values('i, text', _numbered([a for a, _ in fixtures.SAFE_SPACING]))}")
def spacing_rules_fixture(read):
    rows = _beside(read, "nation", "n_nationkey", "i int, text string", _numbered([a for a, _ in fixtures.SAFE_SPACING]))
    return rows.select("doc", "i", safe_spacing(F.col("text")).alias("fixed"))


@query(f"SELECT n_nationkey AS doc, i, fixed FROM nation, {_values('i, fixed', _numbered([b for _, b in fixtures.LOOSE_SPACING]))}")
def spacing_to_a_fixed_point(read):
    rows = _beside(read, "nation", "n_nationkey", "i int, text string", _numbered([a for a, _ in fixtures.LOOSE_SPACING]))
    return rows.select("doc", "i", loose_spacing(F.col("text")).alias("fixed"))


@query(f"SELECT n_nationkey AS doc, i, fixed, wrong, style FROM nation, {_values('i, fixed, wrong, style', [(k, *r[1:]) for k, r in enumerate(fixtures.ANALYZED)])}")
def spacing_with_an_analyzer(read):
    rows = _beside(read, "nation", "n_nationkey", "i int, text string", _numbered([r[0] for r in fixtures.ANALYZED]))
    text, small = F.col("text"), fixtures.small_analyzer
    return rows.select("doc", "i", morphology.spacing(text, small).alias("fixed"), morphology.wrong_blank_count(text, small).alias("wrong"), morphology.missing_blanks_are_style(text, small).alias("style"))


@query(f"""SELECT n_nationkey AS doc, i, s.* FROM nation, (SELECT i, unnest(runs) AS s FROM {_values('i, runs', [(k, [f'{s}|{e}|{c}' for s, e, c in r[2]]) for k, r in enumerate(fixtures.HIGHLIGHTS) if r[2]])})
    """.replace("s.*", "split_part(s, '|', 1)::INTEGER AS start, split_part(s, '|', 2)::INTEGER AS \"end\", split_part(s, '|', 3) AS color"))
def span_winner(read):
    rows = [(k, t, [{"phrase": p, "color": c} for p, c in ps]) for k, (t, ps, _) in enumerate(fixtures.HIGHLIGHTS)]
    rows = _beside(read, "nation", "n_nationkey", "i int, text string, phrases array<struct<phrase:string,color:string>>", rows)
    return markup.highlighted(rows, "text", "phrases").select("doc", "i", F.explode("runs").alias("r")).select("doc", "i", "r.start", "r.end", "r.color")


@query(f"SELECT n_nationkey AS doc, i, marked FROM nation, {_values('i, marked', _numbered([c for _, _, c in fixtures.UNDERLINES]))}")
def choice_underlines(read):
    rows = _beside(read, "nation", "n_nationkey", "i int, text string, choices array<string>", [(k, t, c) for k, (t, c, _) in enumerate(fixtures.UNDERLINES)])
    return rows.select("doc", "i", markup.underlined(F.col("text"), markup.circled_map(F.col("choices"))).alias("marked"))


_MOST = "least(CASE WHEN len(choices) > 0 THEN len(choices) ELSE 5 END, 7)"


@query(f"""SELECT n_nationkey AS doc, num FROM nation, (SELECT num, answer, choices::VARCHAR[] AS choices, kind FROM {_values('num, answer, choices, kind, shown', fixtures.ANSWERS)})
WHERE kind IS DISTINCT FROM '서술형' AND choices IS NOT NULL AND NOT coalesce(answer BETWEEN 1 AND {_MOST}, FALSE)""")
def answer_checks(read):
    rows = _beside(read, "nation", "n_nationkey", "num int, answer int, choices array<string>, kind string", [r[:4] for r in fixtures.ANSWERS])
    return markup.bad_answers(rows, kind="kind", essay="서술형").select("doc", "num")


@query(f"SELECT n_nationkey AS doc, item, type, lesson, number, set_size::BIGINT AS set_size, passage, translation, CASE WHEN set_size = 0 THEN '사람의 생각' ELSE '' END AS topic FROM nation, {_values('item, type, lesson, number, set_size, passage, translation', [r for r in fixtures.BOOK_ITEMS if r[1] != 'SKIP'])}".replace("SELECT n_nationkey AS doc, item,", "SELECT n_nationkey AS doc, item::BIGINT AS item,"))
def book_items(read):
    book = _beside(read, "nation", "n_nationkey", "line_no bigint, text string, is_break boolean", [(k, t, False) for k, t in enumerate(fixtures.BOOK)])
    got = items.extracted(items.classified(items.items(book, "doc")), "doc").where("type <> 'SKIP'")
    return got.select("doc", "item", "type", "lesson", "number", "set_size", "passage", "translation", "topic")


@query(f"""SELECT n_nationkey AS doc, n, instruction, body, choices, answer_number, korean_translation, solution, answer_number IS NOT NULL AS answered FROM nation, (SELECT * FROM {_values('n, instruction, body, choices', fixtures.EXAM_QUESTIONS, 'q')}
LEFT JOIN {_values('n, answer_number, korean_translation, solution', fixtures.EXAM_ANSWERS, 'a')} USING (n))""")
def mock_exams(read):
    asked = _beside(read, "nation", "n_nationkey", "line_no bigint, text string", _numbered(fixtures.EXAM))
    key = _beside(read, "nation", "n_nationkey", "line_no bigint, text string", _numbered(fixtures.EXAM_KEY))
    both = exams.merged(exams.questions(asked, "doc"), exams.answers(key, "doc"), "doc")
    return both.select("doc", "n", "instruction", "body", "choices", "answer_number", "korean_translation", "solution", "answered")


def _textbook(read) -> DataFrame:
    pages = _beside(read, "nation", "n_nationkey", "page int, line_no bigint, text string", [(p, k, t) for p, ts in fixtures.TEXTBOOK.items() for k, t in enumerate(ts)])
    lessons = textbook.lesson_pages(textbook.contents(pages.where("page = 6"), "doc"), "doc", F.lit(10))
    return textbook.problems(pages, lessons, "doc")


def _solutions(read) -> tuple[DataFrame, DataFrame]:
    return textbook.solutions(_beside(read, "nation", "n_nationkey", "line_no bigint, text string", _numbered(fixtures.SOLUTION)), "doc")


_PROBLEM = "lesson, position, qid, instruction, body, choices, vocab, footnote"
_SOLVED = "lesson, problem, answer, sozae, korean_translation, solution_guide, structure_in_focus, body_ref_page"
_MERGED = "lesson, position, ex_number, answer_number, body, korean_translation"


@query(f"SELECT n_nationkey AS doc, t.* FROM nation, {_values(_PROBLEM, fixtures.TEXTBOOK_PROBLEMS)}")
def textbook_problems(read):
    return _textbook(read).select("doc", *_PROBLEM.split(", "))


@query(f"SELECT n_nationkey AS doc, t.* FROM nation, {_values(_SOLVED, fixtures.SOLVED)}")
def textbook_solutions(read):
    return _solutions(read)[1].select("doc", *_SOLVED.split(", "))


@query(f"SELECT n_nationkey AS doc, t.* FROM nation, {_values(_MERGED, fixtures.TEXTBOOK_MERGED)}")
def textbook_merged(read):
    return textbook.merged(_textbook(read), *_solutions(read), "doc").select("doc", *_MERGED.split(", "))


@query(f"SELECT n_nationkey AS doc, line_no::BIGINT AS line_no, page, \"column\", text, is_break FROM nation, {_values('line_no, page, \"column\", text, is_break', fixtures.PLACED_LINES)}")
def placed_lines(read):
    words = _beside(read, "nation", "n_nationkey", "page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string", fixtures.PLACED)
    return lines.page_lines(words.withColumn("page_width", F.lit(612.0)), "doc", "page")
