"""Rows of study sheets, in printing order: analyses, exams and vocabulary tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import first_index
from textloom.functions.text import escaped, let, stripped
from textloom.operators.layout import paged
from textloom.operators.markup import answer_char, bad_answers, circled_map, missed, underlined

# Question types with a form of their own, the mark of essays, the parts of a vocabulary test, and wording of sheets.
TABLE_TYPE, WRITING_TYPE, INSERT_TYPE, ESSAY = "어법_ABC", "조건_영작", "문장_삽입", "서술형"
VOCABULARY_PARTS = [("en_to_ko", "영어 → 한국어"), ("ko_to_en", "한국어 → 영어"), ("vocab_list", "단어장 / 정답")]
CONTINUED, STUDENT, FORECAST = "  (계속)", "_학생용", "_예상문제_"
QUOTED = "밑줄\\s*친\\s*(\"[^\"]+\"|“[^”]+”|'[^']+'|‘[^’]+’)"
ANSWER_LINES, ANSWER_LINE = 3, "_" * 58
# Colours of highlights; others are black.
COLORS = {"blue": "#1a56cc", "orange": "#e06c00", "green": "#1a7a3c", "red": "#cc0000"}


#: Words of a column of a vocabulary test, unless its data say otherwise.
PER_COLUMN = 20


def sentence_rows(sentences: DataFrame, doc: str, order: str) -> DataFrame:
    """Adds page (from 1), kind, new_section and num to the rows of an analysis.

    ``divider`` rows (a lesson's banner) and changes of section begin a page,
    but not the first section of the sheet or after a banner.  Sentences are
    numbered from 01 in each section; ``spacer`` rows have no number.  A row
    without section belongs to that before it.
    """
    w = Window.partitionBy(doc).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = sentences.withColumn("divider", F.coalesce("divider", F.lit(False))).withColumn("spacer", F.coalesce("spacer", F.lit(False)))
    x = x.withColumn("__part", F.sum(F.col("divider").cast("int")).over(so_far))
    in_part = Window.partitionBy(doc, "__part").orderBy(order)
    named = F.when(~F.col("divider"), F.nullif("section", F.lit("")))
    before = F.last(named, ignorenulls=True).over(in_part.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("__before", before).withColumn("new_section", F.coalesce(named.isNotNull() & ~named.eqNullSafe(F.col("__before")), F.lit(False)))
    turns = F.col("divider") | (F.col("new_section") & F.col("__before").isNotNull())
    x = x.withColumn("page", F.sum(turns.cast("int")).over(so_far) + 1).withColumn("__run", F.sum((F.col("divider") | F.col("new_section")).cast("int")).over(so_far))
    counted = ~F.col("divider") & ~F.col("spacer")
    number = F.sum(counted.cast("int")).over(Window.partitionBy(doc, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("kind", F.when(F.col("divider"), "divider").when(F.col("spacer"), "spacer").otherwise("sentence"))
    digits = F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    return x.withColumn("num", F.when(counted, digits)).drop("__part", "__before", "__run")


def _code(color: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv]), color), F.lit("#000000"))


def english_markup(text: Column, runs: Column, star: Column) -> Column:
    """A sentence with its coloured runs (those of ``markup.highlighted``) and a star before it where it has one; the text is escaped."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, r: Column) -> Column:
        piece = lambda x, y: escaped(F.substring(text, x + 1, y - x))
        run = F.concat(F.lit('<font color="'), _code(r["color"]), F.lit('"><b>'), piece(r["start"], r["end"]), F.lit("</b></font>"))
        return F.struct(F.concat(a["out"], piece(a["at"], r["start"]), run).alias("out"), r["end"].alias("at"))

    rest = lambda a: F.concat(a["out"], escaped(F.substring(text, a["at"] + 1, F.length(text))))
    marked = F.aggregate(runs, start, step, rest)
    return F.concat(F.when(star, f'<font color="{COLORS["red"]}">★ </font>').otherwise(""), marked)


def label_row(highlights: Column) -> Column:
    """The labels of highlights in their colours; null without any."""
    tag = lambda h: F.concat(F.lit('<font color="'), _code(h["color"]), F.lit('" size="6.5"><b>['), F.coalesce(h["label"], F.lit("")), F.lit("]</b></font>"))
    return F.when(F.size(highlights) > 0, F.array_join(F.transform(highlights, tag), "  "))


def highlight_misses(text: Column, highlights: Column) -> Column:
    """Phrases of highlights that have no place in the text (``markup.located``)."""
    return missed(text, F.transform(highlights, lambda h: F.struct(h["phrase"].alias("phrase"), h["color"].alias("color"))))


def passage_book_lines(printable: DataFrame, names: DataFrame, doc: str) -> DataFrame:
    """(doc, page, row, text): a page for each item of ``items.printable``: lesson and number, topic, passage, translation."""
    p = printable.join(names, [doc, "lesson"], "left")
    head = F.concat(F.col("lesson"), F.lit("강 "), F.coalesce(F.concat(F.col("title"), F.lit(" ")), F.lit("")), F.col("number"), F.lit("번"))
    parts = [F.array(head), F.when(F.col("topic") != "", F.array("topic")), F.split("passage", "\n\n"), F.when(F.col("translation") != "", F.split("translation", "\n\n"))]
    lines = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in parts])
    return p.select(doc, F.col("item").cast("int").alias("page"), F.posexplode(lines).alias("row", "text"))


def vocabulary_rows(words: DataFrame, doc: str, order: str, per_column: int = PER_COLUMN) -> DataFrame:
    """(doc, mode, heading, page, column, row, num, en, ko): a test of each direction and the list, each on pages of two columns.

    The side that is asked for is empty.  Pages count from 1 over all parts.
    """
    n = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    w = paged(words.withColumn("__n", n), "__n", 2 * per_column, per_column)
    pages = F.ceil(F.count("*").over(Window.partitionBy(doc)) / (2 * per_column))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mode"), F.lit(t).alias("title")) for k, (m, t) in enumerate(VOCABULARY_PARTS)])
    w = w.withColumn("__pages", pages).withColumn("__part", F.explode(parts))
    heading = F.concat(F.col("__part.title"), F.when(F.col("page") > 0, CONTINUED).otherwise(""))
    mode = F.col("__part.mode")
    return w.select(
        doc,
        mode.alias("mode"),
        heading.alias("heading"),
        (F.col("__part.k") * F.col("__pages") + F.col("page") + 1).alias("page"),
        "column",
        "row",
        "num",
        F.when(mode == "ko_to_en", "").otherwise(F.col("en")).alias("en"),
        F.when(mode == "en_to_ko", "").otherwise(F.col("ko")).alias("ko"),
    )


def quoted_targets(questions: Column) -> Column:
    """Expressions that the wording of questions (an array) quotes as underlined, each once, in order."""
    found = F.flatten(F.transform(questions, lambda q: F.regexp_extract_all(F.coalesce(q, F.lit("")), F.lit(f"(?U){QUOTED}"), 1)))
    bare = F.transform(found, lambda t: stripped(F.substring(t, F.lit(2), F.length(t) - 2)))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def asks_marked(question: Column) -> Column:
    """If a question is about marked words."""
    return F.coalesce(question.contains("①") | question.contains("밑줄 친 단어") | question.contains("밑줄 친 부분"), F.lit(False))


def underlined_paragraphs(passage: Column, targets: Column, marked: Column) -> Column:
    """Paragraphs of a passage, blank ones left out, with targets underlined at their first place and marked words after their markers."""
    filled = F.filter(F.transform(F.split(F.coalesce(passage, F.lit("")), "\n"), stripped), lambda p: p != "")

    def underline(ps: Column, t: Column) -> Column:
        at = lambda p: F.call_function("locate", t, p)
        once = lambda p: F.concat(F.substring(p, F.lit(1), at(p) - 1), F.lit("<u>"), t, F.lit("</u>"), F.substring(p, at(p) + F.length(t), F.length(p)))
        return let(first_index(ps, lambda p: p.contains(t)), lambda k: F.transform(ps, lambda p, i: F.when(i == k, once(p)).otherwise(p)))

    return F.transform(F.aggregate(targets, filled, underline), lambda p: underlined(p, marked))


def _merged_maps(maps: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(maps, empty, lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))


def choice_lines(kind: Column, choices: Column, prompt: Column, conditions: Column) -> Column:
    """What stands below a question: a row of three words for each choice, a writing task with its conditions and lines, or the choices."""
    given = F.coalesce(choices, F.array().cast("array<string>"))
    row = lambda c, i: F.concat(F.substring(F.lit("①②③④⑤"), i + 1, F.lit(1)), F.lit(" | "), F.array_join(F.slice(F.transform(F.split(F.translate(c, "①②③④⑤", ""), "—"), stripped), 1, 3), " | "))
    table = F.concat(F.array(F.lit(" | (A) | (B) | (C)")), F.transform(given, row))
    asked = F.transform(F.coalesce(conditions, F.array().cast("array<string>")), lambda c: F.concat(F.lit("  • "), c))
    writing = F.concat(F.array(F.concat(F.lit("▶ "), F.coalesce(prompt, F.lit("")))), F.array(F.lit("＜조건＞")), asked, F.array_repeat(F.lit(ANSWER_LINE), ANSWER_LINES))
    return F.when((kind == TABLE_TYPE) & (F.size(given) > 0), table).when(kind == WRITING_TYPE, writing).otherwise(given)


def exam_rows(exams: DataFrame, doc: str) -> DataFrame:
    """(doc, section, position, num, question, insert_sentence, passage, choices, answer_shown, model_answer, key, explanation).

    ``exams`` has ``sections``: label, passage, and questions as
    ``sources.study.EXAM`` describes them.  A passage stands at the section's
    first question, or at each question with one of its own; it is an array of
    paragraphs with what questions ask about underlined.  Positions count from
    1 over the whole exam.
    """
    s = exams.select(doc, F.posexplode("sections").alias("section", "s"))
    qs = F.coalesce("s.questions", F.filter(F.col("s.questions"), lambda _: F.lit(False)))
    marked = F.transform(F.filter(qs, lambda q: asks_marked(q["question"])), lambda q: circled_map(F.coalesce(q["choices"], F.array().cast("array<string>"))))
    targets = quoted_targets(F.transform(qs, lambda q: q["question"]))
    s = s.withColumn("shared", underlined_paragraphs(F.col("s.passage"), targets, _merged_maps(marked)))
    q = s.select(doc, "section", "shared", F.posexplode("s.questions").alias("at", "q")).select(doc, "section", "at", "shared", "q.*")
    own = F.coalesce(F.nullif("passage_underlined", F.lit("")), F.nullif("passage_abc", F.lit("")))
    empty, no_targets = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    words = F.when(asks_marked(F.col("question")), circled_map(F.coalesce("choices", no_targets))).otherwise(empty)
    passage = F.when(own.isNotNull(), underlined_paragraphs(own, no_targets, words)).when(F.col("at") == 0, F.col("shared")).otherwise(no_targets)
    essay = F.coalesce(F.col("answer_display") == ESSAY, F.lit(False))
    explained = F.filter(F.transform(F.split(F.coalesce("explanation", F.lit("")), "\n"), stripped), lambda x: x != "")
    position = F.row_number().over(Window.partitionBy(doc).orderBy("section", "at"))
    return q.select(
        doc,
        "section",
        position.alias("position"),
        "num",
        "question",
        F.when(F.col("type") == INSERT_TYPE, F.col("insert_sentence")).alias("insert_sentence"),
        passage.alias("passage"),
        choice_lines(F.col("type"), F.col("choices"), F.col("korean"), F.col("conditions")).alias("choices"),
        F.when(essay, ESSAY).otherwise(answer_char(F.col("answer"), F.col("choices"))).alias("answer_shown"),
        F.when(essay, F.nullif("answer", F.lit(""))).alias("model_answer"),
        F.array_join("key_phrases", " / ").alias("key"),
        explained.alias("explanation"),
    )


def bad_exam_answers(exams: DataFrame, doc: str) -> DataFrame:
    """(doc, num, answer): objective questions whose answer is none of their choices."""
    q = exams.select(doc, F.explode("sections").alias("s")).select(doc, F.explode("s.questions").alias("q")).select(doc, "q.*")
    return bad_answers(q, kind="answer_display", essay=ESSAY).select(doc, "num", "answer")


def output_name(stem: Column, given: Column, turn: Column, student: bool) -> Column:
    """The file of an exam: the given name, else one from the data's name and the round; students' copies are marked once."""
    base = F.concat(F.regexp_replace(stem, "^exam_data_", ""), F.lit(FORECAST), F.coalesce(turn, F.lit("1")), F.lit("회.pdf"))
    name = F.coalesce(F.nullif(given, F.lit("")), base)
    if not student:
        return name
    root = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    return F.when(F.endswith(root, F.lit(STUDENT)), name).otherwise(F.concat(root, F.lit(STUDENT), F.substring(name, F.length(root) + 1, F.length(name))))
