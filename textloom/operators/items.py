"""Items of a book: from its lines to passage, translation and topic.

Lines have a document, line_no, text and is_break, as ``lines.page_lines`` gives
them.  Only the last step, on the lines of one item, is Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.korean import aligned_paragraphs, has_hangul, loose_spacing
from textloom.functions.morphology import Maker, joined_wraps
from textloom.functions.text import is_english_line, let, stripped
from textloom.operators import handlers
from textloom.operators.segments import wins

# Notation of item headers, of shared blocks and of lesson names; section labels; words of instructions.
HEADER = r"(?U)#\s*강\s+(\d+)\s+#\s*쪽\s+(\d+)\s+#\s*번\s+(\d+)\s+#\s*문항코드\s+(\S+)"
SHARED = r"(?Ud)#\s*강\s+(\d+)\s+#\s*쪽\s+\d+\s+#\s*번\s+(\d+)~(\d+)\s+#\s*문항코드\s*$"
LESSON = r"(?Ud)^(\d{2})\s+강\s+(.+)$"
PROBLEM = ["[ 문제]", "[문제]"]
AFTER_BODY = ("[ 정답", "[정답", "[ 해석", "[해석")
AS_IT_IS = ["목적으로 가장 적절한", "목적으로 적절한", "심경으로", "심경 변화", "분위기로", "요지로", "주장으로", "주제로", "제목으로", "의미하는 바", "내용과 일치하지 않는", "내용과 일치하는", "내용으로 일치"]
SHORTEST_PASSAGE, SHORTEST_TRANSLATION = 20, 10

_LINE = "array<struct<line_no:bigint,text:string,is_break:boolean>>"


def lesson_names(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, lesson, title): the first title of each lesson."""
    s = stripped(F.col("text"))
    named = lines.select(doc, F.regexp_extract(s, LESSON, 1).alias("lesson"), stripped(F.regexp_extract(s, LESSON, 2)).alias("title"), "line_no")
    return wins(named.where("lesson <> '' and title <> ''"), [doc, "lesson"], ["line_no"], ["title"])


def items(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, item, lesson, page, number, code, lines, shared, set_id, set_size): items from header to header, from 1.

    Lines before the first header belong to none.  A marker of a shared block
    (numbers, no code) gives the lines up to the next header to as many items
    as it has numbers, from the next one on, up to the first of another lesson
    or with a number out of its range; of several markers the last counts.
    Where there is none, ``shared`` is empty and ``set_size`` 0.
    """
    text = lines.select(doc, "line_no", "text", F.coalesce("is_break", F.lit(False)).alias("is_break"))
    order = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header, marker = F.coalesce(F.col("text").rlike(HEADER), F.lit(False)), stripped(F.col("text"))
    rows = text.withColumn("head", header).withColumn("item", F.sum(header.cast("int")).over(order))
    packed = F.array_sort(F.collect_list(F.struct("line_no", "text", "is_break")))
    body = rows.where("item > 0").groupBy(doc, "item").agg(packed.alias("lines"))
    first = F.get("lines", F.lit(0))["text"]
    parts = [F.regexp_extract(first, HEADER, k).alias(n) for k, n in enumerate(["lesson", "page", "number", "code"], 1)]
    body = body.select(doc, "item", *parts, "lines").withColumn("lesson", F.when(F.length("lesson") < 2, F.lpad("lesson", 2, "0")).otherwise(F.col("lesson")))

    m = rows.where(marker.rlike(SHARED)).select(doc, F.col("item").alias("block"), F.col("line_no").alias("set_id"), *[F.regexp_extract(marker, SHARED, k).alias(n) for k, n in enumerate(["m_lesson", "low", "high"], 1)])
    m = m.withColumn("m_lesson", F.when(F.length("m_lesson") < 2, F.lpad("m_lesson", 2, "0")).otherwise(F.col("m_lesson"))).withColumn("size", F.expr("try_cast(high as bigint) - try_cast(low as bigint) + 1")).where("size >= 2")
    shared = rows.withColumnRenamed("item", "block").join(m.select(doc, "block", "set_id"), [doc, "block"]).where("line_no >= set_id").groupBy(doc, "set_id").agg(packed.alias("shared"))
    # the items that a marker reaches, in order, until one does not fit
    reach = m.join(body.select(doc, "item", "lesson", "number"), doc).where("item > block and item <= block + size")
    fits = (F.col("lesson") == F.col("m_lesson")) & F.coalesce(F.expr("try_cast(number as bigint) between try_cast(low as bigint) and try_cast(high as bigint)"), F.lit(False))
    so_far = Window.partitionBy(doc, "set_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    reach = reach.withColumn("ok", F.min(fits.cast("int")).over(so_far)).where("ok = 1")
    sets = reach.groupBy(doc, "item").agg(F.max(F.struct("set_id", "size")).alias("s")).select(doc, "item", "s.set_id", F.col("s.size").alias("set_size"))
    out = body.join(sets, [doc, "item"], "left").join(shared, [doc, "set_id"], "left")
    return out.select(doc, "item", "lesson", "page", "number", "code", "lines", F.coalesce("shared", F.array().cast(_LINE)).alias("shared"), "set_id", F.coalesce("set_size", F.lit(0)).alias("set_size"))


def instruction(lines: Column) -> Column:
    """The instruction of an item (an array of texts): up to six lines after the first problem label, to a choice, a bracket or the English text."""
    trimmed = F.transform(lines, stripped)
    at = F.array_position(F.transform(trimmed, lambda s: s.isin(PROBLEM)), True).cast("int")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("over"))

    def step(a: Column, s: Column) -> Column:
        over = a["over"] | s.rlike(r"^[①②③④⑤\[{]") | (is_english_line(s) & ~has_hangul(s))
        return F.struct(F.when(over | (s == ""), a["text"]).otherwise(F.concat_ws(" ", F.nullif(a["text"], F.lit("")), s)).alias("text"), over.alias("over"))

    return let(F.when(at > 0, F.slice(trimmed, at + 1, 6)).otherwise(F.array().cast("array<string>")), lambda ls: F.aggregate(ls, start, step, lambda a: a["text"]))


def _numbered_prose(lines: Column) -> Column:
    """If the body, from the first English line after a problem label to the answer or translation, has a long line with a choice marker."""
    start = F.struct(F.lit(0).alias("state"), F.lit(False).alias("found"))

    def step(a: Column, line: Column) -> Column:
        return let(stripped(line), lambda s: let(_state(a["state"], s), lambda st: F.struct(st.alias("state"), (a["found"] | ((st == 2) & s.rlike("[①②③④⑤]") & (F.length(s) >= 40))).alias("found"))))

    return F.aggregate(lines, start, step, lambda a: a["found"])


def _state(state: Column, s: Column) -> Column:
    """0 outside, 1 in the instruction, 2 in the body."""
    ends = F.lit(False)
    for label in AFTER_BODY:
        ends = ends | F.startswith(s, F.lit(label))
    return F.when(s.isin(PROBLEM), 1).when(ends, 0).when((state == 1) & is_english_line(s), 2).otherwise(state)


def item_type(lines: Column, asked: Column) -> Column:
    """The type of an item from its lines (an array of texts) and its instruction.  The first rule that fits counts."""
    text = F.array_join(lines, "\n")
    has = lambda *words: _all(asked.contains(w) for w in words)
    any_of = lambda *words: asked.rlike("|".join(f"\\Q{w}\\E" for w in words))
    slot = lambda x: text.rlike(rf"(?U)\(\s*{x}\s*\)")
    three = slot("A") & slot("B") & slot("C")
    kind = (
        F.when(F.size(lines) == 0, "AS_IS")
        .when(has("다음 글을 읽고", "물음에 답하시오"), F.when((three & slot("D")) | any_of("순서로 가장 적절한", "이어질 내용을 순서"), "LONG2").otherwise("LONG1"))
        .when(any_of("도표의 내용", "다음 글(안내문)", "안내문의 내용", "광고의 내용"), "SKIP")
        .when(has("어법상") | (has("어법") & any_of("틀린", "적절하지 않은", "적절한")), "REPLACE")
        .when(any_of("낱말의 쓰임", "문맥에 맞는 낱말", "문맥상 낱말") | has("낱말", "적절"), "REPLACE")
        .when(has("요약") & any_of("(A)", "(B)", "빈칸"), "SUMMARY")
        .when(text.contains("↓") & has("빈칸") & any_of("(A)", "(B)"), "SUMMARY")
        .when(has("빈칸에 들어갈"), "FILL")
        .when(any_of("전체 흐름과 관계", "흐름과 무관", "관계 없는 문장"), "REMOVE")
        .when(any_of("이어질 글의 순서", "순서에 맞게 배열", "순서로 가장 적절한"), "REORDER")
        .when(has("들어가기에 가장 적절한 곳") | has("주어진 문장", "적절한"), "INSERT")
        .when(any_of(*AS_IT_IS), "AS_IS")
        .when((text.contains("어법") | F.lower(text).contains("grammar")) & _numbered_prose(lines), "REPLACE")
        .when(text.rlike("_{3,}"), "FILL")
        .when(three & ~slot("D"), "REORDER")
    )
    return kind.otherwise("AS_IS")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def classified(book: DataFrame) -> DataFrame:
    """Adds ``instruction`` and ``type`` to items."""
    texts = F.transform("lines", lambda x: F.coalesce(x["text"], F.lit("")))
    return book.withColumn("instruction", instruction(texts)).withColumn("type", item_type(texts, F.col("instruction")))


def _lines(rows) -> list[handlers.Line]:
    return [handlers.Line(r["text"] or "", bool(r["is_break"])) for r in rows]


def extracted(book: DataFrame, doc: str, analyzer: Maker | None = None) -> DataFrame:
    """Adds passage, translation and topic to classified items.

    With an analyzer, words of translations and topics that line ends parted
    are joined too.

    Items of a set of three or more take the set's order, that of its first
    item which gives one (its own if it is alone), when all blocks of the
    passage are there.  Translations follow the paragraphs of their passages.
    """

    @F.pandas_udf("string")
    def order_of(lines: pd.Series) -> pd.Series:
        return pd.Series([handlers.order_of(_lines(x)) for x in lines], dtype=object)

    @F.pandas_udf("struct<passage:string,translation:string,topic:string,base:string,then:string>")
    def extract(kind: pd.Series, size: pd.Series, code: pd.Series, asked: pd.Series, lines: pd.Series, shared: pd.Series, order: pd.Series) -> pd.DataFrame:
        rows = zip(kind, size, code, asked, lines, shared, order, strict=True)
        out = [handlers.extract(k, handlers.Item(_lines(ls), c, a, _lines(sh), o if isinstance(o, str) else None), n) for k, n, c, a, ls, sh, o in rows]
        return pd.DataFrame(out, columns=list(handlers.Extracted._fields), dtype=object)

    own = book.withColumn("own_order", F.when(F.col("set_size") >= 3, order_of("lines")))
    in_set = own.where("set_size >= 3").groupBy(doc, "set_id").agg(F.count("*").alias("members"), F.min(F.when(F.col("own_order").isNotNull(), F.struct("item", "own_order")))["own_order"].alias("set_order"))
    own = own.join(in_set, [doc, "set_id"], "left")
    order = F.when(F.col("members") >= 2, F.col("set_order")).when(F.col("type") == "REORDER", F.col("own_order"))
    got = own.withColumn("x", extract("type", "set_size", "code", "instruction", "lines", "shared", order))
    told = aligned_paragraphs(F.col("x.base"), F.col("x.translation"))
    unlabelled = stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(told, r"(?U)\(\s*[A-C]\s*\)\s+", ""), "[ \t]{2,}", " "), " *\n\n *", "\n\n"))
    head, tail = F.regexp_replace(F.substring_index(told, "→", 1), r"(?Ud)\s+$", ""), F.regexp_replace(F.substring(told, F.instr(told, "→") + 1, F.length(told)), r"(?U)^\s+", "")
    parted = F.when((F.instr(told, "→") > 0) & (head != "") & (tail != ""), F.concat(head, F.lit("\n\n→ "), tail)).otherwise(told)
    told = F.when(F.col("x.then") == "labels", unlabelled).when(F.col("x.then") == "arrow", parted).otherwise(told)
    out = got.select(*book.columns, F.col("x.passage").alias("passage"), told.alias("translation"), F.col("x.topic").alias("topic"))
    whole = lambda c: joined_wraps(loose_spacing(F.col(c)), analyzer) if analyzer else loose_spacing(F.col(c))
    return out.withColumn("translation", whole("translation")).withColumn("topic", whole("topic"))


def printable(extracts: DataFrame, doc: str) -> DataFrame:
    """(doc, item, lesson, number, topic, passage, translation): what goes into the passage book; short translations are empty."""
    kept = extracts.where((F.col("type") != "SKIP") & (F.length("passage") >= SHORTEST_PASSAGE))
    return kept.select(doc, "item", "lesson", "number", "topic", "passage", F.when(F.length("translation") > SHORTEST_TRANSLATION, F.col("translation")).otherwise("").alias("translation"))
