"""Textbooks and their solution books: lessons, problems, solutions, and both joined.

Solutions are read with running windows over the lines of a book, all on one
partitioning and order, in place of a loop with state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import before_index, between, block, first_index, from_index
from textloom.functions.korean import has_hangul
from textloom.functions.text import let, stripped
from textloom.operators.segments import carried_forward, next_bound, trailing_segments

# Pages of contents, and notation of the textbook.
CONTENTS_PAGES = (4, 5, 6)
ITEM_ID = r"(?Ud)^\s*(26005-\d{4})\s*$"
SKIPPED = r"(?Ud)^\s*(?:Solving\s+Strategies|Academic\s+Vocabulary\s+by\s+Topic)\s*$"
EXERCISES = r"(?Ud)^\s*xercises\s*$"
ASKS = r"(?U)^\s*(?:다음\s+글|다음은|다음\s+빈칸|밑줄\s+친|윗글|주어진\s+글|다음\s+문장|다음\s+도표|다음\s+표|다음\s+안내문|다음에)"
CONCLUDES = r"(?U)^\s*(?:따라서|그러므로|즉|그래서|결론적으로)"
ASKS_GROUP = r"(?U)^\s*\d{2}\s*[~～〜]\s*\d{2}\s+(다음\s+글.+)"
ASKS_ONE = r"(?U)^\d{1,2}\.\s*(?:윗글|밑줄|빈칸|문맥상|다음\s+글|다음\s+빈칸)"
TEXTBOOK_NOISE = [
    r"^\s*$",
    r"^\s*\d+\s+20\d+학년도\s+EBS\s+수능특강\s+영어\s*$",
    r"^\s*\d{1,3}\s*$",
    r"^\s*(?:ateway|xercises|Solving\s+Strategies|Words\s*&\s*Phrases\s+in\s+Use|Solution\s+Guide|Structure\s+in\s+Focus|Academic\s+Vocabulary\s+by\s+Topic)\s*$",
    r"^\s*[GE]\s*$",
    r"^\s*(?:유형편|주제ㆍ소재편|주제·소재편)\s*$",
    r"^\s*I{1,3}\s*$",
    r"^\s*%?\d+%?\s*$",
    r"^\s*\[20\d+학년도[^\]]+\]\s*$",
    r"^\s*20\d+학년도\s+.+번\s*$",
    r"^\s*정답과\s*해설\s*\d+쪽?\s*$",
    r"^\s*C\s*o\s*n\s*t\s*e\s*n\s*t\s*s\s*$",
    r"^\s*\d+\s*[•·ㆍ]\s*.+\s+\d+\s*$",
]
# Notation of the solution book.
LESSON = r"(?Ud)^(\d{2}) ([가-힣].*)$"
NO_LESSON = ["유형편", "주제·소재편", "주제ㆍ소재편", "테스트편"]
TEST = r"(?U)^TEST\s+본문\s+\d+"
GATEWAY_MANY = r"(?Ud)^.*?G\s*ateway\s+(\d{2}\s*[①②③④⑤].+)$"
GATEWAY_ONE = r"(?U)^.*?G\s*ateway\s+([①②③④⑤])(?:\s|$)"
EXERCISE_KEY = r"(?U)^E\s*xercises\s+\d{2}\s*[①②③④⑤]"
KEY_GOES_ON = r"(?U)^\d{2}\s*[①②③④⑤]"
GATEWAY_BODY = r"(?Ud)^ateway\s+본문\s+(\d+)쪽\s*$"
EXERCISES_BODY = r"(?Ud)^E\s+본문\s+\d+\s*[~～〜]\s*\d+쪽\s*$"
EXERCISE = r"(?Ud)^(\d{2})(?:\s+.+)?\s*$"
ANSWER, ANSWERS = r"(?Ud)^정답\s*([①②③④⑤])(?:\s+.+)?\s*$", r"(?Ud)^정답\s+(\d{2}\s*[①②③④⑤].+)$"
TOPIC, TOLD = r"(?Ud)^소재\s+(.+)$", r"(?Ud)^해석\s+(.+)$"
GUIDE, STRUCTURE = r"(?Ud)^Solution\s+Guide\s*$", r"(?Ud)^Structure\s+in\s+Focus\s*$"
CULTURE = r"(?U)^Culture\s*Note\b"
PAGE_HEAD = r"(?U)\s*(?:유형편|주제[ㆍ·]소재편)\s*"
PAIR = r"(?U)(\d{2}\s*[①②③④⑤])"
SOLUTION_NOISE = [
    r"^\s*$",
    r"^\s*Part\s*$",
    r"^\s*Part\s+I+\s+.+\s*$",
    r"^\s*I{1,2}\s*$",
    r"^\s*[GE]\s*$",
    r"^\s*유형편\s*$",
    r"^\s*주제·소재편\s*$",
    r"^\s*주제ㆍ소재편\s*$",
    r"^\s*정답과\s*해설\s*\d*\s*$",
    r"^\s*\d+\s+20\d+학년도\s+EBS\s+수능특강\s+영어\s*$",
    r"^\s*영\s*어\s*$",
    r"^\s*영어영역\s*$",
]
FIELDS = ["korean_translation", "solution_guide", "structure_in_focus"]
LONG_READING = "장문 독해"


def _is_noise(s: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | s.rlike(f"(?Ud){p}")
    return out


def contents(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, lesson, title, start_page) of the lines of the pages of contents: a lesson's number, its title and its page.

    Of equal lessons the last counts.  Blank lines do not.
    """
    w = Window.partitionBy(doc).orderBy("line_no")
    s = lines.select(doc, "line_no", stripped(F.col("text")).alias("s")).where("s <> ''")
    s = s.withColumn("title", F.lead("s").over(w)).withColumn("p", F.lead("s", 2).over(w))
    s = s.where(F.col("s").rlike(r"(?Ud)^\d{2}$") & F.col("p").rlike(r"(?Ud)^\d{1,3}$") & ~F.col("title").rlike(r"(?U)^\d"))
    s = s.select(doc, "line_no", F.col("s").cast("int").alias("lesson"), "title", F.col("p").cast("int").alias("start_page")).where("lesson between 1 and 30 and start_page between 5 and 250")
    return s.groupBy(doc, "lesson").agg(F.max(F.struct("line_no", "title", "start_page")).alias("x")).select(doc, "lesson", "x.title", "x.start_page")


def lesson_pages(toc: DataFrame, doc: str, total_pages: Column) -> DataFrame:
    """Adds ``end_page``: before the next lesson; the last lesson ends with the book, or after four pages from lesson 21 on."""
    last = F.when(F.col("lesson").between(21, 30), F.least(F.col("start_page") + 3, total_pages)).otherwise(total_pages)
    return next_bound(toc, [doc], ["lesson"], "start_page", "__next").withColumn("end_page", F.coalesce(F.col("__next") - 1, last)).drop("__next")


def without_sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves out sections of advice and vocabulary, up to the exercises' title or an item id, which stay."""
    s = stripped(F.col("text"))
    event = F.when(s.rlike(SKIPPED), True).when(s.rlike(EXERCISES) | F.col("text").rlike(ITEM_ID), False)
    return carried_forward(lines, keys, ["line_no"], event, "__skip").where(~F.coalesce("__skip", F.lit(False))).drop("__skip")


def problem(lines: Column, title: Column) -> Column:
    """Instruction, body, choices, vocab and footnote of the lines of a problem (an array of texts), noise and lesson title left out.

    The instruction is that of a group of problems, else a line with one of its
    openings (and the next, if that ends it), else the first Korean question.
    """
    def parts(c: Column) -> Column:
        group = first_index(c, lambda s: s.rlike(ASKS_GROUP))
        opening = first_index(c, lambda s: s.rlike(ASKS))
        question = first_index(c, lambda s: has_hangul(s) & F.endswith(s, F.lit("?")) & ~s.rlike(CONCLUDES))
        two = ~F.endswith(F.get(c, opening), F.lit("?")) & F.coalesce(F.get(c, opening + 1).contains("적절한"), F.lit(False))
        asked = F.when(group.isNotNull(), stripped(F.regexp_extract(F.get(c, group), ASKS_GROUP, 1))).when(opening.isNotNull(), F.when(two, F.concat_ws(" ", F.get(c, opening), F.get(c, opening + 1))).otherwise(F.get(c, opening))).otherwise(F.coalesce(F.get(c, question), F.lit("")))
        start = F.coalesce(group + 1, opening + F.when(two, 2).otherwise(1), question + 1, F.lit(0))
        return let(F.struct(asked.alias("asked"), start.alias("start"), group.isNotNull().alias("grouped")), lambda v: rest(c, v))

    def rest(c: Column, v: Column) -> Column:
        here = lambda p: first_index(c, lambda s, i: (i >= v["start"]) & p(s))
        one = here(lambda s: s.rlike(ASKS_ONE))
        marks = F.struct(
            F.coalesce(F.when(v["grouped"], one), here(lambda s: s.rlike("^[①②③④⑤]"))).alias("choice"),
            here(lambda s: F.startswith(s, F.lit("□"))).alias("vocab"),
            here(lambda s: s.rlike(r"(?U)^\*\s*[A-Za-z]") & s.contains(":")).alias("note"),
        )

        def cut(m: Column) -> Column:
            n = F.size(c)
            body = between(c, v["start"], F.coalesce(F.least(m["choice"], m["vocab"], m["note"]), n))
            choices = between(c, m["choice"], F.when(m["vocab"] > m["choice"], m["vocab"]).otherwise(n))
            notes = between(c, m["note"], F.when(m["choice"] > m["note"], m["choice"]).otherwise(n))
            text = lambda ls: F.coalesce(block(ls), F.lit(""))
            return F.struct(v["asked"].alias("instruction"), text(body).alias("body"), text(choices).alias("choices"), text(from_index(c, m["vocab"])).alias("vocab"), text(notes).alias("footnote"))

        return let(marks, cut)

    cleaned = F.transform(F.filter(lines, lambda s: ~_is_noise(s, TEXTBOOK_NOISE) & (stripped(s) != stripped(title))), stripped)
    return let(cleaned, parts)


def problems(pages: DataFrame, lessons: DataFrame, doc: str) -> DataFrame:
    """(doc, lesson, title, position, qid, instruction, body, choices, vocab, footnote); position 0 is the lesson's gateway.

    ``pages`` has page (from 1), line_no and text; ``lessons`` is that of
    ``lesson_pages``.  A problem ends with its id; lines after the last go.
    """
    inside = pages.join(lessons, doc).where("page between start_page and end_page").select(doc, "lesson", "title", F.struct("page", "line_no").alias("line_no"), "text")
    keys = [doc, "lesson"]
    cut = trailing_segments(without_sections(inside, keys), keys, ["line_no"], F.coalesce(F.col("text").rlike(ITEM_ID), F.lit(False)), "position")
    packed = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    p = cut.groupBy(*keys, "title", "position").agg(packed.alias("ls"))
    p = p.withColumn("qid", F.regexp_extract(F.element_at("ls", -1), ITEM_ID, 1)).withColumn("x", problem(before_index(F.col("ls"), F.size("ls") - 1), F.col("title")))
    return p.select(*keys, "title", F.col("position").cast("int").alias("position"), "qid", "x.*")


def answer_pairs(text: Column) -> Column:
    """Pairs of two digits and a choice as a map; of equal numbers the last counts."""
    found = F.regexp_extract_all(text, F.lit(PAIR), 1)
    return F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != F.substring(p, 1, 2)), F.create_map(F.substring(p, 1, 2), F.substring(p, -1, 1))))


def _in_order(pairs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_keys(pairs)), lambda k: F.element_at(pairs, k)), ",")


def _read_solution(lines: DataFrame, doc: str) -> DataFrame:
    """Lines with lesson, event, section, targets and field."""
    w = Window.partitionBy(doc).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    s = F.col("s")
    x = lines.where(~_is_noise(F.coalesce("text", F.lit("")), SOLUTION_NOISE)).select(doc, "line_no", stripped(F.col("text")).alias("s"))
    n = F.regexp_extract("s", LESSON, 1).try_cast("int")
    heads = s.rlike(LESSON) & n.between(1, 30) & ~stripped(F.regexp_extract("s", LESSON, 2)).isin(NO_LESSON)
    x = x.withColumn("head", F.coalesce(heads, F.lit(False))).withColumn("lesson", last(F.when(s.rlike(TEST), 0).when(F.col("head"), n)))
    in_lesson = F.coalesce(F.col("lesson") > 0, F.lit(False))
    event = F.when(s.rlike(TEST), "test").when(F.col("head"), "lesson")
    event = event.when(in_lesson, F.when(s.rlike(GATEWAY_MANY), "gateway key").when(s.rlike(GATEWAY_ONE), "gateway answer").when(s.rlike(EXERCISE_KEY), "key").when(s.rlike(GATEWAY_BODY), "gateway").when(s.rlike(EXERCISES_BODY), "exercises"))
    x = x.withColumn("event", event)
    # lines right after a key that go on with it
    key_at = last(F.when(~s.rlike(KEY_GOES_ON), F.when(F.col("event") == "key", F.col("line_no")).otherwise(-1)))
    x = x.withColumn("key_at", key_at).withColumn("event", F.when(F.col("event").isNull() & (F.col("key_at") >= 0) & s.rlike(KEY_GOES_ON), "key").otherwise(F.col("event")))
    x = x.withColumn("section", last(F.when(F.col("event").isin("test", "lesson"), "").when(F.col("event") == "gateway", "gw").when(F.col("event") == "exercises", "ex")))
    keys = x.where("event = 'key'").groupBy(doc, "lesson", "key_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda r: r["s"]), " ").alias("text"))
    keys = keys.groupBy(doc, "lesson").agg(answer_pairs(F.max(F.struct("key_at", "text"))["text"]).alias("known"))
    x = x.join(keys, [doc, "lesson"], "left")
    number = F.regexp_extract("s", EXERCISE, 1)
    opens = (F.col("section") == "ex") & s.rlike(EXERCISE) & F.coalesce(F.map_contains_key("known", number), F.lit(False))
    many = F.col("section").isin("gw", "ex") & s.rlike(ANSWERS)
    x = x.withColumn("event", F.coalesce("event", F.when(opens, "exercise").when(many, "answers")))
    none = F.array().cast("array<string>")
    targets = F.when(F.col("event").isin("test", "lesson", "exercises"), none).when(F.col("event") == "gateway", F.array(F.lit("gw"))).when(F.col("event") == "exercise", F.array(number))
    targets = targets.when((F.col("event") == "answers") & (F.col("section") == "ex"), F.array_sort(F.map_keys(answer_pairs(s))))
    x = x.withColumn("targets", F.coalesce(last(targets), none))
    label = stripped(F.regexp_replace(F.regexp_replace("s", PAGE_HEAD, " "), "[ \t]{2,}", " "))
    x = x.withColumn("label", label)
    has = F.size("targets") > 0
    named = F.when(F.col("label").rlike(ANSWER), "answer").when(F.col("label").rlike(TOPIC), "topic").when(F.col("label").rlike(TOLD), FIELDS[0]).when(F.col("label").rlike(GUIDE), FIELDS[1]).when(F.col("label").rlike(STRUCTURE), FIELDS[2])
    x = x.withColumn("event", F.coalesce("event", F.when(has, named), F.when(s.rlike(CULTURE), "culture")))
    x = x.withColumn("field", last(F.col("event"))).withColumn("piece", last(F.when(F.col("event").isNotNull(), F.col("line_no"))))
    # a gateway read again takes the place of the one before
    return x.withColumn("gateway_at", F.max(F.when(F.col("event") == "gateway", F.col("line_no"))).over(Window.partitionBy(doc, "lesson")))


def solutions(lines: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Of the lines of a solution book: its lessons and its problems.

    Lessons: (doc, lesson, title, gateway_answer, gateway_answer_map,
    exercises_answers).  Problems: (doc, lesson, problem, answer, sozae,
    korean_translation, solution_guide, structure_in_focus, body_ref_page);
    problem is ``gw`` or two digits.  An exercise begins at its number if the
    lesson's key has it.  What follows the answers of several is all of theirs.
    What is missing is empty.
    """
    x = _read_solution(lines, doc).where("lesson > 0")
    keys = [doc, "lesson"]
    is_event = lambda e: F.col("event") == e
    first_title = F.min(F.when(is_event("lesson"), F.struct("line_no", stripped(F.regexp_extract("s", LESSON, 2)).alias("v"))))["v"]
    newest = lambda when, v: F.max(F.when(when, F.struct(F.col("line_no"), v.alias("v"))))["v"]
    many = newest(is_event("gateway key"), F.regexp_extract("s", GATEWAY_MANY, 1))
    summary = newest(is_event("gateway key") | is_event("gateway answer"), F.when(is_event("gateway key"), _in_order(answer_pairs(F.regexp_extract("s", GATEWAY_MANY, 1)))).otherwise(F.regexp_extract("s", GATEWAY_ONE, 1)))
    empty = F.create_map().cast("map<string,string>")
    lessons = x.groupBy(*keys).agg(first_title.alias("title"), F.coalesce(summary, F.lit("")).alias("gateway_answer"), F.coalesce(answer_pairs(many), empty).alias("gateway_answer_map"), F.coalesce(F.any_value("known"), empty).alias("exercises_answers"))

    live = x.select("*", F.explode("targets").alias("problem")).where("problem <> 'gw' or line_no >= gateway_at")
    pairs = answer_pairs(F.regexp_extract("s", ANSWERS, 1))
    answered = F.when(is_event("answer"), F.regexp_extract("label", ANSWER, 1)).when(is_event("answers"), F.when(F.col("problem") == "gw", _in_order(pairs)).otherwise(F.element_at(pairs, F.col("problem"))))
    heads = live.groupBy(*keys, "problem").agg(
        F.coalesce(newest(answered.isNotNull(), answered), F.lit("")).alias("answer"),
        F.coalesce(newest(is_event("topic"), stripped(F.regexp_extract("label", TOPIC, 1))), F.lit("")).alias("sozae"),
        newest(is_event("gateway"), F.regexp_extract("s", GATEWAY_BODY, 1).try_cast("int")).alias("body_ref_page"),
    )
    told = live.where(F.col("field").isin(FIELDS)).withColumn("t", F.when(F.col("event").isNull(), F.col("s")).when(is_event(FIELDS[0]), stripped(F.regexp_extract("label", TOLD, 1)))).where("t is not null")
    joined = lambda order, t: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, t))), lambda r: r[t]), "\n")
    pieces = told.groupBy(*keys, "problem", "field", "piece").agg(joined("line_no", "t").alias("t"))
    pieces = pieces.withColumn("t", stripped(F.regexp_replace(F.regexp_replace("t", PAGE_HEAD, " "), "[ \t]{2,}", " "))).where("t <> ''")
    texts = pieces.groupBy(*keys, "problem").pivot("field", FIELDS).agg(joined("piece", "t"))
    out = heads.join(texts, [*keys, "problem"], "left")
    return lessons, out.select(*keys, "problem", "answer", "sozae", *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS], "body_ref_page")


def merged(asked: DataFrame, lessons: DataFrame, solved: DataFrame, doc: str) -> DataFrame:
    """Problems of the textbook with their solutions: (doc, lesson, title, position, ex_number, answer_number, both their columns).

    Lessons of either book stay, with at least their gateway; exercises are
    those of the textbook, the n-th with the solution of number n.  In lessons
    of long reading an empty body is that of the problem before.
    """
    keys = [doc, "lesson"]
    gateways = asked.select(*keys).unionByName(lessons.select(*keys)).distinct().withColumn("position", F.lit(0))
    places = gateways.unionByName(asked.where("position > 0").select(*keys, "position"))
    key = F.when(F.col("position") == 0, "gw").otherwise(F.lpad(F.col("position").cast("string"), 2, "0"))
    titles = asked.groupBy(*keys).agg(F.first("title").alias("book_title"))
    l = lessons.withColumnRenamed("title", "solution_title")
    m = places.join(asked.drop("title"), [*keys, "position"], "left").withColumn("problem", key).join(solved, [*keys, "problem"], "left").join(titles, keys, "left").join(l, keys, "left")
    m = m.withColumn("title", F.coalesce(F.nullif("book_title", F.lit("")), "solution_title", F.lit("")))
    number = F.when(F.col("position") > 0, F.col("problem"))
    m = m.withColumn("ex_number", number).withColumn("answer_number", F.coalesce(F.when(number.isNull(), F.col("gateway_answer")).otherwise(F.try_element_at("exercises_answers", "problem")), F.lit("")))
    m = carried_forward(m, keys, ["position"], F.nullif("body", F.lit("")), "before")
    m = m.withColumn("body", F.when(F.col("title").contains(LONG_READING), F.coalesce("before", "body")).otherwise(F.col("body")))
    return m.drop("before", "problem", "book_title", "solution_title", "gateway_answer", "gateway_answer_map", "exercises_answers")
