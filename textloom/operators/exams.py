"""Mock exams: questions and answers from the lines of their booklets, and both joined.

Lines have a document, line_no from 0, and text.  A booklet's lines are one
array; its questions are slices of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import before_index, between, block, first_index, from_index
from textloom.functions.korean import has_hangul
from textloom.functions.text import let, stripped
from textloom.operators.joins import left_override

# Notation of questions, groups and section labels; instructions of questions whose text holds the choices; questions read as they are.
QUESTION = r"(?Ud)^(\d{1,2})\.(?:\s+|$)"
CHOICE = "^[①②③④⑤]"
GROUP = r"(?Ud)^\[(\d+)\s*[~～〜]\s*(\d+)\]\s*(.+)"
LONE_GROUP = r"(?Ud)^\[(\d+)\s*[~～〜]\s*(\d+)\]\s*$"
ANY_GROUP = r"(?Ud)^\[(\d+)\s*[~～〜]\s*(\d+)\]"
PAGE_NUMBER = r"(?Ud)^\d{1,2}$"
ANSWER_HEADING = r"(?U)^(\d{1,2})\.\s*\[출제\s*의도\]"
ANSWER_PAIR = r"(?U)(\d{1,2}\.?\s+[①②③④⑤])"
TRANSLATION = r"(?Ud)^\[해석\]\s*(.*)$"
TRANSLATION_END = r"(?U)^\[(?:풀이|Words\s*(?:and|&)\s*Phrases|어휘|어구|Solution|Vocabulary)\]"
SECTION = r"(?Ud)^\[(해석|풀이|Words and Phrases|어휘|Solution)\]\s*$"
MARKED_IN_TEXT = "어법상|낱말의 쓰임|전체 흐름과 관계 없는"
EASY = [18, 19, 20, 21, 22, 23, 24, 26]
SHORTEST_SHARED, LAST_NUMBER = 200, 45


def _booklets(lines: DataFrame, doc: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text"))))
    return lines.groupBy(doc).agg(F.transform(packed, lambda x: x["text"]).alias("ls"))


def _starts(books: DataFrame, doc: str, pattern: str, low: int, high: int) -> DataFrame:
    """(doc, n, start, end): the first line of each number, up to that of the next number."""
    at = books.select(doc, F.size("ls").alias("size"), F.posexplode("ls").alias("at", "text")).where(F.col("text").rlike(pattern))
    n = F.regexp_extract("text", pattern, 1).cast("int")
    first = at.select(doc, "size", n.alias("n"), "at").where(F.col("n").between(low, high)).groupBy(doc, "n").agg(F.min("at").alias("start"), F.first("size").alias("size"))
    return first.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(doc).orderBy("n")), F.col("size"))).drop("size")


def _groups(books: DataFrame, doc: str, pattern: str) -> DataFrame:
    """(doc, at, low, high) of group headers; numbers too large for a question are none."""
    at = books.select(doc, F.posexplode("ls").alias("at", "text")).where(F.col("text").rlike(pattern))
    number = lambda k: F.regexp_extract("text", pattern, k).try_cast("int")
    return at.select(doc, "at", number(1).alias("low"), number(2).alias("high"))


def _last_of_group(numbers: DataFrame, groups: DataFrame, doc: str, value: str) -> DataFrame:
    """The value of the last group that holds a number."""
    held = numbers.select(doc, "n").join(groups, doc).where("n between low and high")
    return held.groupBy(doc, "n").agg(F.max(F.struct("at", value))[value].alias(value))


def _without_noise(ls: Column) -> Column:
    return F.filter(ls, lambda s: ~F.startswith(F.regexp_replace(s, r"(?U)^\s+", ""), F.lit("*")) & ~stripped(s).rlike(PAGE_NUMBER))


def questions(lines: DataFrame, doc: str, low: int = 18, high: int = LAST_NUMBER) -> DataFrame:
    """(doc, n, instruction, body, choices) of the questions from ``low`` to ``high``.

    A question begins at the first line of its number and ends before the next
    number or a group header.  Members of a group take its instruction, and its
    text if that has ``SHORTEST_SHARED`` characters; of several groups the last
    counts.  Notes and page numbers are left out.  Where the text itself holds
    the choices, there are no others.
    """
    books = _booklets(lines, doc)
    found = _starts(books, doc, QUESTION, low, high)
    after = F.get("ls", F.col("at") + 1)
    groups = _groups(books, doc, GROUP).join(books, doc)
    plain = ~after.rlike(QUESTION) & ~after.rlike(CHOICE)
    asked = F.concat(stripped(F.regexp_extract(F.get("ls", "at"), GROUP, 3)), F.when(plain, F.concat(F.lit(" "), stripped(after))).otherwise(""))
    goes_on = plain & ~after.rlike(GROUP) & (F.length(after) < 50) & (after.contains("오.") | after.contains("?"))
    begin = F.col("at") + 1 + F.coalesce(goes_on, F.lit(False)).cast("int")
    groups = groups.join(found.select(doc, F.col("n").alias("low"), "start"), [doc, "low"], "left")
    text = block(_without_noise(between(F.col("ls"), begin, F.coalesce("start", begin))))
    groups = groups.select(doc, "at", "low", "high", asked.alias("asked"), text.alias("told"))
    shared = _last_of_group(found, groups.where(F.length("told") >= SHORTEST_SHARED), doc, "told")
    joint = _last_of_group(found, groups, doc, "asked")
    cuts = found.select(doc, "n", "start", "end").join(groups.select(doc, "at"), doc).where("at > start and at < end").groupBy(doc, "n").agg(F.min("at").alias("cut"))

    q = found.join(cuts, [doc, "n"], "left").join(joint, [doc, "n"], "left").join(shared, [doc, "n"], "left").join(books, doc)
    q = q.select(doc, "n", "asked", "told", between(F.col("ls"), F.col("start"), F.coalesce("cut", "end")).alias("b")).where("size(b) > 0")
    own, following = stripped(F.regexp_replace(F.get("b", F.lit(0)), QUESTION, "")), stripped(F.get("b", F.lit(1)))
    q = q.withColumn("own", own).withColumn("following", following)
    ends = F.col("following").contains("?") | F.substring("following", -3, 3).contains(".") | F.col("following").contains("오.")
    joins = F.coalesce(F.col("asked").isNull() & (F.col("own") != "") & (F.col("following") != "") & ~F.col("following").rlike(CHOICE) & ~F.col("following").rlike("^[A-Z]") & (F.length("following") < 60) & ends, F.lit(False))
    q = q.withColumn("instruction", F.coalesce("asked", F.when(joins, F.concat_ws(" ", "own", "following")).otherwise(F.col("own"))))
    rest = from_index(F.col("b"), F.when(joins, 2).otherwise(1))
    q = q.withColumn("rest", F.when(F.col("asked").isNotNull() & (F.col("own") != ""), F.concat(F.array("own"), rest)).otherwise(rest))
    q = q.withColumn("split", F.when(~F.col("instruction").rlike(MARKED_IN_TEXT), first_index(F.col("rest"), lambda s: s.rlike(CHOICE))))
    body = F.coalesce("told", block(_without_noise(before_index(F.col("rest"), F.col("split")))))
    choices = F.when(F.col("split").isNotNull(), block(from_index(F.col("rest"), F.col("split")))).otherwise("")
    return q.select(doc, "n", "instruction", body.alias("body"), choices.alias("choices"))


def is_vocabulary(line: Column) -> Column:
    """A word and its meaning: at most 45 characters, Latin first, Hangul inside, no marks of a sentence."""
    return _is_word(stripped(line))


def _is_word(s: Column) -> Column:
    return (F.length(s) <= 45) & s.rlike("^[a-zA-Z~]") & ~s.rlike('[,.!?"]') & has_hangul(s)


def translation_of(lines: Column) -> Column:
    """The translation in an answer (an array of lines, page numbers left out).

    With its label: from there, text on the label's line included, to the next
    label or a group header.  Without: to a label, a group header, or
    vocabulary that is followed by more or by nothing.
    """
    # each line is stripped once
    marked = F.transform(lines, lambda t: F.struct(t.alias("t"), stripped(t).alias("s")))
    ends = lambda x: x["s"].rlike(TRANSLATION_END) | x["s"].rlike(LONE_GROUP)
    texts = lambda xs: F.transform(xs, lambda x: x["t"])

    def labelled(ls: Column, at: Column) -> Column:
        inline = stripped(F.regexp_extract(F.get(ls, at)["s"], TRANSLATION, 1))
        told = let(from_index(ls, at + 1), lambda r: texts(before_index(r, first_index(r, ends))))
        return F.when(inline != "", F.concat(F.array(inline), told)).otherwise(told)

    def plain(ls: Column) -> Column:
        word = lambda x: _is_word(x["s"])
        words = lambda x, i: word(x) & ((i == F.size(ls) - 1) | F.coalesce(word(F.get(ls, i + 1)), F.lit(False)))
        return texts(before_index(ls, first_index(ls, lambda x, i: ends(x) | words(x, i))))

    kept = F.filter(marked, lambda x: ~x["s"].rlike(PAGE_NUMBER))
    return let(kept, lambda ls: let(first_index(ls, lambda x: x["s"].rlike(TRANSLATION)), lambda at: F.when(at.isNotNull(), labelled(ls, at)).otherwise(plain(ls))))


def solution_of(lines: Column) -> Column:
    """The text from the solution's label to the next label; empty without one."""
    kept = F.filter(lines, lambda s: ~stripped(s).rlike(PAGE_NUMBER))
    is_label = lambda s: F.regexp_extract(stripped(s), SECTION, 1)
    told = lambda r: block(before_index(r, first_index(r, lambda s: is_label(s) != "")))
    return let(kept, lambda ls: let(first_index(ls, lambda s: is_label(s) == "풀이"), lambda at: F.when(at.isNotNull(), let(from_index(ls, at + 1), told)).otherwise("")))


def answer_key(books: DataFrame, doc: str) -> DataFrame:
    """(doc, n, answer_number): the first pair of each number before the title of the explanations."""
    key = before_index(F.col("ls"), first_index(F.col("ls"), lambda s: stripped(s) == "해 설"))
    pairs = books.select(doc, F.posexplode(F.flatten(F.transform(key, lambda s: F.regexp_extract_all(s, F.lit(ANSWER_PAIR), 1)))).alias("i", "pair"))
    pairs = pairs.select(doc, "i", F.regexp_extract("pair", "(?U)^([0-9]+)", 1).try_cast("int").alias("n"), F.substring("pair", -1, 1).alias("answer_number")).where(F.col("n").between(1, LAST_NUMBER))
    return pairs.groupBy(doc, "n").agg(F.min(F.struct("i", "answer_number"))["answer_number"].alias("answer_number"))


def answers(lines: DataFrame, doc: str, low: int = 18, high: int = LAST_NUMBER) -> DataFrame:
    """(doc, n, answer_number, korean_translation, solution) of the headings from ``low`` to ``high``.

    A group's translation of ``SHORTEST_SHARED`` characters is that of all its
    members; of several groups the last counts.  What is missing is empty.
    """
    books = _booklets(lines, doc)
    found = _starts(books, doc, ANSWER_HEADING, low, high)
    groups = _groups(books, doc, ANY_GROUP).join(found.select(doc, F.col("n").alias("low"), "start"), [doc, "low"], "left").join(books, doc)
    told = block(translation_of(between(F.col("ls"), F.col("at") + 1, F.coalesce("start", F.size("ls")))))
    groups = groups.select(doc, "at", "low", "high", told.alias("told")).where(F.length("told") >= SHORTEST_SHARED)
    shared = _last_of_group(found, groups, doc, "told")
    a = found.join(shared, [doc, "n"], "left").join(answer_key(books, doc), [doc, "n"], "left").join(books, doc)
    a = a.withColumn("b", between(F.col("ls"), F.col("start") + 1, F.col("end")))
    return a.select(doc, "n", F.coalesce("answer_number", F.lit("")).alias("answer_number"), F.coalesce("told", block(translation_of(F.col("b")))).alias("korean_translation"), solution_of(F.col("b")).alias("solution"))


def merged(asked: DataFrame, answered: DataFrame, doc: str) -> DataFrame:
    """Questions with their answers, where there are any, and whether they are read as they are."""
    return left_override(asked, answered, [doc, "n"], "answered").withColumn("is_easy_type", F.col("n").isin(EASY))
