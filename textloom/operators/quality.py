"""Rules that sheets should keep: each function gives the rows that break one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import stripped
from textloom.operators.sheets import COLORS

# Bounds that the rules give.
EXCERPT, STARS, SUMMARY_WORDS, MOST_WORDS = (400, 600), (2, 4), (25, 40), 80


def _outside(c: Column, bounds: tuple[int, int]) -> Column:
    return ~F.coalesce(c.between(*bounds), F.lit(False))


def repeated_choices(questions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, choice, times): choices that a question has more than once, markers and white space aside."""
    one = questions.select(*keys, F.explode("choices").alias("c")).withColumn("choice", stripped(F.translate("c", "①②③④⑤", "")))
    return one.groupBy(*keys, "choice").agg(F.count("*").alias("times")).where("times > 1")


def odd_excerpts(passages: DataFrame, text: str = "passage") -> DataFrame:
    """Passages with fewer or more characters than an excerpt should have; null has none."""
    return passages.where(_outside(F.coalesce(F.length(text), F.lit(0)), EXCERPT))


def given_away(questions: DataFrame, sentence: str = "insert_sentence", text: str = "passage") -> DataFrame:
    """Questions whose sentence to insert is in the text already."""
    return questions.where((stripped(F.col(sentence)) != "") & F.col(text).contains(stripped(F.col(sentence))))


def extra_colors(sentences: DataFrame, highlights: str = "highlights") -> DataFrame:
    """Adds ``extra`` to sentences with highlights in colours that are not reserved."""
    used = F.transform(highlights, lambda h: h["color"])
    return sentences.withColumn("extra", F.array_sort(F.array_except(used, F.array(*[F.lit(c) for c in COLORS])))).where("size(extra) > 0")


def odd_stars(sentences: DataFrame, keys: list[str], star: str = "star") -> DataFrame:
    """(keys, stars): items with too few or too many starred sentences."""
    return sentences.groupBy(*keys).agg(F.count_if(F.coalesce(star, F.lit(False))).alias("stars")).where(_outside(F.col("stars"), STARS))


def odd_summaries(summaries: DataFrame, text: str = "summary") -> DataFrame:
    """Summaries with too few or too many words; null has none."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return summaries.where(_outside(words, SUMMARY_WORDS))


def too_long_vocabularies(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words): lists of more words than a test has room for."""
    return words.groupBy(*keys).agg(F.count("*").alias("words")).where(F.col("words") > MOST_WORDS)


def foreign_words(words: DataFrame, passages: DataFrame, keys: list[str], en: str = "en", text: str = "passage") -> DataFrame:
    """Words that their passage does not have, whatever the case.  Words and passages meet on keys and word."""
    seen = passages.select(*keys, F.explode(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}'-]+")).alias("__w")).distinct()
    return words.withColumn("__w", F.lower(stripped(F.col(en)))).join(seen, [*keys, "__w"], "left_anti").drop("__w")


# Question types with their standard wording and points.
CATALOGUE = [
    ("주제_파악", "윗글의 주제로 가장 적절한 것은?", 2),
    ("요지_파악", "윗글의 요지로 가장 적절한 것은?", 2),
    ("제목_파악", "윗글의 제목으로 가장 적절한 것은?", 2),
    ("내용_일치", "윗글의 내용과 일치하는 것은?", 2),
    ("내용_불일치", "윗글의 내용과 일치하지 않는 것은?", 2),
    ("빈칸_연결어", "윗글의 빈칸 (A), (B)에 들어갈 말로 알맞게 짝지은 것은?", 3),
    ("빈칸_어휘", "윗글의 빈칸에 들어갈 말로 가장 적절한 것은?", 3),
    ("빈칸_문장", "윗글의 빈칸에 들어갈 말로 가장 적절한 것은?", 3),
    ("어법_ABC", "윗글의 밑줄 친 (A), (B), (C)에서 어법에 맞는 표현으로 가장 적절한 것은?", 3),
    ("어법_밑줄", "윗글의 밑줄 친 ①~⑤ 중, 어법상 틀린 것은?", 3),
    ("어휘_밑줄", "윗글의 밑줄 친 단어의 쓰임이 적절하지 않은 것은?", 3),
    ("지칭_추론", "윗글의 밑줄 친 표현의 의미로 가장 적절한 것은?", 2),
    ("순서_배열", "주어진 글 다음에 이어질 글의 순서로 가장 적절한 것은?", 3),
    ("문장_삽입", "주어진 문장이 들어가기에 가장 적절한 곳은?", 3),
    ("단어_변형", "윗글의 바로 위에 이 글과 연결되는 문장을 주어진 단어를 사용하여 완성하시오.", 4),
    ("조건_영작", "다음 우리말과 같은 뜻이 되도록 주어진 조건에 맞게 영작하시오.", 4),
    ("답할수없는것", "윗글의 내용으로 답할 수 없는 질문은?", 2),
]
# What the passage of a type must show.
SHOWN = [
    ("빈칸_연결어", r"_{5,}"),
    ("빈칸_어휘", r"_{5,}"),
    ("빈칸_문장", r"_{5,}"),
    ("어법_밑줄", r"(?s)①.*②.*③.*④.*⑤"),
    ("어법_ABC", r"(?s)\(A\)\s*\[[^\]/]+/[^\]]+\].*\(B\)\s*\[[^\]/]+/[^\]]+\].*\(C\)\s*\[[^\]/]+/[^\]]+\]"),
    ("순서_배열", r"(?s)\(A\).*\(B\).*\(C\)"),
    ("문장_삽입", r"(?s)①.*②.*③.*④.*⑤"),
]
# What the marking of an essay says.
RUBRIC = ["예시답안", "인정답안", "배점", "채점영역", "채점기준", "부분점수", "유의사항", "오답기준"]


def catalogue_of(spark: SparkSession) -> DataFrame:
    """(type, wording, points): the question types there are."""
    return spark.createDataFrame(CATALOGUE, "type string, wording string, points int")


def off_catalogue(questions: DataFrame, keys: list[str], kind: str = "type", question: str = "question", points: str | None = None) -> DataFrame:
    """(keys, type, problem): questions of no known type, or with other points than their type has, or with more than its standard wording.

    Additions after the wording are reported; another wording is not.
    """
    names = F.array(*[F.lit(t) for t, _, _ in CATALOGUE])
    place = F.array_position(names, F.col(kind)).cast("int")
    at = F.when(place > 0, place)
    wording, due = F.get(F.array(*[F.lit(w) for _, w, _ in CATALOGUE]), at - 1), F.get(F.array(*[F.lit(p) for _, _, p in CATALOGUE]), at - 1)
    more = F.startswith(stripped(F.col(question)), wording) & (stripped(F.col(question)) != wording)
    problem = F.when(at.isNull(), "type").when(F.col(points) != due, "points") if points else F.when(at.isNull(), "type")
    return questions.select(*keys, F.col(kind).alias("type"), problem.when(more, "wording").alias("problem")).where("problem is not null")


def unprocessed_passages(questions: DataFrame, kind: str = "type", text: str = "passage") -> DataFrame:
    """Questions whose passage lacks the blanks, markers, choices or blocks of their type; null has none."""
    lacks = F.lit(False)
    for t, pattern in SHOWN:
        lacks = lacks | ((F.col(kind) == t) & ~F.coalesce(F.col(text), F.lit("")).rlike(pattern))
    return questions.where(lacks)


def base_forms(word: Column) -> Column:
    """The words whose regular inflection a word can be, itself left out (an array)."""
    w, vowel = F.lower(stripped(word)), "aeiou"
    out = []
    for ending, forms in (
        ("(?:ies)$", ["y"]), ("(?:ied)$", ["y"]), ("(?:ier)$", ["y"]), ("(?:iest)$", ["y"]), ("s$", [""]), ("es$", [""]), ("ed$", ["", "e"]), ("ing$", ["", "e"]), ("er$", ["", "e"]), ("est$", ["", "e"]),
    ):
        out += [F.when(w.rlike(f"..{ending}"), F.regexp_replace(w, ending, f)) for f in forms]
    out += [F.when(w.rlike(f"[{vowel}]([^{vowel}])\\1{e}$"), F.regexp_replace(w, f"(.)\\1{e}$", "$1")) for e in ("ed", "ing", "er", "est")]
    return F.array_distinct(F.filter(F.array_compact(F.array(*out)), lambda f: f != w))


def inflected_twins(words: DataFrame, keys: list[str], en: str = "en") -> DataFrame:
    """(keys, base, inflected): words of a list of which one is a regular inflection of another.  Both meet on keys and word."""
    w = words.select(*keys, F.lower(stripped(F.col(en))).alias("base")).distinct()
    forms = w.select(*keys, F.col("base").alias("inflected"), F.explode(base_forms(F.col("base"))).alias("base"))
    return forms.join(w, [*keys, "base"]).select(*keys, "base", "inflected")


def capitalised(words: DataFrame, en: str = "en", proper: str | None = None) -> DataFrame:
    """Words with a capital letter that are not marked as proper nouns."""
    marked = F.coalesce(F.col(proper), F.lit(False)) if proper else F.lit(False)
    return words.where(F.col(en).rlike(r"\p{Lu}") & ~marked)


def rubric_gaps(rubrics: DataFrame, keys: list[str], parts: str = "rubric", steps: str = "steps") -> DataFrame:
    """(keys, missing, overlap, beyond): essays whose marking lacks a part, has two steps for one score, or steps over the points.

    ``parts``: map<string,string>; ``steps``: array<struct<least,most>> of the
    scores each step gives.  Points are the part 배점.
    """
    given = F.coalesce(parts, F.create_map().cast("map<string,string>"))
    missing = F.filter(F.array(*[F.lit(p) for p in RUBRIC]), lambda p: F.coalesce(stripped(F.try_element_at(given, p)), F.lit("")) == "")
    in_order = F.array_sort(F.coalesce(steps, F.filter(steps, lambda _: F.lit(False))))
    overlap = F.coalesce(F.exists(F.transform(in_order, lambda s, i: s["least"] <= F.get(in_order, i - 1)["most"]), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    most = F.regexp_extract(F.coalesce(F.try_element_at(given, F.lit("배점")), F.lit("")), r"(\d+)", 1).try_cast("int")
    beyond = F.coalesce(F.exists(in_order, lambda s: s["most"] > most), F.lit(False))
    return rubrics.select(*keys, missing.alias("missing"), overlap.alias("overlap"), beyond.alias("beyond")).where("size(missing) > 0 or overlap or beyond")
