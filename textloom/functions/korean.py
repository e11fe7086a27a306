"""Korean text: character tests, repair of wrong blanks, places to part paragraphs.

All of it is column expressions.  Patterns count white space and digits as
Unicode does, and ``$`` stands only at the end or before a last line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let

# Particles, units, endings and marks of the spacing rules.
PARTICLES = "의 에 에서 에게 에게서 이 가 을 를 은 는 과 와 로 으로 도 만 부터 까지 처럼 마저 조차 라고 라는 이라 이라고 보다 께 께서 에도".split()
UNITS = "년 월 일 시 분 초 개 명 마리 번 차 회 장 권 위 살 세 인 건 편 쪽 급 등 호 종 대 도".split()
TERMINALS = "다 던 네 지 요 야 까".split()
LOOSE_PARTICLES = "을 를 는 의 에서 에게 으로 까지 부터 처럼 마다 조차 마저 보다 에 로 도".split()
PUNCTUATION = [".", ",", ";", ":", "!", "?", "'", '"', "…", ")", "(", "[", "]", "{", "}", "-", "—", "·"]
# Word endings after which a paragraph may end, with their scores; the first that fits counts.
BREAKS = [
    (10, r"[.?!]"),
    (8, "님께|께|에게"),
    (1, "(?:이고|하고|되고|하며|되며|인데|으며|면서|라서|해서),?"),
    (5, ","),
    (5, "에서|으로|로서|지만|는데"),
    (3, "는|은|가|이"),
    (2, "를|을"),
]

_ALL, _HANGUL = "(?Ud)", "[가-힣]"


def has_hangul(c: Column) -> Column:
    """At least one Hangul syllable."""
    return c.rlike(_HANGUL)


def is_numeric(c: Column) -> Column:
    """Digits, with commas after the first."""
    return c.rlike("(?d)^[0-9][0-9,]*$")


def is_punctuation(c: Column) -> Column:
    """One mark, white space around it aside."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "").isin(PUNCTUATION)


def _closed(left: str, words: list[str], follows: str, gap: str = r"\s+") -> str:
    return f"{_ALL}({left}){gap}({'|'.join(words)})(?={follows}|$)"


# What stands before and after the blanks of the rules.
_SAFE = [
    _closed("[A-Za-z0-9]", PARTICLES, r"""[\s,.!?:;"'’”)\]]"""),
    _closed(r"\d", UNITS, r"[\s,.!?:;]"),
    _closed(r"""[)\]}”’"']""", PARTICLES, r"""[\s,.!?:;"'’”)\]]"""),
    _closed(f"(?<!{_HANGUL}){_HANGUL}{{1,4}}", TERMINALS, r"""[.?!,;:)\]"'’”]"""),
]

_LOOSE = [
    _closed(f"(?<!{_HANGUL})그", "녀 것 곳 들".split(), f"[가-힣 .,!?]", "[ \t]+"),
    _closed(f"{_HANGUL}{{2,}}", LOOSE_PARTICLES, r"""[\s.,!?;:)\]"'’”」』]""", "[ \t]+"),
    _closed(f"{_HANGUL}*지", ["만"], r"[\s.,!?]", "[ \t]+"),
    _closed(f"{_HANGUL}{{2,}}", ["과", "와"], rf"[.,!?;:”」』)\]]|[ \t]+{_HANGUL}{{2}}|\s*$", "[ \t]+"),
    _closed(f"{_HANGUL}*습니", ["다", "까"], r"[.,!?\s)”』\]]", "[ \t]+"),
]


def _rewritten(c: Column, rules: list[str]) -> Column:
    for rule in rules:
        c = F.regexp_replace(c, rule, "$1$2")
    return c


def safe_spacing(c: Column) -> Column:
    """Takes out blanks before particles (after Latin, digits, closing marks), units and final endings.  One pass."""
    return _rewritten(c, _SAFE)


def loose_spacing(c: Column) -> Column:
    """Joins particles and endings to their words until nothing changes.

    Each pass that changes a text takes out a blank, so the number of blanks
    bounds the passes; a text that no longer changes is only compared.  Texts
    without Hangul are returned as they are.
    """
    passes = F.sequence(F.lit(0), F.length(F.regexp_replace(c, "[^ \t]", "")))
    start = F.struct(c.alias("text"), F.lit(None).cast("string").alias("last"))
    fixed = F.aggregate(passes, start, lambda s, _: F.when(s["text"].eqNullSafe(s["last"]), s).otherwise(F.struct(_rewritten(s["text"], _LOOSE).alias("text"), s["text"].alias("last"))), lambda s: s["text"])
    return F.when(has_hangul(c), fixed).otherwise(c)


def reassembled(parts: Column) -> Column:
    """Fragments as one sentence: blanks between them, none before closing and after opening marks.  None: empty."""
    joined = F.regexp_replace(F.array_join(parts, " "), r"(?U)\s+", " ")
    tidy = F.regexp_replace(F.regexp_replace(joined, r" ([.,;:!?)\]…])", "$1"), r"([(\[]) ", "$1")
    return F.coalesce(F.trim(tidy), F.lit(""))


def break_score(word: Column) -> Column:
    """How naturally a paragraph ends after a word, 0 to 10."""
    score = F
    for points, ending in BREAKS:
        score = score.when(word.rlike(f"(?d)(?:{ending})$"), points)
    return score.otherwise(0)


def aligned_paragraphs(passage: Column, translation: Column) -> Column:
    """The translation parted into as many paragraphs as the passage.

    Paragraphs are parted by blank lines.  As it is if the passage has at most
    one, if both have as many, or if the translation has fewer words than the
    passage paragraphs.  Else each end lies within three words of the passage's
    share of words, where break_score less half the distance is greatest, the
    first such place on ties.
    """
    filled = lambda a: F.filter(a, lambda p: p.rlike(r"(?U)\S"))
    paragraphs = lambda c: filled(F.split(c, "\n\n"))
    words_of = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    inputs = F.struct(
        F.transform(paragraphs(passage), lambda p: F.size(words_of(p))).alias("counts"),
        words_of(F.replace(translation, F.lit("\n\n"), F.lit(" "))).alias("words"),
        F.size(paragraphs(translation)).alias("parts"),
    )

    def aligned(v: Column) -> Column:
        counts, words, n = v["counts"], v["words"], F.size(v["words"])
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)

        def best(target: Column) -> Column:
            places = F.sequence(F.greatest(F.lit(0), F.floor(target) - 3).cast("int"), F.least(n - 1, F.floor(target) + 3).cast("int"))
            scored = F.transform(places, lambda p: F.struct((break_score(F.get(words, p)) - F.abs(p - target) * 0.5).alias("score"), (-p).alias("p")))
            return -F.array_max(scored)["p"] + 1

        # ends never go back, and at least one word is left for the last paragraph
        start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def cut(s: Column, count: Column) -> Column:
            seen = s["seen"] + count
            end = F.greatest(s["at"] + 1, F.least(best(seen / total * n), n - 1)).cast("int")
            return let(end, lambda e: F.struct(seen.alias("seen"), e.alias("at"), F.array_append(s["out"], F.array_join(F.slice(words, s["at"] + 1, e - s["at"]), " ")).alias("out")))

        rest = lambda s: F.array_append(s["out"], F.array_join(F.slice(words, s["at"] + 1, n), " "))
        parted = F.aggregate(F.slice(counts, 1, F.size(counts) - 1), start, cut, lambda s: F.array_join(filled(rest(s)), "\n\n"))
        same = (F.size(counts) <= 1) | (v["parts"] == F.size(counts)) | (n < F.size(counts))
        return F.when(same, translation).otherwise(parted)

    return let(inputs, aligned)
