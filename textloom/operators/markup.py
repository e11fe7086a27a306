"""Markup of study sheets: nested highlights, underlined choices, answer checks.

Match positions are not exposed by SQL regular expressions, so spans are found
in Arrow-batched functions; everything else is column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Choice markers, in order.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
#: Markers that an answer can have.
ANSWERS = "①②③④⑤⑥⑦"
#: Closing quotation marks, and marks that may stand before the one a phrase ends with.
CLOSING, BEFORE_CLOSING = "\"'’”", ".,;:!?"
_LATIN = "[A-Za-z0-9]"


def candidates(text: str, phrase: str) -> list[tuple[int, int]]:
    """Where a phrase stands, one place after the other: with no Latin letter or
    digit beside a letter or digit it begins or ends with; else its first
    occurrence; else, where it ends with a closing quotation mark, with one
    mark more before that."""
    if not phrase:
        return []
    left = f"(?<!{_LATIN})" if phrase[0].isalnum() else ""
    right = f"(?!{_LATIN})" if phrase[-1].isalnum() else ""
    places = lambda pattern: [m.span() for m in re.finditer(pattern, text)]
    found = places(left + re.escape(phrase) + right)
    if not found and phrase in text:
        return places(re.escape(phrase))[:1]
    if not found and phrase[-1] in CLOSING:
        return places(f"{re.escape(phrase[:-1])}[{BEFORE_CLOSING}]?{re.escape(phrase[-1])}")
    return found


def located(text: str, phrases: list[tuple[str, str]]) -> tuple[list[tuple[int, int, str]], list[str]]:
    """(start, end, colour) of phrases, and those without a place.  They claim places in order, each the first that no other has claimed exactly."""
    claimed: list[tuple[int, int, str]] = []
    missed = []
    for phrase, color in phrases:
        free = [c for c in candidates(text, phrase) if c not in [(s, e) for s, e, _ in claimed]]
        if free:
            claimed.append((*free[0], color))
        else:
            missed.append(phrase)
    return claimed, missed


def spans(text: str, phrases: list[tuple[str, str]]) -> list[dict]:
    """Runs of equal colour: in each place the shortest span wins, the later one on ties."""
    claimed, _ = located(text, phrases)
    best: list[str | None] = [None] * len(text)
    for s, e, color in sorted(claimed, key=lambda x: x[0] - x[1]):  # long spans first; sort is stable, so later ones overwrite
        best[s:e] = [color] * (e - s)
    out: list[dict] = []
    for k, color in enumerate(best):
        if out and out[-1]["color"] == color:
            out[-1]["end"] = k + 1
        else:
            out.append({"start": k, "end": k + 1, "color": color})
    return [x for x in out if x["color"] is not None]


def highlighted(df: DataFrame, text_col: str, phrases_col: str, name: str = "runs") -> DataFrame:
    """Adds the coloured runs of a text; phrases are array<struct<phrase,color>>, nulls have none."""

    @F.pandas_udf("array<struct<start:int,end:int,color:string>>")
    def run(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([spans(t, [(p["phrase"], p["color"]) for p in ps]) if isinstance(t, str) and ps is not None else [] for t, ps in zip(texts, phrases, strict=True)])

    return df.withColumn(name, run(text_col, phrases_col))


def missed(text: Column, phrases: Column) -> Column:
    """The phrases, of array<struct<phrase,color>>, that get no place in a text; of null ones none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([located(t, [(p["phrase"], p["color"]) for p in ps])[1] if isinstance(t, str) and ps is not None else [] for t, ps in zip(texts, phrases, strict=True)])

    return run(text, phrases)


def circled_map(choices: Column) -> Column:
    """Choices '① words' as a map from marker to words, the last of a marker winning; others are left out."""
    marked = F.filter(choices, lambda c: c.rlike(f"^\\s*[{CIRCLED}]\\s*\\S"))
    pairs = F.transform(marked, lambda c: F.struct(F.regexp_extract(c, f"([{CIRCLED}])", 1).alias("k"), F.regexp_extract(c, f"[{CIRCLED}]\\s*(.*\\S)\\s*$", 1).alias("v")))
    # a later pair of the same marker takes the place of earlier ones
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.lit(100)), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(last)


def underlined(text: Column, choices: Column) -> Column:
    """Underlines, after the first place of each marker, its words if they follow there (any white space between)."""
    # a fold, as expressions nested for each marker would grow with their power

    def step(out: Column, pair: Column) -> Column:
        words = pair["value"]
        at = F.call_function("locate", pair["key"], out)
        rest = F.substring(out, at + 1, F.length(out))
        blank = F.length(F.regexp_extract(rest, r"^(\s*)", 1))
        fits = (at > 0) & (words != "") & F.startswith(F.substring(rest, blank + 1, F.length(rest)), words)
        new = F.concat(F.substring(out, F.lit(1), at + blank), F.lit("<u>"), words, F.lit("</u>"), F.substring(rest, blank + F.length(words) + 1, F.length(rest)))
        return F.when(fits, new).otherwise(out)

    return F.aggregate(F.map_entries(choices), text, step)


def answer_char(answer: Column, choices: Column) -> Column:
    """The circled digit of a 1-based answer; null if it is none of the choices (five if there are none, seven at most)."""
    n = answer.cast("int")
    size = F.coalesce(F.size(choices), F.lit(0))
    most = F.least(F.when(size > 0, size).otherwise(5), F.lit(len(ANSWERS)))
    return F.when((n >= 1) & (n <= most), F.substring(F.lit(ANSWERS), n, F.lit(1)))


def bad_answers(questions: DataFrame, answer: str = "answer", choices: str = "choices", kind: str = "type", essay: str = "essay") -> DataFrame:
    """Objective questions whose answer is none of their choices, of five where the list is empty.  Essays and questions without a list pass."""
    objective = (F.coalesce(F.col(kind), F.lit("")) != essay) & F.col(choices).isNotNull()
    return questions.where(objective & answer_char(F.col(answer), F.col(choices)).isNull())
