"""Spacing repair that needs a morphological analyzer.

The analyzer is a parameter: a function that makes one, called once in each
Python worker.  Where it gives none, texts stay as they are, counts are 0 and
answers false; ``is_installed`` tells which.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.korean import safe_spacing

# Score by which joining must win, syllables that are words of their own, tags of ends of words, and forms of the rules.
JOIN_SCORE = 5.0
OWN_WORDS = set("의가이은는을를과와도만로야까나네며겠랑자")
NOUN, AUXILIARY, STEMS, DERIVING = "NNG", "VX", ("VV", "VA"), ("XSV", "XSA")
CLOSED_TAGS = {"EP", "EF", "EC", "ETN", "ETM", "JKS", "JKC", "JKG", "JKO", "JKB", "JKV", "JKQ", "JX", "JC"}
NOUN_AND_VERB = re.compile(r"(?<![가-힣])([가-힣]{2,4})\s+((?:하|되|시)[가-힣]{1,5})(?=[\s,.!?:;]|$)")
SYLLABLE_AND_REST = re.compile(r"(?<![가-힣])([가-힣])\s+([가-힣]{2,5})(?=[\s,.!?:;]|$)")


class Token(NamedTuple):
    form: str
    tag: str
    start: int


class Analyzer(Protocol):
    """What the rules ask of an analyzer."""

    def tokens(self, text: str) -> list[Token]: ...

    def score(self, text: str) -> float: ...

    def spaced(self, text: str) -> str: ...


Maker = Callable[[], Analyzer | None]


@cache
def installed() -> Analyzer | None:
    """The analyzer package of the worker, if it is there."""
    try:
        import kiwipiepy
    except ImportError:
        return None
    engine = kiwipiepy.Kiwi()

    class Installed:
        def tokens(self, text: str) -> list[Token]:
            return [Token(t.form, str(t.tag), t.start) for t in engine.tokenize(text)]

        def score(self, text: str) -> float:
            return engine.analyze(text, top_n=1)[0][1]

        def spaced(self, text: str) -> str:
            return engine.space(text)

    return Installed()


def is_installed(maker: Maker = installed) -> bool:
    """If there is an analyzer here."""
    return maker() is not None


def verb_of_noun(a: Analyzer, noun: str, rest: str) -> bool:
    """A common noun and what makes a verb or adjective of it."""
    alone, joined = a.tokens(noun), a.tokens(noun + rest)
    return [t.tag for t in alone] == [NOUN] and len(joined) > 1 and joined[0][:2] == (noun, NOUN) and joined[1].tag in DERIVING


def word_of_syllable(a: Analyzer, syllable: str, rest: str) -> bool:
    """A syllable that belongs to the word after it: a stem before its ending, or part of a longer verb or derived noun."""
    alone, joined = a.tokens(syllable), a.tokens(syllable + rest)
    if syllable in OWN_WORDS or len(alone) != 1 or len(joined) < 2:
        return False
    tag, first, second = alone[0].tag, joined[0], joined[1]
    if tag in STEMS:
        return first[:2] == (syllable, tag) and second.tag.startswith("E")
    longer = tag == NOUN and first.form.startswith(syllable) and len(first.form) > len(syllable)
    return longer and (first.tag in STEMS or (first.tag == NOUN and second.tag in DERIVING))


def splits_word(a: Analyzer, left: str, right: str) -> bool:
    """If a blank stands inside a word: joined, there is no auxiliary verb, and the left part is not closed."""
    if not left or not right or any(t.tag == AUXILIARY for t in a.tokens(left + right)):
        return False
    before = a.tokens(left)
    return bool(before) and before[-1].tag not in CLOSED_TAGS


def _blanks(text: str) -> set[int]:
    """How many letters stand before each blank inside a text."""
    seen, out = 0, set()
    for c in text.strip(" "):
        if c == " ":
            out.add(seen)
        seen += c != " "
    return out


def _proposed(a: Analyzer, text: str) -> tuple[set[int], set[int]]:
    """Blanks that the analyzer would take out and put in; none if it changes letters."""
    fixed = a.spaced(text)
    if fixed.replace(" ", "") != text.replace(" ", ""):
        return set(), set()
    return _blanks(text) - _blanks(fixed), _blanks(fixed) - _blanks(text)


def _split_words(a: Analyzer, text: str) -> Iterator[tuple[str, bool]]:
    """Words with whether the blank before each is wrong.  A blank beside another one, or at an end, has no word on one side and is right."""
    out, _ = _proposed(a, text)
    words = text.split(" ")
    letters = 0
    for k, word in enumerate(words):
        yield word, k > 0 and letters in out and splits_word(a, words[k - 1], word)
        letters += len(word)


def repaired(a: Analyzer, text: str) -> str:
    """Without wrong blanks after nouns, after single syllables, and inside words."""
    text = NOUN_AND_VERB.sub(lambda m: m[1] + m[2] if verb_of_noun(a, m[1], m[2]) else m[0], text)
    text = SYLLABLE_AND_REST.sub(lambda m: m[1] + m[2] if word_of_syllable(a, m[1], m[2]) else m[0], text)
    if not text.strip():
        return text
    return "".join(word if wrong or k == 0 else f" {word}" for k, (word, wrong) in enumerate(_split_words(a, text)))


def wrapped_pairs(a: Analyzer, text: str, wrap_score: float | None = None) -> Iterator[dict]:
    """Pairs of Hangul words from left to right with their scores.

    A pair is joined if that scores higher by ``JOIN_SCORE``; with
    ``wrap_score``, pairs around a line feed count too, and by that.  The next
    pair begins after a joined one, else at its right word.
    """
    pair = re.compile(r"([가-힣]+)([ \t]+)([가-힣]+)" if wrap_score is None else r"([가-힣]+)([ \t\n]+)([가-힣]+)")
    at = 0
    while m := pair.search(text, at):
        joined, split = a.score(m[1] + m[3]), a.score(f"{m[1]} {m[3]}")
        least = wrap_score if wrap_score is not None and "\n" in m[2] else JOIN_SCORE
        merged = joined - split >= least
        yield {"at": m.start(2), "end": m.end(2), "left": m[1], "right": m[3], "merged_score": joined, "split_score": split, "diff": joined - split, "merged": merged}
        at = m.end(3) if merged else m.start(3)


def unwrapped(a: Analyzer, text: str, wrap_score: float | None = None) -> str:
    """With the pairs that belong together joined."""
    out, at = [], 0
    for p in wrapped_pairs(a, text, wrap_score):
        if p["merged"]:
            out.append(text[at : p["at"]])
            at = p["end"]
    return "".join(out) + text[at:]


def wrong_blanks(a: Analyzer, text: str) -> int:
    """How many blanks that the analyzer would take out stand inside words."""
    return sum(wrong for _, wrong in _split_words(a, text))


def is_style(a: Analyzer, text: str) -> bool:
    """If the analyzer would put in blanks, on balance, and all of them before auxiliary verbs."""
    out, into = _proposed(a, text)
    starts = {t.start for t in a.tokens(text.replace(" ", "")) if t.tag == AUXILIARY}
    return len(into) > len(out) and into <= starts


def _column(c: Column, kind: str, maker: Maker, f: Callable[[Analyzer, str], object], otherwise: Callable[[str], object]) -> Column:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        a = maker()
        return pd.Series([None if not isinstance(t, str) else f(a, t) if a and t else otherwise(t) for t in texts], dtype=object)

    return run(c)


def spacing(c: Column, maker: Maker = installed) -> Column:
    """``korean.safe_spacing`` and then the rules that need the analyzer.  Null: null."""
    return _column(safe_spacing(c), "string", maker, repaired, lambda t: t)


def joined_wraps(c: Column, maker: Maker = installed, wrap_score: float | None = None) -> Column:
    """Words that a line end or a wrong blank parted, joined.  Null: null."""
    return _column(c, "string", maker, lambda a, t: unwrapped(a, t, wrap_score), lambda t: t)


def wrap_audit(c: Column, maker: Maker = installed, wrap_score: float | None = None) -> Column:
    """All pairs that ``joined_wraps`` considers, as an array to explode."""
    kind = "array<struct<left:string,right:string,merged_score:double,split_score:double,diff:double,merged:boolean>>"
    return _column(c, kind, maker, lambda a, t: [{k: v for k, v in p.items() if k not in ("at", "end")} for p in wrapped_pairs(a, t, wrap_score)], lambda _: [])


def wrong_blank_count(c: Column, maker: Maker = installed) -> Column:
    """How many blanks of a text are wrong.  Null: null."""
    return _column(c, "int", maker, wrong_blanks, lambda _: 0)


def missing_blanks_are_style(c: Column, maker: Maker = installed) -> Column:
    """If all blanks that a text lacks are a matter of style.  Null: null."""
    return _column(c, "boolean", maker, is_style, lambda _: False)
