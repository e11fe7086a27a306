"""What an item says once its answer is put in: edits of its lines, then one projection.

Plain functions on the lines of one item, run in Arrow batches by
``items.extracted``; they need the places of matches, which SQL does not give.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

# Choice markers, section labels, corrections by item code (answer, wrong, right), and patterns of the books' notation.
FIVE = "①②③④⑤"
SECTION_TITLES = {"Structure in Focus", "Solution Guide", "{Structure in Focus}", "{Solution Guide}"}
NO_TEXT = SECTION_TITLES | {"#", "Page", "EBS", "Light", ""}
LONE_MARKS = {".", ",", ";", ":", "—", "-"}
CORRECTIONS = {"26662-0036": (3, "perceive", "to perceive"), "26662-0041": (5, "rationality", "irrationality")}
LETTER_CORRECTIONS = {"26662-0078": (5, "excludes", "requires")}
_WORD = r"([A-Za-z](?:(?![가-힣])[\w'\-])*)"  # without Hangul, which would take the first syllable of a particle
CORRECTION_NOTES = [
    re.compile(rf"\b{_WORD}\s*(?:을|를|은|는)\s+{_WORD}\s*(?:와|과)?\s*같은\s*낱말로\s*바꾸어야"),
    re.compile(rf"\b{_WORD}\s*(?:을|를|은|는)\s+(?:(?:접속사|관계사|관계대명사|관사|대명사|부사|명사|동사|형용사|전치사)\s+)?{_WORD}\s*(?:으로|로)\s+고쳐야"),
]
_DOTS, _DASH = r"\s*(?:……|⋯⋯|\.{6})\s*", r"\s*[–—-]\s*"
TRIPLE = re.compile(rf"([{FIVE}])\s+(.+?){_DOTS}(.+?){_DOTS}(.+?)\s*$")
PAIR = re.compile(rf"([{FIVE}])\s+(.+?){_DOTS}(.+?)\s*$")
ORDER = re.compile(rf"([{FIVE}])\s*" + _DASH.join([r"\(\s*([A-D])\s*\)"] * 3))
LETTERS_ONLY = re.compile(r"[(\[]*[A-C][)\]]*(?:[\s,]*[(\[]*[A-C][)\]]*){2}$")
NAME_BEFORE_SALUTATION = re.compile(r"[A-Z][a-z]+ (?:[A-Z]\.\s*)?[A-Z][a-z]+\s+(?=To Whom|Dear )")


class Line(NamedTuple):
    text: str
    breaks: bool = False


class Item(NamedTuple):
    """What a handler may use.  ``shared`` is the block of the item's set, ``order`` the set's order of lettered blocks."""

    lines: list[Line]
    code: str = ""
    instruction: str = ""
    shared: list[Line] = []
    order: str | None = None


class Extracted(NamedTuple):
    """``base`` is the passage whose paragraphs the translation follows, ``then`` what is done with it afterwards."""

    passage: str
    translation: str
    topic: str
    base: str
    then: str = ""


def is_english(s: str) -> bool:
    s = s.strip()
    return len(s) >= 4 and sum(c < "\x80" for c in s) / len(s) > 0.7


def tidy(s: str, closing: str = r".,;:!?)\]") -> str:
    """Single blanks, none before closing marks or after opening ones."""
    return re.sub(r"([(\[])\s+", r"\1", re.sub(rf"\s+([{closing}])", r"\1", re.sub(r"\s+", " ", s))).strip()


def paragraphs(lines: list[Line]) -> str:
    out: list[list[str]] = []
    for text, breaks in lines:
        if breaks or not out:
            out.append([])
        out[-1].append(text)
    return "\n\n".join(" ".join(p) for p in out)


def english_blocks(lines: list[Line]) -> list[tuple[int, list[Line]]]:
    """(start, lines) of runs of English lines.  Choices and titles end a run, footnotes do not, a lone mark joins the line before."""
    runs: list[tuple[int, list[Line]]] = []
    open_run = False
    for k, (text, breaks) in enumerate(lines):
        s = text.strip()
        marked = any(c in FIVE for c in s)
        if s in NO_TEXT or LETTERS_ONLY.match(s) or (marked and (len(s) < 40 or s[0] in FIVE)):
            open_run = False
            continue
        if marked:
            s = re.sub(f"[{FIVE}]", "", s).strip()
        if s.startswith("*") and ":" in s:
            continue
        if is_english(s):
            if not open_run:
                runs.append((k, []))
            runs[-1][1].append(Line(s, breaks))
            open_run = True
        elif open_run and s in LONE_MARKS:
            last = runs[-1][1].pop()
            runs[-1][1].append(Line(last.text + s, last.breaks))
        else:
            open_run = False
    return runs


def after_label(lines: list[Line], label: str) -> int | None:
    """Where a section begins: after the first line that is its label or closes with it."""
    return next((k + 1 for k, x in enumerate(lines) if x.text.strip() == label or f"{label}}}" in x.text), None)


def topic_of(lines: list[Line]) -> str:
    """At most five lines, up to a blank one or the translation, and none after 50 characters; long English is left out."""
    start, parts = after_label(lines, "소재"), []
    for line in lines[start : start + 5] if start else []:
        s = line.text.strip()
        if not s or "해석" in s:
            break
        if not is_english(s) or len(s) < 30:
            parts.append(s)
        if sum(map(len, parts)) > 50:
            break
    return " ".join(parts)


def plain(lines: list[Line]) -> Extracted:
    """The longest English block of two lines or more (else of one), the translation up to it or the next title, the topic."""
    runs = english_blocks(lines)
    runs = [r for r in runs if len(r[1]) >= 2] or runs
    at, best = max(runs, key=lambda r: sum(len(x.text) for x in r[1]), default=(-1, []))
    passage = paragraphs(best)
    if name := NAME_BEFORE_SALUTATION.match(passage):
        passage = passage[name.end() :]
    start, told = after_label(lines, "해석"), []
    if start is not None:
        for line in lines[start : at if at > start else None]:
            if line.text.strip() in SECTION_TITLES:
                break
            if s := tidy(line.text):
                told.append(Line(s, line.breaks))
    return Extracted(passage, paragraphs(told), topic_of(lines), passage)


def answer_number(lines: list[Line]) -> int | None:
    """One to five, alone on one of the three lines after the first answer label."""
    at = next((k for k, x in enumerate(lines) if "정답모범답안" in x.text), None)
    if at is None:
        return None
    numbers = (int(x.text) for x in lines[at + 1 : at + 4] if re.fullmatch(r"\s*\d+\s*", x.text))
    return next((n for n in numbers if 1 <= n <= 5), None)


def choices(lines: list[Line], pattern: re.Pattern, last: bool = False) -> dict[int, tuple[str, ...]]:
    """Choice number to its parts; of equal numbers the first (or last) counts."""
    found: dict[int, tuple[str, ...]] = {}
    for line in lines:
        m = pattern.search(line.text) if last else pattern.match(line.text.strip())
        n = FIVE.index(m[1]) + 1 if m else 0
        if n and (last or n not in found):
            found[n] = tuple(g.strip() for g in m.groups()[1:])
    return found


def order_of(lines: list[Line]) -> str | None:
    """Letters of the right order."""
    order = choices(lines, ORDER, last=True).get(answer_number(lines) or 0)
    return "".join(order) if order else None


def explanation(lines: list[Line]) -> str:
    """The text of the explanation, up to the next bracket or item header; a repeated title only goes."""
    out, inside = [], False
    for line in lines:
        s = line.text.strip()
        if "{Solution Guide}" in line.text:
            inside = True
        elif inside and s:
            if s[0] in "{[" or re.search(r"#\s*강\s+\d+", s):
                break
            out.append(s)
    return " ".join(out)


def correction(note: str, marker: str) -> tuple[str, str] | None:
    """(wrong, right) of an explanation: the nearest within 400 characters after the marker, else the first."""
    found = [m for p in CORRECTION_NOTES for m in p.finditer(note)]
    at = note.find(marker)
    near = [m for m in found if at >= 0 and 0 <= m.start() - at < 400]
    best = min(near, key=lambda m: m.start()) if near else next(iter(found), None)
    return (best[1], best[2]) if best else None


def corrected(lines: list[Line], marker: str, gap: str, wrong: str, right: str) -> list[Line]:
    """The right word for the marker and the wrong one after it, on its line or at the start of the next."""
    text = "\n".join(x.text for x in lines)
    blank = r"[^\S\n]"
    word = re.escape(wrong) + r"\b"
    hit = re.search(rf"{re.escape(marker)}{blank}{gap}{word}|{blank}*{re.escape(marker)}{blank}*(\n{blank}*){word}", text)
    if hit:
        text = text[: hit.start()] + (hit[1] or "") + right + text[hit.end() :]
    return [Line(t, x.breaks) for t, x in zip(text.split("\n"), lines, strict=True)]


def edited(lines: list[Line], edit: Callable[[str], str]) -> list[Line]:
    """Lines after an edit of all of them as one text; paragraph breaks go."""
    return [Line(t) for t in edit("\n".join(x.text for x in lines)).split("\n")]


def option_table(lines: list[Line]) -> dict[int, tuple[str, ...]]:
    """Five triples within seven lines of their head; else none.  Of equal numbers the last counts."""
    at = next((k for k, x in enumerate(lines) if re.fullmatch(r"\(A\)\s+\(B\)\s+\(C\)", x.text.strip())), None)
    rows = [TRIPLE.match(x.text.strip()) for x in lines[at + 1 : at + 8]] if at is not None else []
    found = {FIVE.index(m[1]) + 1: tuple(g.strip() for g in m.groups()[1:]) for m in rows if m}
    return found if len(found) == 5 else {}


def replace(item: Item) -> Extracted:
    """Puts right a word after a circled marker, or the right one of two for each lettered slot."""
    lines, table, n = item.lines, option_table(item.lines), answer_number(item.lines)
    if any(re.match(r"①\s*\(a\)", x.text.strip()) for x in lines[:10]):
        return plain(lines)
    if table and re.search(r"\(\s*A\s*\)[\s\S]{0,40}/", "\n".join(x.text for x in lines)):
        if n is None:
            return plain(lines)

        def fill(text: str) -> str:
            for k, slot in enumerate("ABC"):
                options = sorted({row[k] for row in table.values()})  # a fixed order of trials
                either = "|".join(rf"{re.escape(a)}\s*/\s*{re.escape(b)}" for a in options for b in options if a != b)
                if either:
                    text = re.sub(rf"\(\s*{slot}\s*\)\s*(?:{either})(?=[\s.,;:!?])", lambda _: table[n][k], text, count=1)
            return text

        return plain(edited(lines, fill))
    fix = CORRECTIONS.get(item.code)
    if fix is None and n is not None and (pair := correction(explanation(lines), FIVE[n - 1])):
        fix = (n, *pair)
    return plain(corrected(lines, FIVE[fix[0] - 1], "*", *fix[1:]) if fix else lines)


def fill(item: Item) -> Extracted:
    """Puts the right choice into the first blank."""
    out = plain(item.lines)
    choice = choices(item.lines, re.compile(rf"([{FIVE}])\s*(.+?)\s*$")).get(answer_number(item.lines) or 0)
    return out._replace(passage=re.sub("_{3,}", lambda _: choice[0], out.passage, count=1)) if choice else out


def remove(item: Item) -> Extracted:
    """Takes out the sentence of the answer's marker, and from the translation what stands in parentheses as a sentence."""
    n = answer_number(item.lines)
    if n is None:
        return plain(item.lines)
    # the sentence ends before the next marker or a line of notes
    sentence = rf"{FIVE[n - 1]}[^{FIVE}]*?(?=[{FIVE}]|\n *[*\[{{]|\Z)"
    out = plain(edited(item.lines, lambda t: re.sub(sentence, "", t, count=1)))
    return out._replace(translation=tidy(re.sub(r"\(\s*[^()]*?[.?!]\s*\)", " ", out.translation)))


def blocks_in_order(text: str, order: str) -> str | None:
    """The lead and the lettered blocks in order; null if one is missing."""
    lead, *parts = re.split(r"\s*\(\s*([A-C])\s*\)\s+", text)
    blocks: dict[str, str] = {}
    for letter, block in zip(parts[::2], parts[1::2], strict=True):
        blocks.setdefault(letter, block.strip())
    return " ".join(filter(None, [lead.strip(), *(blocks[x] for x in order)])) if len(blocks) == 3 and set(order) <= set(blocks) else None


def reorder(item: Item) -> Extracted:
    """Puts lettered blocks in order."""
    out, order = plain(item.lines), order_of(item.lines)
    if order is None:
        return out
    return out._replace(passage=blocks_in_order(out.passage, order) or out.passage, then="labels")


def lettered(lines: list[Line], label: str, stops: Callable[[str], bool]) -> dict[str, str]:
    """Texts of blocks that begin with a label ``(A)``; the first of a letter counts."""
    blocks: dict[str, str] = {}
    current: tuple[str, list[str]] | None = None
    for s in filter(None, (x.text.strip() for x in lines)):
        m = re.match(label, s)
        if not m and (stops(s) if current else False):
            break
        if m:
            if current:
                blocks.setdefault(current[0], " ".join(current[1]).strip())
            current = (m[1], [s[m.end() :]])
        elif current:
            current[1].append(s)
    if current:
        blocks.setdefault(current[0], " ".join(current[1]).strip())
    return blocks


def without_letters(text: str) -> str:
    """Without markers (a) to (e)."""
    return re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"\s+", " ", re.sub(r"\(\s*[a-e]\s*\)", " ", text))).strip()


def set_of_three(item: Item) -> Extracted | None:
    """The first lettered block of the set and the others in its order; null if one is missing."""
    english = lettered(item.shared, r"\(([A-D])\)$", lambda s: s[0] in "[{")
    layout = "A" + (item.order or "")
    if not item.order or not set(layout) <= set(english):
        return None
    start = after_label(item.shared, "해석")
    told = item.shared[start:] if start else []
    end = next((k for k, x in enumerate(told) if x.text.strip() in SECTION_TITLES or (x.text.strip().startswith("#") and "문항코드" in x.text)), len(told))
    korean = lettered(told[:end], r"\(([A-D])\)\s+", lambda s: False)
    passage = "\n\n".join(filter(None, (without_letters(english[x]) for x in layout)))
    return Extracted(passage, "\n\n".join(filter(None, (korean.get(x, "") for x in layout))), topic_of(item.shared), "")


def set_of_two(item: Item) -> Extracted:
    """The passage of a set of two items; the item on word use has its word put right."""
    lines = item.shared
    if "낱말" in item.instruction and "쓰임" in item.instruction:
        fix, n = LETTER_CORRECTIONS.get(item.code), answer_number(item.lines)
        if fix is None and n is not None and (pair := correction(explanation(item.lines), f"({'abcde'[n - 1]})")):
            fix = (n, *pair)
        if fix:
            lines = corrected(lines, f"({'abcde'[fix[0] - 1]})", "+", *fix[1:])
    out = plain(lines)
    told = re.sub(r"\S+\s*\(\s*→\s*([^)]+?)\s*\)", r"\1", out.translation)
    passage = without_letters(out.passage)
    return Extracted(passage, tidy(re.sub("[‘’]", "", told)), out.topic, passage)


def insert(item: Item) -> Extracted:
    """Puts the given sentence, which comes first, at the answer's place."""
    out, n = plain(item.lines), answer_number(item.lines)
    at = next((k for k, x in enumerate(item.lines) if x.text.strip().startswith("[") and "문제" in x.text), None)
    texts: list[str] = []
    for s in filter(None, (x.text.strip() for x in item.lines[at + 1 :])) if at is not None else []:
        if (s.startswith("*") and ":" in s) or (texts and (s[0] == "[" or not is_english(s))):
            break
        if is_english(s):
            texts.append(s)
    end = next((k + 1 for k in range(len(texts)) if re.search(r"""[.?!]['")\]]*\s*$""", texts[k])), len(texts))
    given, body = " ".join(texts[:end]), " ".join(texts[end:])
    if n is None or not body or not re.search(rf"\(\s*[{FIVE}]\s*\)", body):
        return out
    body = re.sub(rf"\(\s*([{FIVE}])\s*\)", lambda m: given if m[1] == FIVE[n - 1] else "", body)
    return out._replace(passage=re.sub(r"\s{2,}", " ", body).strip())


def summary(item: Item) -> Extracted:
    """Adds the summary after the arrow with both blanks filled."""
    lines = item.lines
    end = next((k for k in range(1, len(lines)) if re.match(r"#\s*강\s+\d+", lines[k].text.strip())), len(lines))
    out = plain(lines[:end])
    pair = choices(lines, PAIR).get(answer_number(lines) or 0)
    at = next((k + 1 for k, x in enumerate(lines) if x.text.strip() == "↓"), len(lines))
    told: list[str] = []
    for s in filter(None, (x.text.strip() for x in lines[at:])):
        if s[0] in FIVE + "[{#*" or not is_english(s) or re.fullmatch(r"\(\s*A\s*\)\s*\(\s*B\s*\)", s):
            break
        told.append(s)
    if not pair or not told:
        return out
    text = " ".join(told)
    for slot, word in zip("AB", pair, strict=True):
        text = re.sub(rf"\(\s*{slot}\s*\)", lambda _, w=word: w, text, count=1)
    text = re.sub(r"\ba\(n\)\s+(\w)", lambda m: ("an " if m[1].lower() in "aeiou" else "a ") + m[1], text)
    text = re.sub(r"\s{2,}", " ", re.sub(r"\s+([.,;:!?])", r"\1", text)).strip()
    return out._replace(passage=f"{out.passage.rstrip()}\n\n{text}", then="arrow")


#: Types that are not just read.
HANDLERS: dict[str, Callable[[Item], Extracted]] = {"REPLACE": replace, "FILL": fill, "REMOVE": remove, "REORDER": reorder, "INSERT": insert, "SUMMARY": summary}


def extract(kind: str, item: Item, set_size: int) -> Extracted:
    """By the set if the item has one, else by its type."""
    whole = set_of_three(item) if item.shared and set_size >= 3 else None
    if whole:
        return whole
    if item.shared and set_size == 2:
        return set_of_two(item)
    if item.shared and set_size >= 3 and kind == "REORDER":
        return plain(item.lines)
    return HANDLERS.get(kind, lambda i: plain(i.lines))(item)
