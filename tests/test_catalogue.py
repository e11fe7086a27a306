import hashlib
import re

import pytest
from compare import differences

from textloom.functions.korean import BREAKS
from textloom.plans import books, catalogue, registry  # noqa: F401 (they register their queries)

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert differences(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], FOLDER) == ""


def _score(word):
    return next((n for n, ending in BREAKS if re.search(f"(?:{ending})$", word)), 0)


def _aligned(source, words):
    """Paragraphs of words after the shares of the source's paragraphs, one end after the other."""
    total, seen, at, out = sum(len(p.split()) for p in source), 0, 0, []
    for p in source[:-1]:
        seen += len(p.split())
        target = seen / total * len(words)
        places = range(max(0, int(target) - 3), min(len(words) - 1, int(target) + 3) + 1)
        end = max(at + 1, min(max(places, key=lambda k: (_score(words[k]) - abs(k - target) / 2, -k)) + 1, len(words) - 1))
        out.append(" ".join(words[at:end]))
        at = end
    return [p for p in [*out, " ".join(words[at:])] if p]


def test_paragraph_alignment(spark):
    got = {r.doc_id: (r.paragraphs, r.digest) for r in registry.QUERIES["paragraph_alignment"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    parted = 0
    for r in docs:
        source = [p for p in (r.text or "").split("\n") if p.strip()]
        words = (r.text or "").split()
        if len(source) > 1 and len(words) >= len(source):
            want = _aligned(source, words)
            assert got[r.doc_id] == (len(want), hashlib.md5("\n\n".join(want).encode()).hexdigest()), r.doc_id
            parted += 1
    assert len(got) == len(docs) and parted > 50


def test_highlight_runs(spark):
    """Letter by letter: each phrase colours its first free place between words; the shortest one over a letter wins."""
    got = {(r.conv_id, r.turn, k): r.color for r in registry.QUERIES["highlight_runs"](spark, FOLDER).collect() for k in range(r.start, r.end)}
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        spans = []
        for phrase, color in (("the", "red"), ("of the", "blue"), ("and", "green")):
            places = [m.start() for m in re.finditer(rf"(?<![^\W_]){phrase}(?![^\W_])", r.text)] or [k for k in [r.text.find(phrase)] if k >= 0]
            spans += [(len(phrase), k, color) for k in places[:1]]
        for n, k, color in sorted(spans, reverse=True):
            want |= {(r.conv_id, r.turn, j): color for j in range(k, k + n)}
    assert got == want and want
