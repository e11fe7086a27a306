"""Spacing rules, sentences and paragraphs on small fixtures."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import korean


def values(spark, rows, make, schema="a string, b string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", make.alias("v")).orderBy("i").collect()]


def test_safe_spacing(spark):
    rows = [
        ("Berlin 에서 왔다.", "Berlin에서 왔다."),
        ("1924 년", "1924년"),
        ("그의 말씀) 은 옳다", "그의 말씀)은 옳다"),
        ("편해졌 다.", "편해졌다."),
        ("그것은 다 좋다", "그것은 다 좋다"),
        ("Berlin 이스라엘", "Berlin 이스라엘"),
        ("", ""),
        (None, None),
    ]
    assert values(spark, rows, korean.safe_spacing(F.col("a"))) == [w for _, w in rows]


def test_loose_spacing_reaches_a_fixed_point(spark):
    rows = [
        ("정보 를 찾고 있습니 다.", "정보를 찾고 있습니다."),
        ("그 녀는 갔다", "그녀는 갔다"),
        ("하지 만, 사람 들 과 함께", "하지만, 사람 들 과 함께"),
        ("학교 에서 는 배운다", "학교에서는 배운다"),
        ("no Hangul 는", "no Hangul 는"),
        ("plain  text", "plain  text"),
        ("", ""),
        (None, None),
    ]
    assert values(spark, rows, korean.loose_spacing(F.col("a"))) == [w for _, w in rows]


def test_reassembled(spark):
    rows = [(["나는", "London", "에", "(", "영국", ")", "갔다", "."], "나는 London 에 (영국) 갔다."), ([], ""), (None, "")]
    assert values(spark, rows, korean.reassembled(F.col("a")), "a array<string>, b string") == [w for _, w in rows]


@pytest.mark.parametrize("word,score", [("갔다.", 10), ("선생님께", 8), ("이고,", 1), ("그래,", 5), ("집에서", 5), ("나는", 3), ("책을", 2), ("책", 0)])
def test_break_score(spark, word, score):
    assert values(spark, [(word, "")], korean.break_score(F.col("a"))) == [score]


def _aligned(passage: str, translation: str) -> str:
    """The same, word by word."""
    source = [p for p in passage.split("\n\n") if p.strip()]
    words = translation.replace("\n\n", " ").split()
    if len(source) <= 1 or len([p for p in translation.split("\n\n") if p.strip()]) == len(source) or len(words) < len(source):
        return translation
    scores = {"갔다.": 10, "나는": 3, "책을": 2, "그래,": 5}
    out, at, seen, total = [], 0, 0, sum(len(p.split()) for p in source)
    for p in source[:-1]:
        seen += len(p.split())
        target = seen / total * len(words)
        places = range(max(0, int(target) - 3), min(len(words) - 1, int(target) + 3) + 1)
        end = max(places, key=lambda k: (scores.get(words[k], 0) - abs(k - target) / 2, -k)) + 1
        end = max(at + 1, min(end, len(words) - 1))
        out.append(" ".join(words[at:end]))
        at = end
    return "\n\n".join([*out, " ".join(words[at:])])


def test_aligned_paragraphs(spark):
    ko = "나는 책을 보고 집에 갔다. 그래, 너도 책을 보고 나는 잔다 지금".split()
    rows = [
        ("a b c d\n\ne f g", " ".join(ko)),
        ("a\n\nb c\n\nd e f g h", " ".join(ko * 3)),
        ("a b\n\nc\n\nd", "하나 둘"),
        ("a b", "하나 둘\n\n셋"),
        ("a\n\nb", "하나 둘\n\n셋"),
        ("a\n\nb\n\nc", "하나 둘\n\n셋 넷"),
        ("a\n\n\n\nb", "하나 둘 셋"),
        ("", ""),
    ]
    assert values(spark, rows, korean.aligned_paragraphs(F.col("a"), F.col("b"))) == [_aligned(*r) for r in rows]
