"""Rules that ask an analyzer, with one that knows a few words."""

from pyspark.sql import functions as F

from textloom.functions import morphology
from textloom.plans.fixtures import ANALYZED, SmallAnalyzer
from textloom.plans.fixtures import small_analyzer as small


def values(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_rules():
    a = SmallAnalyzer()
    for text, fixed, wrong, style in ANALYZED:
        assert (morphology.repaired(a, text), morphology.wrong_blanks(a, text), morphology.is_style(a, text)) == (fixed, wrong, style), text


def test_wraps():
    a = SmallAnalyzer()
    # 10 - 5.0001 = 4.9999 is below the score, but not below that of a line end
    assert morphology.unwrapped(a, "안타깝 게도 x") == "안타깝 게도 x"
    assert morphology.unwrapped(a, "나는 찾\n을 것이다", 4.0) == "나는 찾을 것이다"
    assert [(p["left"], p["right"], p["merged"]) for p in morphology.wrapped_pairs(a, "가 찾 을 것")] == [("가", "찾", False), ("찾", "을", False), ("을", "것", False)]


def test_columns(spark):
    assert values(spark, ["Berlin 에서 확보 하기", "", None], lambda c: morphology.spacing(c, small)) == ["Berlin에서 확보하기", "", None]
    assert values(spark, ["능 력을 길러 있어야 한다", "", None], lambda c: morphology.wrong_blank_count(c, small)) == [1, 0, None]
    assert values(spark, ["해주다", "새집", None], lambda c: morphology.missing_blanks_are_style(c, small)) == [True, False, None]
    assert values(spark, ["찾\n을", None], lambda c: morphology.joined_wraps(c, small, 4.0)) == ["찾을", None]
    audit = values(spark, ["찾 을", ""], lambda c: morphology.wrap_audit(c, small))
    assert [(r.left, r.right, r.merged) for r in audit[0]] == [("찾", "을", False)] and audit[1] == []


def test_without_analyzer(spark):
    none = lambda: None
    assert not morphology.is_installed(none)
    assert values(spark, ["확보 하기", None], lambda c: morphology.spacing(c, none)) == ["확보 하기", None]
    assert values(spark, ["확보 하기"], lambda c: morphology.wrong_blank_count(c, none)) == [0]
