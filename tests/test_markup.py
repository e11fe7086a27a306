from pyspark.sql import functions as F

from textloom.operators import markup as m


def test_spans():
    assert m.spans("the cat sat", [("cat", "red"), ("the cat sat", "blue")]) == [{"start": 0, "end": 4, "color": "blue"}, {"start": 4, "end": 7, "color": "red"}, {"start": 7, "end": 11, "color": "blue"}]
    assert m.spans("a cat, cat", [("cat", "x"), ("cat", "y")]) == [{"start": 2, "end": 5, "color": "x"}, {"start": 7, "end": 10, "color": "y"}]
    assert m.spans("concat", [("cat", "x")]) == [{"start": 3, "end": 6, "color": "x"}]
    # one mark more before the quotation mark at the phrase's end, and nothing else
    assert m.spans("her flight had been “delayed.”", [("had been “delayed”", "x")]) == [{"start": 11, "end": 30, "color": "x"}]
    assert m.spans("it’s so", [("it's", "x")]) == m.spans("“so..” it", [("“so”", "x")]) == m.spans("“so. x”", [("“so” x", "x")]) == []
    # a Hangul particle does not hide a word, a Latin letter does
    assert m.spans("stopword는 word를 word.", [("word", "x"), ("word", "y")]) == [{"start": 10, "end": 14, "color": "x"}, {"start": 16, "end": 20, "color": "y"}]
    assert m.candidates("a a a a", "a a") == [(0, 3), (4, 7)]
    assert m.spans("nothing", [("absent", "x"), ("", "y")]) == []


def test_highlights_in_a_frame(spark):
    df = spark.createDataFrame([("a cat", [("cat", "red")]), (None, [("x", "y")]), ("b", None)], "t string, p array<struct<phrase:string,color:string>>")
    assert [r["runs"] for r in m.highlighted(df, "t", "p").select("runs").collect()] == [[(2, 5, "red")], [], []]


def test_underlines(spark):
    rows = [("① big dogs ② small", ["① big", "②  small "]), ("①big ①big", ["① big"]), ("no marker", ["① big"]), ("① huge", ["① big"]), ("① b", ["① a", "① b", "plain"])]
    df = spark.createDataFrame(rows, "t string, c array<string>")
    got = [r[0] for r in df.select(m.underlined(F.col("t"), m.circled_map(F.col("c")))).collect()]
    assert got == ["① <u>big</u> dogs ② <u>small</u>", "①<u>big</u> ①big", "no marker", "① huge", "① <u>b</u>"]


def test_answers(spark):
    rows = [(1, 1, ["a", "b"], "x"), (2, 0, ["a", "b"], "x"), (3, 3, ["a", "b"], "x"), (4, None, ["a"], "x"), (5, 9, ["a"], "essay"), (6, 9, [], "x"), (9, 5, [], "x"), (10, 9, None, "x"), (7, 7, list("abcdefgh"), None), (8, 8, list("abcdefgh"), "x")]
    df = spark.createDataFrame(rows, "id int, answer int, choices array<string>, type string")
    assert sorted(r["id"] for r in m.bad_answers(df).collect()) == [2, 3, 4, 6, 8]
    assert df.where("id = 7").select(m.answer_char(F.col("answer"), F.col("choices"))).first()[0] == "⑦"
