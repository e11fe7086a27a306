"""Each rule with rows that keep it and rows that break it."""

from textloom.operators import quality


def test_questions(spark):
    q = spark.createDataFrame([(1, ["① a", "② b", "③a "], "Here it is.", "x Here it is. y"), (2, ["① a", "② b"], "New.", "x"), (3, None, None, None)], "n int, choices array<string>, insert_sentence string, passage string")
    assert [(r.n, r.choice, int(r[2])) for r in quality.repeated_choices(q, ["n"]).collect()] == [(1, "a", 2)]
    assert [r.n for r in quality.given_away(q).collect()] == [1]
    assert sorted(r.n for r in quality.odd_excerpts(q).collect()) == [1, 2, 3]
    assert quality.odd_excerpts(spark.createDataFrame([("x" * 400,), ("x" * 600,)], "passage string")).count() == 0


def test_sentences(spark):
    s = spark.createDataFrame([(1, [("p", "blue")], True), (1, [("p", "pink"), ("q", "red")], True), (2, [], None), (3, None, True)], "n int, highlights array<struct<phrase:string,color:string>>, star boolean")
    assert [(r.n, r.extra) for r in quality.extra_colors(s).collect()] == [(1, ["pink"])]
    assert sorted((r.n, r.stars) for r in quality.odd_stars(s, ["n"]).collect()) == [(2, 0), (3, 1)]


def test_summaries(spark):
    s = spark.createDataFrame([(k, " ".join(["w"] * k)) for k in (0, 24, 25, 40, 41)] + [(-1, None)], "n int, summary string")
    assert sorted(r.n for r in quality.odd_summaries(s).collect()) == [-1, 0, 24, 41]


def test_vocabularies(spark):
    w = spark.createDataFrame([(1, "Idea"), (1, "gone"), (2, "idea")], "n int, en string")
    p = spark.createDataFrame([(1, "The idea, again."), (2, None)], "n int, passage string")
    assert sorted((r.n, r.en) for r in quality.foreign_words(w, p, ["n"]).collect()) == [(1, "gone"), (2, "idea")]
    many = spark.createDataFrame([(k // 81,) for k in range(161)], "n int")
    assert [(r.n, r[1]) for r in quality.too_long_vocabularies(many, ["n"]).collect()] == [(0, 81)]


def test_catalogue(spark):
    kinds = quality.catalogue_of(spark)
    assert sorted((r.points, r["count"]) for r in kinds.groupBy("points").count().collect()) == [(2, 7), (3, 8), (4, 2)]
    rows = [(1, "주제_파악", "윗글의 주제로 가장 적절한 것은?", 2), (2, "주제_파악", "윗글의 주제로 가장 적절한 것은? (단, 하나만)", 2), (3, "주제_파악", "다른 말", 3), (4, "없는_유형", "x", 2), (5, None, None, None)]
    q = spark.createDataFrame(rows, "n int, type string, question string, points int")
    assert sorted((r.n, r.problem) for r in quality.off_catalogue(q, ["n"], points="points").collect()) == [(2, "wording"), (3, "points"), (4, "type"), (5, "type")]
    assert sorted((r.n, r.problem) for r in quality.off_catalogue(q, ["n"]).collect()) == [(2, "wording"), (4, "type"), (5, "type")]


def test_processed_passages(spark):
    good = {"빈칸_어휘": "It is _______ here.", "어법_밑줄": "①a ②b ③c ④d ⑤e", "어법_ABC": "(A)[a / b] x (B)[c / d] (C)[e / f]", "순서_배열": "x\n(A) a\n(B) b\n(C) c", "문장_삽입": "( ① ) a ( ② ) b ( ③ ) c\n( ④ ) d ( ⑤ )", "주제_파악": "plain"}
    rows = [(k, t, True) for k, t in good.items()] + [(k, "plain", False) for k in good if k != "주제_파악"] + [("빈칸_문장", None, False)]
    df = spark.createDataFrame(rows, "type string, passage string, right boolean")
    got = quality.unprocessed_passages(df).collect()
    assert len(got) == 6 and not any(r.right for r in got)


def test_inflections_and_capitals(spark):
    words = "develop developed developing develops rely relies relied stop stopped stopping make making big bigger biggest red bed thing this es".split()
    df = spark.createDataFrame([(1, w) for w in words] + [(2, "Develop "), (2, "developed"), (3, "running"), (3, None)], "n int, en string")
    got = {(r.n, r.base, r.inflected) for r in quality.inflected_twins(df, ["n"]).collect()}
    want = {"developed": "develop", "developing": "develop", "develops": "develop", "relies": "rely", "relied": "rely", "stopped": "stop", "stopping": "stop", "making": "make", "bigger": "big", "biggest": "big"}
    assert got == {(1, b, w) for w, b in want.items()} | {(2, "develop", "developed")}
    caps = spark.createDataFrame([("London", True), ("Idea", False), ("idea", None), ("McKay", None), (None, None)], "en string, proper boolean")
    assert sorted(r.en for r in quality.capitalised(caps, proper="proper").collect()) == ["Idea", "McKay"]
    assert quality.capitalised(caps).count() == 3


def test_rubrics(spark):
    whole = {p: "x" for p in quality.RUBRIC} | {"배점": "4점"}
    rows = [(1, whole, [(3, 4), (0, 2)]), (2, whole, [(0, 2), (2, 4)]), (3, whole, [(0, 5)]), (4, {**whole, "유의사항": " "}, []), (5, None, None)]
    got = {r.n: (r.missing, r.overlap, r.beyond) for r in quality.rubric_gaps(spark.createDataFrame(rows, "n int, rubric map<string,string>, steps array<struct<least:int,most:int>>"), ["n"]).collect()}
    assert got == {2: ([], True, False), 3: ([], False, True), 4: (["유의사항"], False, False), 5: (quality.RUBRIC, False, False)}
