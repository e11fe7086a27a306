"""Lines of pages against word-by-word versions."""

import random

from pyspark.sql import functions as F

from textloom.operators import lines

SCHEMA = "doc string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string, page_width double"


def page_of(seed, columns):
    """Words in columns with jitter, a head over all columns, and a few odd ones."""
    r = random.Random(seed)
    rows, n = [("d", seed, 0, 50.0, 100.0, 560.0, 112.0, "머리", 612.0)], 1
    width = 490 / columns
    for c in range(columns):
        for k in range(r.randint(5, 15)):
            x, y = 60 + c * width, 200 + 15 * k + r.choice([0, 0, 30])
            while x < 60 + (c + 1) * width - 60:
                text = r.choice(["단어", "를", "12", "word", ".", "했습니다"])
                w = 4 if text == "." else 8 * len(text)
                y0 = float(y + r.choice([0, 1, 3]))
                rows.append(("d", seed, n, float(x), y0, float(x + w), y0 + 10, text, 612.0))
                n, x = n + 1, x + w + r.choice([0.5, 1.0, 4.0, -3.0])
    return rows


def valleys(words, width, size=4):
    """Gutters by density, bin by bin."""
    plain = [w for w in words if w[5] - w[3] <= width / 2 and w[4] >= 160] or words
    n = [0] * (int(width // size) + 2)
    for w in plain:
        for i in range(max(0, int(w[3] // size)), min(len(n) - 1, int(w[5] // size)) + 1):
            n[i] += 1
    found, i, end = [], 60 // size, len(n) - 60 // size
    while i < end:
        j = i
        while j < end and n[j] < max(n) * 0.3:
            j += 1
        if (j - i) * size >= 8:
            low, runs = min(n[i:j]), []
            for k in range(i, j):
                if n[k] == low:
                    runs[-1:] = [(runs[-1][0], k)] if runs and runs[-1][1] == k - 1 else [*runs[-1:], (k, k)]
            a, b = max(runs, key=lambda x: (x[1] - x[0], -x[0]))
            found.append((a + b) / 2 * size)
        i = max(j, i + 1)
    edges = [60, *found, width - 60]
    return [x for k, x in enumerate(found) if x - edges[k] >= 90 and edges[k + 2] - x >= 90]


def test_density_gutters(spark):
    pages = {s: page_of(s, 1 + s % 3) for s in range(12)}
    got = lines.density_gutters(spark.createDataFrame(sum(pages.values(), []), SCHEMA), ["doc", "page"]).collect()
    assert {r.page: r.gutters for r in got} == {s: valleys(p, 612.0) for s, p in pages.items()}
    assert any(r.gutters for r in got)


def test_line_groups(spark):
    rows = [("d", 0, k, 0.0, y, 1.0, y + 1, "x", 100.0) for k, y in enumerate([0.0, 3.0, 6.0, 9.0, 20.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    by_no = lambda d: [r.line for r in d.orderBy("word_no").collect()]
    assert by_no(lines.anchored_lines(df, ["doc"])) == [0, 0, 1, 1, 2]
    assert by_no(lines.chained_lines(df, ["doc"])) == [0, 0, 0, 0, 1]


def test_line_text(spark):
    rows = [
        (1, [(0, 16, "있습니"), (17, 25, "다"), (26, 30, ".")], "있습니다 .", "있습니다 ."),
        (2, [(0, 8, "3"), (9.0, 17, "년"), (18.01, 26, "에")], "3년 에", "3년 에"),
        (3, [(0, 60, "방문했습니다사진"), (41, 43, "."), (59, 62, ",")], "방문했습니다. 사진,", "방문했습니다사진 . ,"),
        (4, [(0, 10, "word"), (10, 20, "단어")], "word 단어", "word 단어"),
        (5, [], "", ""),
    ]
    df = spark.createDataFrame([(i, [(float(a), float(b), t) for a, b, t in ws]) for i, ws, *_ in rows], "i int, ws array<struct<x0:double,x1:double,text:string>>")
    got = df.select("i", lines.line_text(lines.with_marks_inside(F.col("ws"))).alias("a"), lines.line_text(F.col("ws"), False).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, _, a, b in rows]


def test_page_lines(spark):
    def word(page, n, x, y, text):
        return ("d", page, n, float(x), float(y), float(x + 40), float(y + 10), text, 600.0)

    two = [word(2, k, x, y, f"w{x}-{y}") for k, (x, y) in enumerate((x, y) for x in (60, 100, 140, 360, 400, 440) for y in (200, 212, 240))]
    df = spark.createDataFrame([word(1, 0, 80, 200, "one"), word(1, 1, 130, 203, "line"), word(1, 2, 80, 230, "next"), *two], SCHEMA)
    for dense in (False, True):
        got = [(r.line_no, r.page, r.column, r.text, r.is_break) for r in lines.page_lines(df, "doc", "page", dense).orderBy("line_no").collect()]
        row = lambda xs, y: " ".join(f"w{x}-{y}" for x in xs)
        left, right = (60, 100, 140), (360, 400, 440)
        assert got == [
            (0, 1, 0, "one line", False),
            (1, 1, 0, "next", True),
            (2, 2, 0, row(left, 200), True),
            (3, 2, 0, row(left, 212), False),
            (4, 2, 0, row(left, 240), True),
            (5, 2, 1, row(right, 200), True),
            (6, 2, 1, row(right, 212), False),
            (7, 2, 1, row(right, 240), True),
        ]
    assert lines.page_lines(df.where("false"), "doc", "page").count() == 0
