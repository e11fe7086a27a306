import random

from pyspark.sql import functions as F

from textloom.operators.columns import column_of, gutters


def by_pixels(words, width, min_column=120, min_gap=10):
    full = {x for a, b in words for x in range(max(0, int(a)), min(int(width), int(b)) + 1)}
    blank = [x for x in range(int(width) + 1) if x not in full]
    strips = []
    for x in blank:
        if strips and strips[-1][1] == x:
            strips[-1][1] = x + 1
        else:
            strips.append([x, x + 1])
    if len(strips) < 2 or not full:
        return []
    inner = [(a + b) / 2 for a, b in strips if min(full) < a and b <= max(full) and b - a >= min_gap]
    edges = [min(full), *inner, max(full) + 1]
    return [m for k, m in enumerate(inner) if m - edges[k] >= min_column and edges[k + 2] - m >= min_column]


def test_against_pixels(spark):
    rng = random.Random(2)
    pages, rows = {}, []
    for p in range(60):
        width = rng.choice([300.5, 600.0, 900.9])
        bands = rng.choice([[(0, width)], [(20, width / 2 - 8), (width / 2 + 8, width - 20)], [(30, width / 3 - 6), (width / 3 + 6, 2 * width / 3 - 4), (2 * width / 3 + 5, width + 9)]])
        pages[p] = (width, [(x := rng.uniform(*rng.choice(bands)), x + rng.uniform(5, 40)) for _ in range(rng.choice([1, 30, 200]))])
        rows += [(p, a, b, width) for a, b in pages[p][1]]
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double, page_width double")
    got = {r["page"]: r["gutters"] for r in gutters(df, ["page"], 60, 5).collect()}
    assert got == {p: by_pixels(w, width, 60, 5) for p, (width, w) in pages.items()}
    assert any(got.values())


def test_column_of(spark):
    df = spark.createDataFrame([([10.0, 20.0], 8.0, 12.0), ([10.0, 20.0], 9.0, 13.0), ([], 1.0, 2.0), ([10.0, 20.0], 30.0, 31.0)], "g array<double>, x0 double, x1 double")
    assert [r[0] for r in df.select(column_of(F.col("g"), F.col("x0"), F.col("x1"))).collect()] == [0, 1, 0, 2]
