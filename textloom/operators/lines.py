"""Lines of a page from its placed words.

Words have x0, y0, x1, y1, text and page_width, and word_no for ties.  Arrays
below hold the words of one column or one line of a page, never more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.korean import has_hangul, is_numeric, is_punctuation
from textloom.functions.text import let
from textloom.operators.columns import column_of, gutters
from textloom.operators.segments import anchors, chained_groups

#: The widest gap inside a word, the widest mark that can stand inside one, the share of a line's height that parts paragraphs.
TIGHT_GAP, MARK_WIDTH, BREAK_SHARE = 1.0, 10.0, 0.8
#: The margin without gutters, and where the band of page heads ends.
MARGIN, HEAD_BAND = 60, 160


def density_gutters(words: DataFrame, keys: list[str], bin_size: int = 4, valley: float = 0.3, min_gutter: int = 8, min_column: int = 90) -> DataFrame:
    """(keys, gutters): middles of the emptiest part of each valley in the density of words across a page.

    Words over half a page wide and those of the head band do not count,
    unless there are no others.  A valley is a run of bins, margins aside, with
    less than ``valley`` of the page's greatest count.  Its emptiest part is
    the longest run of its lowest count, the first on ties.  Both columns
    beside a gutter, up to the next one or the margin, must be wide enough.
    """
    last = F.floor(F.col("page_width") / bin_size) + 1
    counts = F.col("x1") - F.col("x0") <= 0.5 * F.col("page_width")
    w = words.select(
        *keys,
        "page_width",
        (counts & (F.col("y0") >= HEAD_BAND)).alias("plain"),
        F.greatest(F.lit(0), F.floor(F.col("x0") / bin_size)).alias("a"),
        F.least(last, F.floor(F.col("x1") / bin_size)).alias("b"),
    ).where("b >= a")
    bins = w.select(*keys, "page_width", "plain", F.explode(F.sequence("a", "b")).alias("bin")).groupBy(*keys, "page_width", "bin").agg(F.count_if("plain").alias("plain"), F.count("*").alias("every"))
    page = bins.groupBy(*keys, "page_width").agg(F.max("plain").alias("p"), F.max("every").alias("e"), F.map_from_entries(F.collect_list(F.struct("bin", F.struct("plain", "every")))).alias("m"))
    most = F.when(F.col("p") > 0, F.col("p")).otherwise(F.col("e"))
    at = lambda i: F.coalesce(F.when(F.col("p") > 0, F.try_element_at("m", i)["plain"]).otherwise(F.try_element_at("m", i)["every"]), F.lit(0))
    first, after = MARGIN // bin_size, last + 1 - MARGIN // bin_size
    # a bin that is no valley ends the last one
    cells = F.concat(F.transform(F.filter(F.sequence(F.lit(first).cast("long"), F.greatest(F.lit(first), after - 1)), lambda i: i < after), lambda i: F.struct(i.alias("i"), at(i).alias("n"))), F.array(F.struct(after.alias("i"), F.lit(None).cast("long").alias("n"))))
    fresh = F.struct(F.lit(0).alias("bins"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("run_n"), F.lit(0).cast("long").alias("core"), F.lit(0).cast("long").alias("core_n"))
    start = F.struct(fresh.alias("v"), F.array().cast("array<double>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        v, i, n = s["v"], c["i"], c["n"]
        lower, same = (v["bins"] == 0) | (n < v["low"]), n == v["low"]
        goes_on = same & (v["run"] + v["run_n"] == i)
        run = F.when(lower | (same & ~goes_on), i).otherwise(v["run"])
        run_n = F.when(lower | (same & ~goes_on), 1).when(goes_on, v["run_n"] + 1).otherwise(v["run_n"])
        longer = lower | (run_n > v["core_n"])
        inside = F.struct((v["bins"] + 1).alias("bins"), F.when(lower, n).otherwise(v["low"]).alias("low"), run.alias("run"), run_n.cast("long").alias("run_n"), F.when(longer, run).otherwise(v["core"]).alias("core"), F.when(longer, run_n).otherwise(v["core_n"]).cast("long").alias("core_n"))
        middle = (2 * v["core"] + v["core_n"] - 1) / 2 * bin_size
        closed = F.when((v["bins"] > 0) & (v["bins"] * bin_size >= min_gutter), F.array_append(s["found"], middle)).otherwise(s["found"])
        low = F.coalesce(n < most * valley, F.lit(False))
        return F.when(low, F.struct(inside.alias("v"), s["found"].alias("found"))).otherwise(F.struct(fresh.alias("v"), closed.alias("found")))

    page = page.select(*keys, "page_width", F.aggregate(cells, start, step, lambda s: s["found"]).alias("m"))
    edges = F.concat(F.array(F.lit(float(MARGIN))), "m", F.array((F.col("page_width") - MARGIN).cast("double")))
    page = page.withColumn("e", edges)
    kept = F.filter("m", lambda x, i: (x - F.get("e", i) >= min_column) & (F.get("e", i + 2) - x >= min_column))
    return page.select(*keys, F.transform(kept, lambda x: F.bround(x, 1)).alias("gutters"))


def anchored_lines(words: DataFrame, keys: list[str], tolerance: float = 4) -> DataFrame:
    """Adds ``line``, from 0: a word joins a line if its y0 is within ``tolerance`` of that line's first word, from above."""
    group = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("y0").cast("double"))).alias("__y"), F.collect_list(F.struct(*[c for c in words.columns if c not in keys])).alias("__w"))
    return group.select(*keys, anchors(F.col("__y"), tolerance).alias("__a"), F.explode("__w").alias("__w")).select(*keys, "__w.*", (F.size(F.filter("__a", lambda a: a <= F.col("__w.y0"))) - 1).cast("long").alias("line"))


def chained_lines(words: DataFrame, keys: list[str], tolerance: float = 4) -> DataFrame:
    """Adds ``line``, from 0: a word joins a line if its y0 is within ``tolerance`` of the word before it."""
    return chained_groups(words, keys, ["y0", "x0", "word_no"], F.col("y0"), tolerance, "line")


def with_marks_inside(words: Column) -> Column:
    """Words of a line (structs of x0, x1, text, by x0) with narrow marks put where they stand inside Hangul words.

    A mark that starts strictly inside a Hangul word of two letters or more
    goes after the letter it starts in, and a blank after it unless the word
    ends there.  Marks inside no such word stay.
    """
    is_mark = lambda w: is_punctuation(w["text"]) & (w["x1"] - w["x0"] < MARK_WIDTH)
    holds = lambda w, m: ~is_mark(w) & has_hangul(w["text"]) & (F.length(w["text"]) >= 2) & (w["x0"] < m["x0"]) & (m["x0"] < w["x1"])

    def spliced(w: Column, marks: Column) -> Column:
        n = F.length(w["text"])
        place = lambda m: F.greatest(F.lit(1), F.least(((m["x0"] - w["x0"]) / ((w["x1"] - w["x0"]) / n)).cast("int") + 1, n))
        here = lambda k: F.array_join(F.transform(F.filter(marks, lambda m: place(m) == k), lambda m: m["text"]), "")
        letters = F.transform(F.sequence(F.lit(1), n), lambda k: let(here(k), lambda m: F.concat(F.substring(w["text"], k, F.lit(1)), m, F.when((m != "") & (k < n), " ").otherwise(""))))
        return F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), F.array_join(letters, "").alias("text"))

    def rebuilt(ws: Column) -> Column:
        kept = F.filter(ws, lambda m: ~(is_mark(m) & F.exists(ws, lambda w: holds(w, m))))
        return F.transform(kept, lambda w: let(F.filter(ws, lambda m: is_mark(m) & holds(w, m)), lambda ms: F.when(F.size(ms) > 0, spliced(w, ms)).otherwise(w)))

    return let(words, rebuilt)


def line_text(words: Column, marks_apart: bool = True) -> Column:
    """Words of a line (structs of x0, x1, text, by x0) joined by blanks.

    No blank stands before a Hangul word that follows Hangul or digits at
    ``TIGHT_GAP`` or less; with ``marks_apart``, marks count as neither.
    """
    start = F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("double").alias("x1"))

    def step(s: Column, w: Column) -> Column:
        tight = (w["x0"] - s["x1"] <= TIGHT_GAP) & has_hangul(w["text"]) & (has_hangul(s["token"]) | is_numeric(s["token"]))
        if marks_apart:
            tight = tight & ~is_punctuation(s["token"]) & ~is_punctuation(w["text"])
        before = F.when(s["token"].isNull(), s["before"]).otherwise(F.concat(s["before"], s["token"], F.lit(" ")))
        tight = F.coalesce(tight, F.lit(False))
        return F.struct(F.when(tight, s["before"]).otherwise(before).alias("before"), F.when(tight, F.concat(s["token"], w["text"])).otherwise(w["text"]).alias("token"), w["x1"].cast("double").alias("x1"))

    return F.aggregate(words, start, step, lambda s: F.concat(s["before"], F.coalesce(s["token"], F.lit(""))))


def page_lines(words: DataFrame, doc: str, page: str, by_density: bool = False) -> DataFrame:
    """(doc, line_no, page, column, text, is_break): lines in reading order, from 0.

    By coverage: blank strips part columns, lines are anchored, marks go inside
    words.  By density: valleys part columns, lines are chained, marks stay.
    A line breaks a paragraph if it is over ``BREAK_SHARE`` of its height below
    the one before it, or begins a column of a page with several; the first
    line of a document does not.  Lines without text are left out.
    """
    keys = [doc, page]
    strips = density_gutters(words, keys) if by_density else gutters(words, keys)
    placed = words.join(strips, keys, "left")
    bounds = F.coalesce("gutters", F.array().cast("array<double>"))
    placed = placed.withColumn("column", column_of(bounds, F.col("x0"), F.col("x1"))).withColumn("__many", F.size(bounds) > 0).drop("gutters")
    lined = (chained_lines if by_density else anchored_lines)(placed, [*keys, "column"])
    across = F.array_sort(F.collect_list(F.struct("x0", "y0", "word_no", "x1", "text")))
    lines = lined.groupBy(*keys, "column", "line").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.first("__many").alias("many"), F.transform(across, lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))).alias("ws"))
    text = F.trim(line_text(F.col("ws"), False)) if by_density else line_text(with_marks_inside(F.col("ws")))
    in_column = Window.partitionBy(*keys, "column").orderBy("line")
    height = F.col("bottom") - F.col("top")
    gap = F.coalesce((height > 0) & (F.col("top") - F.lag("bottom").over(in_column) > height * BREAK_SHARE), F.lit(False))
    lines = lines.withColumn("text", text).withColumn("gap", gap).where(F.col("text").rlike(r"(?U)\S"))
    lines = lines.withColumn("first", F.col("many") & (F.row_number().over(in_column) == 1))
    lines = lines.withColumn("line_no", F.row_number().over(Window.partitionBy(doc).orderBy(page, "column", "line")).cast("long") - 1)
    return lines.select(doc, "line_no", page, "column", "text", (F.col("gap") | (F.col("first") & (F.col("line_no") > 0))).alias("is_break"))
