"""Queries on the supplied tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.korean import BREAKS, aligned_paragraphs, break_score
from textloom.functions.text import escaped, is_english_line, stripped, tidied
from textloom.operators import columns, exams, items, joins, layout, lines, markup, quality, segments, sheets
from textloom.plans.registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

_LINES = "lines AS (SELECT doc_id, lang, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))"
_STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
_ENGLISH = f"(length({_STRIPPED}) >= 4 AND length(regexp_replace({_STRIPPED}, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / length({_STRIPPED}) > 0.7)"


@query(f"WITH {_LINES} SELECT lang, count(*) AS n_lines, count(*) FILTER (WHERE {_ENGLISH}) AS n_english FROM lines GROUP BY lang")
def english_lines(read):
    lines = read("documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(is_english_line(F.col("line"))).alias("n_english"))


@query(f"""WITH {_LINES}, marked AS (SELECT *, {_ENGLISH} AS en, sum(CASE WHEN {_ENGLISH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines),
blocks AS (SELECT doc_id, island, min(line_no) AS start_line, count(*) AS n_lines, sum(length({_STRIPPED})) AS chars FROM marked WHERE en GROUP BY doc_id, island),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n_lines >= 2 THEN 0 ELSE 1 END, chars DESC, start_line) AS r FROM blocks)
SELECT doc_id, start_line::BIGINT AS start_line, n_lines, chars::BIGINT AS chars FROM ranked WHERE r = 1""")
def longest_english_block(read):
    lines = segments.lines_of(read("documents"))
    runs = segments.islands(lines, ["doc_id"], "line_no", is_english_line(F.col("line")))
    blocks = runs.groupBy("doc_id", "island").agg(F.min("line_no").cast("long").alias("start_line"), F.count("*").alias("n_lines"), F.sum(F.length(stripped(F.col("line")))).alias("chars"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("n_lines") >= 2, 0).otherwise(1), F.desc("chars"), "start_line"))
    return blocks.withColumn("r", best).where("r = 1").select("doc_id", "start_line", "n_lines", "chars")


@query("SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g')) AS t FROM documents)")
def tidy_punctuation(read):
    t = tidied(F.col("text"))
    return read("documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query("""WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations)
SELECT conv_id, segment::BIGINT AS segment, count(*) AS n, min(turn) AS first_turn FROM s WHERE segment > 0 GROUP BY conv_id, segment""")
def segments_leading(read):
    return segments.leading_segments(read("conversations"), ["conv_id"], ["turn"], F.col("role") == "user").groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("""WITH s AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment,
max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM conversations)
SELECT conv_id, segment::BIGINT AS segment, count(*) AS n, max(turn) AS last_turn FROM s WHERE open = 1 GROUP BY conv_id, segment""")
def segments_trailing(read):
    return segments.trailing_segments(read("conversations"), ["conv_id"], ["turn"], F.col("role") == "assistant").groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events")
def next_bound(read):
    return segments.next_bound(read("events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id", "next_event").drop("ts")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_wins(read):
    return segments.wins(read("events"), ["user_id", "event_type"], ["event_id"], ["event_id", "value"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(read):
    return segments.wins(read("events"), ["user_id", "event_type"], ["event_id"], ["event_id", "value"], last=True)


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_forward(read):
    e = read("events").select("event_id", "user_id", "ts", "event_type", "value")
    return segments.carried_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("value")), "carried").select("event_id", "user_id", "carried")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM g)
SELECT user_id, chain::BIGINT AS chain, count(*) AS n FROM c GROUP BY user_id, chain""")
def chained_groups(read):
    e = read("events").select("user_id", F.struct("ts", "event_id").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return segments.chained_groups(e, ["user_id"], "at", F.col("us"), F.lit(3_600_000_000)).groupBy("user_id", "chain").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE a AS (SELECT user_id, min(value) AS anchor FROM events WHERE value IS NOT NULL GROUP BY user_id
UNION ALL SELECT user_id, anchor FROM (SELECT a.user_id, (SELECT min(value) FROM events e WHERE e.user_id = a.user_id AND e.value - a.anchor > 20) AS anchor FROM a) WHERE anchor IS NOT NULL)
SELECT user_id, count(*) AS n_groups FROM a GROUP BY user_id""")
def anchored_groups(read):
    e = read("events").where("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return e.select("user_id", F.size(segments.anchors(F.col("v"), 20)).cast("long").alias("n_groups"))


@query("SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NOT NULL THEN l.quality END AS quality, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic END AS toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_override_merge(read):
    return joins.left_override(read("documents").select("doc_id", "source"), read("labels"), ["doc_id"], "labelled").select("doc_id", "source", "quality", "toxic", "labelled")


@query("""SELECT coalesce(c.nation, s.nation) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM
(SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.nation = s.nation""")
def full_outer_merge(read):
    c = read("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = read("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full_outer").fillna(0, ["customers", "suppliers"])


@query("""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents),
l AS (SELECT source, quality, toxic, row_number() OVER (PARTITION BY source ORDER BY l.doc_id) AS position FROM labels l JOIN documents USING (doc_id))
SELECT source, position::INTEGER AS position, doc_id, quality, toxic FROM d LEFT JOIN l USING (source, position)""")
def positional_join(read):
    d = read("documents").select("source", "doc_id")
    l = read("labels").join(d, "doc_id").select("source", F.col("doc_id").alias("l_id"), "quality", "toxic")
    return joins.positional_join(d, l, ["source"], ["doc_id"], ["l_id"]).select("source", "position", "doc_id", "quality", "toxic")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
b AS (SELECT m.o_custkey, m.o_orderkey AS marker, o.o_orderkey AS attached, o.n - m.n AS distance, min(CASE WHEN m.o_orderstatus = o.o_orderstatus THEN 1 ELSE 0 END) OVER (PARTITION BY m.o_custkey, m.o_orderkey ORDER BY o.n) AS ok
FROM n m JOIN n o ON m.o_custkey = o.o_custkey AND o.n BETWEEN m.n + 1 AND m.n + 3 WHERE m.o_totalprice > 200000) SELECT o_custkey, marker, attached, distance FROM b WHERE ok = 1""")
def range_attach(read):
    o = read("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return joins.range_attach(o, ["o_custkey"], ["o_orderkey"], F.col("o_totalprice") > 200000, 3, "o_orderstatus", "o_orderkey")


@query("""WITH p AS (SELECT doc_id, i, ms[i] AS m FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+ [a-z]+') AS ms FROM documents), LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i))
SELECT doc_id, number, word FROM (SELECT doc_id, split_part(m, ' ', 1) AS number, split_part(m, ' ', 2) AS word, row_number() OVER (PARTITION BY doc_id, split_part(m, ' ', 1) ORDER BY i DESC) AS r FROM p) WHERE r = 1""")
def answer_pairs(read):
    pairs = read("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([0-9]+ [a-z]+)"), 1)).alias("i", "m"))
    pairs = pairs.select("doc_id", "i", F.split_part("m", F.lit(" "), F.lit(1)).alias("number"), F.split_part("m", F.lit(" "), F.lit(2)).alias("word"))
    return segments.wins(pairs, ["doc_id", "number"], ["i"], ["word"], last=True)


_FALLBACK = """CASE WHEN regexp_matches(text, '_{3,}') THEN 'FILL' WHEN regexp_matches(text, '\\(\\s*A\\s*\\)') AND regexp_matches(text, '\\(\\s*B\\s*\\)') AND regexp_matches(text, '\\(\\s*C\\s*\\)')
AND NOT regexp_matches(text, '\\(\\s*D\\s*\\)') THEN 'REORDER' ELSE 'AS_IS' END"""
_ASKED = [
    ("다음 글을 읽고, 물음에 답하시오.", "LONG1"),
    ("다음 글을 읽고, 물음에 답하시오. 순서로 가장 적절한 것은?", "LONG2"),
    ("다음 도표의 내용과 일치하지 않는 것은?", "SKIP"),
    ("다음 글에서 어법상 틀린 것은?", "REPLACE"),
    ("문맥상 낱말의 쓰임이 적절하지 않은 것은?", "REPLACE"),
    ("내용을 한 문장으로 요약하고자 한다. 빈칸 (A), (B)에 들어갈 말은?", "SUMMARY"),
    ("다음 빈칸에 들어갈 말로 가장 적절한 것은?", "FILL"),
    ("전체 흐름과 관계 없는 문장은?", "REMOVE"),
    ("이어질 글의 순서로 가장 적절한 것은?", "REORDER"),
    ("주어진 문장이 들어가기에 가장 적절한 곳은?", "INSERT"),
    ("다음 글의 제목으로 가장 적절한 것은?", "AS_IS"),
]


@query(f"""SELECT kind, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE doc_id % {len(_ASKED) + 1} {" ".join(f"WHEN {k} THEN '{t}'" for k, (_, t) in enumerate(_ASKED))} ELSE {_FALLBACK} END AS kind FROM documents) GROUP BY kind""")
def type_cascade(read):
    asked = F.get(F.array(*[F.lit(a) for a, _ in _ASKED]), (F.col("doc_id") % (len(_ASKED) + 1)).cast("int"))
    texts = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    docs = read("documents").select("doc_id", F.when(asked.isNull(), texts).otherwise(F.concat(F.array(F.lit("[문제]"), asked), texts)).alias("ls")).withColumn("asked", items.instruction(F.col("ls")))
    return docs.groupBy(items.item_type(F.col("ls"), F.col("asked")).alias("kind")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{3,}') GROUP BY word),
r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS position FROM c) SELECT word, n, (position // 40)::BIGINT AS page, (position % 40 // 20)::BIGINT AS "column", (position % 20)::BIGINT AS "row" FROM r WHERE position < 80""")
def vocab_topk_pages(read):
    words = read("documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(80)  # the 80 rows of the report
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1)
    return layout.paged(top, "position", 40, 20).drop("position")


@query(f"""WITH n AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT o_custkey, (n // 10)::BIGINT AS chunk, {', '.join(f"max(CASE WHEN n % 10 = {k} THEN o_orderpriority END) AS a{k + 1}" for k in range(10))} FROM n GROUP BY o_custkey, n // 10""")
def answer_key_chunks(read):
    return layout.answer_rows(read("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"], "o_orderpriority")


@query("SELECT conv_id, split_part(text, ' ', 1) AS choice, count(*) AS times FROM conversations GROUP BY ALL HAVING count(*) > 1")
def duplicate_choices(read):
    asked = read("conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit("① "), F.split_part("text", F.lit(" "), F.lit(1)))).alias("choices"))
    return quality.repeated_choices(asked, ["conv_id"])


@query("SELECT page_id, length(e) AS n_chars, md5(e) AS digest FROM (SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM pages)")
def html_escape_markup(read):
    e = escaped(F.col("html"))
    return read("pages").select("page_id", F.length(e).cast("long").alias("n_chars"), F.md5(e.cast("binary")).alias("digest"))


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, line_no, i, ws[i] AS word FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM lines), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
x AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 6 AS x0 FROM w),
b AS (SELECT unnest(range((x0 // 48)::BIGINT, ((x0 + length(word) * 6) // 48)::BIGINT + 1)) AS bin FROM x WHERE word <> '')
SELECT bin, count(*) AS words FROM b GROUP BY bin""")
def gutter_histogram(read):
    w = layout.positioned_words(segments.lines_of(read("documents")), ["doc_id", "line_no"]).where("word <> ''")
    return w.select(F.explode(F.sequence(F.floor(F.col("x0") / 48), F.floor(F.col("x1") / 48))).alias("bin")).groupBy("bin").agg(F.count("*").alias("words"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM lines GROUP BY doc_id")
def words_to_lines_roundtrip(read):
    w = layout.positioned_words(segments.lines_of(read("documents")), ["doc_id", "line_no"])
    lines = w.groupBy("doc_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "word"))), lambda s: s["word"]), " ").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.md5(text.cast("binary")).alias("digest"))


_SCORE = "CASE " + " ".join(f"WHEN regexp_matches(word, '(?:{e})$') THEN {n}" for n, e in BREAKS) + " ELSE 0 END"


@query(f"WITH w AS (SELECT lang, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents) SELECT lang, ({_SCORE})::INTEGER AS score, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL")
def break_scores(read):
    words = read("documents").select("lang", F.explode(F.split("text", "[ \n]")).alias("word")).where("word <> ''")
    # a word is scored once, however often it stands there
    words = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return words.groupBy("lang", break_score(F.col("word")).alias("score")).agg(F.sum("n").alias("n"))


@query(None)
def paragraph_alignment(read):
    lines_apart, in_one = F.replace("text", F.lit("\n"), F.lit("\n\n")), F.replace("text", F.lit("\n"), F.lit(" "))
    told = aligned_paragraphs(lines_apart, in_one)
    return read("documents").select("doc_id", F.size(F.split(told, "\n\n")).alias("paragraphs"), F.md5(told.cast("binary")).alias("digest"))


_WORDS = f"""{_LINES}, w AS (SELECT doc_id, line_no, i, ws[i] AS word FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM lines), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
x AS (SELECT *, (coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 6)::BIGINT AS x0 FROM w)"""


def _page_words(read) -> DataFrame:
    """Words of documents set in a fixed pitch, as a page of 612 points each."""
    w = layout.positioned_words(segments.lines_of(read("documents")), ["doc_id", "line_no"]).where("word <> ''")
    return w.select("doc_id", "x0", "x1", (F.col("line_no") + 200).alias("y0"), F.lit(612).alias("page_width"))


@query(f"""WITH {_WORDS}, c AS (SELECT doc_id, unnest(range(greatest(0, x0 // 4), least(154, (x0 + length(word) * 6) // 4) + 1)) AS bin, length(word) * 6 <= 306 AS plain FROM x WHERE word <> ''),
b AS (SELECT doc_id, bin, count(*) FILTER (WHERE plain) AS p, count(*) AS e FROM c GROUP BY ALL), m AS (SELECT doc_id, max(p) AS p, max(e) AS e FROM b GROUP BY doc_id),
g AS (SELECT m.doc_id, i AS bin, coalesce(CASE WHEN m.p > 0 THEN b.p ELSE b.e END, 0) AS n, CASE WHEN m.p > 0 THEN m.p ELSE m.e END AS most FROM m CROSS JOIN (SELECT unnest(range(15, 140)) AS i) LEFT JOIN b ON b.doc_id = m.doc_id AND b.bin = i),
v AS (SELECT doc_id, bin, n, bin - row_number() OVER (PARTITION BY doc_id ORDER BY bin) AS valley FROM g WHERE n < most * 0.3), l AS (SELECT *, min(n) OVER (PARTITION BY doc_id, valley) AS low, count(*) OVER (PARTITION BY doc_id, valley) AS bins FROM v),
k AS (SELECT doc_id, valley, bin, bin - row_number() OVER (PARTITION BY doc_id, valley ORDER BY bin) AS run FROM l WHERE n = low AND bins * 4 >= 8), r AS (SELECT doc_id, valley, run, count(*) AS len, min(bin) AS a, max(bin) AS z FROM k GROUP BY ALL),
t AS (SELECT doc_id, (a + z) / 2 * 4 AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, valley ORDER BY len DESC, a) AS best FROM r) WHERE best = 1),
e AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY x), 60) AS before, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY x), 552) AS after FROM t) SELECT doc_id, x::DOUBLE AS gutter FROM e WHERE x - before >= 90 AND after - x >= 90""")
def density_columns(read):
    return lines.density_gutters(_page_words(read), ["doc_id"]).select("doc_id", F.explode("gutters").alias("gutter"))


@query(f"""WITH {_WORDS}, y AS (SELECT doc_id, x0 % 240 + line_no % 2 * 330 AS a, least(length(word) * 6, 40) AS n FROM x WHERE word <> ''), c AS (SELECT DISTINCT doc_id, unnest(range(a, a + n + 1)) AS px FROM y),
s AS (SELECT doc_id, px, lead(px) OVER (PARTITION BY doc_id ORDER BY px) AS nxt FROM c), d AS (SELECT doc_id, min(px) AS l, max(px) + 1 AS r, count(*) FILTER (WHERE nxt > px + 1) + (min(px) > 0)::INT + (max(px) < 612)::INT AS blanks FROM s GROUP BY doc_id),
m AS (SELECT s.doc_id, (px + 1 + nxt) / 2 AS x, l, r FROM s JOIN d USING (doc_id) WHERE nxt - px - 1 >= 10 AND blanks >= 2),
e AS (SELECT doc_id, x, coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY x), l) AS before, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY x), r) AS after FROM m) SELECT doc_id, x::DOUBLE AS gutter FROM e WHERE x - before >= 120 AND after - x >= 120""")
def coverage_columns(read):
    # lines set in turn in a left and a right column
    words = _page_words(read).withColumn("n", F.least(F.col("x1") - F.col("x0"), F.lit(40))).withColumn("x0", F.pmod("x0", F.lit(240)) + F.pmod(F.col("y0") - 200, F.lit(2)) * 330)
    return columns.gutters(words.withColumn("x1", F.col("x0") + F.col("n")), ["doc_id"]).select("doc_id", F.explode("gutters").alias("gutter"))


@query(f"""SELECT type, count(*) AS n FROM (SELECT {_FALLBACK} AS type FROM (SELECT coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' ___ ' WHEN 1 THEN ' (A) ( B) (C )' WHEN 2 THEN ' (A) (B) (C) (D)' ELSE '' END AS text FROM documents)) GROUP BY type""")
def item_types(read):
    added = F.coalesce(F.get(F.array(*[F.lit(x) for x in (" ___ ", " (A) ( B) (C )", " (A) (B) (C) (D)")]), (F.col("doc_id") % 4).cast("int")), F.lit(""))
    asked = read("documents").select(F.split(F.concat(F.coalesce("text", F.lit("")), added), "\n").alias("ls")).withColumn("asked", items.instruction(F.col("ls")))
    return asked.groupBy(items.item_type(F.col("ls"), F.col("asked")).alias("type")).agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM lines WHERE NOT regexp_full_match({_STRIPPED}, '[0-9]{{1,2}}') GROUP BY doc_id")
def untitled_translations(read):
    told = read("documents").select("doc_id", exams.translation_of(F.split("text", "\n")).alias("t")).where("size(t) > 0")
    return told.select("doc_id", F.size("t").cast("long").alias("n_lines"), F.md5(F.array_join("t", "\n").cast("binary")).alias("digest"))


@query("""WITH s AS (SELECT conv_id, turn, role = 'system' AS divider, length(text) < 80 AS spacer, CASE WHEN role <> 'system' THEN role END AS named FROM conversations),
p AS (SELECT *, sum(divider::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM s), b AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
n AS (SELECT *, named IS NOT NULL AND named IS DISTINCT FROM before AS new FROM b), r AS (SELECT *, sum((divider OR new)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run, 1 + sum((divider OR (new AND before IS NOT NULL))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM n)
SELECT conv_id, turn, page::BIGINT AS page, CASE WHEN NOT divider AND NOT spacer THEN lpad(sum((NOT divider AND NOT spacer)::INT) OVER (PARTITION BY conv_id, run ORDER BY turn)::VARCHAR, 2, '0') END AS num FROM r""")
def sentence_numbers(read):
    s = read("conversations").select("conv_id", "turn", F.col("role").alias("section"), (F.length("text") < 80).alias("spacer"), (F.col("role") == "system").alias("divider"))
    return sheets.sentence_rows(s, "conv_id", "turn").select("conv_id", "turn", "page", "num")


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n, ceil(count(*) OVER (PARTITION BY p_brand) / 40) AS pages FROM part), m AS (SELECT * FROM (VALUES (0, 'en_to_ko'), (1, 'ko_to_en'), (2, 'vocab_list')) AS v(k, mode))
SELECT p_brand, mode, (k * pages + n // 40 + 1)::BIGINT AS page, (n % 40 // 20)::BIGINT AS "column", (n % 20)::BIGINT AS "row", p_partkey AS num, CASE WHEN mode = 'ko_to_en' THEN '' ELSE p_name END AS en, CASE WHEN mode = 'en_to_ko' THEN '' ELSE p_type END AS ko FROM w, m""")
def vocabulary_sheets(read):
    words = read("part").select("p_brand", F.col("p_partkey").alias("num"), F.col("p_name").alias("en"), F.col("p_type").alias("ko"))
    return sheets.vocabulary_rows(words, "p_brand", "num").drop("heading")


@query(None)
def highlight_runs(read):
    phrases = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("color")) for p, c in (("the", "red"), ("of the", "blue"), ("and", "green"))])
    marked = markup.highlighted(read("conversations").withColumn("phrases", phrases), "text", "phrases")
    return marked.select("conv_id", "turn", F.explode("runs").alias("r")).select("conv_id", "turn", "r.start", "r.end", "r.color")
