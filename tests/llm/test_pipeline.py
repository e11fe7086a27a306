import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_jaccard_tree import brute
from tests.llm.test_mixing_sharding import draws, place

from textloom.llm import decontam, sharding, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    """Each stage takes effect on what the one before kept, and the last places every row."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
        assert docs.columns[:5] == columns
        if name == "toxicity":
            model = toxicity.train(spark.createDataFrame(before, "doc_id long, text string, source string"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
            scores = {d: model.score(t) for d, t, _ in before}
            assert sorted(kept[name]) == sorted(d for d, s in scores.items() if s < 0.3)
            assert 0 < len(before) - len(kept[name]) < 0.3 * len(before)
        elif name == "near copies":
            assert sorted(kept[name]) == sorted(d for d, _, c in brute([(d, t) for d, t, _ in before], 5, 80) if d == c)
        elif name == "decontamination":
            items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            for d, t, _ in before:
                w = b" ".join(decontam.words_of(t))
                if any(b" ".join(x) in w for x in items):
                    assert d not in kept[name]
            assert len(kept[name]) >= 0.95 * len(before)
        elif name == "mixing":
            assert Counter(kept[name]) == draws(before)
        elif name == "sharding":
            assert all(r["shard"] == place(sharding.even_tree(8), r["doc_id"]) for r in docs.collect())
            assert len(kept[name]) == len(before)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == Counter(kept["sharding"])


def test_stages_act_on_rows_where_ids_repeat_or_are_null(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    schema = "doc_id long, text string, lang string"
    rows = [(1, a, "x"), (1, a, "x"), (None, a + " z", "x"), (None, b, "x"), (None, b, "x"), (0, c, "x"), (2, c, "x"), (2, d, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema).repartition(4), FOLDER)
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a, "x"), (None, b, "x"), (0, c, "x"), (2, d, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x")])
    leak = d + " " + spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"] + " " + c
    rows = [(None, leak, "x"), (None, a, "x"), (3, leak, "x"), (3, b, "x"), (3, b, "x"), (4, None, "x"), (None, None, "x")]
    kept = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, schema).repartition(3), FOLDER)
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[1] != leak)


def test_copies_of_items_go_whole_or_in_part(spark):
    """Each item whole, in upper case with marks, its first, middle and last four fifths, and with every eighth word changed."""
    rng = random.Random(6)
    words = [f"n{k}" for k in range(4000)]
    rows, leaks = [], set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = r["text"].split()
        n = -(-4 * len(w) // 5)
        lo = (len(w) - n) // 2
        for part in (w, [x.upper() + "," for x in w], w[:n], w[lo : lo + n], w[-n:], [rng.choice(words) if k % 8 == 3 else x for k, x in enumerate(w)]):
            rows.append((len(rows), " ".join(rng.choices(words, k=rng.choice([0, 30, 300])) + part + rng.choices(words, k=20))))
            leaks.add(len(rows) - 1)
    clean = {len(rows) + k for k in range(100)}
    rows += [(d, " ".join(rng.choices(words, k=rng.choice([1, 40, 400])))) for d in sorted(clean)]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), FOLDER).collect()}
    assert clean <= kept
    assert len(leaks & kept) <= 0.02 * len(leaks)


def test_stages_with_null_ids_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    extra = ["__id", "__text", "__gone", "mix_rate", "mix_copy", "mix_n", "mix_source", "mix_step", "mix_order", "comp", "row", "score", "shard"]
    text = " ".join(f"w{rng.randrange(9000)}" for _ in range(60_000))
    rows = [(None, text, "a"), (None, None, None), (1, "", "a"), (1, "", "a"), (2, "x y", "b"), (2, "x y", "b"), (3, text + " z", "b")]
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in extra)).repartition(3)
    assert corpus_pipeline.drop_toxic(spark, docs, FOLDER).columns == docs.columns
    # (the model learns from the documents given, so it is made of others here)
    near = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert Counter((r["doc_id"], len(r["text"] or "")) for r in near.collect()) == Counter([(None, 0), (1, 0), (1, 0), (2, 3), (3, len(text) + 2)])
    for stage in (corpus_pipeline.drop_leaks, corpus_pipeline.mix, corpus_pipeline.shard):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in extra[:-1]] == list(range(len(extra) - 1))
    assert corpus_pipeline.drop_leaks(spark, docs, FOLDER).count() == len(rows)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_leaks, corpus_pipeline.mix, corpus_pipeline.shard):
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
