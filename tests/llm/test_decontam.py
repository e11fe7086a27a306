import math
import random

import numpy as np

from textloom.llm import decontam as m


def slow_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(97, 103)]) for _ in range(rng.randrange(70))] for _ in range(2))
        assert m.common_subsequence(a, b) == slow_lcs(a, b)


def corpus(seed):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    words = common * 20 + [f"w{i}" for i in range(1500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(15, 60)))) for i in range(40)]
    docs, planted = [], set()
    for d in range(400):
        w = text(rng.choice([0, 5, 40, 300, 3000]))
        if d % 4 == 0:
            item, t = rng.choice(items)
            t = t.split()
            kind = rng.random()
            if kind < 0.4:  # some words changed
                for _ in range(len(t) // 8):
                    t[rng.randrange(len(t))] = rng.choice(words)
            elif kind < 0.6:
                t = [x.upper() + "," for x in t]
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
            planted.add((d, item))
        docs.append((d, " ".join(w)))
    return items, docs, planted


def test_recall_and_precision_against_brute_force(spark):
    items, docs, planted = corpus(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    got = m.contaminated(df, bench).collect()
    # brute force: every window of every document
    want = set()
    for d, t in docs:
        w = m.words_of(t)
        for i, x in items:
            x = m.words_of(x)
            for at in range(0, max(1, len(w) - len(x) + 1), 5):
                if m.common_subsequence(x, w[at : at + len(x) + 8]) >= 0.75 * len(x):
                    want.add((d, i))
                    break
    assert planted <= want
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found & want) >= 0.97 * len(want)
    assert all(r["kind"] == "paraphrase" for r in got if (r["doc_id"], r["item_id"]) not in want)
    assert len(found - want) <= 2


def test_paraphrase_needs_the_answer(spark):
    rng = random.Random(5)
    noise = [f"n{i}" for i in range(3000)]
    item = [f"q{i}" for i in range(32)]
    half = [x for i, x in enumerate(item) if i % 8 < 5 and i < 24]
    rows = [(1, half + item[24:]), (2, half + [rng.choice(noise) for _ in range(8)]), (3, item), *[(i, [rng.choice(noise) for _ in range(200)]) for i in range(4, 60)]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in m.contaminated(df, bench, paraphrase=0.5).collect()}
    assert got == {1: "paraphrase", 3: "copy"}


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (None, ""), (3, "a b c d e f g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x A b c d e f g h i j y"), (2, "z " * 100_000), (5, "a b")], "doc_id long, text string")
    assert m.contaminated(none, bench).count() == 0
    assert m.contaminated(docs, bench.limit(0)).count() == 0
    assert sorted((r["doc_id"], r["item_id"]) for r in m.contaminated(docs, bench).collect()) == [(None, 1), (None, 3)]
    kept = m.decontaminated(docs.union(spark.createDataFrame([(9, "a b c d e f g h i j")], docs.schema)), bench)
    assert kept.count() == 5


def trimmed_corpus(seed):
    """Items of 60 to 240 words, of which documents hold the middle alone, or the whole with both ends reworded."""
    rng = random.Random(seed)
    words = [f"c{i}" for i in range(30)] * 20 + [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.choice([60, 80, 100, 140, 180, 240]))) for i in range(60)]
    docs, planted = [], set()
    for d in range(480):
        w = text(rng.choice([0, 40, 300, 1500]))
        if d % 4 == 0:
            item, t = items[d // 4 % 60]
            n = int(0.77 * len(t))
            lo = (len(t) - n) // 2
            part = t[lo : lo + n] if d < 240 else text(lo) + t[lo : lo + n] + text(len(t) - lo - n)
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
            planted.add((d, item))
        docs.append((d, " ".join(w)))
    return [(i, " ".join(t)) for i, t in items], docs, planted


def test_items_trimmed_or_reworded_at_both_ends_are_found(spark):
    items, docs, planted = trimmed_corpus(11)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = m.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found & planted) >= 0.99 * len(planted)
    assert found <= planted


def test_recall_where_the_space_is_fitted_on_a_sample(spark, monkeypatch):
    """About 2 % of the words alone fit the space; nothing that brute force finds is lost."""
    items, docs, planted = corpus(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(m, "FIT_WORDS", 5_000)
    assert sum(len(t.split()) for _, t in docs) > 40 * m.FIT_WORDS
    split = [(i, m.words_of(x)) for i, x in items]
    want = set()
    for d, t in docs:
        w = m.words_of(t)
        for i, x in split:
            if len(set(x).intersection(w)) >= 0.7 * len(set(x)) and any(m.common_subsequence(x, w[at : at + len(x) + 8]) >= 0.75 * len(x) for at in range(0, max(1, len(w) - len(x) + 1), 5)):
                want.add((d, i))
    assert planted <= want
    found = {(r["doc_id"], r["item_id"]) for r in m.contaminated(df, bench).collect()}
    assert len(found & want) >= 0.97 * len(want)


def test_parts_of_items_of_many_lengths_beside_a_very_short_item(spark):
    """Three quarters of an item from its start, middle or end; paraphrases; an item of four words changes nothing."""
    rng = random.Random(21)
    words = [f"c{i}" for i in range(30)] * 20 + [f"w{i}" for i in range(6000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.choice([15, 20, 30, 60, 120, 250, 400, 600]))) for i in range(64)]
    docs, planted = [], {"start": set(), "middle": set(), "end": set(), "paraphrase": set()}
    for d in range(256):
        item, t = items[d // 4]
        kind = list(planted)[d % 4]
        n = math.ceil(0.755 * len(t))
        lo = {"start": 0, "middle": (len(t) - n) // 2, "end": len(t) - n, "paraphrase": 0}[kind]
        part = t[lo : lo + n] if kind != "paraphrase" else [w if rng.random() < 0.66 else rng.choice(words) for w in t[:-8]] + t[-8:]
        docs.append((d, " ".join(text(rng.choice([0, 40, 500])) + part + text(rng.choice([0, 40])))))
        if kind != "paraphrase" or m.common_subsequence([w.encode() for w in t], [w.encode() for w in part]) >= 0.55 * len(t):
            planted[kind].add((d, item))
    bench = spark.createDataFrame([*((i, " ".join(t)) for i, t in items), (99, "four words of text")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in m.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()}
    for kind, rows in planted.items():
        print(kind, len(found & rows), len(rows))
        assert len(found & rows) >= 0.95 * len(rows), kind
    assert found <= set().union(*planted.values()) | {(d, d // 4) for d in range(3, 256, 4)}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items, docs, planted = corpus(8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(m, "BLOCK_WORDS", 400)
    monkeypatch.setattr(m, "_QUERIES", 5)
    found = {(r["doc_id"], r["item_id"]) for r in m.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()}
    assert len(found & planted) >= 0.97 * len(planted)


def test_the_space_is_fitted_on_all_documents(spark):
    """250,000 documents of two or three words: as many words as the space has directions, so the factorisation is exact."""
    from pyspark.sql import functions as F

    names = [f"v{k}" for k in range(60)]
    block = m.Block([(k, " ".join(names[k : k + 10]), None) for k in range(0, 60, 10)])
    pick = lambda s: F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(s)), F.lit(60)))
    docs = spark.range(0, 250_000, 1, 6).select(F.concat_ws(" ", pick(1), F.lit("other"), F.when(F.col("id") % 3 == 0, pick(2))).alias("text"))
    block.fit(docs, "text", 5)
    rows = [[block.number[w] for w in m.words_of(r["text"]) if w != b"other"] for r in docs.collect()]
    a = np.zeros((len(rows) + len(block.passages), 60))
    for i, r in enumerate(rows):
        for k in r:
            a[i, k] += 1
    for i, (item, o) in enumerate(block.passages, len(rows)):
        a[i, block.numbers(block.words[item][o : o + block.widths[item]])] += 1
    a *= block.idf
    want = block.idf[:, None] * np.linalg.inv(a.T @ a) * block.idf
    assert np.allclose(block.project @ block.project.T, want, rtol=0.01, atol=1e-3 * abs(want).max())
