import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import quality, textfeatures, toxicity


def tables(spark, label, seed=1, n=500):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([8, 60, 500]))]
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(max(1, len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(["zonk", "zonker", "qworp"])
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, f"doc_id long, {label} int"), dict(labels)


@pytest.mark.parametrize(("module", "score", "label", "mod", "out"), [(toxicity, toxicity.toxicity, "toxic", 4, 2), (quality, quality.quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, module, score, label, mod, out):
    docs, labels, y = tables(spark, label)
    model = module.train(docs, labels, label)
    got = {r["doc_id"]: r for r in score(docs, model, 0.5).collect()}
    assert len(got) == len(y)
    held = [d for d in y if zlib.crc32(str(d).encode()) % mod == out]
    assert sum(got[d]["predicted"] == y[d] for d in held) / len(held) > (0.97 if module is toxicity else 0.9)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # labels of held-out rows do not matter
    flipped = labels.withColumn(label, F.when(textfeatures.remainder(mod) == out, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r["doc_id"]: r["score"] for r in score(docs, module.train(docs, flipped, label), 0.5).collect()}
    assert all(abs(again[d] - got[d]["score"]) < 1e-9 for d in got)


@pytest.mark.parametrize(("module", "score", "label"), [(toxicity, toxicity.toxicity, "toxic"), (quality, quality.quality, "quality")])
def test_edges(spark, module, score, label):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "é" * 1_500_000), (3, "word"), (3, "word")], "doc_id long, text string")
    for labels in ([], [(1, 1), (3, 1), (None, 1), (9, 0)], [(1, 0), (3, 1), (2, None), (3, 1)], [(3, 1), (3, 0)]):
        model = module.train(docs, spark.createDataFrame(labels, f"doc_id long, {label} int"), label)
        got = score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert score(docs.limit(0), model).count() == 0
    assert toxicity.clean(docs, toxicity.Model(toxicity.np.zeros(1 << toxicity.BITS, "f4"), -5.0)).count() == 6


def test_long_texts_in_pieces(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    whole = [sorted(g.tolist()) for g in textfeatures.char_ngrams(data, (3, 5), 12)]
    monkeypatch.setattr(textfeatures, "PIECE", 700)
    parts = list(textfeatures.char_ngrams(data, (3, 5), 12))
    assert [sorted(x for p in parts[k::2] for x in p.tolist()) for k in range(2)] == whole


def slots_of(text, sizes, bits):
    """Every n-gram of bytes, hashed one by one."""
    data, out = b" " + (text or "").encode() + b" ", []
    for n in sizes:
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h * 1099511628211 + c + 1) % 2**64
            out.append(h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - bits)
    return out


TEXTS = [None, "", "a", "A bad  word, é!", "zonk " * 300]


def test_toxicity_scores_against_brute_force(spark):
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype("f4") / 10, -0.3)
    got = toxicity.toxicity(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model, 0.3).collect()
    for r in got:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in TEXTS[r["doc_id"]] or "")
        z = model.bias + sum(float(model.weights[s]) for s in set(slots_of(low, toxicity.SIZES, toxicity.BITS)))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-6 and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_fit_scales_by_log_count_ratios_and_lowers_the_loss():
    rng = random.Random(3)
    texts, y = [], []
    for i in range(120):
        y.append(i % 4 == 0)
        texts.append(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)) + (" zonk" if y[-1] else " mild") * (i % 3))
    y = np.array(y, int)
    slots = [toxicity.features(t) for t in texts]
    model = toxicity.fit(slots, y, 0.25)
    count = [Counter(s for f, c in zip(slots, y, strict=True) if c == side for s in f.tolist()) for side in (0, 1)]
    for s in set().union(*(f.tolist() for f in slots)):
        p, q = count[1][s] + 1.0, count[0][s] + 1.0
        ratio = math.log(p / (y.sum() + 2)) - math.log(q / (len(y) - y.sum() + 2))
        if abs(ratio) < toxicity.NOISE * math.sqrt(1 / p + 1 / q):
            assert model.weights[s] == 0
    unseen = np.setdiff1d(np.arange(1 << toxicity.BITS), np.concatenate(slots))
    assert not model.weights[unseen].any() and model.weights.any()
    z = np.array([model.bias + model.weights[f].sum() for f in slots])
    loss = np.logaddexp(0, np.where(y == 1, -z, z)).mean()
    assert loss < 0.8 * -(0.25 * math.log(0.25) + 0.75 * math.log(0.75))


def test_noise_is_chosen_on_folds_of_the_rows_given():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    y = np.array([int(rng.random() < 0.3) for _ in range(160)])
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" zonk" if c else "") for c in y]
    loss = toxicity.noise_by_folds([toxicity.features(t) for t in texts], y, 0.3, choices=(0.0, 3.0))
    assert loss[3.0] < loss[0.0] < math.log(2) * 2


def test_quality_scores_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=(1 << quality.BITS, quality.DIM)).astype("f4"), rng.normal(size=(quality.DIM, 2)), np.array([0.1, -0.2]))
    got = quality.quality(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model, 0.5).collect()
    for r in got:
        t = TEXTS[r["doc_id"]]
        words = [xxhash.xxh3_64_intdigest(w) >> 64 - quality.BITS for w in (t or "").encode().split()]
        every = words + slots_of(t, quality.SIZES, quality.BITS)
        z = (sum(model.embedding[s].astype(float) for s in every) / max(1, len(every)) if every else np.zeros(quality.DIM)) @ model.output + model.bias
        p = np.exp(z - z.max())
        assert abs(r["score"] - p[1] / p.sum()) < 1e-5


def test_quality_fit_against_plain_gradient_steps():
    """The same steps, one number at a time."""
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(6)]
    counts = [rng.integers(1, 4, len(r)) for r in rows]
    y, share = np.array([0, 1, 0, 1, 1, 0]), 0.4
    got = quality.fit(rows, counts, y, share, steps=36, rate=0.3, seed=9)
    draw = np.random.default_rng(9)
    e = draw.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    w, b = np.zeros((quality.DIM, 2)), [0.0, 0.0]
    total = 6 * len(y)
    for step in range(total):
        if step % len(y) == 0:
            order = draw.permutation(len(y))
        i = order[step % len(y)]
        part = counts[i] / counts[i].sum()
        mean = sum(p * e[s] for p, s in zip(part, rows[i], strict=True))
        z = [mean @ w[:, k] + b[k] for k in (0, 1)]
        p1 = 1 / (1 + math.exp(z[0] - z[1]))
        scale = 0.3 * (1 - step / total) * (share / y.mean() if y[i] else (1 - share) / (1 - y.mean()))
        g = [((1 - p1) - (y[i] == 0)) * scale, (p1 - (y[i] == 1)) * scale]
        back = w[:, 0] * g[0] + w[:, 1] * g[1]
        for k in (0, 1):
            w[:, k] -= mean * g[k]
            b[k] -= g[k]
        for p, s in zip(part, rows[i], strict=True):
            e[s] = e[s] - p * len(rows[i]) * back
    assert np.allclose(got.output, w, atol=1e-4) and np.allclose(got.bias, b, atol=1e-4) and np.allclose(got.embedding, e, atol=1e-4)


def test_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}", "h") for i in range(500)] + [(2, "b", "h")] * 300 + [(3, "c " * 1000, "h"), (4, None, "h")], "doc_id long, text string, hash string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    every = lambda n: sorted(map(tuple, textfeatures.labelled_sample(docs, labels, "toxic", F.lit(True), n).collect()))
    assert len(every(1)) == 2 and {y for _, y in every(1)} == {0, 1}
    assert len(every(10)) == 12 and every(10) == every(10)
    monkeypatch.setattr(textfeatures, "SAMPLE_BYTES", 100)
    assert sum(len(t) for t, _ in every(1000)) <= 100 and ("b", 0) in every(1000)


def test_toxicity_learns_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """Of 1,900 toxic rows the last 400, by a hash of their id, alone hold one of two marks; the rows are dealt into parts."""
    import corpus_pipeline

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    ids = [r["doc_id"] for r in spark.range(6000).withColumnRenamed("id", "doc_id").where(textfeatures.remainder(4) != 2).orderBy(F.xxhash64("doc_id")).collect()]
    toxic, clean = ids[:1900], ids[1900:]
    text = lambda mark="": " ".join([*rng.choices(words, k=12), mark])
    rows = [(d, text("zonk" if k < 1500 else "qworp")) for k, d in enumerate(toxic)] + [(d, text()) for d in clean]
    new = [(10_000 + k, text("qworp" if k % 2 else "")) for k in range(40)]
    docs = spark.createDataFrame(rows + new, "doc_id long, text string").repartition(5)
    spark.createDataFrame([(d, int(k < 1900)) for k, d in enumerate(ids)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert {d for d, _ in new if d in kept} == {d for d, _ in new if d % 2 == 0}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000)
    one, two = (toxicity.train(d, labels) for d in (docs, docs.repartition(2)))
    assert one.bias == two.bias and (one.weights == two.weights).all()
    assert all((one.score(t) >= 0.3) == (d % 2 == 1) for d, t in new)
    # slots with weights are those whose exact counts differ by more than chance
    slots = {d: toxicity.features(t) for d, t in rows}
    p, q = (np.bincount(np.concatenate([slots[d] for d in some]), minlength=1 << toxicity.BITS) for some in (toxic, clean))
    assert ((one.weights != 0) <= (toxicity.ratios(p, q, len(toxic), len(clean)) != 0)).all()


def test_slots_that_no_row_has_say_nothing_where_classes_differ_in_size():
    p, q = np.array([0.0, 0.0, 20.0, 1.0]), np.array([0.0, 1.0, 0.0, 9000.0])
    assert (toxicity.ratios(p, q, 100, 9900) != 0).tolist() == [False, False, True, True]
