import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from decimal import Decimal, getcontext

import numpy as np
import pytest

from textloom.llm import mixing, sharding


def uniform(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / (1 << 52)


def draws(rows, targets=None, total=None, seed=17):
    """(id, copies) of each row, by inverting the distribution one probability at a time."""
    size = Counter(s for _, _, s in rows)
    weight = dict.fromkeys(size, 1.0) if targets is None else {s: targets.get(s, 0.0) for s in size}
    out = []
    for d, t, s in rows:
        rate = weight[s] * ((total or len(rows)) / sum(weight.values())) / size[s]
        u, k, p = uniform(seed, d, hashlib.md5((t or "").encode()).hexdigest()), 0, math.exp(-rate)
        c = p
        while rate < 500 and c <= u and k < 10_000:
            k += 1
            p *= rate / k
            c += p
        if rate >= 500:  # exp(-rate) would vanish
            k = exact_quantile(u, rate)
        out += [d] * (k if rate else 0)
    return Counter(out)


ROWS = [(i, f"text {i % 40}", f"s{min(i % 7, 3)}") for i in range(600)] + [(900, None, None), (901, "", "rare"), (5, "text 5", "s3"), (None, "x", "s1")]


def test_poisson_draws_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, mix_n int").repartition(6)
    for targets, total in ((None, None), ({"s0": 3.0, "s1": 1.0, None: 0.5}, 2000)):
        got = mixing.mix_sources(df, targets, total).collect()
        assert Counter(r["doc_id"] for r in got) == draws(ROWS, targets, total)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_shares_reach_their_targets_and_order_is_mixed(spark):
    rows = [(i, "t", "big" if i % 10 else "small") for i in range(20_000)]
    got = [r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"big": 1.0, "small": 1.0}).collect()]
    n = Counter(r["source"] for r in got)
    assert abs(n["big"] / 10_000 - 1) < 0.05 and abs(n["small"] / 10_000 - 1) < 0.05
    first = Counter(r["source"] for r in got[:2000])
    assert 800 < first["small"] < 1200


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert Counter(r["doc_id"] for r in mixing.mix_sources(df).collect()) == draws(ROWS)


def exact_quantile(u, rate):
    """The least k with P(X <= k) > u, by sums of probabilities of 50 digits from the mode outwards."""
    getcontext().prec = 50
    r, mode = Decimal(rate), int(rate)
    if mode < 1000:
        p = (-r).exp()
        for k in range(1, mode + 1):
            p *= r / k
    else:  # Stirling's series
        n = Decimal(mode)
        pi = Decimal("3.14159265358979323846264338327950288419716939937510")
        log = n * n.ln() - n + (2 * pi * n).ln() / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
        p = (n * r.ln() - r - log).exp()
    below, k, q, u = p, mode, p, Decimal(u)
    while k > 0 and q > Decimal("1e-40"):
        q *= k / r
        k -= 1
        below += q
    if below > u:
        k = mode
        while k >= 0 and below > u:
            below -= p
            p *= k / r
            k -= 1
        return k + 1
    k = mode
    while below <= u:
        k += 1
        p *= r / k
        below += p
    return k


@pytest.mark.parametrize("rate", [1e-9, 1e-3, 0.7, 1.0, 40.0, 1e3, 12_345.6, 1e8])
def test_inversion_against_exact_quantiles(rate):
    rng = random.Random(int(rate))
    us = [2.0**-52, 0.5, 1 - 2.0**-52] + [rng.random() for _ in range(4 if rate > 1e6 else 40)]
    assert mixing.poisson_quantile(np.array(us), rate).tolist() == [exact_quantile(u, rate) for u in us]


def test_table_of_a_large_rate_is_small():
    first, below, _ = mixing.poisson_table(1e8)
    assert len(below) < 210_000 and first > 9e7
    assert mixing.poisson_quantile(np.array([0.3]), 0.0).tolist() == mixing.poisson_quantile(np.array([0.3]), float("nan")).tolist() == [0]


def test_a_source_of_few_documents_is_exploded_in_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(i, f"t{i}", "big") for i in range(2000)] + [(5000, "x", "small"), (5001, None, "small"), (None, "y", "small")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mix_step int, mix_copy string")
    got = mixing.mix_sources(df, {"big": 1.0, "small": 20.0}, 21_000).collect()
    assert Counter(r["doc_id"] for r in got) == draws(rows, {"big": 1.0, "small": 20.0}, 21_000)
    copies = defaultdict(list)
    for r in got:
        copies[r["doc_id"]].append(r["mix_copy"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    assert min(len(copies[d]) for d in (5000, 5001, None)) > 6000


def test_rows_are_read_once_for_the_shuffle(spark):
    """The order is a hash: no range partitioning, whose sampling would run the explode twice."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    plan = mixing.mix_sources(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(mix_order" in plan


def test_long_and_repeated_rows_with_clashing_columns(spark):
    rows = [(1, "long " * 200_000, "a"), (2, "x", "b"), (2, "x", "b"), (3, "", "a"), (3, None, "a"), (None, None, None)]
    names = ["mix_rate", "mix_copy", "mix_source", "mix_n", "mix_step", "mix_order"]
    df = spark.createDataFrame([(*r, *range(6)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix_sources(df, total=60).collect()
    assert Counter(r["doc_id"] for r in got) == draws(rows, total=60)
    assert all(len(r["text"]) == 1_000_000 for r in got if r["doc_id"] == 1)


def place(node, key, seed=29):
    while node.children:
        kids = [c for c in node.children if c.total > 0]
        node = kids[0] if len(kids) == 1 else min(kids, key=lambda c: -math.log(1 - uniform(seed, c.name, key)) / c.total)
    return node.shard


def test_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(i, "é" * (i % 9)) for i in range(800)] + [(3, "again"), (None, None), (None, "x"), (801, None)] + [(7, "many")] * 300 + [(None, f"m{k}") for k in range(170)]
    tree = sharding.even_tree(8)
    more = sharding.grown(tree, 8)
    got = sharding.shards(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int"), tree, more).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place(tree, d), place(more, d)) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert 0.05 < sum(r["grown_shard"] == 8 for r in got if r["doc_id"] not in (7, None)) / 800 < 0.17
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string"), tree).count() == 0


def test_trees_of_consecutive_counts_obey_the_law():
    """A key that moves goes to the new shard, whether the tree was grown or built for its count."""
    keys = range(4000)
    before = [place(sharding.even_tree(8), k) for k in keys]
    for n in (9, 10, 13):
        assert sharding.even_tree(n) == sharding.grown(sharding.even_tree(n - 1), n - 1)
    for n in (9, 10, 11):
        after = [place(sharding.even_tree(n), k) for k in keys]
        assert {y for x, y in zip(before, after, strict=True) if x != y} == {n - 1}
        assert max(Counter(after).values()) < 1.35 * len(keys) / n
        before = after


def test_shards_of_long_and_repeated_rows_with_clashing_columns(spark):
    rows = [(1, "é" * 500_000), (2, "x"), (2, "x"), (2, "y"), (None, ""), (None, "")]
    names = ["size", "text_crc32", "slot", "order", "bucket", "base", "rank", "key", "grown_shard"]
    df = spark.createDataFrame([(*r, *range(9)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    tree = sharding.even_tree(8)
    got = sharding.shards(df, tree, sharding.grown(tree, 8)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode()), place(tree, d)) for d, t in rows)
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_changed_weights_move_rows_in_their_subtree_only(spark):
    leaf = lambda k, w: sharding.Node(f"shard{k}", w, k)
    tree = lambda w: sharding.Node("root", children=(sharding.Node("a", children=(leaf(0, 1.0), leaf(1, 1.0))), sharding.Node("b", children=(leaf(2, w), leaf(3, 4.0 - w)))))
    before, after = ([place(tree(w), k) for k in range(5000)] for w in (2.0, 3.0))
    moved = {(x, y) for x, y in zip(before, after, strict=True) if x != y}
    assert moved == {(3, 2)}
