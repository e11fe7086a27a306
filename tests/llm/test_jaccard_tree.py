import random

import numpy as np
import pytest

from textloom.llm import jaccard_tree as jt
from textloom.llm import shared
from textloom.llm.shared import shingles


def brute(rows, n_words, percent):
    import re

    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append({tuple(w[i : i + n_words]) for i in range(len(w) - n_words + 1)} if len(w) >= n_words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, count=120):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    rows = []
    shared = [rng.choice(words) for _ in range(40)]
    for i in range(count):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1].split() or ["x"]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30, 100, 400]))]
        if kind > 0.8:
            w = shared + w
        rows.append((i, rng.choice([" ", "\t", "\n "]).join(w)))
    return rows


@pytest.mark.parametrize(("n_words", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [8, 1024])
def test_against_brute_force(spark, monkeypatch, n_words, percent, block):
    """With blocks smaller than files, files found large by a sample, and joins that are not broadcast, and without."""
    monkeypatch.setattr(jt, "BLOCK", block)
    if block == 8:
        monkeypatch.setattr(jt, "SAMPLE", 60)
        monkeypatch.setattr(jt, "SAMPLE_LARGE", 2)
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    rows = corpus(block + percent)
    got = jt.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=n_words, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, n_words, percent)


def test_nulls_ties_extra_columns(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "A B C D"), (7, "  \n"), (8, "x" * 50000), (9, "w " * 20000), (10, "a b")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, n int, node int")
    assert sorted(map(tuple, jt.near_duplicates(df, n_words=3, percent=90).collect()), key=str) == brute(rows, 3, 90)
    assert jt.near_duplicates(df.limit(0)).count() == 0


def test_tree_drops_no_pair_that_can_link():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 63, 150).astype(np.uint64) for _ in range(10)]
    sets = []
    for i in range(300):
        v = base[i % 10].copy()
        k = rng.integers(0, 12)
        v[rng.integers(0, 150, k)] = rng.integers(0, 1 << 63, k).astype(np.uint64)
        sets.append(np.unique(v))
    sets.sort(key=len)
    t = pa.table({"node": list(range(300)), "n": [len(s) for s in sets], "home": [True] * 300, "bitmap": pa.array([jt.bitmap(s) for s in sets], pa.binary())})
    found = {(i, j) for a, b in jt.surviving(jt.Members(t, 90), np.array([0])) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    for j in range(300):
        for i in range(j):
            x = len(np.intersect1d(sets[i], sets[j]))
            if 100 * x >= 90 * (len(sets[i]) + len(sets[j]) - x):
                assert (i, j) in found
    assert len(found) < 300 * 299 / 4


def test_shingle_hashes_are_positional():
    a = shingles(b"a b c d e f g".split(), 5)
    assert len(a) == 3
    assert set(shingles(b"b c d e f".split(), 5)) < set(a)
    assert not set(shingles(b"c b d e f".split(), 5)) & set(a)
