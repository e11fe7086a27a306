import hashlib
import random
import re
from collections import Counter

import pytest

from textloom.llm import debruijn as m
from textloom.llm.shared import Scratch, WordHashes


def brute(rows, size):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 10, 35])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    vocab = [f"w{i}" for i in range(8 if size < 10 else 60)] + ["É", "x," * 3]
    rows = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 34, 35, 36, 80, 300]))]
        if rows and rng.random() < 0.7:
            for _ in range(rng.choice([1, 1, 3])):
                src = (rng.choice(rows)[1] or "").split()
                a = rng.randrange(len(src) + 1)
                at = rng.randrange(len(w) + 1)
                w[at:at] = src[a : a + rng.choice([20, 35, 36, 50, 200])]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100, None), (101, ""), (5, rows[5][1]), rows[6], (None, rows[7][1]), (102, "a " * 4000)]
    df = spark.createDataFrame([(*r, "k", "p") for r in rows], "doc_id long, text string, key string, path string").repartition(4)
    assert sorted(map(tuple, m.repeated_words(df, size).collect()), key=str) == brute(rows, size)


def test_no_rows(spark):
    assert m.repeated_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert m.repeated_words(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1


def same_but_for(rng, n, *words):
    """Texts of n random words before and after one word in which alone they differ."""
    a, b = ([f"u{rng.randrange(10**6)}" for _ in range(n)] for _ in range(2))
    return [" ".join([*a, w, *b]) for w in words]


def test_colliding_hashes_remove_nothing_that_does_not_repeat(spark, monkeypatch):
    """Two words with one 64-bit hash: runs that hold them hash alike but differ, alone and beside a third text with a part of one."""
    forced = WordHashes()
    forced[b"foo"] = forced[b"bar"]
    monkeypatch.setattr(m, "WORDS", forced)
    rng = random.Random(4)
    rows = []
    for n in (3, 20, 40, 90):
        foo, bar = same_but_for(rng, n, "foo", "bar")
        w = bar.split()
        rows += [(len(rows), foo), (len(rows) + 1, bar), (len(rows) + 2, " ".join(["x", *w[max(0, n - 30) : n + 20], f"y{n}"]))]
        if n == 40:
            rows += [(len(rows), foo), (len(rows) + 1, bar + " and more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, m.repeated_words(df, 35).collect()), key=str) == brute(rows, 35)


def test_neighbours_are_compacted_into_maximal_nonbranching_paths(spark):
    """a to d always follow each other; x branches after e; the run of q cannot be its own successor; g stands once."""
    texts = {1: "abcd", 2: "zabcd", 3: "exf", 4: "exg", 5: "ex", 6: "qqq", 7: "qq"}
    rows = [(k, i, 1, ord(c), 0) for k, t in texts.items() for i, c in enumerate(t) if c not in "zg"]
    units = spark.createDataFrame(rows, "key long, start int, edges int, unit long, mini long")
    got = m._compacted(Scratch(spark, "t"), units).collect()
    assert Counter((r["key"], chr(r["chain"]), r["edges"]) for r in got) == Counter(
        {(1, "a", 4): 1, (2, "a", 4): 1, (3, "e", 2): 1, (3, "f", 1): 1, (4, "e", 2): 1, (5, "e", 2): 1, (6, "q", 1): 3, (7, "q", 1): 2}
    )
