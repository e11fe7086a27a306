import math

import numpy as np
import pytest

from textloom.llm import int8_near as m


def brute(rows, t):
    ok = [l is not None and v and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, l in rows]
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    n = len(rows)
    near = {(i, j) for i in range(n) for j in range(n) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= t}
    comp = list(range(n))
    for _ in range(n):
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if comp[k] == comp[i] and rows[k][0] is not None]
        c = min(ids) if ids else d
        out.append((d, sum(a == i for a, _ in near), c, d is not None and c == d))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [16, 512])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(m, "TILE", tile)
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.3, 3])).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [1.0] * 24, None), (403, [float("nan")] * 24, 1), (404, [1.0, None], 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (407, [2.0, 4.0], 1), (None, [2.0, 4.1], 1), (408, [1e-200, 1e-200], 2), (409, [1e200, 1e200], 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, data int")
    got = sorted(map(tuple, m.near_embeddings(df, threshold=0.9).collect()), key=str)
    assert got == brute([r for r in rows if r[0] not in (408, 409)] + [(408, [1.0, 1.0], 2), (409, [1.0, 1.0], 2)], 0.9)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    u = m._norm(rng.normal(size=(400, 64)))
    u[200:] = m._norm(u[:200] + rng.normal(size=(200, 64)) * 0.05)
    exact = u @ u.T
    i, j, sure = (np.concatenate(x) for x in zip(*m.bracketed(m.quantised(u), m.quantised(u), 0.9), strict=True))
    assert {*zip(*np.nonzero(exact >= 0.9), strict=True)} <= {*zip(i, j, strict=True)}
    assert (exact[i, j] > 0.87).all()
    assert (exact[i, j][sure] >= 0.9).all() and 0.5 < sure.mean() < 1


def test_open_pairs_alone_are_fetched_and_tiles_are_small(spark, monkeypatch):
    """A group that lies right at the threshold, so that nearly all its pairs are left open; the payload of a tile."""
    monkeypatch.setattr(m, "TILE", 32)
    rng = np.random.default_rng(8)
    base = rng.normal(size=48)
    noise = 0.2744 * np.linalg.norm(base) / 48**0.5  # of cosines around 0.93
    rows = [(i, (base + rng.normal(size=48) * noise).tolist(), 1) for i in range(150)] + [(200 + i, rng.normal(size=48).tolist(), 1) for i in range(60)]
    got = m.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.93)
    want = brute(rows, 0.93)
    assert 0.2 < sum(n for _, n, _, _ in want) / 150 / 149 < 0.8
    assert sorted(map(tuple, got.collect()), key=str) == want
    q, step, bound = m.quantised(m._norm(rng.normal(size=(100, 64))))
    assert q.nbytes + step.nbytes + bound.nbytes + 2 * 8 * 100 <= 100 * (64 * 8 + 16) / 4


def test_no_rows(spark):
    assert m.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
