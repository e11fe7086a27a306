import random

import pytest

from textloom.llm import shared


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    for few in (0, 1_000_000):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", few)
        links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, k) for k in range(300, 400)] + [(k, k + 1) for k in range(600, 640)]
        links = [(a, b) for a, b in links if a != b]
        least = {x: x for link in links for x in link}
        for _ in least:
            changed = False
            for a, b in links:
                m = min(least[a], least[b])
                changed = changed or (least[a], least[b]) != (m, m)
                least[a] = least[b] = m
            if not changed:
                break
        got = shared.components(shared.Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
        assert {r["node"]: r["component"] for r in got} == least and len(got) == len(least)


def test_a_hub_is_split(spark, monkeypatch):
    """Joins of a hub with its written minimum: adaptive execution reports split partitions."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8192",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    plans = []

    class Watched(shared.Scratch):
        def keep(self, df, name, batch=2000):
            df.foreach(lambda _: None)
            plans.append(df._jdf.queryExecution().executedPlan())
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().keep(df, name, batch)

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rng = random.Random(1)
        links = [(0, k) for k in range(1, 20_000)] + [(rng.randrange(30_000, 40_000), rng.randrange(40_000, 50_000)) for _ in range(4000)]
        links = spark.createDataFrame(links, "a long, b long").repartition(16)
        assert shared.components(Watched(spark, "hub"), links).where("component = 0").count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert any("skew=true" in p for p in plans if isinstance(p, str))


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere"

    with pytest.raises(ValueError):
        shared.shared_folder(Cluster)
    Cluster.sparkContext.master = "local[2]"
    assert shared.shared_folder(Cluster).startswith("file:///")


def test_batches_are_restored_by_the_last(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    a, b = shared._batches(spark, 2000), shared._batches(spark, 500)
    a.__enter__(), b.__enter__()
    assert spark.conf.get(key) == "500"
    a.__exit__(None, None, None)
    assert spark.conf.get(key) == "500"
    b.__exit__(None, None, None)
    assert spark.conf.get(key) == before


def test_summed_rows(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(7)), rng.normal(size=3).astype("f4")) for _ in range(50)]
    want = np.zeros((9, 3))
    for k, v in rows:
        want[k] += v
    df = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in rows], "k long, data binary").repartition(5)
    assert np.allclose(shared.summed_rows(df, 9, 3), want)
    assert not shared.summed_rows(df.limit(0), 2, 3).any()
