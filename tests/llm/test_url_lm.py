import math
import random
from collections import Counter

import numpy as np

from textloom.llm import url_lm as m
from textloom.llm.queries import URL_RULES

RULES = [m.Rule.parse(*r) for r in URL_RULES]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(t), t, v) for t, v in URL_RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "nohost", "http://", "HTTP://A.COM", "http://A.com/", "https://example.com/en/1?x://y/z", "http://www.EXAMPLE.com/en/a#b", "http://x.www.example.com/en/", "http://example.com/en", "http://notexample.com/en/", "ftp://a.net/es/x", "http://net/fr/", "http://a.net/fr?x", "http://ÄB.net/es/\nq", "a://b://c.com/d", "http://x.org?q=/a", "http://x.org#/a"]


def test_rules_and_parsing(spark):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    for r in m.filter_urls(df, RULES).collect():
        host, path = parse(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        text, verdict = rule(host, path)
        assert r["rule"] == text and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_model_against_counting(spark):
    good = [f"http://shop{i}.com/item/{w}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 40)]
    bad = [f"http://s{i}.net/es/win-cash-{w}" for i, w in enumerate(["now", "fast", "big", "free"] * 40)]
    open_ = ["http://q.org/item/alpha", "http://z.org/win-cash-free"] * 3
    rows = list(enumerate(good + bad + open_))
    got = m.filter_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(5), RULES).collect()
    for r in got:
        if r["page_id"] >= len(good + bad):
            assert r["verdict"] == ("allow" if "item" in rows[r["page_id"]][1] else "block")


def test_ratios_against_brute_force():
    texts = {0: ["abc", "abd", "abc"], 1: ["xbc"]}
    counts = np.zeros((2, 2, m.ORDER + 1, 1 << m.BITS))
    plain = {}
    for side, ts in texts.items():
        plain[side] = Counter()
        owner, slots, _ = m._slots(ts)
        for k, (c, b) in enumerate(slots):
            np.add.at(counts[side, 0, k], c, 1)
            np.add.at(counts[side, 1, k], b, 1)
        for t in ts:
            t = "\x01" * m.ORDER + t + "\x02"
            for i in range(m.ORDER, len(t)):
                for k in range(m.ORDER + 1):
                    plain[side][k, t[i - k : i]] += 1
                    plain[side][k, t[i - k : i], t[i]] += 1

    def log(side, text):
        t, total = "\x01" * m.ORDER + text + "\x02", 0.0
        for i in range(m.ORDER, len(t)):
            p = 1 / 256
            for k in range(m.ORDER + 1):
                p = (plain[side][k, t[i - k : i], t[i]] + m.PRIOR * p) / (plain[side][k, t[i - k : i]] + m.PRIOR)
            total += math.log(p)
        return total / (len(text) + 1)

    for t in ("abc", "xbd", "", "zzzz"):
        assert abs(m.Models(counts, 0).ratios([t])[0] - (log(0, t) - log(1, t))) < 1e-9


def test_no_rows(spark):
    assert m.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_more_ngrams_than_slots_of_a_table(spark):
    """Two lists of words, over 500,000 distinct runs: undecided URLs are told apart."""
    rng = random.Random(7)
    lists = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(12_000)] for _ in range(2)]
    urls = []
    for i in range(60_000):
        side = i % 2
        tail = "-".join(rng.choice(lists[side]) for _ in range(3))
        urls.append((i, f"http://{['q.org', ['a.com', 'a.net'][side]][i % 12 > 1]}/{['item', 'es'][side] if i % 12 > 1 else 'es'}/{tail}"))
    runs = np.unique(m._runs([u.split("://")[1] for _, u in urls])[0])
    assert len(runs) > 4 * 131_072
    right = [[], []]
    for r in m.filter_urls(spark.createDataFrame(urls, "page_id long, url string").repartition(4), RULES).where("rule is null").collect():
        right[r["page_id"] % 2].append(r["verdict"] == ("allow", "block")[r["page_id"] % 2])
    assert len(right[0]) == len(right[1]) == 5_000
    assert sum(np.mean(x) for x in right) / 2 >= 0.98


def test_scores_against_brute_force_with_and_without_rare_runs(spark, monkeypatch):
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['a.com', 'b.net', 'c.org'])}/{rng.choice(['es', 'fr', 'x'])}/" + "".join(rng.choices("abcdé", k=rng.randrange(12))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3).cache()
    side = {r["url"]: r["f"] for r in df.selectExpr("url", "pmod(xxhash64(url), 5) f").collect()}
    text = lambda u: "" if not u else "".join(parse(u))
    counts = [Counter(), Counter()]
    for u in urls:
        verdict = rule(*parse(u))[1]
        if verdict is None or side[u] == 0:
            continue
        t = b"\x01" * m.ORDER + text(u).encode() + b"\x02"
        for i in range(m.ORDER, len(t)):
            for k in range(m.ORDER + 1):
                counts[verdict == "block"].update([(k, t[i - k : i]), (k, t[i - k : i], t[i])])

    def score(u):
        t, total = b"\x01" * m.ORDER + text(u).encode() + b"\x02", 0.0
        for i in range(m.ORDER, len(t)):
            p = [1 / 256, 1 / 256]
            for k in range(m.ORDER + 1):
                p = [(c[k, t[i - k : i], t[i]] + m.PRIOR * q) / (c[k, t[i - k : i]] + m.PRIOR) for c, q in zip(counts, p, strict=True)]
            total += math.log(p[0]) - math.log(p[1])
        return total / (len(t) - m.ORDER)

    want = [score(u) for u in urls]
    for most in (1_000_000, 50, 0):
        monkeypatch.setattr(m, "BROADCAST_ROWS", most)
        got = {r["page_id"]: r["score"] for r in m.filter_urls(df, RULES).collect()}
        assert len(got) == len(urls) and all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


def test_calibrated_against_every_threshold():
    rng = random.Random(12)
    for _ in range(200):
        bins = [(rng.randrange(-12, 12) / 4, rng.random() < 0.5, rng.randrange(1, 6)) for _ in range(rng.randrange(1, 12))]
        good, bad = (max(1, sum(n for _, a, n in bins if a == side)) for side in (True, False))
        accuracy = lambda t: sum(n for e, a, n in bins if a and e >= t) / good + sum(n for e, a, n in bins if not a and e < t) / bad  # noqa: E731, B023
        best = max(accuracy(t / 8) for t in range(-30, 30) if any(e >= t / 8 for e, _, _ in bins))
        assert abs(accuracy(m.calibrated(bins)) - best) < 1e-12
    assert m.calibrated([]) == 0.0


def test_long_repeated_urls_and_clashing_columns(spark):
    long = "http://q.org/" + "item/" * 20_000
    rows = [(1, long), (1, long), (2, "http://a.com/item/"), (3, "http://a.net/es/win"), (None, long)] * 3
    df = spark.createDataFrame([(*r, *range(6)) for r in rows], "page_id long, url string, host int, path int, verdict int, score int, key int, side int").repartition(3)
    got = m.filter_urls(df, RULES).collect()
    assert Counter((r["page_id"], r["path"]) for r in got) == Counter((d, parse(u)[1]) for d, u in rows)
    assert len({r["score"] for r in got if r["path"] == parse(long)[1]}) == 1
