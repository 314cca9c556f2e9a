from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import urlfilter as uf

DDL = "page_id long, url string, html string"


def pages(n: int = 600) -> list[tuple]:
    rng = random.Random(10)
    good = ["www.gardening.example.org", "blog.letters.example.com", "news.harbour.example.net"]
    bad = ["best-casino.example.net", "free-bets.example.com", "cheap-pills.example.org"]
    return [(i, f"https://{rng.choice(bad if i % 5 == 0 else good)}/p/{rng.randint(1, 99999)}{rng.choice(('', '.html', '?ref=x'))}", "") for i in range(n)]


def test_rejects_seeded_and_similar_hosts(spark):
    data = pages()
    out = {r.page_id for r in uf.accepted(spark.createDataFrame(data, DDL)).collect()}
    assert out == {i for i, _, _ in data if i % 5}


def test_generalises_beyond_the_seeds(spark):
    tables, threshold = uf.fit(spark.createDataFrame(pages(), DDL))
    s = uf.scores(tables, pa.array(["cheap-casin0.example.net/p/1", "www.gardening.example.org/p/77"]))
    assert s[0] < threshold <= s[1]


def test_scores_match_brute_force(spark):
    data = pages(80)
    tables, _ = uf.fit(spark.createDataFrame(data, DDL))
    url = "www.gardening.example.org/p/00"
    codes, who, size = uf._codes(pa.array([url]))
    want = 0.0
    for i in range(int(size[0])):
        p = [1 / 256, 1 / 256]
        for k in range(uf.ORDER + 1):
            g, c = codes[k][0][i], codes[k][1][i]
            for m in range(2):
                n = max(tables[m, k, 1][c], tables[m, k, 0][g])
                p[m] = (tables[m, k, 0][g] + uf.STRENGTH * p[m]) / (n + uf.STRENGTH)
        want += np.log(p[0]) - np.log(p[1])
    assert abs(uf.scores(tables, pa.array([url]))[0] - want / int(size[0])) < 1e-9


def test_awkward_rows(spark):
    data = pages(100) + [(1000, None, None), (1001, "", "x"), (None, data_url := "https://www.gardening.example.org/p/5", None), (1002, data_url, None), (1002, data_url, None), (1003, "x" * 50_000, None), (1004, "not a url é", None)]
    df = spark.createDataFrame(data, DDL).withColumnRenamed("html", "score")
    out = uf.accepted(df).collect()
    ids = [r.page_id for r in out]
    assert ids.count(1002) == 2 and None in ids and not {1000, 1001} & set(ids)
    one_class = spark.createDataFrame([(i, u, h) for i, u, h in pages(50) if i % 5], DDL)
    assert uf.accepted(one_class).count() == 40
    assert uf.accepted(spark.createDataFrame([], DDL)).count() == 0


def test_varied_urls_score_as_with_unhashed_counts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz-") for _ in range(rng.randint(3, 12)))
    data = [(i, f"{word()}.{word()}{rng.choice(('casino', 'poker')) if i % 10 == 0 else ''}.org/{word()}/{word()}-{word()}.html", "") for i in range(4000)]
    df = spark.createDataFrame(data, DDL)
    tables, _ = uf.fit(df)
    counts = [Counter(), Counter()]
    train = df.where(F.pmod(F.xxhash64("url"), F.lit(uf.HELD_OUT)) != 0).select("url", uf.seeded(F.col("url")).alias("bad"))
    for r in train.collect():
        s = "\1" * uf.ORDER + r.url + "\2"
        for i in range(uf.ORDER, len(s)):
            for k in range(uf.ORDER + 1):
                counts[r.bad].update(((k, s[i - k : i + 1]), (k, s[i - k : i], "")))
    fresh = [f"{word()}.{word()}.org/{word()}/{word()}.html" for _ in range(50)]
    want = []
    for url in fresh:
        s, total = "\1" * uf.ORDER + url + "\2", 0.0
        for i in range(uf.ORDER, len(s)):
            p = [1 / 256, 1 / 256]
            for k in range(uf.ORDER + 1):
                p = [(c[k, s[i - k : i + 1]] + uf.STRENGTH * q) / (c[k, s[i - k : i], ""] + uf.STRENGTH) for c, q in zip(counts, p)]
            total += np.log(p[0]) - np.log(p[1])
        want.append(total / (len(url) + 1))
    assert np.abs(uf.scores(tables, pa.array(fresh)) - want).max() < 1e-9


def test_labels_and_the_bound_of_the_fit(spark):
    data = pages(900)
    df = spark.createDataFrame(data, DDL)
    labels = spark.createDataFrame([(u, None if i == 3 else "gardening" not in u) for i, u, _ in data[:600]] + [(None, True)], "url string, accepted boolean")
    kept = {r.page_id for r in uf.accepted(df, labels).collect()}
    wrong = sum((i in kept) == ("gardening" in u) for i, u, _ in data)
    assert wrong < 0.03 * len(data)
    tables, _ = uf.fit(df, labels, per_class=30)
    assert tables.n[:, np.argsort(-tables.n.sum(0))[0]].max() <= 30 * max(len(u) for _, u, _ in data)
    one = [tables.of(uf._codes(pa.array([""]))[0][0][1])[c][0] for c in (0, 1)]  # every URL ends once and has its characters
    assert all(0 < n <= 30 * 60 for n in one)


def test_a_score_equal_to_the_threshold_stays(spark, monkeypatch):
    df = spark.createDataFrame(pages(200), DDL)
    tables, _ = uf.fit(df)
    s = float(uf.scores(tables, pa.array(["www.gardening.example.org/p/77"]))[0])
    monkeypatch.setattr(uf, "fit", lambda pages, labels=None: (tables, s))
    one = spark.createDataFrame([(1, "https://www.gardening.example.org/p/77", ""), (1, "HTTP://www.gardening.example.org/p/77", "")], DDL)
    assert uf.accepted(one).count() == 2


def test_every_example_counts_and_wide_counts_are_joined(spark, monkeypatch):
    """Far more rejected URLs than 50,000: each is counted. Counts that aren't broadcast give the same scores."""
    df = spark.range(70_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://free-casino.org/"), F.expr("translate(id, '0123456789', 'abcdefghij')")).alias("url"), F.lit("").alias("html"))
    df = df.unionByName(spark.createDataFrame(pages(300), DDL))
    tables, threshold = uf.fit(df)
    kept = df.where(F.pmod(F.xxhash64("url"), F.lit(uf.HELD_OUT)) != 0).groupBy(uf.seeded(F.col("url"))).count().collect()
    end = uf._codes(pa.array([""]))[0][0][0]  # "ends here", of no context: once in every URL
    assert [int(x) for x in tables.of(end)[:, 0]] == [r["count"] for r in sorted(kept, key=lambda r: r[0])]
    assert max(r["count"] for r in kept) > 50_000
    some = df.where("page_id < 600")
    want = sorted((r.page_id, r.url, r.score) for r in uf._scored(some.select("page_id", "url"), tables).collect())
    monkeypatch.setattr(uf, "BROADCAST", 10)
    wide, t = uf.fit(df)
    assert isinstance(wide, uf.Stored) and t == threshold
    got = sorted((r.page_id, r.url, r.score) for r in uf._scored(some.select("page_id", "url"), wide).collect())
    assert got == want
    one_class = spark.createDataFrame([(i, u, h) for i, u, h in pages(50) if i % 5], DDL)
    assert uf.accepted(one_class).count() == 40
