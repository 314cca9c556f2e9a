from __future__ import annotations

import random
import re

import numpy as np
import pytest
from helpers import awkward, frame, rows, sentence, vocabulary

from tessella.llm import decontam as dc


def words(t: str) -> list[str]:
    return re.findall(r"\w+", t.lower())


def distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(doc: str, item: str) -> int | None:
    d, k = words(doc), words(item)
    if not d or not k:
        return None
    best = min(distance(d[i : i + len(k)], k) for i in range(max(1, len(d) - len(k) + 1)))
    return best if best <= dc.allowed(len(k)) else None


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    voc = vocabulary(rng, "abcdefghijkl", 250)
    items = [sentence(rng, rng.randint(6, 45), voc) for _ in range(40)]
    docs = []
    for i in range(240):
        body = [rng.choice(voc) for _ in range(rng.randint(0, 80))]
        if i % 3:
            w = words(items[i % 40])
            for _ in range(int(rng.choice((0, 0.05, 0.1, 0.15, 0.2)) * len(w))):
                p, op = rng.randrange(len(w)), rng.random()
                w[p : p + 1] = [] if op < 0.3 else [rng.choice(voc)] if op < 0.7 else [w[p], rng.choice(voc)]
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append(" ".join(body))
    return docs, items


def test_recall_and_precision_against_brute_force(spark, planted):
    docs, items = planted
    want = {(i, j): e for i, d in enumerate(docs) for j, t in enumerate(items) if (e := brute(d, t)) is not None}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.leaks(frame(spark, rows(docs)), bench).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want) and len(want) > 80
    assert all(want[k] <= e for k, e in got.items())
    assert sum(want[k] == e for k, e in got.items()) >= 0.95 * len(got)
    assert dc.clean(frame(spark, rows(docs)), bench).count() == len(docs) - len({i for i, _ in got})


def test_edits_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 5, (80, 9)).astype(np.uint64), rng.integers(1, 5, (80, 7)).astype(np.uint64)
    na, nb = rng.integers(0, 10, 80), rng.integers(0, 8, 80)
    assert dc.edits(a, na, b, nb).tolist() == [distance(a[i, : na[i]].tolist(), b[i, : nb[i]].tolist()) for i in range(80)]


def test_edits_of_long_windows_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(1, 6, rng.integers(0, 90)).tolist(), rng.integers(1, 6, rng.integers(1, 90)).tolist()
        where = {None: len(b)}
        for i, w in enumerate(b):
            where[w] = where.get(w, 0) | 1 << i
        assert dc.one_edits(a, where) == distance(a, b)


def test_blocks_of_items_find_the_same_and_one_is_held_at_a_time(spark, planted, monkeypatch):
    docs, items = planted
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = frame(spark, rows([*docs[:60], None]))
    whole, left = sorted(map(tuple, dc.leaks(d, bench).collect())), sorted(r.doc_id for r in dc.clean(d, bench).collect())
    live, most, make = set(), [], type(spark.sparkContext).broadcast

    def counted(self, value):
        b = make(self, value)
        if isinstance(value, dc.Items):
            live.add(id(b))
            most.append(len(live))
            gone = b.destroy
            b.destroy = lambda *x: (live.discard(id(b)), gone(*x))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    for limits in ({"block": 18}, {"size": 2000}):
        assert sorted(map(tuple, dc.leaks(d, bench, **limits).collect())) == whole
        assert sorted(r.doc_id for r in dc.clean(d, bench, **limits).collect()) == left and 60 in left
    assert len(most) >= 12 and max(most) == 1 and not live


def changed(rng: random.Random, w: list[str], n: int, voc: list[str]) -> list[str]:
    w = list(w)
    for _ in range(n):
        p, op = rng.randrange(len(w)), rng.random()
        w[p : p + 1] = [] if op < 0.25 else [rng.choice(voc)] if op < 0.75 else [w[p], rng.choice(voc)]
    return w


def test_recall_of_long_items(spark):
    rng = random.Random(9)
    voc = vocabulary(rng, "abcdefghijkl", 2000)
    items = [[rng.choice(voc) for _ in range(k)] for k in (60, 100, 200, 400) for _ in range(10)]
    docs = [[rng.choice(voc) for _ in range(50)] + changed(rng, w, int(dc.allowed(len(w)) * rate), voc) + [rng.choice(voc) for _ in range(50)] for w in items for rate in (0.5, 0.9)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.leaks(frame(spark, rows([" ".join(d) for d in docs])), bench).collect()}
    assert all(i // 2 == j for i, j in got) and len(got) >= 0.95 * len(docs)
    for i, j in list(got)[:4]:
        assert got[i, j] == brute(" ".join(docs[i]), " ".join(items[j]))


def test_an_item_of_very_many_words(spark):
    rng = random.Random(10)
    voc = vocabulary(rng, "abcdefghijkl", 3000)
    item = [rng.choice(voc) for _ in range(10_000)]
    docs = [" ".join(item), " ".join(changed(rng, item, 30, voc)), " ".join(rng.choice(voc) for _ in range(12_000)), "x " + " ".join(item) + " y"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "a short item of six words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.leaks(frame(spark, rows(docs)), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 1)} and got[0, 1] == got[3, 1] == 0 and 0 < got[1, 1] <= 60


def test_awkward_rows(spark):
    item = "quick brown fox jumps over the lazy dog near the river"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, item)], "item_id long, text string")
    docs = frame(spark, awkward()).withColumnRenamed("source", "item_id").withColumnRenamed("lang", "edits")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()} == {(i, j) for i in (1, 2) for j in (1, 4)}
    out = dc.clean(docs, bench)
    assert out.columns == docs.columns
    assert out.count() == docs.count() - 4  # twice 1, 2, and the null doc_id with that text
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs, none).count() == 0 and dc.clean(docs, none).count() == docs.count()
    assert dc.leaks(frame(spark, []), bench).count() == 0 and dc.clean(frame(spark, []), bench).count() == 0
