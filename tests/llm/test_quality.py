from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import awkward, frame, rows, sentence, vocabulary

from tessella.llm import quality as ql


def corpus(n: int = 400):
    rng = random.Random(9)
    voc = vocabulary(rng, "abcdefghijklmno", 300)
    texts, labels = [], []
    for i in range(n):
        t = "\n".join(sentence(rng, rng.randint(6, 20), voc) for _ in range(rng.randint(2, 8)))
        kind = i % 4
        if kind == 1:
            t = t.replace(" ", "%%% ")
        elif kind == 2:
            w = t.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(("vilebad", "nastyword", "horridterm")))
            t = " ".join(w)
        texts.append(t)
        labels.append((i, int(kind != 1), int(kind == 2)))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    lab = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows(texts))
    model = ql.fit(docs, lab)
    assert len(model["lexicon"]) == 3
    kept = {r.doc_id for r in ql.judged(docs, model).collect()}
    good = {i for i, q, t in labels if q and not t}
    assert len(kept & good) >= 0.98 * len(good)
    assert len(kept - good) <= 0.05 * (len(texts) - len(good))


def test_monotonic_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 3)).astype(np.float32)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(3 * np.sin(6 * x[:, 0]) - 4 * x[:, 1] + x[:, 2])))).astype(float)
    trees = ql.boost(x, y, np.array([-1, -1, 0]), trees=30)
    base = rng.random((200, 3)).astype(np.float32)
    for j in (0, 1):
        grid = np.linspace(0, 1, 40, dtype=np.float32)
        s = []
        for g in grid:
            z = base.copy()
            z[:, j] = g
            s.append(trees.score(z))
        assert (np.diff(np.array(s), axis=0) <= 1e-9).all()
    assert ((trees.score(x) > 0) == y).mean() > 0.7


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((400, 4)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    t = ql.boost(x, y, np.zeros(4), trees=10)
    for r, s in zip(x[:50], t.score(x[:50])):
        want = t.base
        for f, th, left, v in zip(t.feature, t.threshold, t.left, t.value):
            at = 0
            while f[at] >= 0:
                at = left[at] + (r[f[at]] > th[at])
            want += v[at]
        assert abs(want - s) < 1e-9


def test_statistics_by_hand():
    x = ql.statistics(pa.array(["Aa bb bb.\nx 1", None, ""]), np.zeros(0, np.uint64))
    got = dict(zip(ql.STATISTICS, x[0].tolist()))
    assert abs(got["words"] - np.log1p(5)) < 1e-6 and abs(got["distinct_words"] - 4 / 5) < 1e-6
    assert abs(got["top_word"] - 2 / 5) < 1e-6 and abs(got["repeated_word"] - 1 / 5) < 1e-6
    assert abs(got["closed_lines"] - 1 / 2) < 1e-6 and abs(got["digits"] - 1 / 13) < 1e-6
    assert np.isfinite(x).all()


def test_statistics_against_brute_force():
    rng = random.Random(17)
    voc = vocabulary(rng, "abcdefgh", 30) + ["Ab9", "%x", "-", "é"]
    texts = ["\n".join(" ".join(rng.choice(voc) for _ in range(rng.randint(0, 9))) + rng.choice(("", ".", "!")) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    bad = voc[:3]
    lexicon = np.sort(ql.tv.words(pa.array(bad))[0])
    for text, x in zip(texts, ql.statistics(pa.array(texts), lexicon)):
        w, raw = re.findall(r"\w+", text.lower()), text.encode()
        lines, n, size = [y for y in text.split("\n") if y], max(1, len(w)), max(1, len(raw))
        count, toxic = Counter(w), sum(y in bad for y in w)
        share = lambda f: sum(map(f, raw)) / size
        want = {
            "words": np.log1p(len(w)), "word_length": sum(len(y.encode()) for y in w) / n, "letters": share(lambda c: chr(c).isascii() and chr(c).isalpha() or c >= 128), "digits": share(lambda c: chr(c).isdigit() and c < 128),
            "symbols": share(lambda c: chr(c) in "#$%&*|<>{}[]=_~^\\@+/"), "space": share(lambda c: chr(c) in " \t\n\r\f\v"), "capitals": share(lambda c: 65 <= c <= 90), "lines": np.log1p(len(lines)),
            "closed_lines": sum(y[-1] in ".!?:;\"'" for y in lines) / max(1, len(lines)), "distinct_words": len(count) / n, "top_word": max(count.values(), default=0) / n, "repeated_word": sum(a == b for a, b in zip(w, w[1:])) / n,
            "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "toxic_share": toxic / n, "toxic_words": np.log1p(toxic),
        }
        assert np.allclose(x, [want[k] for k in ql.STATISTICS], atol=1e-5)


def test_a_stump_is_the_best_split_there_is(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, 3)).astype(np.float32)
    y = (rng.random(300) < np.where(x[:, 1] > 6, 0.8, 0.3)).astype(float)
    monkeypatch.setattr(ql, "DEPTH", 1)
    t = ql.boost(x, y, np.zeros(3), trees=1)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    best = max((sum((g[s].sum() ** 2) / (h[s].sum() + ql.L2) for s in (x[:, j] <= c, x[:, j] > c)), j, c) for j in range(3) for c in np.unique(x[:, j])[:-1] if ql.LEAST <= (x[:, j] <= c).sum() <= 300 - ql.LEAST)
    left = x[:, best[1]] <= best[2]
    want = np.log(p / (1 - p)) + ql.RATE * np.where(left, *(-g[s].sum() / (h[s].sum() + ql.L2) for s in (left, ~left)))
    assert np.allclose(t.score(x), want)


def test_threshold_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        y = (rng.random(200) < 0.6).astype(float)
        score = np.round(rng.normal(y, 0.7), 1)  # with ties
        cut = ql._threshold(score, y)
        kept, gone = (score[y == 1] >= cut).mean(), (score[y == 0] < cut).mean()
        assert kept >= ql.KEEP
        assert all(gone >= (score[y == 0] < c).mean() for c in np.unique(score) if (score[y == 1] >= c).mean() >= ql.KEEP)


def test_equal_texts_and_ties_with_the_threshold_stay_together(spark):
    texts, labels = corpus(200)
    docs = frame(spark, rows([*texts, texts[0], texts[0]]))
    model = ql.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    x = {r.doc_id: r.score for r in ql.judged(docs, {**model, "threshold": -np.inf}).collect()}
    assert x[0] == x[200] == x[201]
    assert {0, 200, 201} <= {r.doc_id for r in ql.judged(docs, {**model, "threshold": x[0]}).collect()}


def test_awkward_rows(spark):
    texts, labels = corpus(120)
    docs = frame(spark, rows(texts, first=0) + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward()]).withColumnRenamed("source", "score").withColumnRenamed("lang", "good")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = ql.judged(docs, ql.fit(docs, lab))
    assert out.columns == ["doc_id", "score"] and out.count() > 20
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ql.judged(docs, ql.fit(docs, none)).count() == docs.where("text != ''").count()
    assert ql.judged(frame(spark, []), ql.fit(frame(spark, []), lab)).count() == 0
