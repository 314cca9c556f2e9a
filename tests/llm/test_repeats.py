from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from helpers import awkward, frame, rows, vocabulary

from tessella.llm import repeats as rp
from tessella.llm import textvec as tv


def brute(docs: dict[int, str]) -> dict[int, list[tuple[int, int]]]:
    words = {i: re.findall(r"\w+", t.lower()) for i, t in docs.items()}
    n = Counter(tuple(w[k : k + rp.LEAST]) for w in words.values() for k in range(len(w) - rp.LEAST + 1))
    out = {}
    for i, w in words.items():
        m = np.zeros(len(w) + 2, int)
        for k in range(len(w) - rp.LEAST + 1):
            if n[tuple(w[k : k + rp.LEAST])] > 1:
                m[k + 1 : k + 1 + rp.LEAST] = 1
        d = np.diff(m)
        if m.any():
            out[i] = list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(12)
    voc = vocabulary(rng, "abcdefg", 500)
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    passages = [make(n) for n in (49, 50, 51, 60, 90, 200)]
    docs = {}
    for i in range(120):
        w = make(rng.randint(0, 60))
        for _ in range(rng.choice((0, 1, 2))):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 50))
            w += p[a:] + make(rng.randint(0, 30))
        docs[i] = " ".join(w)
    docs[200], docs[201] = docs[5], docs[5] + " tail"
    docs[202] = " ".join(passages[4] + passages[4])  # within one document
    docs[203] = "the same word " * 60
    got = {r.doc_id: [(s.first, s.end) for s in r.stretches] for r in rp.repeats(frame(spark, [(i, t, "en", "s", len(t)) for i, t in docs.items()])).collect()}
    assert got == brute(docs)


def blocks_corpus(n: int, seed: int = 15) -> dict[int, str]:
    rng = random.Random(seed)
    voc = vocabulary(rng, "abcdefg", 500)
    passage, other = ([rng.choice(voc) for _ in range(k)] for k in (70, 90))
    make = lambda k: [rng.choice(voc) for _ in range(rng.randint(0, k))]
    docs = {i: " ".join(make(20) + passage[rng.randint(0, 15) :] + make(20) + (other if rng.random() < 0.1 else [])) for i in range(n)}
    docs[n] = " ".join(passage + other + passage)
    return docs


def test_blocks_of_a_large_group_find_the_same(spark, monkeypatch):
    docs = blocks_corpus(60)
    df = frame(spark, [(i, t, "en", "s", len(t)) for i, t in docs.items()])
    monkeypatch.setattr(rp, "BLOCK", 700)
    monkeypatch.setattr(rp, "BUNDLE", 300)
    assert rp._segments(rp._own(df)).select("lead", "block").distinct().count() > 5
    assert {r.doc_id: [(s.first, s.end) for s in r.stretches] for r in rp.repeats(df).collect()} == brute(docs)


def test_a_passage_that_very_many_hold_takes_linear_work(spark, monkeypatch):
    """Rows and words that are shuffled, with the number of holders."""
    monkeypatch.setattr(rp, "BLOCK", 20_000)
    seen = []
    for n in (2_000, 8_000):
        docs = blocks_corpus(n, 16)
        segments = rp._segments(rp._own(frame(spark, [(i, t, "en", "s", len(t)) for i, t in docs.items()])))
        marks = rp._marks(segments)
        seen.append((segments.select("block").distinct().count(), segments.count(), segments.selectExpr("sum(length(words))").first()[0], marks.where("places is not null").count()))
    assert seen[1][0] > 2 * seen[0][0] > 8
    assert all(b < 4.3 * a for a, b in zip(seen[0][1:], seen[1][1:]))


def test_matching_statistics_are_exact():
    rng = np.random.default_rng(0)
    for trial in range(40):
        x = rng.integers(0, 3, rng.integers(2, 120))
        if trial % 2:
            x = np.tile(x, 3)[:250]
        x = np.append(x, x.max() + 1)
        n = len(x)
        want = np.zeros(n, int)
        for i in range(n):
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and x[i + k] == x[j + k]:
                    k += 1
                want[i] = max(want[i], k)
        assert (rp.matching(x) == want).all()


def test_runs_are_fewer_than_words_in_repetitive_text():
    x = np.append(np.tile(np.random.default_rng(1).integers(0, 50, 200), 40), 99)
    heads, _, _, _ = rp.run_index(x)
    assert len(heads) < len(x) / 20


def test_winnowing_chooses_the_least_of_every_neighbourhood():
    rng = np.random.default_rng(2)
    per = np.array([0, 10, 49, 50, 51, 200])
    h = rng.integers(0, 2**63, per.sum()).astype(np.uint64)
    row, at, _ = rp.chosen(h, per)
    g, pos = tv.grams(h, per, rp.K)
    who = np.repeat(np.arange(6), per)[pos]
    w = rp.LEAST - rp.K + 1
    want = set()
    for r in range(6):
        own = g[who == r]
        want |= {(r, i + int(np.argmin(own[i : i + w]))) for i in range(len(own) - w + 1)}
    assert set(zip(row.tolist(), at.tolist())) == want


def test_awkward_rows(spark):
    docs = frame(spark, awkward()).withColumnRenamed("source", "lead").withColumnRenamed("lang", "hash")
    got = {r.doc_id: r.stretches for r in rp.repeats(docs).collect()}
    assert set(got) == {6} and [(s.first, s.end) for s in got[6]] == [(0, 20_000)]  # repeated rows are one document
    assert rp.repeats(frame(spark, [])).count() == 0
    one = frame(spark, rows([" ".join(f"w{i}" for i in range(80))] * 2))
    assert {r.doc_id: [tuple(s) for s in r.stretches] for r in rp.repeats(one).collect()} == {0: [(0, 80)], 1: [(0, 80)]}
