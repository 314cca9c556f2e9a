from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, rows, sentence, vocabulary

from tessella.llm import jaccard as jc


def grams(text: str) -> frozenset:
    w = re.findall(r"\w+", text.lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + jc.N]) for i in range(len(w) - jc.N + 1)) if len(w) >= jc.N else frozenset([tuple(w)])


def brute(docs: dict[int, str]) -> set[frozenset]:
    s = {i: grams(t) for i, t in docs.items()}
    own = {i: i for i in docs}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if s[i] and s[j] and len(s[i] & s[j]) >= jc.THRESHOLD * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                own[b] = a
    out = {}
    for i in ids:
        out.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def corpus(seed: int = 5, n: int = 60) -> dict[int, str]:
    rng = random.Random(seed)
    voc = vocabulary(rng, "abcdefghij", 400)
    docs, i = {}, 0
    shared = sentence(rng, 12, voc)
    for _ in range(n):
        base = [rng.choice(voc) for _ in range(rng.choice((2, 5, 20, 80, 400)))]
        docs[i] = " ".join(base) + (" " + shared if rng.random() < 0.4 else "")
        i += 1
        for _ in range(rng.choice((0, 0, 1, 3))):
            rate = rng.choice((0.0, 0.02, 0.08, 0.2))
            docs[i] = " ".join(rng.choice(voc) if rng.random() < rate else w for w in docs[i - 1].split())
            i += 1
    return docs


def found(docs) -> set[frozenset]:
    got = jc.groups(docs).groupBy("group_id").agg({"doc_id": "collect_set"}).collect()
    assert all(r.group_id == min(r[1]) for r in got)
    return {frozenset(r[1]) for r in got}


def partners(docs: dict[int, str]) -> dict[int, int]:
    s = {i: grams(t) for i, t in docs.items()}
    n = {i: sum(j != i and bool(s[j]) and len(s[i] & s[j]) >= jc.THRESHOLD * len(s[i] | s[j]) for j in docs) for i in docs if s[i]}
    return {i: k for i, k in n.items() if k}


@pytest.mark.parametrize("block", [4096, 5])
def test_groups_and_links_match_brute_force(spark, monkeypatch, block):
    """With hot tiles, and groups of several blocks, too."""
    monkeypatch.setattr(jc, "BLOCK", block)
    docs = corpus(5 + block)
    df = frame(spark, [(i, t, "en", "s", len(t)) for i, t in docs.items()])
    assert found(df) == brute(docs)
    got = {r.doc_id: r.links for r in jc.links(df).collect()}
    assert got == partners(docs)
    group = {i: len(g) - 1 for g in brute(docs) for i in g}
    assert any(got[i] < group[i] for i in got)  # not all of a group are partners


def test_pairs_that_share_nothing_but_a_hot_passage(spark, monkeypatch):
    """A passage that many texts hold, alone and in texts of twice its length: pairs at the threshold whose 40 least hashes tell nothing."""
    rng = random.Random(4)
    voc = vocabulary(rng, "abcdefghij", 900)
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    passage = make(102)
    docs = {i: " ".join(passage + make(100)) for i in range(400)}
    docs[1000] = " ".join(passage)
    monkeypatch.setattr(jc, "BLOCK", 64)
    got = {r.doc_id: r.links for r in jc.links(frame(spark, [(i, t, "en", "s", len(t)) for i, t in docs.items()])).collect()}
    assert got == partners(docs) and got[1000] == 400


def test_keys_of_any_two_sets_at_the_threshold_meet():
    rng = np.random.default_rng(6)
    for _ in range(500):
        both, a, b = rng.integers(1, 60), rng.integers(0, 40), rng.integers(0, 40)
        own = rng.permutation(1 << 16)[: both + a + b].astype(np.uint64)
        level = {int(x): int(k) for x, k in zip(own, rng.integers(0, 4, len(own)))}
        sets = [np.sort(np.concatenate([own[:both], own[both : both + a]])), np.sort(np.concatenate([own[:both], own[both + a :]]))]
        level |= {int(x): max(1, level[int(x)]) for x in own[:both]}
        n = np.array([len(x) for x in sets])
        g, per = jc.keys(np.concatenate(sets), n, np.array([level[int(x)] for x in np.concatenate(sets)]))
        if both >= jc.THRESHOLD * (both + a + b):
            assert set(g[: per[0]].tolist()) & set(g[per[0] :].tolist())


def test_hot_keys_go_from_sets_that_have_others(spark, monkeypatch):
    rng = random.Random(21)
    voc = vocabulary(rng, "abcdefghij", 600)
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    passage = make(60)
    docs = {i: make(rng.randint(300, 600)) + passage for i in range(60)}
    for i in range(0, 40, 2):
        docs[100 + i] = [rng.choice(voc) if rng.random() < 0.12 else w for w in docs[i]]
        docs[200 + i] = passage + make(rng.randint(0, 8))  # hardly more than the passage
    docs = {i: " ".join(w) for i, w in docs.items()}
    monkeypatch.setattr(jc, "BLOCK", 10)
    df = frame(spark, [(i, t, "en", "s", len(t)) for i, t in docs.items()])
    sets = jc.tv.written(jc.profiles(df).withColumn("band", jc.F.lit(0)).dropDuplicates(["sig"]), "sets")
    keys = dict(sets.select("sig", jc.F.size("tiles")).collect())
    met, hot = jc._met(sets).where("band = 0 and i = 0 and j = 0").groupBy("sig").count(), sets.select(jc.F.explode("tiles").alias("tile")).groupBy("tile").count().where("count > 10")
    assert hot.count() > 0 and met.count() < len(keys)  # sets without other partners have left
    assert found(df) == brute(docs)


def test_bound_never_rules_out_a_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)])
        sets = [np.unique(a), np.unique(b)]
        n = np.array([len(s) for s in sets])
        _, bits = jc.signatures(np.concatenate(sets), n)
        joined = len(np.intersect1d(*sets)) >= jc.THRESHOLD * len(np.union1d(*sets))
        g = jc.walk(n, bits)
        if joined:
            assert g[0] == g[1]


def test_sets_and_short_texts():
    g, n = jc.gram_sets(pa.array(["a b c d", "A, b; C d", "a b", "a", "", None, "a b c a b c"]))
    assert n.tolist() == [2, 2, 1, 1, 0, 0, 3]
    assert (g[:2] == g[2:4]).all()
    sig, _ = jc.signatures(g, n)
    assert sig[0] == sig[1] and len(set(sig.tolist())) == 5


def test_query_shape(spark, tmp_path):
    frame(spark, rows(["one two three four five"] * 3 + ["six seven eight nine ten"])).write.parquet(f"{tmp_path}/documents.parquet")
    out = jc.query(spark, str(tmp_path))
    assert sorted(map(tuple, out.select("doc_id", "group_id", "links").collect())) == [(0, 0, 2), (1, 0, 2), (2, 0, 2)]


def test_many_copies_are_one_group(spark):
    out = jc.groups(frame(spark, rows(["the same words again and again in order"] * 1500)))
    assert out.count() == 1500 and out.select("group_id").distinct().count() == 1


def test_awkward_rows(spark):
    docs = frame(spark, awkward()).withColumnRenamed("source", "sig").withColumnRenamed("lang", "_near_duplicate")
    out = jc.stage(spark, docs.withColumnRenamed("_near_duplicate", "group_id"), "")
    got = out.collect()
    assert len([r for r in got if r.doc_id == 1]) == 2 and not [r for r in got if r.doc_id == 2]
    assert len([r for r in got if r.doc_id is None]) == 2 and len([r for r in got if r.doc_id == 6]) == 2
    assert jc.stage(spark, docs, "").columns == docs.columns
    assert jc.stage(spark, frame(spark, []), "").count() == 0
