from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, rows, sentence, vocabulary

from tessella.llm import langid


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    voc = {k: vocabulary(rng, s) for k, s in (("aa", "abcdefg"), ("bb", "nopqrst"), ("cc", "éèàùçöü"))}
    texts, langs = [], []
    for i in range(360):
        k = ("aa", "bb", "cc")[i % 3]
        texts.append(" ".join(sentence(rng, rng.randint(5, 20), voc[k]) for _ in range(rng.randint(1, 8))))
        langs.append(k)
    return texts, langs


def test_held_out_accuracy_and_rejection(spark, corpus):
    texts, langs = corpus
    model = langid.fit(frame(spark, rows(texts[:240], langs[:240])), per_language=60)
    name, cos, ok = langid.predict(model, pa.array(texts[240:]))
    assert (name == np.array(langs[240:])).mean() > 0.98
    assert ok.mean() > 0.98
    _, _, ok = langid.predict(model, pa.array(["xyzzy wvk hjkl zyx " * 20, "12345 67890", "", None]))
    assert not ok.any()


def test_counts_match_brute_force():
    text = "Ab, c  déf"
    tf, letters = langid.counts(pa.array([text, None, ""]))
    body = b"ab c d\xc3\xa9f"
    assert letters.tolist() == [7, 0, 0]
    assert tf[0].sum() == sum(max(0, len(body) - n + 1) for n in (1, 2, 3))
    assert tf[1].sum() == tf[2].sum() == 0


def plain(text: str) -> dict[int, int]:
    """Term counts of a text by bucket, byte by byte."""
    low, x = text.lower().encode(), []
    is_letter = lambda c: 97 <= c <= 122 or c >= 128
    for i, c in enumerate(low):
        if is_letter(c):
            x.append(c)
        elif i and is_letter(low[i - 1]):
            x.append(32)
    out = {}
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            code = int.from_bytes(bytes(x[i : i + n]), "big") + (n << 24)
            b = (code * 2654435761 % 2**32) >> 20
            out[b] = out.get(b, 0) + 1
    return out


def test_prediction_against_brute_force(spark, corpus):
    texts, langs = corpus
    model = langid.fit(frame(spark, rows(texts[:240], langs[:240])), per_language=60)
    own = [*texts[240:280], "abc", "xyzzy hjkl", "é", "abc nop " * 30]
    got = langid.predict(model, pa.array(own))
    df = {}
    for t in texts[:240]:
        for b in plain(t):
            df[b] = df.get(b, 0) + 1
    for text, name, cos, ok in zip(own, *got):
        v = {b: math.log1p(n) * (math.log(241 / (1 + df.get(b, 0))) + 1) for b, n in plain(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        best = max(sum(x * float(c[b]) for b, x in v.items()) / norm for c in model["centroids"])
        assert abs(best - cos) < 1e-4
        letters = sum(97 <= c <= 122 or c >= 128 for c in text.lower().encode())
        bound = model["bound"][min(int(math.log2(letters)), 20)]
        assert ok == (1 - best <= bound) or abs(1 - best - bound) < 1e-4
        near = [k for k, c in zip(model["names"], model["centroids"]) if sum(x * float(c[b]) for b, x in v.items()) / norm > best - 1e-5]
        assert name in near


def test_the_first_language_by_name_wins_a_tie(corpus):
    text = corpus[0][0]
    tf, _ = langid.counts(pa.array([text]))
    v = langid.vectors(tf, np.ones(langid.DIM, np.float32))
    model = {"idf": np.ones(langid.DIM, np.float32), "centroids": np.concatenate([v, v]), "names": ["aa", "bb"], "bound": np.zeros(21) + 1e-6}
    assert langid.predict(model, pa.array([text]))[0].tolist() == ["aa"] and langid.predict(model, pa.array([text]))[2].all()


def test_counts_beyond_16_bits_train_unclipped(spark):
    docs = frame(spark, rows(["ab " * 70_000, "xyz " * 10], ["aa", "bb"]))
    _, _, tf, _ = langid._sample(docs, 5)
    assert tf.max() > 65_535


def test_document_frequencies_cover_all_documents(spark, corpus):
    texts, langs = corpus
    df, n = langid._frequencies(frame(spark, rows(texts, langs)))
    tf, _ = langid.counts(pa.array(texts))
    assert n == len(texts)
    assert (df == (tf > 0).sum(0)).all()


def test_awkward_rows(spark, corpus):
    docs = frame(spark, rows(*corpus, first=100) + awkward()).withColumnRenamed("source", "language")
    out = langid.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert not [r for r in got if r.text is None or not r.text.strip()]
    assert len([r for r in got if (r.doc_id or 0) >= 100]) >= 355
    assert langid.identify(docs, langid.fit(docs)).columns == ["doc_id", "language", "cosine"]


def test_empty_and_unlabelled(spark, corpus):
    none = frame(spark, [])
    assert langid.stage(spark, none, "").count() == 0
    bare = frame(spark, rows(corpus[0][:5], [None] * 5))
    assert langid.stage(spark, bare, "").count() == 0


@pytest.mark.parametrize("letters", [20, 60, 120])
def test_foreign_and_junk_texts_of_any_length_are_rejected(spark, corpus, letters):
    texts, langs = corpus
    model = langid.fit(frame(spark, rows(texts[:240], langs[:240])), per_language=60)
    rng = random.Random(letters)
    junk = [" ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(letters // 5)) for s in ("hijkmuvwxyz", "абвгдежзик") for _ in range(20)]
    junk += ["".join(rng.choice(s) for _ in range(letters)) for s in ("的一是不了人我在", "ABCDXYZabcdhijkxyz0123456789+/") for _ in range(20)]
    assert langid.predict(model, pa.array(junk))[2].mean() <= 0.02
    clean = [t for x in texts[240:] for t in langid.cuts(x) if letters // 2 < langid.counts(pa.array([t]))[1][0] <= letters]
    assert len(clean) > 60 and langid.predict(model, pa.array(clean))[2].mean() > 0.97
