from __future__ import annotations

import base64
import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from helpers import awkward, frame, rows

from tessella.llm import bpe, textvec

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HARD = ["", "a", " ", "  ", "\n", "a  b", "a \n b", "it's we're 'tis don't'll  's x's't", "''s \"'re", "\n's", "x'", "x'r", "'ve'd", "日本語 テスト　です", "é à ü", "1234 abc12", "  \n\n  x  ", "🎉🎉 ok", "\t'll go", "end  ", "a" * 700, "<|endoftext|>", "٣٤٥ x²", "It’s", "ab" * 400]


def ranks(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ids_of(enc, texts):
    ids, n = enc.encode(*textvec.buffers(pa.array(texts)))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_equals_the_public_encoder(name):
    path = f"/opt/tokenizers/{name}.tiktoken"
    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice(" \n\t'abstrevldm10.,!é日") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    assert ids_of(bpe.Encoder(bpe.load(path)), texts) == [ref.encode_ordinary(t) for t in texts]


def test_pretokens_equal_the_pattern():
    rng = random.Random(6)
    texts = HARD + ["".join(rng.choice(" \n'sretvlmd.é9") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    data, offs = textvec.buffers(pa.array(texts))
    starts, per = bpe.pretokens(data, offs)
    end = np.cumsum(per)
    for i, t in enumerate(texts):
        own = starts[end[i] - per[i] : end[i]] - offs[i]
        want = [len(t[: m.start()].encode()) for m in regex.finditer(PATTERN, t)]
        assert own.tolist() == want, t


def test_brute_force_merging():
    v = bpe.load(bpe.VOCABULARY)
    r = ranks(bpe.VOCABULARY)
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode() for _ in range(300)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    ids, n = v.encode_many(data, end - [len(w) for w in words], end)
    for w, got in zip(words, np.split(ids, np.cumsum(n)[:-1])):
        parts = [w[i : i + 1] for i in range(len(w))]
        while len(parts) > 1:
            best = min((r.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(pairwise(parts)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert got.tolist() == [r[p] for p in parts]


def test_cache_overflow_changes_nothing():
    v = bpe.load(bpe.VOCABULARY)
    texts = [f"word{i} and {i}th other" for i in range(200)]
    assert ids_of(bpe.Encoder(v, cache=16), texts) == ids_of(bpe.Encoder(v), texts)


def test_collision_is_noticed():
    enc = bpe.Encoder(bpe.load(bpe.VOCABULARY))
    good = ids_of(enc, ["hello there"])
    enc.ids = enc.ids[::-1].copy()  # what was kept is wrong now
    assert ids_of(enc, ["hello there"]) == good


def test_round_trip_and_awkward_rows(spark):
    docs = frame(spark, awkward())
    out = bpe.encode(docs)
    got = out.collect()
    assert len(got) == docs.count()
    assert all((r.ids is None) == (r.n_tokens == 0 and r.ids is None) for r in got)
    assert [r for r in got if r.ids is None] and [r for r in got if r.ids == []]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted([tuple(r) for r in bpe.decode(out).collect()], key=key) == sorted([(r.doc_id, r.text) for r in docs.collect()], key=key)
    assert bpe.stage(spark, frame(spark, []), "").count() == 0


def test_columns_with_clashing_names(spark):
    docs = frame(spark, rows(["one two", None])).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    got = {r.doc_id: r for r in bpe.encode(docs).collect()}
    assert got[0].n_tokens == len(got[0].ids) > 1 and got[1].ids is None
