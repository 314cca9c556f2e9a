from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tessella.llm import linedup as ld

A, B, C, D = (f"This is a whole line number {x} of some text." for x in "abcd")


def brute(docs: list[tuple[int, str]]) -> dict[int, str]:
    """Each document aligned with every earlier one."""
    out = {}
    split = {i: [x.strip() for x in t.split("\n")] for i, t in docs}
    for i, t in docs:
        gone = set()
        for j in (j for j in split if j < i):
            gone |= set(ld.dropped(split[j], split[i], [len(x) for x in split[i]]))
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_patience_keeps_order_and_deletes_from_the_later():
    assert ld.patience([1, 2, 3], [0, 1, 2, 9, 3]) == [(0, 1), (1, 2), (2, 4)]
    assert ld.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert ld.patience([5, 5, 7], [5, 7, 5]) == [(0, 0), (2, 1)] or ld.patience([5, 5, 7], [5, 7, 5])[0] == (0, 0)
    assert ld.patience([], [1]) == []


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.integers(0, 6), max_size=12), hs.lists(hs.integers(0, 6), max_size=12))
def test_patience_is_an_alignment(a, b):
    pairs = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    unique = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    if a == b:
        assert len(pairs) == len(a)
    elif unique:
        assert pairs


def test_line_hashes_ignore_surrounding_space():
    h, n, per = ld.line_hashes(pa.array(["a b\n  a b \r\n\n\té", "", None, "x"]))
    assert per.tolist() == [4, 1, 1, 1]
    assert h[0] == h[1] and n.tolist() == [3, 3, 0, 1, 0, 0, 1]
    assert h[2] == h[4] == h[5]


@pytest.mark.parametrize("pool", ["long", "short", "both"])
def test_against_brute_force(spark, pool):
    rng = random.Random(4)
    long = [f"Shared line {i} with enough characters in it" for i in range(12)]
    short = [f"verse {i}" for i in range(8)] + ["", "ok"]
    pool = {"long": [*long, "short", ""], "short": short, "both": long[:5] + short}[pool]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"Own {rng.random() if rng.random() < 0.5 else rng.randint(0, 9)}" for _ in range(rng.randint(1, 9)))) for i in range(100)]
    out = {r.doc_id: r.text for r in ld.dedup(frame(spark, [(i, t, "en", "s", len(t)) for i, t in docs])).collect()}
    assert out == brute(docs)


@settings(max_examples=300, deadline=None)
@given(hs.lists(hs.integers(0, 30), max_size=15), hs.integers(0, 14), hs.integers(1, 15))
def test_every_line_of_a_block_lies_in_a_key_within_it(n, first, size):
    h = np.arange(7, 7 + len(n))
    _, a, b, per = ld.keys_of(h, np.array(n, np.int32), np.array([0, len(n)]))
    assert per.tolist() == [0, len(a)] and all(sum(n[i : j + 1]) >= ld.MIN_CHARS for i, j in zip(a, b))
    block = range(first, min(first + size, len(n)))
    if sum(n[i] for i in block) >= ld.MIN_CHARS:
        keys = [(i, j) for i, j in zip(a, b) if i >= block[0] and j <= block[-1]]
        assert all(any(i <= x <= j for i, j in keys) for x in block)


def test_equal_runs_have_equal_keys():
    text = "own\nverse one\nverse two\nverse three\nelse"
    k = [ld.keys_of(*ld.line_hashes(pa.array([t]))) for t in (text, "verse two\n verse three\nx")]
    assert len(set(k[0][0].tolist()) & set(k[1][0].tolist())) == 1


def test_stage_drops_whole_copies_and_keeps_the_rest(spark):
    docs = frame(spark, rows([f"{A}\n{B}", f"{C}\n{A}\n{B}\n{D}", f"{A}\n{B}", f"Fresh text that stands alone here\n{B}"]))
    out = {r.doc_id: r for r in ld.stage(spark, docs, "").collect()}
    assert set(out) == {0, 1, 3}
    assert out[1].text == f"{C}\n{D}" and out[1].n_chars == len(out[1].text)
    assert out[3].text == "Fresh text that stands alone here"


def test_short_shared_lines_stay(spark):
    out = ld.dedup(frame(spark, rows([f"ok\n{A}", f"ok\n{B}"]))).collect()
    assert {r.doc_id: r.lines_deleted for r in out} == {0: 0, 1: 0}


def test_narrow_ids(spark):
    docs = frame(spark, rows([f"{A}\n{B}", f"{A}\nNew text of the second document"])).withColumn("doc_id", F.col("doc_id").cast("int"))
    out = ld.stage(spark, docs, "")
    assert out.schema["doc_id"].dataType.simpleString() == "int"
    assert {r.doc_id: r.text for r in out.collect()}[1] == "New text of the second document"


def test_awkward_rows(spark):
    docs = frame(spark, awkward()).withColumnRenamed("source", "_gone").withColumnRenamed("lang", "key")
    out = ld.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert len([r for r in got if r.doc_id == 1]) == 2  # repeated rows are one document
    assert not [r for r in got if r.doc_id == 2]  # a copy of 1
    assert len([r for r in got if r.doc_id is None]) == 2
    assert len([r for r in got if r.doc_id in (3, 4, 5)]) == 3
    assert ld.dedup(docs).count() == docs.count()
    assert ld.stage(spark, frame(spark, []), "").count() == 0


def test_lines_that_the_earliest_holder_has_elsewhere(spark):
    turned, twice = "\n".join([D, C, B, A]), f"{A}\n{B}\n{A}"
    for texts in ([f"{A}\n{B}\n{C}\n{D}", turned, turned], [A, twice, twice]):
        out = {r.doc_id: r.lines_deleted for r in ld.dedup(frame(spark, rows(texts))).collect()}
        assert out[2] == len(texts[2].split("\n"))
