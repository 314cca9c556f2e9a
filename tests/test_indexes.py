from __future__ import annotations

import random

import numpy as np
import pytest

from tessella.errors import QueryError
from tessella.operators import ann, vector
from tessella.operators.indexes import TextIndex, VectorIndex


def test_text_index(spark, tmp_path):
    i = TextIndex(spark, "english")
    i.upsert("a", "The runners were running quickly")
    i.upsert("b", "A lazy dog")
    assert len(i) == 0  # not committed yet
    i.commit()
    assert [r["_id"] for r in i.search("run").collect()] == ["a"]
    i.upsert("a", "now a dog, too")
    i.remove(["b", "nobody"])
    i.commit()
    assert [r["_id"] for r in i.search("dog run").collect()] == ["a"] and len(i) == 1
    i.add(spark.createDataFrame([("c", "dogs run"), ("d", None)], "_id string, body string"), "body")
    i.save(f"{tmp_path}/t")
    assert {r["_id"] for r in TextIndex.load(spark, f"{tmp_path}/t", "english").search("dog").collect()} == {"a", "c"}


def test_vector_index_finds_itself_first(spark, tmp_path):
    rng = random.Random(1)
    vs = [(f"v{k:03}", [rng.uniform(-1, 1) for _ in range(8)]) for k in range(100)]
    for metric in ("cosine", "l2"):
        i = VectorIndex(spark, 8, metric)
        i.add(spark.createDataFrame(vs, "_id string, e array<double>"), "e")
        hits = i.search(vs[17][1], 3).collect()
        assert hits[0]["_id"] == "v017" and abs(hits[0].distance) < 1e-5 and len(hits) == 3
    i.upsert("v017", [9.0] * 8)
    i.remove(["v018"])
    i.commit()
    assert len(i) == 99 and i.search([9.0] * 8, 1).first()["_id"] == "v017"
    i.save(f"{tmp_path}/v")
    assert len(VectorIndex.load(spark, f"{tmp_path}/v", 8)) == 99
    with pytest.raises(QueryError):
        i.search([1.0])


def vectors(spark, n: int, d: int, seed: int, clustered: bool = False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (20, d))[rng.integers(0, 20, n)] + rng.normal(0, 0.3, (n, d)) if clustered else rng.uniform(-1, 1, (n, d))
    x[1] = x[0]  # a tie
    x[2] = 0
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(x.tolist())], "_id string, v array<double>"), x


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_nearest_of_many_queries_is_exact(spark, metric):
    idx, x = vectors(spark, 300, 8, 1)
    asked = idx.where("cast(_id as int) % 7 < 3")
    got = {}
    for r in vector.nearest(idx, asked, 5, metric, block=40).collect():
        got.setdefault(r.query, []).append((round(r.distance, 9), r["_id"]))
    assert len(got) == asked.count()
    for q, hits in got.items():
        one = vector.search(idx, x[int(q)].tolist(), 5, metric).collect()
        assert [i for _, i in sorted(hits)] == [r["_id"] for r in sorted(one, key=lambda r: (round(r.distance, 9), r["_id"]))]
    assert vector.nearest(idx, idx.where("false"), 5).count() == 0


@pytest.mark.parametrize("metric, d, clustered", [("cosine", 32, False), ("euclidean", 32, False), ("cosine", 64, True), ("dot", 16, True)])
def test_recall_of_the_approximate_index(spark, metric, d, clustered):
    idx, _ = vectors(spark, 1000, d, 2, clustered)
    i = ann.build(idx, metric)
    assert i.rows.count() == 1000 and len(i.centroids) == 31
    asked = idx.where("cast(_id as int) % 50 = 7")
    right = {(r.query, r["_id"]) for r in vector.nearest(idx, asked, 10, metric).collect()}
    found = {(r.query, r["_id"]) for r in i.nearest(asked, 10).collect()}
    assert len(right & found) >= 0.9 * len(right)
    assert {(r.query, r["_id"]) for r in i.nearest(asked, 10, probes=31).collect()} == right


def test_approximate_index_of_few_rows(spark):
    idx, _ = vectors(spark, 5, 4, 3)
    assert ann.build(idx).nearest(idx, 10).count() == 25
    assert ann.build(idx.where("false")).nearest(idx.where("false"), 3).count() == 0
