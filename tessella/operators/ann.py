"""Approximate nearest neighbours: vectors dealt out to lists by their nearest centroid, of which a search reads a few.

The centroids come from k-means on at most ``sample`` vectors (those with the smallest hash of _id); every vector is in the index.
How many lists a search reads is calibrated on the same sample, so that they hold TARGET of the neighbours of its vectors. The
table is sorted by list, so a search skips the row groups of the other lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import QueryError
from tessella.operators import vector
from tessella.sources.snapshots import written

SAMPLE = 20_000
LISTS = 4096
TARGET = 0.97
PROBED = 512  # vectors of the sample that calibrate
_ROUNDS = 8


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """For cosine, directions alone count; for dot, lists are made by distance all the same."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def _order(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Lists in the order in which a search for each x reads them."""
    if metric == "dot":
        return np.argsort(-(x @ centroids.T), 1, kind="stable")
    return np.argsort((centroids * centroids).sum(1) - 2 * _unit(x, metric) @ centroids.T, 1, kind="stable")


def _list(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(1) - 2 * _unit(x, metric) @ centroids.T, 1)


@dataclass
class Index:
    rows: DataFrame  # list, _id, v
    centroids: np.ndarray
    probes: int
    metric: str

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, block: int = vector.BLOCK) -> DataFrame:
        """(query, _id, distance) of about the k nearest rows to each of queries (_id, v)."""
        n = min(probes or self.probes, len(self.centroids))

        def search(ids: list[str], q: np.ndarray) -> DataFrame:
            if q.shape[1] != self.centroids.shape[1]:
                raise QueryError(f"dimension mismatch: expected {self.centroids.shape[1]}, got {q.shape[1]}")
            asked: dict[int, list[int]] = {}
            for i, own in enumerate(_order(q, self.centroids, self.metric)[:, :n].tolist()):
                for c in own:
                    asked.setdefault(c, []).append(i)
            b, metric = self.rows.sparkSession.sparkContext.broadcast((ids, q, {c: np.array(i) for c, i in asked.items()})), self.metric

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, q, asked = b.value
                best = vector.Best(len(ids), k)
                for batch in batches:
                    for at in range(0, batch.num_rows, 2048):
                        piece = batch.slice(at, 2048)
                        where, own, x = piece.column(0).to_numpy(), piece.column(1).to_numpy(zero_copy_only=False), vector.matrix(piece.column(2), q.shape[1])
                        for c in np.unique(where).tolist():
                            if c in asked:
                                sel = np.flatnonzero(where == c)
                                for i, d in zip(asked[c], vector.distances(q[asked[c]], x[sel], metric)):
                                    best.add(i, d, own[sel])
                yield best.batch(ids)

            rows = self.rows if len(asked) == len(self.centroids) else self.rows.where(F.col("list").isin(sorted(asked)))
            return rows.select("list", "_id", "v").mapInArrow(part, "query string, _id string, distance double")

        return vector.by_block(queries, block, search, k)


def _centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """k-means, seeded with rows spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(_ROUNDS):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        n = np.bincount(own, minlength=lists)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


def _probes(x: np.ndarray, c: np.ndarray, metric: str, k: int = 10) -> int:
    """How many lists hold TARGET of the k nearest of vectors of the sample."""
    own, step = _list(x, c, metric), max(1, len(x) // PROBED)
    places = []
    for i in range(0, len(x), step):
        near = np.argsort(vector.distances(x[i : i + 1], x, metric)[0], kind="stable")[: k + 1]
        turn = np.empty(len(c), int)
        turn[_order(x[i : i + 1], c, metric)[0]] = np.arange(len(c))
        places.append(turn[own[near[near != i][:k]]])
    places = np.concatenate(places) if places else np.zeros(1, int)
    return int(np.quantile(places, TARGET, method="higher")) + 1 if len(places) else 1


def build(idx: DataFrame, metric: str = "cosine", lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of (_id, v). An empty table gives an index that finds nothing."""
    metric, spark = vector.metric(metric), idx.sparkSession
    n = idx.count()
    rows = idx.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(min(sample, max(n, 1))).select("v").collect()  # at most sample rows
    x = np.array([r[0] for r in rows], np.float64) if rows else np.zeros((1, 1))
    lists = max(1, min(lists or int(n**0.5), LISTS, len(x)))
    c = _centroids(_unit(x, metric), lists)
    b = spark.sparkContext.broadcast(c)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _list(vector.matrix(batch.column(1), b.value.shape[1]), b.value, metric) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), batch.column(1)], ["list", "_id", "v"])

    dealt = idx.select("_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(part, "list int, _id string, v array<double>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a list may be large: its rows are spread over several tasks
    table = written(dealt.repartition(parts, "list", F.pmod(F.xxhash64("_id"), F.lit(8))).sortWithinPartitions("list"), "lists")
    return Index(table, c, _probes(x, c, metric), metric)
