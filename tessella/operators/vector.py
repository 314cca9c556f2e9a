"""Exact nearest neighbours over vector columns.

For one query, distances are built-in expressions, so the scan stays in the JVM and the top k are kept by partition before they
meet. For many, queries are broadcast in blocks of at most BLOCK and meet batches of rows in matrix products, SLICE queries at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import QueryError
from tessella.sources.snapshots import written

BLOCK = 4096
SLICE = 128  # the queries whose distances to 2,048 rows are in memory at once: 2 MB, and a few times that while they are worked out
METRICS = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot": "dot", "dotproduct": "dot", "dot_product": "dot"}


def metric(name: str) -> str:
    if name.lower() not in METRICS:
        raise QueryError(f"unknown metric: {name}")
    return METRICS[name.lower()]


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def distance(v: Column, query: Sequence[float], name: str) -> Column:
    """Cosine: 1 - cos, 1 if either is zero. Euclidean. Dot: the negative product."""
    q = F.array(*[F.lit(float(x)) for x in query])
    name = metric(name)
    if name == "euclidean":
        return F.sqrt(_sum(v, q, lambda a, b: (a - b) * (a - b)))
    dot = _sum(v, q, lambda a, b: a * b)
    if name == "dot":
        return -dot
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) * F.lit(sum(x * x for x in query) ** 0.5)
    return F.when(norm == 0, F.lit(1.0)).otherwise(1.0 - dot / norm)


def index(docs: DataFrame, field: str, dimension: int) -> DataFrame:
    """(_id, v) of the documents whose field is a numeric vector of that dimension."""
    kind = docs.schema[field].dataType if field in docs.columns else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        v = F.col(f"`{field}`").cast("array<double>")
    elif "fields" in docs.columns:
        v = F.try_element_at(F.col("fields"), F.lit(field))["v"]
    else:
        v = F.lit(None).cast("array<double>")
    # a null inside makes it no vector
    return docs.select("_id", v.alias("v")).where((F.size("v") == dimension) & ~F.exists("v", lambda x: x.isNull()))


def search(idx: DataFrame, query: Sequence[float], k: int, name: str = "cosine") -> DataFrame:
    """(_id, distance) of the k nearest, the nearest first, then by id."""
    return idx.select("_id", distance(F.col("v"), query, name).alias("distance")).orderBy("distance", "_id").limit(k)


def matrix(col: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a list column, all of that dimension, as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def distances(q: np.ndarray, x: np.ndarray, name: str) -> np.ndarray:
    """Of each row of q to each row of x, as distance() has them."""
    dot = q @ x.T
    if name == "dot":
        return -dot
    if name == "euclidean":
        near = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * dot, 0)
        close = np.nonzero(near < 1e-6 * (1 + (q * q).sum(1)[:, None]))  # where the difference of squares isn't exact
        near[close] = ((q[close[0]] - x[close[1]]) ** 2).sum(1)
        return np.sqrt(near)
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
    return np.where(norm == 0, 1.0, 1.0 - dot / np.where(norm == 0, 1.0, norm))


class Best:
    """The k nearest rows so far of each query; ties go to the least id."""

    def __init__(self, queries: int, k: int):
        self.k, self.d, self.ids = k, [np.zeros(0)] * queries, [np.zeros(0, object)] * queries

    def add(self, i: int, d: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(d <= self.d[i][-1]) if len(self.d[i]) == self.k else np.arange(len(d))
        if not len(near):
            return
        d, ids = np.concatenate([self.d[i], d[near]]), np.concatenate([self.ids[i], ids[near]])
        if len(d) > self.k:
            own = np.flatnonzero(d <= np.partition(d, self.k - 1)[self.k - 1])
            d, ids = d[own], ids[own]
        o = np.lexsort((ids.astype(str), d))[: self.k]
        self.d[i], self.ids[i] = d[o], ids[o]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        n = [len(x) for x in self.d]
        cols = [np.repeat(np.array(names, object), n), np.concatenate([*self.ids, np.zeros(0, object)]), np.concatenate([*self.d, np.zeros(0)])]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["query", "_id", "distance"])


def by_block(queries: DataFrame, block: int, search: Callable[[list[str], np.ndarray], DataFrame], k: int) -> DataFrame:
    """(query, _id, distance) of the k nearest, from search(ids, vectors) of each block of queries, a row for each task's k nearest."""
    parts = -(-queries.count() // block)
    parts = parts * 5 // 4 if parts > 1 else parts
    out = None
    for i in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) == i).select("_id", "v").orderBy("_id").collect()
        if rows:
            one = search([r[0] for r in rows], np.array([r[1] for r in rows], np.float64))
            best = one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "_id"))).where(F.col("rank") <= k).drop("rank")
            best = written(best, "nearest") if parts > 1 else best
            out = best if out is None else out.union(best)
    return queries.sparkSession.createDataFrame([], "query string, _id string, distance double") if out is None else out


def nearest(idx: DataFrame, queries: DataFrame, k: int, name: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(query, _id, distance) of the k nearest rows of idx to each row of queries, both (_id, v) of one dimension."""
    name = metric(name)

    def search(ids: list[str], q: np.ndarray) -> DataFrame:
        b = idx.sparkSession.sparkContext.broadcast((ids, q))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = b.value
            best = Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    piece = batch.slice(at, 2048)
                    own, x = piece.column(0).to_numpy(zero_copy_only=False), matrix(piece.column(1), q.shape[1])
                    for first in range(0, len(q), SLICE):
                        for i, d in enumerate(distances(q[first : first + SLICE], x, name), first):
                            best.add(i, d, own)
            yield best.batch(ids)

        return idx.select("_id", "v").mapInArrow(part, "query string, _id string, distance double")

    return by_block(queries, block, search, k)
