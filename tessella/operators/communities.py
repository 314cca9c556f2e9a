"""Community detection by Louvain local moves and by label propagation.

Both visit vertices one after another in the order of their ids and act on what they have done so far, so they run
within one task, which holds the graph as arrays of numbers, and names as Arrow has them. ``synchronous`` is the distributed form of label propagation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import weighted
from tessella.sources.snapshots import written


class Graph:
    """Vertices numbered in the order of their names, and each one's neighbours in arrays, in the order of the edges."""

    def __init__(self, src: pa.Array, dst: pa.Array, weight: np.ndarray | None = None):
        """With weights, edges between the same two vertices are one, of the sum of their weights; loops join nothing."""
        coded = pa.chunked_array([src, dst]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.names, n = coded.dictionary.take(pa.array(order)), len(order)
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        ends = rank[coded.indices.to_numpy()]
        a, b = ends[: len(src)], ends[len(src) :]
        del coded, ends
        o = np.lexsort((b, a))
        o = o[a[o] != b[o]]
        a, b = a[o], b[o]
        v, u = np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel()
        w = None if weight is None else np.repeat(weight[o], 2)
        o = np.argsort(v, kind="stable")
        v, u, w = v[o], u[o], None if w is None else w[o]
        if w is not None and len(v):
            pair = v.astype(np.int64) * n + u
            _, first, at = np.unique(pair, return_index=True, return_inverse=True)
            if len(first) < len(pair):
                w, keep = np.bincount(at, w), np.argsort(first)
                v, u, w = v[first[keep]], u[first[keep]], w[keep]
        self.n, self.to, self.weight = n, u, w
        self.start = np.searchsorted(v, np.arange(n + 1))


def louvain(g: Graph, max_iter: int = 10, resolution: float = 1.0) -> np.ndarray:
    """The community of each vertex, as the number of its label. Of equal gains the least label wins."""
    own, start = np.arange(g.n, dtype=np.int32), g.start
    # sums from the left, as the moves below have them
    k = np.bincount(np.repeat(np.arange(g.n), np.diff(start)), g.weight, g.n)
    total = k.copy()
    twice = sum(k.tolist())
    if twice <= 0:
        return own
    for _ in range(max_iter):
        moved = False
        for v in range(g.n):
            lo, hi = start[v], start[v + 1]
            if lo == hi:
                continue
            here, kv = int(own[v]), float(k[v])
            links: dict[int, float] = {}
            for c, w in zip(own[g.to[lo:hi]].tolist(), g.weight[lo:hi].tolist()):
                links[c] = links.get(c, 0.0) + w
            f = resolution * kv / twice
            stay = links.get(here, 0.0) - f * (float(total[here]) - kv)
            best, to = 0.0, here
            for c in sorted(links):
                if c != here and (gain := links[c] - f * float(total[c]) - stay) > best + 1e-12:
                    best, to = gain, c
            if to != here:
                total[here] -= kv
                total[to] += kv
                own[v], moved = to, True
        if not moved:
            break
    return own


def label_propagation(g: Graph, max_iter: int = 10) -> np.ndarray:
    """The label of each vertex, as its number: the most frequent of its neighbours', kept on a tie, else the least."""
    own, start = np.arange(g.n, dtype=np.int32), g.start
    for _ in range(max_iter):
        moved = False
        for v in range(g.n):
            lo, hi = start[v], start[v + 1]
            if lo == hi:
                continue
            seen = Counter(own[g.to[lo:hi]].tolist())
            top = max(seen.values())
            if seen.get(int(own[v]), 0) < top:
                own[v], moved = min(c for c, n in seen.items() if n == top), True
        if not moved:
            break
    return own


def communities(edges: DataFrame, algorithm: str = "louvain", max_iter: int = 10, resolution: float = 1.0) -> DataFrame:
    """(id, size, members): the communities, the largest first, then by id."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        src, dst = (pa.concat_arrays([pa.array([], pa.large_string()), *(r.column(i).cast(pa.large_string()) for r in rows)]) for i in (0, 1))
        weight = np.concatenate([np.zeros(0), *(r.column(2).to_numpy(zero_copy_only=False) for r in rows)])
        g = Graph(src, dst, weight if algorithm == "louvain" else None)
        del rows, src, dst, weight
        own = louvain(g, max_iter, resolution) if algorithm == "louvain" else label_propagation(g, max_iter)
        for at in range(0, g.n, 1 << 16):
            vertex, label = g.names.slice(at, 1 << 16), g.names.take(pa.array(own[at : at + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([vertex.cast(pa.string()), label.cast(pa.string())], ["vertex", "id"])

    labels = weighted(edges).repartition(1).mapInArrow(one, "vertex string, id string")
    return _grouped(labels)


def _grouped(labels: DataFrame) -> DataFrame:
    return labels.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("vertex")).alias("members")).orderBy(F.col("size").desc(), "id")


def synchronous(edges: DataFrame, max_iter: int = 10) -> DataFrame:
    """Label propagation in which all vertices of one parity of hash act at once: for graphs that no task can hold."""
    both = edges.where("src != dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select(F.col("e.src").alias("v"), F.col("e.dst").alias("u"))
    both = written(both.withColumn("turn", F.pmod(F.xxhash64("v"), F.lit(2))), "adjacency")
    labels = written(edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct(), "labels").withColumn("id", F.col("vertex"))
    for i in range(max_iter):
        # a vertex and what its neighbours say, in one pass: its own label is a row that counts for none
        said = both.where(F.col("turn") == i % 2).join(labels, F.col("u") == F.col("vertex")).groupBy("v", "id").agg(F.count(F.lit(1)).alias("n"))
        rows = said.select("v", "id", "n", F.lit(False).alias("own")).union(labels.select("vertex", "id", F.lit(0).cast("long"), F.lit(True)))
        seen = rows.groupBy("v", "id").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        best = seen.groupBy(F.col("v").alias("vertex")).agg(F.max("n").alias("top"), F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("to"), F.max(F.when(F.col("own"), F.col("id"))).alias("id"), F.max(F.when(F.col("own"), F.col("n"))).alias("kept"))
        new = F.when(F.col("kept") < F.col("top"), F.col("to")).otherwise(F.col("id"))
        labels = written(best.select("vertex", new.alias("new"), "id"), "labels")
        if i % 2 and labels.where("new != id").isEmpty():
            break
        labels = labels.select("vertex", F.col("new").alias("id"))
    return _grouped(labels.select("vertex", "id"))
