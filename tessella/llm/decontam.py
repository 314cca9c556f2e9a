"""Benchmark decontamination: documents with a passage within a small edit distance of a benchmark item.

Texts are sequences of lower-cased words. An item of L words is found in a document if some window of L words (the whole
document if it is shorter) is within floor(EDIT_RATE * L) word edits of it.

Every window of every item length is a query. Running sums count its words and word pairs that some item has: d edits
leave at least L - d of an item's words and L - 1 - 2 d of its pairs, so windows with fewer can't match. The others are
embedded by CGK random walks: a walk reads word w at step t and advances if hash(walk, t, w) is odd, which turns edits into few
changed steps. Walks drift apart with every edit, so in windows of more than REACH words every other walk begins at the last word
and goes back, and none is sampled beyond what it reads of REACH words. Each of WALKS walks is bit-sampled BANDS times at SAMPLED
steps, and windows meet items in equal samples; pairs that met are verified with the exact edit distance. Simulated at the full
distance, samples meet in 0.96 to 1.00 of all cases at 8 to 1,000 words; the tests hold recall against brute force.

Items are taken in blocks of at most BLOCK items and BLOCK_BYTES of text (an item that is longer is a block of its own), so
what is broadcast has a fixed bound at any size of the benchmark. With several blocks the documents are read once for each, one
block is held at a time, and its result is written before the next.

Defined results: null or wordless texts and items match nothing, nor does a null doc_id in leaks() (stage() keeps such a
row if its text is clean); a very long text or item is compared whole; equal items are each reported, as is, of windows that tie,
the least number of edits; repeated documents are each judged; an empty benchmark matches nothing, empty documents give an
empty table; extra columns, of whatever name, are ignored by leaks() and pass through stage() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

EDIT_RATE = 0.2
WALKS = 16
BANDS = 4
SAMPLED = 3
REACH = 40
BLOCK = 20_000
BLOCK_BYTES = 16 << 20
_ROWS = 1024
_CELLS = 1 << 20  # words of the windows that are compared side by side
_LONG = 256  # longer ones are compared one by one


def allowed(words: np.ndarray | int) -> np.ndarray | int:
    return np.floor(np.asarray(words) * EDIT_RATE + 1e-9).astype(np.int64)


def _draws() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, (2 * REACH, WALKS), dtype=np.uint64) | np.uint64(1), rng.random((WALKS, BANDS, SAMPLED))


_SALT, _PICK = _draws()


def samples(h: np.ndarray, start: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sample hashes (windows x WALKS * BANDS) of windows: n words of h from start on, read as an item of length words."""
    if not len(start):
        return np.zeros((0, WALKS * BANDS), np.uint64)
    flat = np.append(h, np.uint64(0))  # beyond the end, a walk stands and reads 0
    # sampled are steps that nearly all walks reach within the window
    pick = np.floor(_PICK.reshape(1, -1) * (1.6 * np.minimum(length, REACH))[:, None]).astype(np.int64).reshape(len(start), WALKS, BANDS * SAMPLED)
    steps = int(pick.max()) + 1
    seen = np.empty((steps, len(start), WALKS), np.uint64)
    back = (length > REACH)[:, None] & (np.arange(WALKS) % 2 == 1)
    begin, way, n = np.where(back, (start + n - 1)[:, None], start[:, None]), np.where(back, -1, 1), n[:, None]
    at = np.zeros((len(start), WALKS), np.int64)
    for t in range(steps):
        x = seen[t] = flat[np.where(at < n, begin + way * at, len(h))]
        at += ((x * _SALT[t]) >> np.uint64(40)).astype(np.int64) & 1
    got = seen[pick, np.arange(len(start))[:, None, None], np.arange(WALKS)[None, :, None]].reshape(len(start), WALKS, BANDS, SAMPLED)
    out = np.zeros((len(start), WALKS, BANDS), np.uint64)
    for k in range(SAMPLED):
        out = tv.mix(out * np.uint64(0x9E3779B97F4A7C15) + got[..., k])
    tag = (np.arange(WALKS * BANDS) + (length[:, None] << 16)).astype(np.uint64)
    return tv.mix(out.reshape(len(start), -1) + tag)


def edits(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The word edit distance of each pair of rows of a and b, of which na and nb words count."""
    cols = np.arange(b.shape[1] + 1)
    row = np.tile(cols, (len(a), 1))
    out = np.where(na == 0, nb, 0)
    for i in range(a.shape[1]):
        change = row[:, :-1] + (b != a[:, i : i + 1])
        new = np.concatenate([np.full((len(a), 1), i + 1), np.minimum(change, row[:, 1:] + 1)], 1)
        row = np.minimum.accumulate(new - cols, 1) + cols  # insertions
        done = na == i + 1
        out[done] = row[done, nb[done]]
    return out


def one_edits(a: list, where: dict) -> int:
    """The word edit distance of a and an item of which where gives each word's places as bits, and None the number of words."""
    n = where[None]
    full, top = (1 << n) - 1, 1 << (n - 1)
    more, less, out = full, 0, n  # where the distance rises and falls from one word of the item to the next
    for w in a:
        same = where.get(w, 0)
        v = same | less
        d = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(d | more)), more & d
        out += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less = down | (full & ~(v | up)), up & v
    return out


class _Known:
    """A set of hashes with a bit table in front of it."""

    def __init__(self, h: np.ndarray):
        self.sorted = np.unique(h)
        self.bits = max(18, int(len(self.sorted) * 8).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.sorted >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def running(self, h: np.ndarray) -> np.ndarray:
        """How many of the first i hashes are in the set, for each i from 0."""
        out = self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = _in(h[at], self.sorted)
        return np.concatenate([[0], np.cumsum(out)])


class Items:
    """A block of the benchmark, indexed by word, length and sample."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, _, _, per, _ = tv.words(pa.array(texts, pa.string()))
        use = np.flatnonzero(per > 0)
        self.ids, self.n = np.array(ids, np.int64)[use], per[use]
        self.w, self.first = np.append(h, np.uint64(0)), (np.cumsum(per) - per)[use]  # ragged: the words end to end
        self.words, self.pairs = _Known(h), _Known(tv.grams(h, per, 2)[0])
        self.lengths = np.unique(self.n)
        self.words_by_length, self.pairs_by_length = {}, {}
        for k in self.lengths.tolist():
            own = [h[a : a + k] for a in self.first[self.n == k]]
            self.words_by_length[k] = np.unique(np.concatenate(own))
            self.pairs_by_length[k] = np.unique(tv.grams(np.concatenate(own), np.full(len(own), k), 2)[0])
        s = np.concatenate([samples(h, self.first[i : i + _ROWS], self.n[i : i + _ROWS], self.n[i : i + _ROWS]) for i in range(0, len(use), _ROWS)] or [np.zeros((0, 1), np.uint64)])
        key, item = s.ravel(), np.repeat(np.arange(len(use)), s.shape[1])
        o = np.argsort(key, kind="stable")
        self.key, self.item = key[o], item[o]

    def find(self, h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, edits) of the items found in rows of words."""
        first = np.cumsum(per) - per
        row = np.repeat(np.arange(len(per)), per)
        run = self.words.running(h)
        two = np.zeros(len(h), np.uint64)
        g, at = tv.grams(h, per, 2)
        two[at] = g
        run2 = self.pairs.running(two)  # a pair counts where its first word stands
        start, n, length = [], [], []
        for k in self.lengths.tolist():
            d = int(allowed(k))
            a = np.flatnonzero((run2[k - 1 : len(h)] - run2[: len(h) - k + 1] >= k - 1 - 2 * d) & (run[k:] - run[:-k] >= k - d)) if len(h) >= k else np.zeros(0, np.int64)
            a = a[row[a] == row[np.minimum(a + k - 1, len(h) - 1)]]
            short = np.flatnonzero((per < k) & (per >= max(1, k - d)))
            short = short[run[first[short] + per[short]] - run[first[short]] >= k - d]
            s, m = np.concatenate([a, first[short]]), np.concatenate([np.full(len(a), k), per[short]])
            step = max(1, min(1 << 14, _CELLS // k))
            for i in range(0, len(s), step):
                ok = self._own(h, two, s[i : i + step], m[i : i + step], k, d)
                start.append(s[i : i + step][ok])
                n.append(m[i : i + step][ok])
                length.append(np.full(int(ok.sum()), k))
        found = []
        if start:
            start, n, length = np.concatenate(start), np.concatenate(n), np.concatenate(length)
            for i in range(0, len(start), _ROWS):
                found.append(self._verified(h, row, start[i : i + _ROWS], n[i : i + _ROWS], length[i : i + _ROWS]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        r, item, e = (np.concatenate(x) for x in zip(*found))
        o = np.lexsort((e, item, r))
        r, item, e = r[o], item[o], e[o]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1])
        return r[new], item[new], e[new]

    def _own(self, h: np.ndarray, two: np.ndarray, start: np.ndarray, n: np.ndarray, k: int, d: int) -> np.ndarray:
        """Whether the windows pass the same two bounds with the words and pairs of the items of k words alone."""
        at = np.arange(k)
        where = np.minimum(start[:, None] + at, len(h) - 1)
        ok = (_in(two[where], self.pairs_by_length[k]) & (at < n[:, None] - 1)).sum(1) >= k - 1 - 2 * d
        left = np.flatnonzero(ok)
        ok[left] = (_in(h[where[left]], self.words_by_length[k]) & (at < n[left, None])).sum(1) >= k - d
        return ok

    def _verified(self, h: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = samples(h, start, n, length)
        lo, hi = np.searchsorted(self.key, s.ravel(), "left"), np.searchsorted(self.key, s.ravel(), "right")
        count = hi - lo
        which = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        pair = np.unique(np.repeat(np.repeat(np.arange(len(start)), s.shape[1]), count) * len(self.n) + self.item[which])
        x, y = pair // len(self.n), pair % len(self.n)
        same = length[x] == self.n[y]
        x, y = x[same], y[same]
        short = np.flatnonzero(self.n[y] <= _LONG)
        out = [self._long(h, row, start, n, *(np.delete(v, short) for v in (x, y)))]
        x, y = x[short], y[short]
        step = max(1, _CELLS // int(self.n[y].max(initial=1)))
        for i in range(0, len(x), step):
            p, q = x[i : i + step], y[i : i + step]
            at = np.arange(int(self.n[q].max()))
            w, item = h[np.minimum(start[p][:, None] + at, len(h) - 1)], self.w[np.minimum(self.first[q][:, None] + at, len(self.w) - 1)]
            w[at >= n[p][:, None]] = 0
            e = edits(w, n[p], item, self.n[q])
            hit = e <= allowed(self.n[q])
            out.append((row[start[p[hit]]], q[hit], e[hit]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _long(self, h: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows x and long items y: the best for each row and item, leaving out windows whose words say they can't be better."""
        best: dict[tuple[int, int], int] = {}
        for item in np.unique(y).tolist():
            k = int(self.n[item])
            words = self.w[self.first[item] : self.first[item] + k]
            where: dict = {None: k}
            for i, w in enumerate(words.tolist()):
                where[w] = where.get(w, 0) | 1 << i
            known, own = np.unique(words), x[y == item]
            least = [k - int(_in(h[start[i] : start[i] + n[i]], known).sum()) for i in own]
            for j in np.argsort(least, kind="stable").tolist():
                key = (int(row[start[own[j]]]), item)
                if least[j] <= min(best.get(key, 1 << 60) - 1, int(allowed(k))):
                    e = one_edits(h[start[own[j]] : start[own[j]] + n[own[j]]].tolist(), where)
                    if e <= allowed(k):
                        best[key] = min(e, best.get(key, e))
        got = np.array([(*key, e) for key, e in best.items()], np.int64).reshape(-1, 3)
        return got[:, 0], got[:, 1], got[:, 2]


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def blocks(benchmark: DataFrame, block: int = BLOCK, size: int = BLOCK_BYTES) -> tuple[int, Iterator[Items]]:
    """The number of blocks, and the benchmark's items in blocks of about that many and that size at most, read as they are asked for."""
    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // block), -(-total // size))
    parts = parts * 5 // 4 if parts > 1 else parts  # hashing doesn't deal them out evenly

    def each() -> Iterator[Items]:
        for k in range(parts):
            rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
            yield Items([r[0] for r in rows], [r[1] for r in rows])

    return parts, each()


def _found(items: Items, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, _, _, per, _ = tv.words(text)
    return items.find(h, per) if len(h) and len(items.n) else (np.zeros(0, np.int64),) * 3


def _by_block(benchmark: DataFrame, ddl: str, search, block: int, size: int) -> DataFrame | None:
    """The union of search(broadcast items) over all blocks, of which one is held at a time; None without items."""
    spark = benchmark.sparkSession
    parts, own = blocks(benchmark, block, size)
    out = []
    for items in own:
        b = spark.sparkContext.broadcast(items)
        one = search(b)
        if parts == 1:
            return one
        out.append(tv.written(one, "found"))
        b.destroy()
    return reduce(DataFrame.union, out) if out else None


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, size: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id and the least number of word edits, for every item found in a document."""
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64())])
    ddl = "doc_id long, item_id long, edits long"

    def search(b) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in tv.pieces(batch, "text"):
                    r, item, e = _found(b.value, piece.column(1))
                    yield tv.batch_of(schema, piece.column(0).take(pa.array(r)), b.value.ids[item], e)

        return own.mapInArrow(part, ddl)

    out = _by_block(benchmark, ddl, search, block, size)
    return docs.sparkSession.createDataFrame([], ddl) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, size: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns unchanged, in which no item is found."""
    parts, own = blocks(benchmark, block, size)
    if parts == 0:
        return docs
    if parts == 1:
        b, at = docs.sparkSession.sparkContext.broadcast(next(own)), docs.columns.index("text")

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in tv.pieces(batch, "text"):
                    keep = np.ones(piece.num_rows, bool)
                    keep[_found(b.value, piece.column(at))[0]] = False
                    yield tv.pass_through(piece, keep)

        return docs.mapInArrow(part, docs.schema)
    # with several blocks, the texts in which an item is found are named by two hashes and leave in the end
    named = docs.where("text is not null").select("text", F.xxhash64("text").alias("_a"), F.xxhash64("text", F.lit(5)).alias("_b"))
    schema = pa.schema([("_a", pa.int64()), ("_b", pa.int64())])

    def search(b) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in tv.pieces(batch, "text"):
                    r = pa.array(np.unique(_found(b.value, piece.column(0))[0]))
                    yield tv.batch_of(schema, piece.column(1).take(r), piece.column(2).take(r))

        return named.mapInArrow(part, "_a long, _b long").distinct()

    found = _by_block(benchmark, "_a long, _b long", search, block, size).distinct()
    return docs.join(found, (F.xxhash64(docs["text"]) == found["_a"]) & (F.xxhash64(docs["text"], F.lit(5)) == found["_b"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
