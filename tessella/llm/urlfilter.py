"""URL filter: the likelihood ratio of two character models.

A variable-order Markov model of each class, accepted and rejected, gives every character of a URL the probability
    p_k(c | context of k characters) = (n(context c) + STRENGTH p_{k-1}(c | shorter context)) / (n(context) + STRENGTH)
from order ORDER down to a uniform p. A URL's score is the difference of the two log-likelihoods by character, and
URLs that score at least the calibrated threshold stay.

The examples come from a table of labels (url, accepted). Without one, a host that contains one of SEED_TERMS is an example
of what to reject, any other host one of what to accept. All examples are used: one in HELD_OUT (by hash of the URL) sets the
threshold, all others are counted, each of their n-grams by itself under a 64-bit hash. The
threshold is the one that errs least, classes weighing the same, over the scores of all that are held out.

Counts of at most BROADCAST n-grams, of 24 bytes each, go to every task. More stay a table, of which each chunk of URLs
gets those of its own n-grams by a join; scores are the same.

Characters are the bytes of the lower-cased URL without its scheme, with every digit read as 0.

Defined results: a null or empty URL is dropped; equal URLs score alike, each page by itself; a very long URL is scored whole; a
score that ties with the threshold is accepted; labels with a null don't train; a null page_id is kept with its URL's score; if a
class has no example, every non-empty URL is accepted; extra columns, of whatever name, are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

SEED_TERMS = ("casino", "bets", "betting", "poker", "gambl", "pills", "pharma", "viagra", "adult", "porn", "xxx", "spam", "ads-", "adserv", "doorway", "warez")
ORDER = 5
STRENGTH = 4.0
HELD_OUT = 5
BROADCAST = 2_000_000
_BINS = 4000
_LOW, _HIGH = -10.0, 10.0
_ROWS = 8192


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def seeded(url: Column) -> Column:
    """Whether the host has one of the seed terms."""
    h = host(url)
    out = F.lit(False)
    for t in SEED_TERMS:
        out = out | h.contains(t)
    return out


def _codes(url: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each order, hashes of n-gram and context at each character; the row of each; characters by row."""
    data, offs = tv.buffers(url)
    size = np.diff(offs)
    wide = size + ORDER + 1
    first = np.cumsum(wide) - wide
    row = np.repeat(np.arange(len(size)), size)
    x = np.full(int(wide.sum()), 1, np.uint64)
    inner = np.arange(len(data)) + np.repeat(first + ORDER - offs[:-1], size)
    x[inner] = np.where((data >= 48) & (data <= 57), np.uint8(48), data)
    x[first + ORDER + size] = 2
    at = np.sort(np.concatenate([inner, first + ORDER + size]), kind="stable")
    who = np.repeat(np.arange(len(size)), size + 1)
    out = []
    g = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        # the k characters before, hashed from the nearest back
        if k:
            g = tv.mix(g * np.uint64(257) + x[at - k] + np.uint64(k << 20))
        tag = np.uint64(2 * k + 1)
        out.append((tv.mix(tv.mix(g + tag) + (x[at] + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)), tv.mix(tv.mix(g + tag) ^ np.uint64(0x5555))))
    return out, who, size + 1


class Counts:
    """Counts of n-grams and contexts by class, under their hashes; [class, order, 0 or 1] looks hashes up."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        o = np.argsort(h)
        self.h, self.n = h[o], n[:, o]

    def __getitem__(self, at: tuple[int, int, int]) -> _Of:
        return _Of(self, at[0])

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts of each hash, in both classes."""
        if not len(self.h):
            return np.zeros((2, *np.shape(h)), np.int64)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[i] == h, self.n[:, i], 0)


class _Of:
    """The counts of one class. Order and kind are part of the hash."""

    def __init__(self, counts: Counts, c: int):
        self.counts, self.c = counts, c

    def __getitem__(self, h: np.ndarray) -> np.ndarray:
        return self.counts.of(h)[self.c]


class Stored:
    """Counts of more n-grams than are broadcast: a table (h, good, bad), and whether each class has any."""

    def __init__(self, table: DataFrame, seen: list[bool]):
        self.table, self.seen = table, seen


def _local(h: pa.Array, good: pa.Array, bad: pa.Array) -> Counts:
    return Counts(h.to_numpy().view(np.uint64), np.array([good.to_numpy(), bad.to_numpy()]))


def _tables(pages: DataFrame) -> Counts | Stored:
    """The counts of every n-gram and context."""
    schema = pa.schema([("h", pa.int64()), ("good", pa.int64()), ("bad", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "url", max_rows=_ROWS):
                codes, who, _ = _codes(piece.column(0))
                bad = piece.column(1).to_numpy(zero_copy_only=False)[who].astype(bool)
                for k in range(ORDER + 1):
                    for h in codes[k]:
                        key, at = np.unique(h, return_inverse=True)
                        yield tv.batch_of(schema, key.view(np.int64), *(np.bincount(at[sel], minlength=len(key)) for sel in (~bad, bad)))

    got = pages.select("url", "bad").mapInArrow(part, "h long, good long, bad long").groupBy("h").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    got = tv.written(got, "ngrams")
    n, good, bad = got.agg(F.count(F.lit(1)), F.sum("good"), F.sum("bad")).first()
    if n > BROADCAST:
        return Stored(got, [good > 0, bad > 0])
    t = got.toArrow().combine_chunks()
    return _local(*(t[c].combine_chunks() for c in ("h", "good", "bad")))


def scores(tables: Counts, url: pa.Array) -> np.ndarray:
    codes, who, size = _codes(url)
    p = np.full((2, len(who)), 1 / 256)
    for gram, context in codes:
        p = (tables.of(gram) + STRENGTH * p) / (tables.of(context) + STRENGTH)
    return np.bincount(who, np.log(p[0]) - np.log(p[1]), minlength=len(size)) / size


def _scored(pages: DataFrame, tables: Counts | Stored) -> DataFrame:
    """pages with their score as the last column."""
    if isinstance(tables, Stored):
        return _scored_by_join(pages, tables)
    b = pages.sparkSession.sparkContext.broadcast(tables)
    at = pages.columns.index("url")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "url", max_rows=_ROWS):
                yield piece.append_column("score", pa.array(scores(b.value, piece.column(at)), pa.float64()))

    return pages.mapInArrow(part, _with_score(pages))


def _with_score(pages: DataFrame) -> str:
    return pages.schema.simpleString()[7:-1].replace(":", " ") + ", score double"


def _scored_by_join(pages: DataFrame, tables: Stored) -> DataFrame:
    at = pages.columns.index("url")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "url", max_rows=_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([tv.packed(piece)], pa.binary())], ["blob"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0), batch.column(1)):
                codes, _, _ = _codes(tv.unpacked(blob.as_py()).column(at))
                h = np.unique(np.concatenate([x for c in codes for x in c]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk.as_py())), pa.array(h.view(np.int64))], ["chunk", "h"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece, found = tv.unpacked(batch.column(0)[i].as_py()), batch.column(1)[i].values
                own = _local(*(found.field(k) for k in range(3))) if found is not None else Counts(np.zeros(0, np.uint64), np.zeros((2, 0), np.int64))
                yield piece.append_column("score", pa.array(scores(own, piece.column(at)), pa.float64()))

    chunks = tv.written(pages.mapInArrow(pack, "blob binary").withColumn("chunk", F.monotonically_increasing_id()), "urls").select("chunk", "blob")
    need = chunks.mapInArrow(hashes, "chunk long, h long")
    found = need.join(tables.table, "h").groupBy("chunk").agg(F.collect_list(F.struct("h", "good", "bad")).alias("counts"))
    return chunks.join(found, "chunk", "left").select("blob", "counts").mapInArrow(part, _with_score(pages))


def _bare(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))


def fit(pages: DataFrame, labels: DataFrame | None = None, per_class: int | None = None) -> tuple[Counts | Stored, float]:
    """The two models and the threshold, from labels (url, accepted) or, without them, from the seed terms in pages.

    All examples count, unless per_class bounds those that the models are of."""
    bad = seeded(F.col("url")) if labels is None else ~F.col("accepted").cast("boolean")
    own = (pages if labels is None else labels).where("url != ''").select(_bare(F.col("url")).alias("url"), bad.alias("bad"), F.xxhash64("url").alias("key")).where("bad is not null")
    held = F.pmod("key", F.lit(HELD_OUT)) == 0
    counted = own.where(~held)
    if per_class is not None:
        each = [counted.where(kind).orderBy("key", "url").limit(per_class) for kind in (F.col("bad"), ~F.col("bad"))]
        counted = each[0].unionByName(each[1])
    tables = _tables(counted)
    if not (all(tables.seen) if isinstance(tables, Stored) else tables.n.any(1).all()):
        return tables, -np.inf
    own = own.withColumn("held", held)
    cell = F.floor((F.least(F.greatest(F.col("score"), F.lit(_LOW)), F.lit(_HIGH - 1e-9)) - _LOW) / (_HIGH - _LOW) * _BINS).cast("int")
    seen = np.zeros((2, _BINS))
    for r in _scored(own.where("held").select("url", "bad"), tables).groupBy("bad", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        seen[int(r.bad), r.cell] = r.n
    if not seen[0].any() or not seen[1].any():
        return tables, 0.0
    share = seen / seen.sum(1, keepdims=True)
    wrong = np.concatenate([[0], np.cumsum(share[0])]) + 1 - np.concatenate([[0], np.cumsum(share[1])])  # below goes
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return tables, _LOW + (_HIGH - _LOW) * float(best[len(best) // 2]) / _BINS


def accepted(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """page_id, url and score of the accepted pages."""
    tables, threshold = fit(pages, labels)
    own = pages.where("url != ''").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("full"), _bare(F.col("url")).alias("url"))
    return _scored(own, tables).where(F.col("score") >= threshold).select("page_id", F.col("full").alias("url"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
