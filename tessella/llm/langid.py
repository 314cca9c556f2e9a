"""Language identification by nearest centroid.

A document's vector holds its byte 1- to 3-grams, hashed to DIM buckets, as log term frequency times inverse
document frequency, normalised. Several clustered centroids stand for each language; the cosine to the nearest
decides the language, and a document farther from it than nearly all held-out texts of its length is rejected: the bound
of each octave of letters is the QUANTILE of the distances of labelled texts, and of pieces cut from longer ones to that
length, that the centroids weren't fitted on.

The document frequencies come from every document. The centroids are fitted on at most ``per_language`` labelled
rows of each language (those with the smallest hash of doc_id), and the distance bounds on as many others, or on the same
if no language has two rows.

Defined results: a null or empty text, or one without letters, is rejected; null labels don't train; with no labelled
row every document is rejected; repeated rows are judged one by one; a very long text counts whole; of languages whose
centroids are equally near, the first by name is taken, and a distance equal to its bound is accepted; extra columns, of whatever
name, pass through stage() unchanged and are ignored by identify(); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

DIM = 4096
PER_LANGUAGE = 300
CLUSTERS = 4
QUANTILE = 0.995
PIECE_OCTAVES = 13
_LEAST = 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ROWS = 256


def counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term counts (rows x DIM) of the n-grams, and the letters in each row."""
    data, offs = tv.buffers(tv.lowered(text))
    rows = len(offs) - 1
    letter = _LETTER[data]
    keep = letter.copy()
    if len(data):
        keep[1:] |= letter[:-1]
    where = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=where[1:])
    x = np.where(letter, data, np.uint8(32))[keep].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(where[offs]))
    out = np.zeros(rows * DIM, np.int64)
    for n in (1, 2, 3):
        if len(x) < n:
            break
        code = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | x[k : len(x) - n + 1 + k]
        ok = row[: len(code)] == row[n - 1 :]
        b = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount((row[: len(code)] * DIM + b)[ok], minlength=rows * DIM)
    w = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=w[1:])
    return out.reshape(rows, DIM), np.diff(w[offs])


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    schema = pa.schema([("bucket", pa.int32()), ("df", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for piece in tv.pieces(batch, "text", max_rows=_ROWS):
                tf, letters = counts(piece.column(0))
                df += (tf > 0).sum(0)
                n += int((letters > 0).sum())
        at = np.flatnonzero(df)
        yield tv.batch_of(schema, np.append(at, -1).astype(np.int32), np.append(df[at], n))

    rows = docs.select("text").mapInArrow(part, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIM, np.int64)
    n = 0
    for r in rows:
        if r.bucket < 0:
            n = r.df
        else:
            df[r.bucket] = r.df
    return df, n


def cuts(text: str) -> list[str]:
    """A piece of the text for each octave of letters below its own, from the start of a word."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "ignore"), np.uint8)
    letter = _LETTER[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=before[1:])
    start = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]])) if len(data) else np.zeros(0, np.int64)
    rng = np.random.default_rng(int.from_bytes(blake2b(data.tobytes(), digest_size=8).digest(), "little"))
    out = []
    for k in range(PIECE_OCTAVES):
        n = int(rng.integers(1 << k, 2 << k))
        enough = start[before[start] + n <= before[-1]]
        if before[-1] < 2 << k or not len(enough):
            break
        a = int(enough[rng.integers(len(enough))])
        out.append(data[a : int(np.searchsorted(before, before[a] + n))].tobytes().decode("utf-8", "ignore"))
    return out


def _sample(docs: DataFrame, per_language: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """At most 2 * per_language labelled rows of each language, as (language, letters, term counts, pieces)."""
    sizes = {r.lang: r.n for r in docs.where("lang is not null and text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return np.array([], object), np.zeros(0), np.zeros((0, DIM), np.float32), []
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30))
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, 2 * per_language / n) * (1 << 30))))])
    schema = pa.schema([("lang", pa.string()), ("letters", pa.int64()), ("tf", pa.binary()), ("cuts", pa.list_(pa.string()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text", max_rows=_ROWS):
                tf, letters = counts(piece.column(1))
                yield tv.batch_of(schema, piece.column(0).cast(pa.string()), letters, [x.tobytes() for x in tf.astype(np.uint32)], [cuts(x) for x in piece.column(1).to_pylist()])

    chosen = docs.where("lang is not null and text is not null").where(key < rate[F.col("lang")]).select("lang", "text")
    rows = chosen.mapInArrow(part, "lang string, letters long, tf binary, cuts array<string>").collect()
    rows.sort(key=lambda r: (r.lang, blake2b(r.tf, digest_size=8).digest()))  # the same order however tasks end
    return np.array([r.lang for r in rows], object), np.array([r.letters for r in rows]), np.array([np.frombuffer(bytes(r.tf), np.uint32) for r in rows], np.float32).reshape(len(rows), DIM), [r.cuts for r in rows]


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, seeded with far-apart rows."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(10):
        own = np.argmax(x @ c.T, 1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _octave(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), 20)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> dict:
    """The model: idf, unit centroids, their languages, and the largest accepted distance for each octave of letters."""
    df, n = _frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    lang, letters, tf, parts = _sample(docs, per_language)
    some = letters > 0
    parts = [parts[i] for i in np.flatnonzero(some)]
    lang, letters, x = lang[some], letters[some], vectors(tf[some], idf)
    cents, names, held = [], [], np.zeros(len(x), bool)
    for k in sorted(set(lang)):
        own = np.flatnonzero(lang == k)
        half = max(1, (len(own) + 1) // 2)
        c = _clusters(x[own[:half]], clusters)
        held[own[half:]] = True
        cents.append(c)
        names += [k] * len(c)
    cent = np.concatenate(cents).astype(np.float32) if cents else np.zeros((0, DIM), np.float32)
    bound = np.full(21, 1.0)
    if len(cent):
        at = np.flatnonzero(held if held.any() else ~held)
        d, o = [1 - (x[at] @ cent.T).max(1)], [_octave(letters[at])]
        pieces = [t for i in at for t in parts[i]]
        for i in range(0, len(pieces), _ROWS):
            n, m = counts(pa.array(pieces[i : i + _ROWS], pa.string()))
            d.append(1 - (vectors(n, idf)[m > 0] @ cent.T).max(1))
            o.append(_octave(m[m > 0]))
        d, o = np.concatenate(d), np.concatenate(o)
        for k in range(21):
            wide = np.sort(abs(o - k))[min(_LEAST, len(o)) - 1]  # the nearest octaves that hold enough
            bound[k] = np.quantile(d[abs(o - k) <= wide], QUANTILE, method="higher")
    return {"idf": idf, "centroids": cent, "names": names, "bound": np.minimum(bound, 1 - 1e-3)}


def predict(model: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, cosine, accepted) of each row."""
    tf, letters = counts(text)
    if not len(model["names"]):
        return np.full(len(tf), None, object), np.zeros(len(tf)), np.zeros(len(tf), bool)
    cos = vectors(tf, model["idf"]) @ model["centroids"].T
    best = cos.argmax(1)
    score = cos[np.arange(len(cos)), best].astype(float)
    return np.array(model["names"], object)[best], score, (letters > 0) & (1 - score <= model["bound"][_octave(letters)])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, predicted language and cosine of each accepted document."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("cosine", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text", max_rows=_ROWS):
                name, score, ok = predict(m.value, piece.column(1))
                yield tv.pass_through(tv.batch_of(schema, piece.column(0).cast(pa.int64()), name, score), ok)

    return docs.select("doc_id", "text").mapInArrow(part, "doc_id long, language string, cosine double")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns unchanged, whose language is accepted."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text", max_rows=_ROWS):
                yield tv.pass_through(piece, predict(m.value, piece.column(at))[2])

    return docs.mapInArrow(part, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs))
