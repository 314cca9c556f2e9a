"""Quality rules: gradient-boosted trees over document statistics.

STATISTICS lists what is measured of a document; those with a sign in SIGNS may only lower the score as they grow
(monotonic constraints: no split may go against them, and children are bounded by the middle of their parent's split).
The trees, grown on histograms with logistic loss, are flattened into node arrays that score all rows side by side.

The trees learn from labels: a row is good if its quality is 1 and it isn't toxic. They are fitted on at most
``most`` labelled rows (those with the smallest hash of doc_id; one in four is held out). From the fitted rows
also comes the lexicon of toxic words: all those seen in at least LEXICON_DOCS toxic documents and in toxic ones mostly (so it has
a bound, too: the words of the fitted rows).
The threshold separates the held-out rows best among those that keep KEEP of the good ones.

Defined results: a null or empty text is dropped; null labels don't train, of a doc_id labelled twice the least label
counts; without labels of both kinds every non-empty document stays with score 0; repeated documents are judged one by
one; a very long text is measured whole; a score that ties with the threshold stays; a null doc_id is kept if its text is good;
extra columns, of whatever name, are ignored; empty documents give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

MOST = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 80, 4, 0.15, 64, 20
L2 = 1.0
KEEP = 0.99
LEXICON_DOCS = 5
STATISTICS = ("words", "word_length", "letters", "digits", "symbols", "space", "capitals", "lines", "closed_lines", "distinct_words", "top_word", "repeated_word", "repeated_lines", "toxic_share", "toxic_words")
SIGNS = {"symbols": -1, "top_word": -1, "repeated_word": -1, "repeated_lines": -1, "toxic_share": -1, "toxic_words": -1}
_SIGN = np.array([SIGNS.get(s, 0) for s in STATISTICS])


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_ALPHA = _lut(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT, _SYMBOL, _SPACE = _lut(b"0123456789"), _lut(b"#$%&*|<>{}[]=_~^\\@+/"), _lut(b" \t\n\r\f\v")
_UPPER, _CLOSE, _LINE = _lut(bytes(range(65, 91))), _lut(b".!?:;\"'"), ~_lut(b"\n")


def statistics(text: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Rows x STATISTICS."""
    data, offs = tv.buffers(text)
    size = np.diff(offs)
    n = np.maximum(size, 1)

    def share(lut: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(lut[data])])
        return (run[offs[1:]] - run[offs[:-1]]) / n

    h, s, e, per, _ = tv.words(text)
    row = np.repeat(np.arange(len(per)), per)
    p = np.maximum(per, 1)
    o = np.lexsort((h, row))
    hs, rs = h[o], row[o]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(hs)))
    top = np.zeros(len(per))
    np.maximum.at(top, rs[first], often)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    bad = np.zeros(len(h))
    if len(lexicon) and len(h):
        bad = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
    ls, le, lines = tv.spans(data, offs, _LINE)
    lrow = np.repeat(np.arange(len(lines)), lines)
    lh = tv.hashes(data, ls, le)
    lo = np.lexsort((lh, lrow))
    twice = np.zeros(len(lh))
    twice[1:] = (lh[lo][1:] == lh[lo][:-1]) & (lrow[lo][1:] == lrow[lo][:-1])
    tot = lambda r, w: np.bincount(r, w, minlength=len(per))
    q = np.maximum(lines, 1)
    toxic = tot(row, bad)
    cols = (
        np.log1p(per), tot(row, (e - s).astype(float)) / p, share(_ALPHA), share(_DIGIT), share(_SYMBOL), share(_SPACE), share(_UPPER),
        np.log1p(lines), tot(lrow, _CLOSE[data[le - 1]] if len(le) else np.zeros(0)) / q, tot(rs, new) / p, top / p, tot(row, again) / p, tot(lrow[lo], twice) / q, toxic / p, np.log1p(toxic),
    )
    return np.stack(cols, 1).astype(np.float32)


class Trees:
    """Boosted trees as node arrays: feature (-1 for a leaf), threshold, left child (the right one follows), value."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.feature, self.threshold, self.left, self.value = (np.zeros((0, 0)) for _ in range(4))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, left, value in zip(self.feature, self.threshold, self.left, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                k = f[at]
                at = np.where(k < 0, at, left[at] + (x[rows, np.maximum(k, 0)] > t[at]))
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, sign: np.ndarray = _SIGN, trees: int = TREES) -> Trees:
    """Trees for the log odds of y, with sign[j] = -1 or 1 where the score may only fall or rise with column j."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(rate / (1 - rate))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], 1)
    raw = np.full(len(y), out.base)
    nodes = 2 ** (DEPTH + 1) - 1
    kept = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t, left, v = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes)
        at = np.zeros(len(y), np.int64)
        level, free = [(0, -np.inf, np.inf)], 1
        v[0] = -g.sum() / (h.sum() + L2)
        for _ in range(DEPTH):
            below = []
            for node, lo, hi in level:
                own = np.flatnonzero(at == node)
                if len(own) < 2 * LEAST:
                    continue
                best = (1e-6, -1, 0)
                gs, hs = g[own].sum(), h[own].sum()
                for j in range(x.shape[1]):
                    m = len(edges[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(code[own, j], w, m))[:-1] for w in (g[own], h[own], None))
                    if not len(gl):
                        continue
                    wl, wr = np.clip(-gl / (hl + L2), lo, hi), np.clip(-(gs - gl) / (hs - hl + L2), lo, hi)
                    fall = lambda w, a, b: -(a * w + 0.5 * (b + L2) * w * w)
                    gain = fall(wl, gl, hl) + fall(wr, gs - gl, hs - hl) - fall(np.clip(-gs / (hs + L2), lo, hi), gs, hs)
                    gain[(nl < LEAST) | (len(own) - nl < LEAST) | (sign[j] * (wr - wl) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                _, j, k = best
                if j < 0:
                    continue
                f[node], t[node], left[node] = j, edges[j][k], free
                right = code[own, j] > k
                at[own] = free + right
                w = []
                for side in (~right, right):
                    w.append(float(np.clip(-g[own[side]].sum() / (h[own[side]].sum() + L2), lo, hi)))
                mid = sum(w) / 2
                for side, (a, b) in enumerate(((lo, mid if sign[j] > 0 else hi) if sign[j] >= 0 else (mid, hi), (mid, hi) if sign[j] > 0 else (lo, mid if sign[j] < 0 else hi))):
                    v[free + side] = w[side]
                    below.append((free + side, a, b))
                free += 2
            level = below
        raw += RATE * v[at]
        kept.append((f, t, left, RATE * v))
    if kept:
        out.feature, out.threshold, out.left, out.value = (np.stack(c) for c in zip(*kept))
    return out


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, good, toxic and held of at most that many labelled documents."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id", F.lit(3))
    chosen = one.orderBy(key, "doc_id").limit(most).select("doc_id", (F.col("quality").eqNullSafe(1) & (F.col("toxic") == 0)).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.pmod(key, F.lit(4)) == 0).alias("held"))
    texts = docs.where("text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id")  # at most `most` rows of a few bytes


def lexicon(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the toxic words."""
    schema = pa.schema([("word", pa.int64()), ("toxic", pa.int64()), ("docs", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text"):
                h, _, _, per, _ = tv.words(piece.column(0))
                bad = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                row = np.repeat(np.arange(len(per)), per)
                o = np.lexsort((h, row))
                new = np.ones(len(h), bool)
                new[1:] = (h[o][1:] != h[o][:-1]) | (row[o][1:] != row[o][:-1])
                o = o[new]
                u, inv = np.unique(h[o], return_inverse=True)
                yield tv.batch_of(schema, u.view(np.int64), np.bincount(inv, bad[row[o]], minlength=len(u)).astype(np.int64), np.bincount(inv, minlength=len(u)))

    words = rows.select("text", "toxic").mapInArrow(part, "word long, toxic long, docs long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    toxic = words.where((F.col("toxic") >= LEXICON_DOCS) & (2 * F.col("toxic") > F.col("docs"))).select("word").toArrow()
    return np.sort(toxic["word"].to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> dict:
    rows = _labelled(docs, labels, most)
    words = lexicon(rows.where("not held"))
    schema = pa.schema([("good", pa.bool_()), ("held", pa.bool_()), ("x", pa.binary())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text"):
                yield tv.batch_of(schema, piece.column(1), piece.column(2), [r.tobytes() for r in statistics(piece.column(0), words)])

    got = rows.select("text", "good", "held").mapInArrow(part, "good boolean, held boolean, x binary").collect()
    got.sort(key=lambda r: bytes(r.x))  # the same order however tasks end
    y, held = np.array([r.good for r in got], float), np.array([r.held for r in got], bool)
    x = np.array([np.frombuffer(bytes(r.x), np.float32) for r in got]).reshape(len(got), len(STATISTICS))
    if not len(y) or len(np.unique(y[~held])) < 2:
        return {"lexicon": words, "trees": Trees(), "threshold": -np.inf}
    trees = boost(x[~held], y[~held])
    return {"lexicon": words, "trees": trees, "threshold": _threshold(trees.score(x[held]), y[held])}


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    good, bad = np.sort(score[y == 1]), np.sort(score[y == 0])
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(np.concatenate([[min(good[0], bad[0]) - 1], (np.unique(score)[1:] + np.unique(score)[:-1]) / 2]))
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    gone = np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmax(np.where(kept >= KEEP, kept + gone, -1))])


def judged(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of the documents that stay."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text"):
                score = m.value["trees"].score(statistics(piece.column(1), m.value["lexicon"]))
                yield tv.pass_through(tv.batch_of(schema, piece.column(0), score), score >= m.value["threshold"])

    return docs.where("text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(part, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
