"""Repeated passages: runs of at least LEAST words that occur more than once, found with a run-length index.

1. Each document gives hashes of K-word windows, thinned by winnowing: the least of every LEAST - K + 1 neighbours stays.
   Any LEAST equal words hold an equal chosen window, so windows chosen only once in the corpus can be left out
   without missing a repeat; there are no other shortcuts and no limits on how often a window occurs.
2. Around the windows that occur again, each document is cut into segments that reach LEAST words to both sides, one for
   each earliest document that its windows lead to. All segments that lead to one document come together, very many of
   them in blocks by doc_id; overlapping segments of a document that meet are one.
3. Those, end to end with a separator of its own behind each, form a text whose Burrows-Wheeler transform consists of
   few long runs. The index keeps the runs and samples the text positions at their ends. Where a run begins, the
   suffix and its neighbour before it in sorted order part after a length that is stored with the sample (as for the
   neighbour behind it at run ends). Matching statistics stream from there: from a sample to the next, the length of
   the longest match drops by one with each word, for within a run the neighbours advance side by side.
   Positions with a match of LEAST words or more, and the words it covers, are marked.
4. Blocks of one group meet by what is left: each names its distinct runs of LEAST words once, with their place if the block
   holds them only there, and runs that another block (or another place) has, too, are marked. A passage that very many
   documents hold is one such run a block, so work and shuffle grow with the number of its holders, not with their pairs.

Segments with the same words are indexed once; they are repeats from end to end. Words are compared by 64-bit hash, lower-cased and
without punctuation between them.

Defined results: null, empty and short texts have no repeats, nor do rows with a null doc_id; a very long text is treated
whole; rows with the same doc_id and text are one document (a passage repeated within a document counts, and both
copies of a passage are marked, whichever came first); extra columns are ignored, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

LEAST = 50
K = 20
BUNDLE = 1_000_000  # words of whole groups that are indexed at once
BLOCK = 1_000_000  # about the words that a block of a larger group holds


def chosen(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within the row, hash) of the K-word windows that winnowing chooses."""
    g, at = tv.grams(h, per, K)
    first = np.cumsum(per) - per
    row = np.repeat(np.arange(len(per)), per)
    n = np.maximum(per - K + 1, 0)
    w = LEAST - K + 1
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g[:0]
    # the least of each w neighbours, from spans that double
    low, span = g.copy(), 1
    while span < w:
        step = min(span, w - span)
        low[: len(g) - step] = np.minimum(low[: len(g) - step], low[step:])
        span += step
    who = row[at]
    last = np.cumsum(n) - 1
    starts = np.flatnonzero(np.arange(len(g)) + w - 1 <= last[who])
    # the largest of these among the neighbourhoods that hold a place; the place is chosen if it is its own value
    best = np.zeros(len(g), np.uint64)
    best[starts] = low[starts]
    span = 1
    while span < w:
        step = min(span, w - span)
        new = best.copy()
        new[step:] = np.maximum(new[step:], best[: len(g) - step])
        best, span = new, span + step
    mark = np.flatnonzero((best == g) & (n[who] >= w))
    return who[mark], at[mark] - first[who[mark]], g[mark]


def run_index(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The run-length index of the words x (dense ids): run heads' text positions with the length that each shares with the
    suffix before it, and run tails' with the length shared with the suffix behind."""
    n = len(x)
    ranks = [x.astype(np.int32)]  # by the first 1, 2, 4, ... words, until all suffixes differ
    while len(ranks) == 1 or int(ranks[-1].max(initial=0)) < n - 1:
        r, step = ranks[-1].astype(np.int64), 1 << (len(ranks) - 1)
        key = r * (int(r.max(initial=0)) + 2)
        key[: max(0, n - step)] += r[step:] + 1
        order = np.argsort(key)
        new = np.empty(n, np.int32)
        s = key[order]
        new[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        ranks.append(new)
    sa = np.empty(n, np.int64)
    sa[ranks[-1]] = np.arange(n)
    bwt = x[sa - 1]
    edge = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero((a < n) & (b < n))
            same = same[ranks[k][a[same]] == ranks[k][b[same]]]
            for z in (got, a, b):
                z[same] += 1 << k
        return got

    heads, tails = sa[edge], sa[edge - 1]
    length = shared(heads, tails)
    return heads, length, tails, length


def matching(x: np.ndarray) -> np.ndarray:
    """At each position, the length of the longest match of what begins there with another place.

    x must end with a word that occurs nowhere else.
    """
    out = np.zeros(len(x), np.int64)
    head, up, tail, down = run_index(x)
    for at, length in ((head, up), (tail, down)):
        sample = np.full(len(x), -1, np.int64)
        sample[at] = at
        sample = np.maximum.accumulate(sample)
        value = np.zeros(len(x), np.int64)
        value[at] = length
        has = np.flatnonzero(sample >= 0)
        out[has] = np.maximum(out[has], value[sample[has]] - (has - sample[has]))
    return out


def _anchors(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, key, at) of the chosen windows."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text"):
                h, _, _, per, _ = tv.words(piece.column(2))
                row, at, g = chosen(h, per)
                k = pa.array(row)
                yield tv.batch_of(schema, g.view(np.int64), piece.column(0).take(k), piece.column(1).take(k), at.astype(np.int32))

    return docs.mapInArrow(part, "hash long, doc_id long, key long, at int")


def _own(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")


def _segments(own: DataFrame) -> DataFrame:
    """(lead, block, blocks, doc_id, key, first, words): segments around windows that occur again, and the document they lead to.

    Where more segments lead to a document than a task should hold, they are dealt out to blocks by doc_id.
    """
    found = _anchors(own).distinct()
    # an anchor's rows come together once; those of one row have no other to lead to
    hot = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lead")).where("n > 1")
    places = F.sum("n").over(Window.partitionBy("lead"))  # a lead has no more windows than words
    hot = hot.select("hash", "lead", F.ceil(places * F.lit(LEAST - K + 10) / F.lit(BLOCK)).cast("int").alias("k"))
    spots = found.join(hot, "hash").groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("lead", "at", "k"))).alias("spots"))
    schema = pa.schema([("lead", pa.int64()), ("block", pa.int64()), ("blocks", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("words", pa.binary())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text"):
                h, _, _, per, _ = tv.words(piece.column(2))
                spots = piece.column(3)
                o = spots.offsets.to_numpy()
                o = o - o[0]
                s = spots.flatten()
                lead, at = s.field(0).to_numpy(), s.field(1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(per)), np.diff(o))
                base = np.cumsum(per) - per
                lo, hi = np.maximum(at - (LEAST - K), 0), np.minimum(at + LEAST, per[row])
                # windows that lead to the same document are one segment as long as they overlap
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (lead[1:] != lead[:-1]) | (lo[1:] > hi[:-1])
                f = np.flatnonzero(new)
                t = np.append(f[1:], len(at)) - 1
                a, b = base[row[f]] + lo[f], base[row[f]] + hi[t]
                ids, blocks = piece.column(0).to_numpy(), s.field(2).to_numpy().astype(np.int64)[f]
                own = (tv.mix(ids[row[f]].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                k = pa.array(row[f])
                yield tv.batch_of(schema, lead[f], own, blocks, piece.column(0).take(k), piece.column(1).take(k), lo[f].astype(np.int32), [h[i:j].tobytes() for i, j in zip(a, b)])

    return own.join(spots.hint("shuffle_hash"), ["doc_id", "key"]).select("doc_id", "key", "text", "spots").mapInArrow(part, "lead long, block long, blocks long, doc_id long, key long, first int, words binary")


def marked(words: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(segment, first, end) of the stretches of the segments' words that repeats of LEAST words cover."""
    alike: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        alike.setdefault(w.tobytes(), []).append(i)
    same = [v for v in alike.values() if len(v) > 1 and len(words[v[0]]) >= LEAST]
    whole = [(i, 0, len(words[i])) for v in same for i in v]
    kept = [v[0] for v in alike.values()]
    done = {v[0] for v in same}
    return whole + [(kept[i], a, b) for i, a, b in _marked([words[i] for i in kept]) if kept[i] not in done]


def _marked(words: list[np.ndarray]) -> list[tuple[int, int, int]]:
    size = np.array([len(w) for w in words])
    ids = np.unique(np.concatenate(words), return_inverse=True)[1]
    m = int(ids.max(initial=-1)) + 1
    x = np.empty(int(size.sum()) + len(size), np.int64)
    first = np.cumsum(size + 1) - size - 1
    inner = np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)
    x[inner] = ids
    x[first + size] = m + np.arange(len(size))
    length = matching(x)
    hit = np.flatnonzero(length >= LEAST)
    if not len(hit):
        return []
    seg = np.searchsorted(first, hit, "right") - 1
    end = np.minimum(hit + length[hit], first[seg] + size[seg])
    reach = np.maximum.accumulate(end)
    new = np.ones(len(hit), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (hit[1:] > reach[:-1])
    f = np.flatnonzero(new)
    t = np.append(f[1:], len(hit)) - 1
    return list(zip(seg[f].tolist(), (hit[f] - first[seg[f]]).tolist(), (reach[t] - first[seg[f]]).tolist()))


def runs_of(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, segment, first word, places) of the distinct runs of LEAST words; of several places, one is given."""
    size = np.array([len(w) for w in segments])
    g, at = tv.grams(np.concatenate(segments), size, LEAST)
    g, one, n = np.unique(g, return_index=True, return_counts=True)
    first = np.cumsum(size) - size
    seg = np.searchsorted(first, at[one], "right") - 1
    return g, seg, at[one] - first[seg], n


def _marks(segments: DataFrame) -> DataFrame:
    """Of each group of segments, the stretches (doc_id, key, first, end; places null) and, where it has several blocks,
    the distinct runs of LEAST words (run, their number of places and, if that is 1, the place)."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = segments.repartition(parts, "lead", "block").sortWithinPartitions("lead", "block")
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("run", pa.int64()), ("places", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, now = [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            own: list[list] = []
            for doc, key, first, w, several in sorted(held, key=lambda r: (r[0], r[1], r[2], -len(r[3]))):
                # overlapping segments of a document are one, for a word is no repeat of itself; so are repeated rows
                if own and own[-1][:2] == [doc, key] and first <= own[-1][2] + len(own[-1][3]):
                    own[-1][3] = np.concatenate([own[-1][3], w[own[-1][2] + len(own[-1][3]) - first :]])
                    own[-1][4] |= several
                else:
                    own.append([doc, key, first, w, several])
            got = marked([r[3] for r in own])
            none = [None] * len(got)
            yield tv.batch_of(schema, [own[s][0] for s, _, _ in got], [own[s][1] for s, _, _ in got], [own[s][2] + a for s, a, _ in got], [own[s][2] + b for s, _, b in got], none, none)
            meet = [r for r in own if r[4] and len(r[3]) >= LEAST]
            if meet:
                g, seg, at, n = runs_of([r[3] for r in meet])
                doc, key, base = (np.array([r[i] for r in meet], np.int64)[seg] for i in range(3))
                place = [pa.array(x, mask=n > 1) for x in (doc, key)] + [pa.array((base + at + d).astype(np.int32), mask=n > 1) for d in (0, LEAST)]
                yield tv.batch_of(schema, *place, g.view(np.int64), n)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for lead, block, blocks, *r in zip(*cols):
                if (lead, block) != now and total > BUNDLE:
                    yield from done()
                    held, total = [], 0
                now = (lead, block)
                held.append((*r[:3], np.frombuffer(r[3], np.uint64), blocks > 1))
                total += len(r[3]) // 8
        if held:
            yield from done()

    return segments.mapInArrow(part, "doc_id long, key long, first int, end int, run long, places long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, and the repeated stretches of its words as [first, end), in order, for the documents that have any."""
    marks = tv.written(_marks(_segments(_own(docs))), "marks")
    runs = marks.where("places is not null").distinct()  # segments that lead elsewhere may give a place again
    again = runs.groupBy("run").agg(F.sum("places").alias("n")).where("n > 1").select("run")
    across = runs.where("places = 1").join(again, "run").select("doc_id", "key", "first", "end")
    found = marks.where("places is null").select("doc_id", "key", "first", "end").union(across)
    merged = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("s"))
    join = F.aggregate(
        "s",
        F.array().cast("array<struct<first:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.select("doc_id", join.alias("stretches"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its repeated stretches of words, and how many words they hold."""
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.transform("stretches", lambda x: x["first"]).alias("first_word"), F.transform("stretches", lambda x: x["end"]).alias("end_word"), F.aggregate("stretches", F.lit(0), lambda a, x: a + x["end"] - x["first"]).alias("words"))
