"""Line dedup by pairwise alignment.

Documents overlap where they share a block of consecutive lines of at least MIN_CHARS characters. Their keys are hashes of the
shortest such runs of lines from each line on and up to each line; a line of MIN_CHARS is a run of its own. Every
line of a block of MIN_CHARS lies in a key within that block, so documents that share no key have nothing to delete.
A key links each later holder to the earliest one first. What stays of a key's lines after that is linked to its other earlier
holders, by a hash that deals them out in slices of NEXT, then NEXT times as many a round, until it is deleted or no earlier
holder is left. So a line goes exactly if the alignment with any earlier document deletes it, yet keys that
thousands hold mostly cost one link each; only where such a line can't be aligned (its order or number differs from all)
does it cost one for each earlier holder. Each linked pair is aligned with patience diff on line hashes: lines that are
unique in both are anchors, the longest increasing run of them is kept, and the gaps between are aligned in turn.
Aligned blocks of MIN_CHARS characters or more are deleted from the later document; the earlier stays as it is.

Lines are compared without surrounding white space. A document is a doc_id with its text: documents are ordered by
doc_id, then by hash of the text, and rows that repeat both are one document and are all treated alike.

Defined results: rows with a null doc_id or text, and empty texts, come back unchanged with no lines deleted; a very
long text is aligned whole; of equal texts the one of least doc_id stays, of one doc_id with several texts the one of least
hash; extra columns are ignored by dedup() and pass through stage() unchanged, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

MIN_CHARS = 20
NEXT = 8
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 32]] = True


def line_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length in characters of each line without surrounding white space, and the lines of each row."""
    data, offs = tv.buffers(text)
    rows = len(offs) - 1
    cut = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(cut, offs)) + 1
    starts = np.sort(np.concatenate([offs[:-1], cut + 1]), kind="stable")
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.cumsum(per) - 1
    ends[last] = offs[1:]
    if len(data):
        solid = np.flatnonzero(~_BLANK[data] & _NOT_NEWLINE[data])
        if len(solid):
            i = np.searchsorted(solid, starts)
            j = np.searchsorted(solid, ends) - 1
            some = i <= j
            starts, ends = np.where(some, solid[np.minimum(i, len(solid) - 1)], starts), np.where(some, solid[np.maximum(j, 0)] + 1, starts)
        else:
            ends = starts.copy()
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    assert len(starts) == per.sum() and rows == len(per)
    return tv.hashes(data, starts, ends).view(np.int64), (lead[ends] - lead[starts]).astype(np.int32), per


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j), increasing in both, of equal elements of a and b as patience diff aligns them."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i += 1
            j += 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie -= 1
            je -= 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        na, nb = Counter(a[i:ie]), Counter(b[j:je])
        at = {b[y]: y for y in range(j, je) if nb[b[y]] == 1 and na.get(b[y]) == 1}
        if not at:
            continue
        seq = [(x, at[a[x]]) for x in range(i, ie) if a[x] in at]
        tops, tails, back = [], [], [-1] * len(seq)
        for k, (_, y) in enumerate(seq):
            p = bisect_left(tops, y)
            back[k] = tails[p - 1] if p else -1
            if p == len(tops):
                tops.append(y)
                tails.append(k)
            else:
                tops[p], tails[p] = y, k
        k, kept = tails[-1], []
        while k >= 0:
            kept.append(seq[k])
            k = back[k]
        x0, y0 = i, j
        for x, y in reversed(kept):
            out.append((x, y))
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
        todo.append((x0, ie, y0, je))
    return sorted(out)


def dropped(early: list, late: list, chars: list) -> list[int]:
    """The lines of late in aligned blocks of at least MIN_CHARS characters."""
    out, block = [], []
    for pair in [*patience(early, late), None]:
        if block and (pair is None or pair != (block[-1][0] + 1, block[-1][1] + 1)):
            if sum(chars[j] for _, j in block) >= MIN_CHARS:
                out += [j for _, j in block]
            block = []
        if pair:
            block.append(pair)
    return out


def keys_of(h: np.ndarray, n: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last line of the shortest runs of MIN_CHARS from each line on and up to each line, and their number by row."""
    run = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    row = np.repeat(np.arange(len(per)), per)
    end = np.cumsum(per)
    at = np.arange(len(n))
    on = np.searchsorted(run, run[:-1] + MIN_CHARS, "left") - 1  # the last line of the run that begins at each line
    to = np.searchsorted(run, run[1:] - MIN_CHARS, "right") - 1  # the first line of the run that ends at each line
    fore, back = on < end[row], to >= (end - per)[row]
    pair = np.unique(np.concatenate([at[fore] * len(n) + on[fore], to[back] * len(n) + at[back]]))
    a, b = (pair // len(n), pair % len(n)) if len(n) else (pair, pair)
    first = (end - per)[row[a]] if len(a) else a
    return tv.hashes(h.view(np.uint64), a, b + 1).view(np.int64), (a - first).astype(np.int32), (b - first).astype(np.int32), np.bincount(row[a], minlength=len(per))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of doc_id and text), h and n (hash and length of each line) and runs (the keys) of each document."""
    run = pa.struct([("line", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("h", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("runs", pa.list_(run))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text", max_rows=4096):
                h, n, per = line_hashes(piece.column(2))
                line, a, b, each = keys_of(h, n, per)
                o = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
                runs = pa.ListArray.from_arrays(o, pa.StructArray.from_arrays([pa.array(line), pa.array(a), pa.array(b)], fields=list(run)))
                yield tv.batch_of(schema, piece.column(0), piece.column(1), tv.list_array(h, per, pa.int64()), tv.list_array(n, per, pa.int32()), runs)

    own = docs.where("doc_id is not null and text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")
    return own.mapInArrow(part, "doc_id long, key long, h array<long>, n array<int>, runs array<struct<line:bigint,a:int,b:int>>")


def _aligned(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """gone of each later document of pairs (doc_id, key, e_id, e_key): the lines to delete."""
    early = one.select(F.col("doc_id").alias("e_id"), F.col("key").alias("e_key"), F.col("h").alias("e_h"))
    # the earlier document's lines join last, behind the last shuffle: very many may be linked to one
    both = pairs.join(one.select("doc_id", "key", "h", "n"), ["doc_id", "key"]).join(early, ["e_id", "e_key"]).select("doc_id", "key", "e_h", "h", "n")
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [dropped(e, h, n) for e, h, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield tv.batch_of(schema, batch.column(0), batch.column(1), gone)

    out = both.mapInArrow(part, "doc_id long, key long, gone array<int>").where(F.size("gone") > 0)
    return out.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _open(gone: Column, links: Column, past: int) -> Column:
    """Those of links with a line that isn't gone, whose holders aren't all behind."""
    return F.filter(links, lambda x: (x["n"] > past) & F.exists(F.sequence(x["a"], x["b"]), lambda i: ~F.array_contains(gone, i)))


def deletions(docs: DataFrame) -> DataFrame:
    """doc_id, key and the sorted numbers of the lines to delete, for the documents that lose any."""
    lines = tv.written(lines_of(docs), "lines")
    one = lines.dropDuplicates(["doc_id", "key"])
    who = F.struct("doc_id", "key")
    holds = lines.select("doc_id", "key", F.explode(F.array_distinct(F.col("runs.line"))).alias("line"))
    first = holds.groupBy("line").agg(F.min(who).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = lines.select("doc_id", "key", F.explode("runs").alias("r")).select("doc_id", "key", "r.*").join(first, "line").where(who > F.col("first"))
    linked = linked.groupBy("doc_id", "key", F.col("first.doc_id").alias("e_id"), F.col("first.key").alias("e_key")).agg(F.collect_set(F.struct("line", "a", "b", "n")).alias("links"))
    linked = tv.written(linked, "links")
    got = tv.written(_aligned(linked.drop("links"), one), "gone")
    found, past, more, holders = [got], 1, NEXT, None
    links = linked.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("links")).alias("links")).join(got, ["doc_id", "key"], "left")
    none = F.array().cast("array<int>")
    todo = links.select("doc_id", "key", F.coalesce("gone", none).alias("gone"), "links")
    while True:
        # what is left of the keys, if they have further holders
        todo = tv.written(todo.select("doc_id", "key", "gone", _open(F.col("gone"), F.col("links"), past).alias("links")).where(F.size("links") > 0), "left")
        if todo.isEmpty():
            break
        each = todo.select("doc_id", "key", F.explode(F.col("links.line")).alias("line")).distinct()
        if holders is None:
            # a place among the n holders by hash: slices of any size without ranking very many holders in one task
            place = (F.pmod(F.xxhash64("line", "doc_id", "key"), F.lit(1 << 30)) * F.col("n") / F.lit(1 << 30)).cast("long")
            again = holds.join(first, "line").join(each.select("line").distinct(), "line", "left_semi")
            holders = tv.written(again.select("line", F.col("doc_id").alias("e_id"), F.col("key").alias("e_key"), place.alias("place")).distinct(), "holders")
        low = 0 if past == 1 else past
        pairs = each.join(holders.where((F.col("place") >= low) & (F.col("place") < past + more)), "line").where(who > F.struct("e_id", "e_key"))
        new = tv.written(_aligned(pairs.select("doc_id", "key", "e_id", "e_key").distinct(), one), "gone")
        found.append(new)
        past, more = past + more, more * NEXT
        todo = todo.join(new.withColumnRenamed("gone", "new"), ["doc_id", "key"], "left").select("doc_id", "key", F.array_union("gone", F.coalesce("new", none)).alias("gone"), "links")
    if len(found) == 1:
        return got.select("doc_id", "key", F.array_sort("gone").alias("gone"))
    every = reduce(DataFrame.union, found).groupBy("doc_id", "key")
    return every.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def _cleaned(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with their text cleaned and, under a name that docs doesn't have, the numbers of the deleted lines."""
    own = "_gone"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    gone = deletions(docs.select("doc_id", "text")).select(F.col("doc_id").alias(own + "d"), F.col("key").alias(own + "k"), F.col("gone").alias(own))
    joined = docs.join(gone.hint("shuffle_hash"), (docs["doc_id"] == gone[own + "d"]) & (F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == gone[own + "k"]), "left")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(own), i)), "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col(own)), own


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, the text without the deleted lines, and how many lines went, for every document."""
    out, gone = _cleaned(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.coalesce(F.size(gone), F.lit(0)).cast("int").alias("lines_deleted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their text cleaned; a document of which no line is left goes. n_chars follows the text if docs has it."""
    out, gone = _cleaned(docs)
    out = out.where(F.col(gone).isNull() | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
