"""Near-duplicate groups: the Jaccard join of the documents' word n-gram sets.

Documents whose sets of N-gram hashes have a Jaccard similarity of THRESHOLD or more are joined; a group is a connected
component of that join.

1. Texts are packed into chunks of about a megabyte, each a row. Every chunk sends 32 bits of its n-grams' hashes to BUCKETS or more
   buckets, and gets back for each how many documents hold it, on a logarithmic scale. A set of n n-grams takes
   as tile keys the rarest n - ceil(THRESHOLD n) + 1 of them (the same order everywhere: frequency, then hash). Two sets at the
   threshold share ceil(THRESHOLD n) n-grams or more, so the first of these in that order is a key of both: no pair is missed. N-grams
   of one document alone can't be shared and are no keys, so that a text without near copies has few keys or none.
   Equal sets count once from here on.
2. A tile has the sets with one key; of tiles with the same sets, one is worked off. In it meet those of sizes in
   [t n, n / t], t being the threshold, as no others can reach it. A tile of more than BLOCK sets is hot (a passage that very
   many documents are largely made of; others have rarer keys). It is cut by size band and worked off by pairs of blocks of BLOCK
   sets, none left out.
   The bitmaps of A and B (parity, 3 to 6 bits for each hash), the larger folded to the size of the smaller, differ in at most |A ^ B| bits, so
   |A & B| <= (|A| + |B| - differing bits) / 2: pairs for which that is too few are ruled out. The others make the tile's
   clusters, found breadth first: a set found once isn't sought again.
3. The components of all clusters get the texts of their sets. All pairs of different sets in a component that pass the same two
   bounds have their exact intersection, by pairs of blocks of BLOCK sets; each pair is seen once. That gives the groups' edges and
   the number of documents each set is joined with; a set counts for each document that has it.
   No pair or partner is capped, and no task gets a whole group.

Defined results: a text with fewer than N words has the hash of all its words as its only n-gram; a very long text has all of
its n-grams; null, empty or wordless texts and null doc_ids join nothing; rows with the same doc_id are one document, joined
through any of its texts, whose links add up; equal sets are one group, named by its least doc_id; extra columns are ignored, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec as tv
from tessella.operators.graph import connected

N = 3
THRESHOLD = 0.5
BLOCK = 4096
BUCKETS = 32


def gram_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-gram hashes of each row without repeats, end to end, and the size of each set."""
    h, _, _, per, _ = tv.words(text)
    g, at = tv.grams(h, per, N)
    row = np.repeat(np.arange(len(per)), per)
    short = np.flatnonzero((per > 0) & (per < N))
    if len(short):
        first = np.cumsum(per) - per
        one = np.zeros(len(short), np.uint64)
        for k in range(N):
            has = per[short] > k
            one[has] = tv.mix(one[has] * np.uint64(3) + h[first[short[has]] + k])
        g, r = np.concatenate([g, one]), np.concatenate([row[at], short])
    else:
        r = row[at]
    o = np.lexsort((g, r))
    g, r = g[o], r[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[new], r[new]
    return g, np.bincount(r, minlength=len(per))


def bits_of(n: np.ndarray) -> np.ndarray:
    """The size of a set's bitmap: a power of two from 3 to 6 bits a hash, so that sets of nearly equal size differ by one fold."""
    return (1 << np.ceil(np.log2(np.maximum(3 * n, 128))).astype(np.int64)).astype(np.int64)


def signatures(g: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each set; and the parity bitmaps, end to end, in bytes."""
    row = np.repeat(np.arange(len(size)), size)
    run = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(tv.mix(g + np.uint64(0x5851F42D4C957F2D)), out=run[1:])
    end = np.cumsum(size)
    sig = tv.mix((run[end] - run[end - size]) ^ size.astype(np.uint64))
    m = bits_of(size)
    first = np.cumsum(m) - m
    odd = np.bincount(first[row] + ((g >> np.uint64(20)).astype(np.int64) & (m[row] - 1)), minlength=int(m.sum())) & 1
    return sig, np.packbits(odd.astype(np.uint8))


def _chunked(docs: DataFrame) -> DataFrame:
    """chunk, blob and size in bytes: about a megabyte of documents in each row, packed."""
    schema = pa.schema([("blob", pa.binary()), ("size", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "text"):
                yield tv.batch_of(schema, [tv.packed(piece)], [piece.nbytes])

    own = docs.where("doc_id is not null and text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(part, "blob binary, size long").withColumn("chunk", F.monotonically_increasing_id())


def _dealt(g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts hashes by bucket, and the number in each bucket."""
    b = (g % np.uint64(buckets)).astype(np.int32)
    return np.argsort(b, kind="stable"), np.bincount(b, minlength=buckets)


def _levels(chunks: DataFrame, buckets: int) -> DataFrame:
    """chunk, l: for each bucket, the levels of the chunk's n-grams in it; 0 is that of an n-gram that one document holds.

    N-grams with the same 32 bits in a bucket share a level, which is as good an order."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("g", pa.binary())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                g, _ = gram_sets(tv.unpacked(blob.as_py()).column(1))
                o, per = _dealt(g, buckets)
                some = np.flatnonzero(per)
                yield tv.batch_of(schema, some.astype(np.int32), np.full(len(some), chunk), _binary((g[o] >> np.uint64(32)).astype(np.uint32).view(np.uint8), 4 * per[some]))

    done = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("level", pa.binary())])

    def leveled(bucket: int, chunk: list, held: list) -> pa.RecordBatch:
        size = np.array([len(x) for x in held])
        _, at, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        level = np.minimum(4 * np.log2(n), 255).astype(np.uint8)
        return tv.batch_of(done, chunk, np.full(len(chunk), bucket, np.int32), _binary(level[at], size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held = None, [], []
        for batch in batches:
            for b, c, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != now:
                    if held:
                        yield leveled(now, chunk, held)
                    now, chunk, held = b, [], []
                chunk.append(c)
                held.append(np.frombuffer(g.as_py(), np.uint32))
        if held:
            yield leveled(now, chunk, held)

    dealt = chunks.select("chunk", "blob").mapInArrow(part, "bucket int, chunk long, g binary")
    counted = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "chunk long, bucket int, level binary")
    return counted.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "level"))).alias("l"))


def keys(g: np.ndarray, size: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tile keys of sets of n-grams of those levels, and their number by set."""
    most = size - np.ceil(THRESHOLD * size - 1e-9).astype(np.int64) + 1
    row = np.repeat(np.arange(len(size)), size)
    some = np.flatnonzero(level > 0)
    some = some[np.lexsort((g[some], level[some], row[some]))]
    r = row[some]
    n = np.bincount(r, minlength=len(size))
    rank = (size - n)[r] + np.arange(len(some)) - (np.cumsum(n) - n)[r]  # those of one document come first
    use = rank < most[r]
    return g[some[use]], np.bincount(r[use], minlength=len(size))


def profiles(docs: DataFrame) -> DataFrame:
    """chunk and place (at), doc_id, sig, n, bits and tiles of each document with words."""
    return _profiles(tv.written(_chunked(docs), "chunks"))


def _profiles(chunks: DataFrame) -> DataFrame:
    schema = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("tiles", pa.list_(pa.int64()))])
    # a bucket is a task's memory
    buckets = max(BUCKETS, _partitions(chunks), int(chunks.agg(F.sum("size")).first()[0] or 0) >> 25)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = tv.unpacked(batch.column(1)[i].as_py())
                g, size = gram_sets(own.column(1))
                o, _ = _dealt(g, buckets)
                level = np.empty(len(g), np.uint8)
                level[o] = tv.buffers(batch.column(2)[i].values.field(1))[0]
                sig, bits = signatures(g, size)
                tiles, per = keys(g, size, level)
                chunk = np.full(len(size), batch.column(0)[i].as_py())
                out = tv.batch_of(schema, chunk, np.arange(len(size), dtype=np.int32), own.column(0), sig.view(np.int64), size.astype(np.int32), _binary(bits, bits_of(size) // 8), tv.list_array(tiles.view(np.int64), per, pa.int64()))
                yield tv.pass_through(out, size > 0)

    with_levels = chunks.join(_levels(chunks, buckets).hint("shuffle_hash"), "chunk").select("chunk", "blob", "l")
    return with_levels.mapInArrow(part, "chunk long, at int, doc_id long, sig long, n int, bits binary, tiles array<long>")


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    o = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(o.tobytes()), pa.py_buffer(data.tobytes())])


def _bound(n: np.ndarray, bits: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some sets the bitmaps, end to end in bytes, don't rule out as partners of a set; n holds the sizes."""
    size = bits_of(n)
    first = (np.cumsum(size) - size) // 8
    at, full, half = np.zeros(len(n), np.int64), {}, {}
    for m in np.unique(size).tolist():
        own = np.flatnonzero(size == m)
        at[own] = np.arange(len(own))
        full[m] = bits[first[own][:, None] + np.arange(m // 8)].view(np.uint64)
        half[m] = full[m][:, : m // 128] ^ full[m][:, m // 128 :]

    def passing(v: int, band: np.ndarray) -> np.ndarray:
        out, m = np.zeros(len(band), np.int64), int(size[v])
        for k in np.unique(size[band]).tolist():
            sel = size[band] == k
            a = full[m][at[v]] if k >= m else half[m][at[v]]
            b = full[k] if k <= m else half[k]
            out[sel] = np.bitwise_count(b[at[band[sel]]] ^ a).sum(1)
        both = n[band] + n[v]
        return (both - out) // 2 >= THRESHOLD / (1 + THRESHOLD) * both - 1e-9

    return passing


def walk(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The group of each set, named by the index of one member: joined are those that pass the bounds.

    n holds the sizes, bits the bitmaps end to end in bytes.
    """
    passing = _bound(n, bits)
    left, group = np.argsort(n, kind="stable"), np.full(len(n), -1)
    while len(left):
        seed = left[0]
        group[seed] = seed
        left, queue = left[1:], [seed]
        while queue and len(left):
            v = queue.pop()
            lo, hi = np.searchsorted(n[left], (np.ceil(n[v] * THRESHOLD - 1e-9), np.floor(n[v] / THRESHOLD + 1e-9) + 0.5))
            if lo == hi:
                continue
            band = left[lo:hi]
            hit = passing(v, band)
            if hit.any():
                found = band[hit]
                group[found] = seed
                queue += found.tolist()
                keep = np.ones(len(left), bool)
                keep[lo:hi] = ~hit
                left = left[keep]
    return group


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _met(sets: DataFrame) -> DataFrame:
    """(tile, band, i, j, sig): the tasks, named by the first four, in which sets (sig, band, tiles) meet."""
    keyed = sets.select(F.explode("tiles").alias("tile"), "sig")
    tiles = tv.written(keyed.groupBy("tile").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sig")).alias("who")).where("m > 1"), "tiles")
    hot = F.col("m") > BLOCK
    # tiles of the same sets have the same work
    one = tiles.groupBy("who", "m").agg(F.min("tile").alias("tile")).select("tile", "m")
    met = tv.written(keyed.join(one, "tile"), "met")
    zero = F.lit(0)
    small = met.where(~hot).select("tile", zero.alias("band"), zero.alias("i"), zero.alias("j"), "sig")
    # a set meets those of its own band and of the next: each is a tile of both
    hot = met.where(hot).join(sets.select("sig", "band"), "sig").select("tile", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "sig")
    blocks = hot.groupBy("tile", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    hot = hot.join(blocks, ["tile", "band"]).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    # every two blocks are a task's work of bounded size
    pairs = F.when(F.col("k") == 1, F.array(F.struct(zero.alias("i"), zero.alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(zero, F.col("k") - 1), lambda x: x != F.col("own")), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    )
    return small.union(hot.select("tile", "band", F.explode(pairs).alias("p"), "sig").select("tile", "band", "p.i", "p.j", "sig"))


def _clusters(sets: DataFrame) -> DataFrame:
    """(cluster, sig): sets that meet and whom the bounds join."""
    at = ["tile", "band", "i", "j"]
    # bitmaps go only where they meet others
    rows = _met(sets).join(sets.select("sig", "n", "bits").hint("shuffle_hash"), "sig")
    tasks = rows.repartition(_partitions(sets), *at).groupBy(*at).agg(F.collect_list(F.struct("sig", "n", "bits")).alias("s"))
    schema = pa.schema([("cluster", pa.int64()), ("sig", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            o = col.offsets.to_numpy()
            s = col.values
            sig, n = s.field(0).to_numpy(), s.field(1).to_numpy().astype(np.int64)
            bits, edge = tv.buffers(s.field(2))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(o[:-1], o[1:]):
                g = walk(n[i:j], bits[edge[i] : edge[j]])
                # a cluster's name comes from its members, so that it is the same wherever it is found
                name = np.zeros(j - i, np.uint64)
                np.add.at(name, g, tv.mix(sig[i:j].view(np.uint64) + np.uint64(77)))
                use = np.flatnonzero((np.bincount(g, minlength=j - i) > 1)[g])
                a.append(name[g[use]].view(np.int64))
                b.append(sig[i:j][use])
            yield tv.batch_of(schema, np.concatenate(a), np.concatenate(b))

    return tasks.select("s").mapInArrow(part, "cluster long, sig long").distinct()


def _texts(chunks: DataFrame, prof: DataFrame, clusters: DataFrame) -> DataFrame:
    """sig and text, compressed, of every set in clusters."""
    reps = prof.groupBy("sig").agg(F.min(F.struct("chunk", "at")).alias("r"))
    want = clusters.select("sig").distinct().join(reps, "sig").groupBy("r.chunk").agg(F.collect_list(F.struct("r.at", "sig")).alias("want"))
    schema = pa.schema([("sig", pa.int64()), ("text", pa.binary())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for blob, want in zip(batch.column(0), batch.column(1)):
                text = tv.unpacked(blob.as_py()).column(1)
                at, sig = want.values.field(0), want.values.field(1)
                yield tv.batch_of(schema, sig, [pack(x.encode()) for x in text.take(at).to_pylist()])

    return chunks.select("chunk", "blob").join(want.hint("shuffle_hash"), "chunk").select("blob", "want").mapInArrow(part, "sig long, text binary")


def _worked(rows: DataFrame, work: Callable[[np.ndarray, list, np.ndarray, np.ndarray], pa.RecordBatch], ddl: str) -> DataFrame:
    """work(sigs, sets of n-grams, sides, documents) of each task, from rows (task, side, docs, sig, text)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, held = None, []

        def done() -> pa.RecordBatch:
            cols = [np.concatenate([h[k] for h in held]) for k in (0, 2, 3)]
            return work(cols[0], [x for h in held for x in h[1]], cols[1], cols[2])

        for batch in batches:
            for piece in tv.pieces(batch, "text", max_bytes=tv.CHUNK_BYTES // 4):
                task, side, docs, sig = (piece.column(k).to_numpy() for k in range(4))
                g, size = gram_sets(pa.array([unpack(x).decode() for x in piece.column(4).to_pylist()], pa.string()))
                own = np.split(g, np.cumsum(size)[:-1])
                cut = np.flatnonzero(np.diff(task)) + 1
                for i, j in zip([0, *cut], [*cut, len(task)]):
                    if task[i] != now:
                        if held:
                            yield done()
                        now, held = task[i], []
                    held.append((sig[i:j], [x.copy() for x in own[i:j]], side[i:j], docs[i:j]))
        if held:
            yield done()

    rows = rows.select("task", "side", "docs", "sig", "text")
    return rows.repartition(_partitions(rows), "task").sortWithinPartitions("task").mapInArrow(part, ddl)


def linked(own: list, side: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set, the index of one member of its group, and the documents of the sets that the threshold joins it with.

    Sets meet those of the other side alone, if there are two."""
    n = np.array([len(x) for x in own])
    flat = np.concatenate(own)
    _, bits = signatures(flat, n)
    passing = _bound(n, bits)
    names, gram = np.unique(flat, return_inverse=True)
    start, has = np.cumsum(n) - n, np.zeros(len(names), bool)
    links, group = np.zeros(len(own), np.int64), np.arange(len(own))
    order = np.argsort(n, kind="stable")
    sizes, cross = n[order], bool(side.any())
    for i, v in enumerate(order.tolist()):
        # those of the same size or larger that stand behind it
        band = order[i + 1 : np.searchsorted(sizes, np.floor(n[v] / THRESHOLD + 1e-9) + 0.5)]
        if cross:
            band = band[side[band] != side[v]]
        if len(band):
            band = band[passing(v, band)]
        if not len(band):
            continue
        mine, k = gram[start[v] : start[v] + n[v]], n[band]
        has[mine] = True
        first = np.cumsum(k) - k
        common = np.add.reduceat(has[gram[np.repeat(start[band] - first, k) + np.arange(int(k.sum()))]].astype(np.int64), first)
        has[mine] = False
        hit = band[common >= THRESHOLD * (k + n[v] - common) - 1e-9]
        if len(hit):
            links[v] += docs[hit].sum()
            links[hit] += docs[v]
            joined = np.unique(np.append(group[hit], group[v]))
            if len(joined) > 1:
                group[np.isin(group, joined)] = joined[0]
    return group, links


def _verified(texts: DataFrame, near: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst, links): edges of the exact join within components (id, component) of what the bounds join.

    Each set is src in every task it is in; links are the documents that it is joined with there. docs: (sig, docs)."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("links", pa.int64())])
    zero = F.lit(0)
    k = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    own = near.withColumnRenamed("id", "sig").join(k, "component").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    # every two blocks are a task, and each by itself
    pairs = F.transform(F.sequence(zero, F.col("k") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    each = own.select("component", "own", "sig", F.explode(pairs).alias("p"))
    side = ((F.col("p.i") != F.col("p.j")) & (F.col("own") == F.col("p.j"))).cast("int")
    rows = each.select(F.xxhash64("component", "p.i", "p.j").alias("task"), side.alias("side"), "sig")

    def work(sig: np.ndarray, own: list, side: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        group, links = linked(own, side, docs)
        return tv.batch_of(schema, sig, sig[group], links)

    return _worked(rows.join(docs, "sig").join(texts, "sig"), work, "src long, dst long, links long")


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The profiles, the components (id, component) of the sets that have partners, and the links of a document of each set (sig, links)."""
    chunks = tv.written(_chunked(docs), "chunks")
    prof = tv.written(_profiles(chunks), "profiles")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / THRESHOLD)) + 1e-9).cast("int")
    sets = prof.groupBy("sig").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("tiles").alias("tiles")).withColumn("band", band)
    clusters = tv.written(_clusters(tv.written(sets, "sets")), "clusters")
    # what the bounds join is worked off once
    near = tv.written(connected(clusters.groupBy("cluster").agg(F.min("sig").alias("dst")).join(clusters, "cluster").select(F.col("sig").alias("src"), "dst")), "near")
    held = prof.select("doc_id", "sig").distinct().groupBy("sig").agg(F.count(F.lit(1)).alias("docs"))
    edges = tv.written(_verified(_texts(chunks, prof, clusters), near, held), "verified")
    links = held.join(edges.groupBy("src").agg(F.sum("links").alias("links")).withColumnRenamed("src", "sig"), "sig", "left")
    return prof, connected(edges.where("src != dst")), links.select("sig", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"))


def _grouped(prof: DataFrame, comp: DataFrame) -> DataFrame:
    """(doc_id, sig, group_id) of the documents that have a near duplicate."""
    member = prof.select("doc_id", "sig").distinct().join(comp.withColumnRenamed("id", "sig").hint("shuffle_hash"), "sig", "left").select("doc_id", "sig", F.coalesce("component", "sig").alias("root"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.max("doc_id").alias("most")).where("group_id < most")
    return member.join(least.select("root", "group_id"), "root").select("doc_id", "sig", "group_id")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the documents that have a near duplicate; a group is named by its least doc_id."""
    prof, comp, _ = _joined(docs)
    return _grouped(prof, comp).select("doc_id", "group_id").distinct()


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, links) of the documents that have a near duplicate; links is the number of documents they are joined with."""
    prof, comp, each = _joined(docs)
    return _grouped(prof, comp).join(each, "sig").groupBy("doc_id", "group_id").agg(F.sum("links").alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that has near duplicates: doc_id, its group (the least doc_id in it) and the number of documents it is joined with."""
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that have a near duplicate of lower doc_id in their group."""
    gone = groups(docs).where("doc_id != group_id").select(F.col("doc_id").alias("_near_duplicate")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_near_duplicate"], "left_anti")
