"""Vectorised text primitives over Arrow buffers: byte arrays in, numpy arrays out, no Python strings.

A *word* is a maximal run of ASCII letters, digits or non-ASCII bytes of the lower-cased text.
Hashes are 64-bit polynomial hashes (taken from one running sum) with a mixing finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from tessella.sources.snapshots import shared_dir, written  # noqa: F401

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 512
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for key, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, col: str, max_bytes: int = CHUNK_BYTES, max_rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows that hold about max_bytes of text; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (held + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)


def spans(data: np.ndarray, offs: np.ndarray, lut: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of bytes in lut, never across rows; and the count of runs by row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    m = lut[data]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    before &= ~first[:n]
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:] & ~first[1:n]
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=run[1:])
    h = (run[ends] - run[starts]) * inv[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, counts by row, row offsets in bytes) of the words of a text column."""
    data, offs = buffers(lowered(text) if lower else text)
    s, e, n = spans(data, offs)
    return hashes(data, s, e), s, e, n, offs


def grams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row's elements, and the position of each one's first element."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]
    at = np.flatnonzero(row[: len(g)] == row[n - 1 :])
    return mix(g[at]), at


def pass_through(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(keep))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    o = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=o[1:])
    return pa.ListArray.from_arrays(pa.array(o), pa.array(values, kind))


def batch_of(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue().to_pybytes())


def unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()
