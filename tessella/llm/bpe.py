"""Byte-pair encoding and decoding with per-prefix dynamic programming.

A text is cut into pretokens by the vocabulary's pattern, worked out from character classes of a whole chunk at once.
For every prefix of a pretoken there is exactly one last token that byte-pair merging would leave there. An automaton
over the vocabulary gives, after each byte, the longest token that ends there; each token points to the next shorter one
that is its suffix. The first of them that is compatible with the last token of the prefix before it is stored, where two
tokens are compatible if undoing their merges never shows a pair that merging would have joined across their border.
Back-pointers from the end of the pretoken then spell the ids.

All new pretokens of a chunk go through this side by side; results are kept by 64-bit hash for the chunks that follow.
Every chunk is decoded and compared with its bytes, so that a hash collision can't pass: such a chunk is encoded afresh.

Defined results: a null text has null ids and 0 tokens, an empty one has no ids; strings that look like special tokens
are ordinary text; rows are encoded one by one, so repeats, nulls in other columns and extra columns of whatever name change
nothing; a very long text, or a single word as long, has the ids of the whole (words beyond LONG bytes only take another loop);
there are no ties: every prefix has one last token; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import textvec as tv

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 1_000_000  # pretokens kept by a worker; beyond that it begins anew
MEMO = 20  # bits of the number of pairs whose compatibility is remembered
LONG = 256  # longer pretokens are encoded one by one
_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 0
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Table:
    """An open-addressing map from non-negative int64 keys to int32 values, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Vocabulary:
    """Tokens by id, their automaton, and how each was merged."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.size = size
        tokens = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        usable = np.zeros(size, bool)
        for t, i in ranks.items():
            parts = self._last_merge(t, ranks)
            if parts:
                usable[i] = True
                self.left[i], self.right[i] = parts
        split = np.flatnonzero(usable & (self.left != np.arange(size)))
        self.pairs = Table(self.left[split].astype(np.int64) * size + self.right[split], split.astype(np.int32))
        self.memo = np.full(1 << MEMO, -2, np.int64)  # a pair of tokens, and whether they are compatible in the last bit
        self.length = np.array([len(t) for t in tokens], np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._automaton(tokens, usable)
        self.whole = {t: i for t, i in ranks.items() if not usable[i]}

    @staticmethod
    def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte; None if merging doesn't lead to it."""
        if len(token) == 1:
            return ranks[token], ranks[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] >= ranks[token]:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if all(p in ranks for p in parts) else None

    def _automaton(self, tokens: list[bytes], usable: np.ndarray) -> None:
        nodes: list[dict[int, int]] = [{}]
        token_at = [-1]
        for i, t in enumerate(tokens):
            if usable[i]:
                s = 0
                for b in t:
                    s2 = nodes[s].get(b)
                    if s2 is None:
                        s2 = nodes[s][b] = len(nodes)
                        nodes.append({})
                        token_at.append(-1)
                    s = s2
                token_at[s] = i
        fail, longest, shorter = [0] * len(nodes), list(token_at), np.full(self.size, -1, np.int32)
        queue = list(nodes[0].values())
        for s in queue:
            f = fail[s]
            up = longest[f] if s else -1
            if token_at[s] >= 0:
                shorter[token_at[s]] = up
            else:
                longest[s] = up
            for b, c in nodes[s].items():
                g = f
                while g and b not in nodes[g]:
                    g = fail[g]
                g = nodes[g].get(b, 0)
                fail[c] = g if g != c else 0
                queue.append(c)
        keys = np.array([s << 8 | b for s, x in enumerate(nodes) for b in x], np.int64)
        self.goto = Table(keys, np.array([c for x in nodes for c in x.values()], np.int32))
        self.root = np.array([nodes[0].get(b, 0) for b in range(256)], np.int32)
        self.fail, self.longest, self.shorter = np.array(fail, np.int32), np.array(longest, np.int32), shorter

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.empty(len(state), np.int32)
        left, s = np.arange(len(state)), state
        while len(left):
            to = self.goto.get(s.astype(np.int64) << 8 | byte[left])
            to = np.where((to < 0) & (s == 0), self.root[byte[left]], to)
            done = to >= 0
            out[left[done]] = to[done]
            left, s = left[~done], self.fail[s[~done]]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of token a followed by those of b leaves just these two; pairs asked for lately are remembered."""
        pair = a.astype(np.int64) * self.size + b
        at = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO)).astype(np.int64)
        held = self.memo[at]
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            held[new] = pair[new] << 1 | self._undone(a[new], b[new])
            self.memo[at[new]] = held[new]
        return (held & 1).astype(bool)

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40)
        while len(at):
            joined = self.pairs.get(a * self.size + b)
            bad = (joined >= 0) & (joined < limit)
            out[at[bad]] = False
            # the later of the two merges is undone first; a byte can't be, and then it is the other one's turn
            a_in, b_in = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            undo_a = np.where(a > b, a_in != a, b_in == b)
            stuck = (a_in == a) & (b_in == b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, a_in, a), np.where(undo_a, b, b_in)
            go = ~bad & ~stuck
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def encode_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each data[start:end], end to end, and the number of ids of each."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        counts, parts = np.zeros(len(size), np.int64), [None] * len(size)
        long = int((size > LONG).sum())
        for w in order[:long]:
            parts[w] = self._encode_one(data[starts[w] : ends[w]])
            counts[w] = len(parts[w])
        todo = order[long:]
        begin = 0
        flat_at, flat_id, flat_seq = [], [], []
        while begin < len(todo):
            top = max(1, int(size[todo[begin]]))
            # words of more than half the longest length share a table
            stop = begin + int(np.searchsorted(-size[todo[begin:]], -(top // 2), side="left"))
            stop = max(begin + 1, min(stop, begin + (1 << 22) // (top + 1)))
            own = todo[begin:stop]
            last = np.full((len(own), top + 1), -1, np.int32)
            state = np.zeros(len(own), np.int32)
            n = size[own]
            for i in range(top):
                act = int(np.searchsorted(-n, -i, side="left"))  # those longer than i
                byte = data[starts[own[:act]] + i].astype(np.int64)
                state = self.step(state[:act], byte)
                cand, left = self.longest[state], np.arange(act)
                while len(left):
                    at = i + 1 - self.length[cand]
                    before = last[left, at]
                    ok = at == 0
                    ask = np.flatnonzero(~ok)
                    ok[ask] = self.compatible(before[ask], cand[ask])
                    last[left[ok], i + 1] = cand[ok]
                    left, cand = left[~ok], self.shorter[cand[~ok]]
            w, at, seq = np.flatnonzero(n > 0), n[n > 0].copy(), 0
            while len(w):
                t = last[w, at]
                flat_at.append(own[w])
                flat_id.append(t)
                flat_seq.append(np.full(len(w), -seq))
                counts[own[w]] += 1
                at = at - self.length[t]
                w, at, seq = w[at > 0], at[at > 0], seq + 1
            begin = stop
        for w in order[:long]:
            flat_at.append(np.full(len(parts[w]), w))
            flat_id.append(np.array(parts[w], np.int32))
            flat_seq.append(np.arange(len(parts[w])))
        if not flat_at:
            return np.zeros(0, np.int32), counts
        word, ids, seq = (np.concatenate(x) for x in (flat_at, flat_id, flat_seq))
        return ids[np.lexsort((seq, word))].astype(np.int32), counts

    def _encode_one(self, x: np.ndarray) -> list[int]:
        last = np.full(len(x) + 1, -1, np.int32)
        memo: dict[tuple[int, int], bool] = {}
        state, goto, longest, shorter, length = 0, self._dict(), self._lists()[0], self._lists()[1], self._lists()[2]
        for i, b in enumerate(x.tolist()):
            while state and (state << 8 | b) not in goto:
                state = int(self.fail[state])
            state = goto.get(state << 8 | b, 0)
            c = longest[state]
            while True:
                at = i + 1 - length[c]
                if at == 0:
                    break
                k = (int(last[at]), c)
                ok = memo.get(k)
                if ok is None:
                    ok = memo[k] = bool(self.compatible(np.array([k[0]]), np.array([c]))[0])
                if ok:
                    break
                c = shorter[c]
            last[i + 1] = c
        out, at = [], len(x)
        while at:
            out.append(int(last[at]))
            at -= length[out[-1]]
        return out[::-1]

    def _dict(self) -> dict[int, int]:
        if not hasattr(self, "_d"):
            there = self.goto.keys >= 0
            self._d = dict(zip(self.goto.keys[there].tolist(), self.goto.values[there].tolist()))
        return self._d

    def _lists(self) -> tuple[list, list, list]:
        if not hasattr(self, "_l"):
            self._l = self.longest.tolist(), self.shorter.tolist(), self.length.tolist()
        return self._l

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        n = self.length[ids]
        total = int(n.sum())
        first = np.cumsum(n) - n
        return self.bytes[np.repeat(self.start[ids] - first, n) + np.arange(total)]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = _LETTER
        elif k == "N":
            out[c] = _NUMBER
    out[_WHITE] = _SPACE
    return out


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pretokens in UTF-8 rows laid end to end, and the number in each row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    lut = _classes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int64)
    kind = lut[np.minimum(b, 127)]
    wide = np.flatnonzero(b >= 0x80)
    if len(wide):
        d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        p, x = lead[wide], b[wide]
        c1, c2, c3 = d[p + 1] & 63, d[p + 2] & 63, d[p + 3] & 63
        cp = np.where(x >= 0xF0, (x & 7) << 18 | c1 << 12 | c2 << 6 | c3, np.where(x >= 0xE0, (x & 15) << 12 | c1 << 6 | c2, (x & 31) << 6 | c1))
        kind[wide] = lut[np.minimum(cp, 0x10FFFF)]
    m = len(lead)
    first = np.zeros(m + 1, bool)
    first[np.searchsorted(lead, offs)] = True  # the first character of each row; one beyond the end
    prev = np.empty(m, np.uint8)
    prev[0] = 255
    prev[1:] = kind[:-1]
    prev[first[:m]] = 255
    blank = kind == _SPACE
    plain = b == 32
    after = np.empty(m, bool)  # a character that isn't white space comes next in the row
    after[-1] = False
    after[:-1] = ~blank[1:] & ~first[1:m]
    joined = np.zeros(m, bool)  # the character before is the space that belongs to this pretoken
    joined[1:] = plain[:-1] & ~blank[1:] & ~first[1:m]
    cut = (kind != prev) & ~joined
    cut |= blank & after
    mark = np.flatnonzero((b == 39) & cut & ~joined)
    if len(mark):
        e = np.concatenate([b, np.zeros(3, np.int64)])
        end = np.concatenate([first, np.ones(3, bool)])  # first[m] may be set; beyond it all is
        c1, c2 = np.where(end[mark + 1], 0, e[mark + 1]), np.where(end[mark + 1] | end[mark + 2], 0, e[mark + 2])
        one = (c1 == 115) | (c1 == 116) | (c1 == 109) | (c1 == 100)
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        ext = np.append(cut, [True] * 4)
        for hit, w in ((one, 2), (two, 3)):
            ext[mark[hit] + 1] = False
            ext[mark[hit] + w] = True
        cut = ext[:m]
    starts = lead[cut]
    return starts, np.diff(np.searchsorted(starts, offs))


class Encoder:
    """Encodes chunks, keeping what it has found for the pretokens it met."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.v, self.most = vocabulary, cache
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.levels = [(none.astype(np.uint64), none, none)] * 2  # hash, place and number of ids: most of them, and the latest
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, end to end, and their number in each row; checked by decoding."""
        starts, per = pretokens(data, offs)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        ids, n = self._cached(data, starts, ends)
        if not np.array_equal(self.v.decode(ids), data):
            ids, n = self._fresh(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(n)])
        edge = np.concatenate([[0], np.cumsum(per)])
        return ids, np.diff(total[edge])

    def _fresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self.v.encode_many(data, starts, ends)
        if self.v.whole:  # a pretoken that is a token as a whole is never split, though merging doesn't lead to it
            parts = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
            for i, (s, e) in enumerate(zip(starts, ends)):
                t = self.v.whole.get(data[s:e].tobytes())
                if t is not None:
                    parts[i], n[i] = np.array([t], np.int32), 1
            ids = np.concatenate(parts) if len(parts) else ids
        return ids, n

    def _cached(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = tv.hashes(data, starts, ends)
        u, one, back = np.unique(h, return_index=True, return_inverse=True)
        has, at, n = np.zeros(len(u), bool), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        for known, place, number in self.levels:
            if len(known):
                i = np.minimum(np.searchsorted(known, u), len(known) - 1)
                hit = np.flatnonzero(known[i] == u)
                has[hit], at[hit], n[hit] = True, place[i[hit]], number[i[hit]]
        new = np.flatnonzero(~has)
        if len(new):
            held = sum(len(x[0]) for x in self.levels)
            if held and held + len(new) > self.most:
                self.forget()
                return self._cached(data, starts, ends)
            ids, n[new] = self._fresh(data, starts[one[new]], ends[one[new]])
            at[new] = self.used + np.cumsum(n[new]) - n[new]
            self._keep(ids, (u[new], at[new], n[new]))
        at, n = at[back], n[back]
        first = np.cumsum(n) - n
        return self.ids[np.repeat(at - first, n) + np.arange(int(n.sum()))], n

    def _keep(self, ids: np.ndarray, new: tuple[np.ndarray, ...]) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        most, late = self.levels
        late = self._merged(late, new)
        # what is large is merged rarely
        self.levels = [self._merged(most, late), tuple(x[:0] for x in late)] if 4 * len(late[0]) > len(most[0]) else [most, late]

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        o = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[o] for x, y in zip(a, b))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This process's encoder."""
    return Encoder(load(path))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids and their number for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for piece in tv.pieces(batch, "text"):
                text = piece.column(1)
                ids, n = enc.encode(*tv.buffers(text))
                lists = tv.list_array(ids, n, pa.int32())
                if text.null_count:
                    lists = pa.array([y.as_py() if x else None for x, y in zip(text.is_valid().to_pylist(), lists)], pa.list_(pa.int32()))
                yield tv.batch_of(schema, piece.column(0).cast(pa.int64()), lists, n)

    return docs.select("doc_id", "text").mapInArrow(part, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the text that ids stand for; null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for whole in batches:
            for k in range(0, whole.num_rows, tv.CHUNK_ROWS):
                batch = whole.slice(k, tv.CHUNK_ROWS)
                col = batch.column(1)
                flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                end = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
                run = np.concatenate([[0], np.cumsum(v.length[flat])])
                at = np.concatenate([[0], run[end]]).astype(np.int64)
                text = pa.Array.from_buffers(pa.large_string(), len(col), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(v.decode(flat).tobytes())])
                yield tv.batch_of(schema, batch.column(0), pc.if_else(col.is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(part, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)
