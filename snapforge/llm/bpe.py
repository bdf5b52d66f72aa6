"""Byte-level BPE encoding and decoding with padded matrices.

Pieces of a text (matches of the public pattern) are put in buckets by length, each bucket a padded matrix of token ids
with one row per distinct piece. In each round every row merges its leftmost pair of lowest rank: pair ranks come from an
open-addressing hash table, only the two pairs beside a merge are looked up again, the merged column is cut out, and rows
without a pair left are taken out. Pieces longer than ``LONG_PIECE`` bytes (unbroken runs) are merged with a heap, whose
cost grows as n log n instead of n squared.

Nulls: a null text is encoded as the empty text (no ids). Other columns are carried as they are, whatever they are named;
a column named like one of the outputs is replaced. Repeated rows and repeated ids give a row each. An empty table gives
an empty table. Memory of a worker is bounded by ``common.CHUNK_BYTES`` of text, or one text if that is longer.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from snapforge.llm.common import arrow_map, chunks, ragged_take
from snapforge.llm.pieces import PieceMemo, Splitter

LONG_PIECE = 256
#: Cells of a matrix at most.
MATRIX_CELLS = 1 << 20


class PairTable:
    """(left id, right id) -> id of the merged token, as an open-addressing hash table in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, self.NONE, np.int64)
        key = self._key(left, right)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            want = todo[free]
            self.keys[slot[want]] = key[want]
            won = want[self.keys[slot[want]] == key[want]]
            self.values[slot[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    NONE = np.int64(1 << 40)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair does not merge; a negative id is padding and never merges."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(left.shape, self.NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = self._key(left[todo], right[todo])
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, key, slot = todo[more], key[more], (slot[more] + np.uint64(1)) & self.mask
        return out.reshape(shape)


class MatrixBPE:
    """Encoder and decoder for a table of byte strings and their ranks (rank = id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))
        self._dict: dict[tuple[int, int], int] | None = None
        self._lists = (left, right, merged)
        size = max(ranks.values()) + 1
        by_id: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_len = np.fromiter(map(len, by_id), np.int64, size)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.token_bytes, self.token_start[ids], self.token_len[ids]).tobytes()

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        results: list[np.ndarray] = []
        lens = np.zeros(len(raw), np.int64)
        at = int(np.searchsorted(size[order], 1))
        rows_of: list[np.ndarray] = [order[:at]]
        while at < len(order):
            width = int(size[order[at]])
            if width > LONG_PIECE:
                ids = self._by_heap(raw[order[at]])
                results.append(ids)
                lens[order[at]] = len(ids)
                rows_of.append(order[at : at + 1])
                at += 1
                continue
            bucket = min(LONG_PIECE, width + max(1, width // 8))  # a bucket's widest row
            to = min(int(np.searchsorted(size[order], bucket, side="right")), at + max(1, MATRIX_CELLS // bucket))
            rows = order[at:to]
            ids, n = self._by_matrix([raw[i] for i in rows], size[rows])
            results.append(ids)
            lens[rows] = n
            rows_of.append(rows)
            at = to
        done = np.concatenate(rows_of) if rows_of else order
        flat = np.concatenate(results) if results else np.empty(0, np.int64)
        starts = np.zeros(len(raw), np.int64)
        starts[done] = np.cumsum(lens[done]) - lens[done]
        return ragged_take(flat, starts, lens).astype(np.uint32), lens

    def _by_matrix(self, raw: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(raw), int(size.max())
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((n, 0), np.int64)
        row = np.arange(n)
        left = size.copy()
        out_rows, out_ids = [], []
        while len(row):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            low = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), self.pairs.NONE)
            go = low < self.pairs.NONE
            if not go.all():  # compaction: finished rows leave
                out_rows.append(row[~go])
                out_ids.append(ids[~go])
                row, ids, rank, best, low = row[go], ids[go], rank[go], best[go], low[go]
                if not len(row):
                    break
            k, width = len(row), ids.shape[1]
            i = np.arange(k)
            ids[i, best] = low
            keep = np.ones((k, width), bool)
            keep[i, best + 1] = False
            ids = ids[keep].reshape(k, width - 1)
            left[row] -= 1
            if width == 2:
                rank = np.empty((k, 0), np.int64)
                continue
            keep = np.ones((k, width - 1), bool)
            keep[i, np.minimum(best + 1, width - 2)] = False  # the pair behind the merge goes; at the end, the merged one
            rank = rank[keep].reshape(k, width - 2)
            has = best < width - 2
            rank[i[has], best[has]] = self.pairs.get(ids[i[has], best[has]], ids[i[has], best[has] + 1])
            has = best > 0
            rank[i[has], best[has] - 1] = self.pairs.get(ids[i[has], best[has] - 1], ids[i[has], best[has]])
        starts = np.zeros(n, np.int64)
        flat, to = [], 0
        for rows, block in zip(out_rows, out_ids):
            starts[rows] = to + np.cumsum(left[rows]) - left[rows]
            flat.append(block[np.arange(block.shape[1]) < left[rows][:, None]])
            to += len(flat[-1])
        return ragged_take(np.concatenate(flat), starts, left), left

    def _by_heap(self, raw: bytes) -> np.ndarray:
        if self._dict is None:
            self._dict = dict(zip(zip(self._lists[0], self._lists[1]), self._lists[2]))
        pair = self._dict.get
        ids: list[int] = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pair((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pair((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pair((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := pair((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h))
        return np.array([x for x in ids if x >= 0], np.int64)


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> MatrixBPE:
    with open(path, "rb") as f:
        return MatrixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PieceMemo:
    return PieceMemo(Splitter(pattern), load_ranks(path).encode_pieces)


def _default(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _with(schema: T.StructType, *new: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(new))


def _replace(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    low = {k.lower() for k in new}
    cols = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n.lower() not in low] + list(new.items())
    return pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, with_decoded: bool = False) -> DataFrame:
    """``df`` with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers); with_decoded adds decoded
    (binary), the bytes that the ids stand for, in the same pass."""
    path, pat = _default(vocabulary, pattern)
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.BinaryType())] * with_decoded
    schema = _with(df.schema, *extra)

    def run(batches):
        memo, bpe = encoder(path, pat), load_ranks(path)
        for whole in batches:
            for b in chunks(whole, text):
                texts = [t or "" for t in b.column(text).to_pylist()]
                ids, lens = memo.ids(texts)
                ends = np.cumsum(lens)
                raw = ids.astype("<u4").tobytes()
                new = {"n_tokens": pa.array(lens, pa.int64()), "ids": pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist())], pa.binary())}
                if with_decoded:
                    back = bpe.decode(ids)
                    stop = np.concatenate(([0], np.cumsum(bpe.token_len[ids])))
                    cut = stop[np.concatenate(([0], ends))].tolist()
                    new["decoded"] = pa.array([back[i:j] for i, j in zip(cut, cut[1:])], pa.binary())
                yield _replace(b, new)

    return arrow_map(df, run, schema)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with decoded (binary) from a column of ids as written by encode(); null ids give null. The bytes need not
    be UTF-8 if the ids were cut."""
    path, _ = _default(vocabulary, "")

    def run(batches):
        bpe = load_ranks(path)
        for whole in batches:
            for b in chunks(whole, ids):
                yield _replace(b, {"decoded": pa.array([None if x is None else bpe.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in b.column(ids).to_pylist()], pa.binary())})

    return arrow_map(df, run, _with(df.schema, T.StructField("decoded", T.BinaryType())))


def round_trip(df: DataFrame, text: str = "text", **kw) -> DataFrame:
    """Per row: n_tokens, and SHA-256 of the ids and of the bytes decoded from them, in lowercase hex."""
    out = encode(df, text, with_decoded=True, **kw)
    return out.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded", text)
