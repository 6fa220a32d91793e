"""Byte-level BPE encoding and decoding by length-bucketed numpy matrices.

The distinct pieces of a batch are padded into one matrix per length bucket. Each round looks up
the ranks of the pairs next to the last merge in an open-addressing hash table, every row merges
its leftmost pair of minimum rank, and the row closes up; rows without a pair leave the matrix.
Pieces over MATRIX_BYTES bytes would cost the square of their length there; they take the same
merges from a heap instead, in n log n.

Nulls and empty texts have no ids. Rows are independent: repeated rows, repeated or null doc_ids
and extra columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from trawl.llm.shared import chunks, extended, pick, table

MATRIX_BYTES = 256
#: Pieces that a worker keeps with their ids; beyond this many it starts anew.
CACHE_PIECES = 400_000
_NONE = np.int32(2**31 - 1)


class ByteBPE:
    """ranks: bytes of a token -> its rank, which is its id; pattern: splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        size = 1 << max(4, 2 * len(keys)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, _NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]] = keys[todo[won]]
            self.values[slot[won]] = np.array(out, np.int32)[todo[won]]
            todo, slot = todo[~won], (slot[~won] + np.uint64(1)) & self.mask

    @classmethod
    def from_file(cls, data: bytes, pattern: str) -> ByteBPE:
        return cls({base64.b64decode(t): int(i) for t, i in (x.split() for x in data.splitlines() if x)}, pattern)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & self.mask

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merged pairs; _NONE where there is none. Negative ids are padding."""
        keys = (a.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32).astype(np.uint64)
        out, todo, slot = np.full(len(keys), _NONE, np.int32), np.flatnonzero((a >= 0) & (b >= 0)), None
        slot = self._slot(keys[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def encode_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, all from one padded matrix."""
        n, width = len(pieces), max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[flat], np.int32(-1))
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], 1)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        rows, out, columns = np.arange(n), [np.empty(0, np.int32)] * n, np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            done = least == _NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : size[k]].copy()
            if done.any():
                rows, ids, ranks, size, at, least = (x[~done] for x in (rows, ids, ranks, size, at, least))
            if not len(rows):
                break
            k = np.arange(len(rows))
            ids[k, at] = least
            close = np.minimum(columns + (columns > at[:, None]), columns[-1])
            ids = np.take_along_axis(ids, close, 1)
            ranks = np.take_along_axis(ranks, close[:, :-1].clip(max=ranks.shape[1] - 1), 1)
            size = size - 1
            ranks[:, -1] = _NONE
            ranks[k, at] = self.pair_ranks(ids[k, at], ids[k, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pair_ranks(ids[before, at[before] - 1], ids[before, at[before]])
            if (most := int(size.max())) < ids.shape[1] - 1:
                ids, ranks, columns = ids[:, : most + 1], ranks[:, :most], columns[: most + 1]
        return out

    def encode_heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: lowest rank first, the leftmost of equal ranks."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, tokens = len(ids), self.ranks, self.tokens
        after, before, text = list(range(1, n + 1)), list(range(-1, n - 1)), [tokens[i] for i in ids]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if text[i] is None or j >= n or ranks.get(text[i] + text[j]) != r:
                continue
            text[i], text[j] = text[i] + text[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := ranks.get(text[i] + text[after[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := ranks.get(text[before[i]] + text[i])) is not None:
                heapq.heappush(heap, (s, before[i]))
        return np.array([ranks[t] for t in text if t is not None], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > MATRIX_BYTES:
                out[k] = self.encode_heap(p).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(k)
        for bits, ks in buckets.items():
            rows = max(1, (1 << 20) >> bits)
            for i in range(0, len(ks), rows):
                part = ks[i : i + rows]
                for k, ids in zip(part, self.encode_matrix([pieces[k] for k in part]), strict=True):
                    out[k] = ids.astype("<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) if t else [] for t in texts]
        new = list(set().union(*split) - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = list(set().union(*split))
        self.cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        get = self.cache.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        for p in new:
            if len(p) > MATRIX_BYTES:  # rare and long: the cache stays small
                del self.cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[int, ByteBPE] = {}


def _loaded(data: bytes, pattern: str) -> ByteBPE:
    if (key := hash((data, pattern))) not in _LOADED:
        _LOADED[key] = ByteBPE.from_file(data, pattern)
    return _LOADED[key]


def bpe_tokens(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: keep, ids array<int>, ids_bytes binary (little-endian), decoded binary.

    The driver reads the rank file, whose size is that of the vocabulary, and broadcasts its bytes.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = pick(docs, *dict.fromkeys([*keep, "text"]))
    kept = rows.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value, pattern)
        for b in chunks(batches):
            ids = bpe.encode_batch(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())],
                names=[*keep, "ids", "ids_bytes", "decoded"],
            )

    return rows.mapInArrow(run, extended(kept, "ids array<int>, ids_bytes binary, decoded binary"))


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if with_ids; decoding stays in the worker."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = extended(pick(docs, "doc_id").schema, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value, pattern)
        for b in chunks(batches):
            ids = bpe.encode_batch(b.column("text").to_pylist())
            columns = [
                b.column("doc_id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
            ]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), *public_ranks())
