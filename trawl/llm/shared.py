"""What the operators share: column picking, tables in the shared folder, hashing of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trawl.sources.scratch import scratch

#: Bytes of text that a worker handles at once; its numpy arrays take about 60 times as much.
CHUNK_BYTES = 2 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by exact name; other columns may clash with them in case or hold dots."""
    cols = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"_{cols.index(n)}").alias(n) for n in names])


def carried(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns under neutral names, and these once more under their own; and the neutral names."""
    cols = df.columns
    plain = [f"_c{i}" for i in range(len(cols))]
    return df.toDF(*plain).select("*", *[F.col(f"_c{cols.index(n)}").alias(n) for n in names]), plain


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and reread: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices with about CHUNK_BYTES of text each, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.array(pc.fill_null(pc.binary_length(b.column(text)), 0))
        part = np.cumsum(size) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_B = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        out = []
        for base in (_B, pow(_B, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    a, b = _POWERS[size]
    return a[:n], b[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() gives the fingerprint of any span; data is uint8."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans [start, end): equal bytes have equal ones wherever they stand."""
    inverse = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


class Bitmap:
    """A set of 64-bit keys in a bitmap of fixed size: has() may wrongly say yes, never wrongly no."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys.view(np.uint64)) >> self.shift
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(keys: DataFrame, log2_bits: int = 26, key: Callable[..., np.ndarray] = lambda column: column) -> Bitmap:
    """The bitmap of key(columns), 64-bit integers; the driver gets its 2**log2_bits bits, however many keys there are."""
    words, shift = 1 << (log2_bits - 6), np.uint64(64 - log2_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for b in batches:
            at = mix(key(*(c.to_numpy() for c in b.columns)).view(np.uint64)) >> shift
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        word = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(bits[word].view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bitmap(out)
