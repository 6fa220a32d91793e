"""Exact substring deduplication by bucket-pointer refinement.

A string of LENGTH bytes repeats if it starts anywhere else, in any text. A suffix array of all
bytes would not fit, so only suffixes that can matter are brought together:

1. Initial buckets. Every string of LENGTH bytes has one anchor, the q-gram in it of lowest hash
   (the leftmost of equals), which depends on the string alone, so equal strings meet at equal
   anchors. Anchors are bucketed by their q-gram; a bucket with one anchor is done. The strings of
   an anchor are its reach; of equal reaches (by a 128-bit digest) one goes on, all are repeats.
2. Refinement. A task takes whole buckets with the bytes of their reaches. A position's bucket
   pointer is the rank of its first SEED bytes among all; then, round by round, buckets are sorted
   by the pointers of the later offsets (SEED, 2 SEED, ... bytes on), and the new pointers are what
   the next round sorts by, until they stand for LENGTH bytes. A string that holds a position alone
   in its bucket can't repeat: such strings leave, and what only they needed is sorted no more.
   Pointers are ranks of the bytes themselves, so equal ones mean equal bytes, not equal hashes.

Buckets are counted with partial sums before the shuffle, so a passage in a third of all texts
costs each task one row. The strings of a q-gram with over HOT_REACHES distinct reaches, which a
bitmap of fixed size tells, are dealt out one by one by 128-bit digests instead. Results go back
to their text by key; only texts that hold a repeat are shuffled. Which q-grams, anchors and texts
to look at again is told by bitmaps as well, where a false hit costs only time.

Results are per row and depend on its text alone. Null texts are empty; texts under LENGTH bytes
lose nothing; repeated rows count as other places and lose everything; null or equal doc_ids are
kept apart by their texts; extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trawl.llm.shared import Bitmap, bitmap, chunks, extended, materialize, mix, pick, prefix_hash, span_hash, table

LENGTH, Q, SEED = 200, 50, 8
#: A very long text is worked through in parts of so many bytes that overlap by LENGTH.
PART_BYTES = 1 << 20
HOT_REACHES, FLUSH_BYTES, SALTS = 4000, 1 << 19, 8
_POSITION = np.uint64((1 << 20) - 1)


def grams_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and at each offset the hash of the Q bytes there."""
    prefix, at = prefix_hash(data), np.arange(len(data) - Q + 1)
    return prefix, span_hash(prefix, at, at + Q)


def _ranked(keys: np.ndarray, buckets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many keys (of the same bucket, which the keys order first) are smaller than each, and whether it is the only one of its kind."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    place = first
    if buckets is not None:
        head = buckets[order[first]]
        new = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        place = first - np.repeat(first[new], np.diff(np.concatenate([new, [len(first)]])))
    rank, alone = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    rank[order], alone[order] = np.repeat(place, size), np.repeat(size == 1, size)
    return rank, alone


def repeated(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the string of LENGTH bytes at each of the ascending starts is also at another of them."""
    pointer = np.zeros(len(data), np.int64)
    n, alive, depth = len(data), starts, SEED
    seeds = np.zeros(max(0, n - SEED + 1), np.uint64)
    for k in range(SEED):
        seeds = (seeds << np.uint64(8)) | data[k : k + len(seeds)]
    at = np.arange(len(seeds))
    pointer[at], alone = _ranked(seeds)
    while True:
        # what holds a position alone in its bucket leaves
        single = np.zeros(n + 1, np.int64)
        single[at[alone] + 1] = 1
        before = np.cumsum(single)
        alive = alive[before[alive + LENGTH - depth + 1] == before[alive]]
        if depth == LENGTH or not len(alive):
            break
        step = min(depth, LENGTH - depth)
        # positions whose pointers the strings left need at the next depth
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, alive, 1)
        np.add.at(change, alive + LENGTH - depth - step + 1, -1)
        at = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        old = pointer[at]
        finer, alone = _ranked(old * (n + 1) + pointer[at + step], old)
        pointer[at] = old + finer  # a bucket keeps its place; its parts follow one another from there
        depth += step
    out = np.zeros(n + 1, bool)
    out[alive] = True
    return out[starts]


def anchors(first: np.ndarray, strings: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last string of its reach): the least of each width q-grams, by hash, then by place."""
    keys = ((first >> np.uint64(20)) << np.uint64(20)) | np.arange(len(first), dtype=np.uint64)
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, 2**64 - 1, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    at = np.arange(strings)
    least = (np.minimum(back[at], ahead[at + width - 1]) & _POSITION).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))
    return least[low], low, np.concatenate([low[1:], [strings]]) - 1


def _parts(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of parts that hold every string of LENGTH bytes once."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    for i in range(0, len(data) - LENGTH + 1, PART_BYTES - LENGTH + 1):
        yield i, data[i : i + PART_BYTES]


def _place(k1: np.ndarray, k2: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(low.astype(np.uint64) + k1.view(np.uint64)) + k2.view(np.uint64))


def _found(batches: Iterator[pa.RecordBatch], grams: Bitmap | None, places: Bitmap | None) -> Iterator[tuple]:
    """k1, k2, copies, bytes, offset; anchors, their reaches and q-grams; equal texts of a chunk come once."""
    for b in chunks(batches):
        seen: dict[tuple[int, int], int] = {}
        keys = list(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True))
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        for key, text in zip(keys, b.column("text").to_pylist(), strict=True):
            if not (copies := seen.pop(key, 0)):
                continue
            for offset, data in _parts(text):
                prefix, first = grams_of(data)
                at, low, high = anchors(first, len(data) - LENGTH + 1, LENGTH - Q + 1)
                gram = first[at]
                ok = np.ones(len(at), bool) if grams is None else grams.has(gram)
                if places is not None:
                    ok &= places.has(_place(*np.array(key, np.int64)[:, None], low + offset))
                if ok.any():
                    yield key, copies, data, offset, at[ok], low[ok], high[ok], gram[ok]


def _flushed(rows: Iterator[list], schema: pa.Schema, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Columns as they come, joined to batches."""
    held: list[list] = []
    n = 0
    for columns in rows:
        held.append(columns)
        if (n := n + len(columns[0])) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _grams(rows: DataFrame) -> DataFrame:
    """The q-gram of every anchor, with how many anchors of a chunk have it."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed(([gram.view(np.int64), np.full(len(gram), copies)] for _, copies, _, _, _, _, _, gram in _found(batches, None, None)), schema)

    return rows.mapInArrow(run, "gram long, n long")


def _digests(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests, as two columns."""
    both = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in pieces), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _reaches(rows: DataFrame, grams: Bitmap) -> DataFrame:
    """Of each anchor whose q-gram may repeat: its strings [low, low + n) and the digest of its reach."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("low", pa.int32()), ("n", pa.int32()), ("gram", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[list]:
            for (k1, k2), copies, data, offset, _, low, high, gram in _found(batches, grams, None):
                # equal reaches have equal anchors, so the bytes tell all
                r1, r2 = _digests([data[i : j + LENGTH].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)])
                yield [np.full(len(low), k1), np.full(len(low), k2), low + offset, high - low + 1, gram.view(np.int64), r1, r2, np.full(len(low), copies)]

        yield from _flushed(columns(), schema)

    return rows.mapInArrow(run, "k1 long, k2 long, low int, n int, gram long, r1 long, r2 long, copies long")


def _bytes_of(rows: DataFrame, grams: Bitmap, places: Bitmap) -> DataFrame:
    """Of each anchor that may be in places: its q-gram, where it is, and the bytes of its reach."""
    schema = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("low", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[list]:
            told: set[tuple[int, int]] = set()  # a text takes part once in a task; its copies are settled already
            for key, _, data, offset, at, low, high, gram in _found(batches, grams, places):
                if (*key, offset) in told:
                    continue
                if len(told) < 1 << 20:
                    told.add((*key, offset))
                cut = np.empty(len(at), object)
                cut[:] = [data[i : j + LENGTH].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                yield [gram.view(np.int64), np.full(len(at), key[0]), np.full(len(at), key[1]), low + offset, cut]

        yield from _flushed(columns(), schema, 5_000)

    return rows.mapInArrow(run, "gram long, k1 long, k2 long, low int, bytes binary")


def _strings(bytes_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of these reaches on end; of all their strings start, reach and offset in it."""
    size = np.array([len(x) for x in bytes_])
    n, start = size - LENGTH + 1, np.cumsum(size) - size
    reach = np.repeat(np.arange(len(size)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join(bytes_), np.uint8), start[reach] + at, reach, at


_RUNS = "k1 long, k2 long, low int, n int"


def _runs(k1: np.ndarray, k2: np.ndarray, low: np.ndarray, reach: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The strings, given in order, as runs of neighbours."""
    first = np.flatnonzero(np.concatenate([[True], (np.diff(reach) != 0) | (np.diff(at) != 1)])) if len(at) else np.empty(0, int)
    n = np.diff(np.concatenate([first, [len(at)]]))
    r = reach[first]
    return pa.RecordBatch.from_arrays([pa.array(k1[r]), pa.array(k2[r]), pa.array((low[r] + at[first]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["k1", "k2", "low", "n"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _bytes_of(), sorted by gram with each gram whole: the strings that two of them share."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        data, start, reach, at = _strings(t.column("bytes").to_pylist())
        twice = repeated(data, start)
        return _runs(*(t.column(c).to_numpy() for c in ("k1", "k2", "low")), reach[twice], at[twice])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        grams = b.column("gram").to_numpy()
        cuts = np.flatnonzero(np.diff(grams, prepend=grams[0] if not held else held[-1].column("gram")[held[-1].num_rows - 1].as_py()))
        sizes = np.cumsum(np.array([len(x) for x in b.column("bytes").to_pylist()]))
        before = sum(h.nbytes for h in held)
        done = 0
        for c in cuts.tolist():
            if before + (sizes[c - 1] if c else 0) - (sizes[done - 1] if done else 0) >= FLUSH_BYTES:
                held.append(b.slice(done, c - done))
                yield settle([h for h in held if h.num_rows])
                held, done, before = [], c, 0
        held.append(b.slice(done))
    if held := [h for h in held if h.num_rows]:
        yield settle(held)


def _dealt_out(hot: DataFrame) -> DataFrame:
    """The same for q-grams with very many reaches: each string is a row of its own, by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                data, start, reach, at = _strings(part.column("bytes").to_pylist())
                raw = data.tobytes()
                d1, d2 = _digests([raw[x : x + LENGTH] for x in start.tolist()])
                k1, k2, low = (part.column(c).to_numpy() for c in ("k1", "k2", "low"))
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(k1[reach]), pa.array(k2[reach]), pa.array((low[reach] + at).astype(np.int32))], names=["d1", "d2", "k1", "k2", "low"])

    strings = materialize(hot.mapInArrow(run, "d1 long, d2 long, k1 long, k2 long, low int"))
    twice = strings.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c > 1").select("d1", "d2")
    # a string that very many share is dealt over SALTS tasks
    salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = strings.withColumn("salt", F.pmod(F.xxhash64("k1", "k2", "low"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["d1", "d2", "salt"], "left_semi").select("k1", "k2", "low", F.lit(1).alias("n"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """rows: text, k1, k2. Per distinct text with repeats: k1, k2, runs array of (low, n), the repeated strings."""
    grams = _grams(rows).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    twice = bitmap(grams)
    reaches = materialize(_reaches(rows, twice))
    of = ["gram", "r1", "r2"]
    variants = materialize(reaches.groupBy(*of).agg(F.sum("copies").alias("c"), F.min(F.struct("k1", "k2", "low")).alias("at")))
    again = variants.where("c > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(*of, "salt")
    dealt = reaches.withColumn("salt", F.pmod(F.xxhash64("k1", "k2", "low"), F.lit(SALTS)).cast("int"))
    settled = dealt.join(again, [*of, "salt"], "left_semi").select("k1", "k2", "low", "n")
    # one row a q-gram, so no q-gram is hot; both sets are told by bitmaps from here on
    several = materialize(variants.groupBy("gram").agg(F.count("*").alias("v")).where("v > 1"))
    open_, hot = bitmap(several.select("gram")), bitmap(several.where(F.col("v") > HOT_REACHES).select("gram"))

    def told(bits: Bitmap, yes: bool = True):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(bits.has(b.column("gram").to_numpy()) == yes))

        return run

    shown = variants.select("gram", "at.*")
    places = bitmap(shown.mapInArrow(told(open_), shown.schema).select("k1", "k2", "low"), key=_place)
    bytes_ = _bytes_of(rows, open_, places)
    runs = [settled]
    if not hot.words.any():
        runs.append(bytes_.repartition("gram").sortWithinPartitions("gram").mapInArrow(_refined, _RUNS))
    else:
        bytes_ = materialize(bytes_)
        runs.append(bytes_.mapInArrow(told(hot, False), bytes_.schema).repartition("gram").sortWithinPartitions("gram").mapInArrow(_refined, _RUNS))
        runs.append(_dealt_out(bytes_.mapInArrow(told(hot), bytes_.schema)))
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    # at most a run for each string of the text
    return materialize(every.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "n")).alias("runs")))


def _outcome(text: str | None, runs: list[dict] | None) -> tuple[int, int, int, str, bytes]:
    data = (text or "").encode()
    if not runs:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data
    change = np.zeros(len(data) + 1, np.int64)
    for r in runs:
        change[r["low"]] += 1
        change[r["low"] + r["n"] + LENGTH - 1] -= 1
    gone = np.cumsum(change[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


def dedup_substrings(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left) if with_bytes."""
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    runs = repeated_runs(rows.select("text", "k1", "k2"))
    touched = bitmap(runs.select(F.expr("k1 ^ k2")))
    more = ", kept binary" if with_bytes else ""
    schema = extended(rows.select("doc_id").schema, f"n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_bytes else 4]

    def told(b: pa.RecordBatch, yes: bool) -> pa.RecordBatch:
        return b.filter(pa.array(touched.has(b.column("k1").to_numpy() ^ b.column("k2").to_numpy()) == yes))

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            runs_ = b.column("runs").to_pylist() if "runs" in b.schema.names else [None] * b.num_rows
            columns = list(zip(*map(_outcome, b.column("text").to_pylist(), runs_), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=schema.names)

    clean = rows.mapInArrow(lambda it: outcomes(told(b, False) for b in it), schema)
    held = rows.mapInArrow(lambda it: (told(b, True) for b in it), rows.schema).join(runs, ["k1", "k2"], "left")
    return clean.unionByName(held.select("doc_id", "text", "runs").mapInArrow(outcomes, schema))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same by counting every string of LENGTH bytes."""
    n = LENGTH
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT *, octet_length(b) AS n FROM d),
strings AS (SELECT r, i, md5_number(b[i:i + {n - 1}]) AS h FROM (SELECT r, b, unnest(range(1, n - {n - 2})) AS i FROM sized WHERE n >= {n})),
twice AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {n}, true) AS new FROM strings WHERE h IN (SELECT h FROM twice)),
spans AS (SELECT r, k, min(i) AS low, max(i) + {n} AS high FROM (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM hits) GROUP BY ALL),
gaps AS (SELECT r, low, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 1) AS a, low - 1 AS z FROM spans
  UNION ALL SELECT s.r, 1 + max(high), max(high), any_value(n) FROM spans s JOIN sized USING (r) GROUP BY s.r),
kept AS (SELECT g.r, unhex(string_agg(CASE WHEN a <= z THEN hex(b[a:z]) ELSE '' END, '' ORDER BY low)) AS b FROM gaps g JOIN sized USING (r) GROUP BY g.r),
counts AS (SELECT r, sum(high - low) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(kept.b, sized.b)) AS kept_sha256
FROM sized LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)"""
