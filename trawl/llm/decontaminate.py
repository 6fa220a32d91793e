"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a run of MIN_MATCH words are joined on those seeds. For each
such pair the longest common unmarked runs are found by Karp-Rabin hashing, marked longest first,
and the search length goes down until MIN_MATCH; a document is contaminated when the tiles cover
at least COVERAGE of an item's words, in whatever order they stand.

Words are the lower-cased runs of letters, digits and underscores. Items of fewer words than
MIN_MATCH need their whole word sequence; items without words match nothing. Null texts have no
words. Rows are independent: repeated rows and null ids stay, extra columns change nothing, and
empty tables give no rows or no matches. Of items with equal coverage, the smallest id is the best.

Up to BLOCK_BYTES of items are broadcast, and the documents are passed over once without a shuffle.
A larger benchmark is joined on its seeds: documents give their seeds, of which a bitmap of fixed
size lets those through that an item may have; what shares a seed becomes a pair of texts, once, and
pairs are tiled one by one. Time is in proportion to the words times the number of different tile
lengths (at most the root of twice an item's words), whatever repeats in either text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trawl.llm.shared import Bitmap, bitmap, chunks, extended, materialize, mix, pick, table

MIN_MATCH, COVERAGE, BLOCK_BYTES, SALTS = 5, 0.5, 8 << 20, 8
_WORDS = re.compile(r"\w+").findall
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids (uint64, wrapping)."""
    out, power, have, at = np.zeros(max(0, len(ids) - n + 1), np.uint64), 0, 0, 0
    if not len(out):
        return out
    # doubling: a run of n is put together from runs of powers of two
    step, size, levels = mix(ids), 1, []
    while True:
        levels.append((size, step))
        if size * 2 > n:
            break
        step = step[: len(step) - size] * np.uint64(pow(int(_FACTOR), size, 1 << 64)) + step[size:]
        size *= 2
    for size, step in reversed(levels):
        if n - have >= size:
            out = out * np.uint64(pow(int(_FACTOR), size, 1 << 64)) + step[at : at + len(out)]
            have, at = have + size, at + size
    return out


def _runs_from(free: np.ndarray) -> np.ndarray:
    """How many places are free from each on without a gap."""
    stop = np.where(free, len(free), np.arange(len(free)))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(free))


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the greedy tiling; both are uint64 word ids, 0 matches nothing.

    The longest common free run comes first, of equally long ones the first in item, then in doc.
    """
    free_i, free_d, out, high = item != 0, doc != 0, [], min(len(item), len(doc))

    def open_(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at_i, at_d = np.flatnonzero(run_i >= size), np.flatnonzero(run_d >= size)
        at_i, at_d = at_i[at_i <= len(item) - size], at_d[at_d <= len(doc) - size]
        return at_i, at_d, run_hashes(item, size)[at_i], run_hashes(doc, size)[at_d]

    while high >= least:
        run_i, run_d = _runs_from(free_i), _runs_from(free_d)
        # the greatest length at which a run is common, by bisection: what is common at n is so at n - 1
        low, size = least, 0
        high = min(high, int(run_i.max(initial=0)), int(run_d.max(initial=0)))
        while low <= high:
            middle = (low + high + 1) // 2 if size else low
            _, _, hi, hd = open_(middle)
            if np.isin(hi, hd).any():
                size, low = middle, middle + 1
            else:
                high = middle - 1
        if not size:
            break
        at_i, at_d, hi, hd = open_(size)
        both = np.isin(hd, hi)
        where: dict[int, tuple[list[int], int]] = {}
        order = np.argsort(hd[both], kind="stable")
        keys, starts = hd[both][order], at_d[both][order]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            where[int(keys[x])] = (starts[x:y].tolist(), 0)
        for i, h in zip(at_i.tolist(), hi.tolist(), strict=True):
            if h not in where or not free_i[i] or not free_i[i + size - 1]:  # marks are as long as size, or longer
                continue
            places, k = where[h]
            while k < len(places):
                j = places[k]
                k += 1
                if free_d[j] and free_d[j + size - 1] and np.array_equal(item[i : i + size], doc[j : j + size]):
                    free_i[i : i + size] = free_d[j : j + size] = False
                    out.append((i, j, size))
                    break
            where[h] = (places, k)
        high = size - 1
    return out


class Items:
    """A block of test items, with the seeds of each."""

    def __init__(self, rows: list[tuple[int | None, str | None]], least: int):
        self.least, self.vocabulary, self.ids, self.items = least, {}, [], []
        for key, text in rows:
            if w := words(text):
                self.ids.append(key)
                self.items.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.uint64))
        self.seeds: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for k, item in enumerate(self.items):
            n = min(least, len(item))
            at = self.seeds.setdefault(n, (None, {}))[1]
            for h in set(run_hashes(item, n).tolist()):
                at.setdefault(h, []).append(k)
        self.seeds = {n: (np.array(sorted(at), np.uint64), at) for n, (_, at) in self.seeds.items()}

    def matches(self, text: str | None, coverage: float) -> list[tuple[int | None, float]]:
        """(item id, covered share) of the items that the text contaminates."""
        w = words(text)
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.uint64, len(w))
        hits: dict[int, list[np.ndarray]] = {}
        for n, (known, at) in self.seeds.items():
            if len(ids) < n:
                continue
            whole = np.flatnonzero(_runs_from(ids != 0) >= n)
            if not len(whole):
                continue
            h = run_hashes(ids, n)[whole]
            ok = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            places, found = whole[ok], h[ok]
            if not len(found):
                continue
            order = np.argsort(found, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], found[order][1:] != found[order][:-1]]))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=True):
                for k in at[int(found[order[x]])]:
                    hits.setdefault(k, []).append(places[order[x:y]])
        out = []
        for k, at in hits.items():
            if (share := covered(self.items[k], ids, np.concatenate(at), self.least)) >= coverage:
                out.append((self.ids[k], share))
        return out


def covered(item: np.ndarray, doc: np.ndarray, seeds: np.ndarray, least: int) -> float:
    """Share of the item's words in tiles, of the words of doc that a seed touches: no other can be in one."""
    least = min(least, len(item))
    near = np.zeros(len(doc) + 1, np.int64)
    np.add.at(near, seeds, 1)
    np.add.at(near, seeds + least, -1)
    parts = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    gap = np.flatnonzero(np.diff(parts) > 1) + 1
    text = np.concatenate([x for p in np.split(parts, gap) for x in (doc[p], np.zeros(1, np.uint64))])
    return sum(t[2] for t in tiles(item, text, least)) / len(item)


_ORDER = lambda k: (k is not None, k or 0)


def _broadcast(rows: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """rows with item_ids, best_item, best_coverage; items are few enough for every worker."""
    shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    schema = extended(rows.schema, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(shared.value, least)
        for b in chunks(batches):
            found = [sorted(known.matches(t, coverage), key=lambda f: (-f[1], _ORDER(f[0]))) for t in b.column("text").to_pylist()]
            ids = [sorted((f[0] for f in x), key=_ORDER) for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int64())), pa.array([x[0][0] if x else None for x in found], pa.int64()), pa.array([x[0][1] if x else 0.0 for x in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _seeds(rows: DataFrame, key: str, lengths: list[int], least: int, bits: Bitmap | None, whole: bool) -> DataFrame:
    """key, seed, n: hashes of the runs of n words for each n of lengths, once a text; of an item (whole) n is its own seed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            keys, seeds, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for k, t in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = word_ids(words(t))
                for n in [min(least, len(ids))] if whole and len(ids) else lengths:
                    h = np.unique(mix(run_hashes(ids, n) + np.uint64(n))).view(np.int64)
                    h = h if bits is None else h[bits.has(h)]
                    keys.append(np.full(len(h), k))
                    seeds.append(h)
                    sizes.append(np.full(len(h), n, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(seeds)), pa.array(np.concatenate(sizes))], names=[key, "seed", "n"])

    return rows.select(key, "text").mapInArrow(run, f"{key} long, seed long, n int")


def word_ids(w: list[str]) -> np.ndarray:
    """64-bit hashes of words, never 0."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") or 1 for x in w], np.uint64)


def _joined(rows: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """The same for any number of items: pairs that share a seed are tiled; equal texts are one."""
    keyed = items.where("text is not null").select("item_id", "text", F.monotonically_increasing_id().alias("item"))
    keyed = materialize(keyed)
    of_items = materialize(_seeds(keyed, "item", [], least, None, True))
    lengths = sorted(r.n for r in of_items.select("n").distinct().collect())  # at most least of them
    texts = materialize(rows.select("text").where("text is not null").distinct().select("text", F.xxhash64("text").alias("doc"), F.xxhash64(F.lit(1), "text").alias("doc2")))
    # a text's two hashes name it; its rows get what it gets
    seeds = _seeds(texts, "doc", lengths, least, bitmap(of_items.select("seed")), False).withColumn("salt", F.pmod("doc", F.lit(SALTS)).cast("int"))
    salted = of_items.select("seed", "item", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    near = seeds.join(salted, ["seed", "salt"]).select("doc", "item").distinct()
    pairs = materialize(near).join(texts, "doc").join(keyed.select("item", "item_id", F.col("text").alias("asked")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            share = []
            for t, a in zip(b.column("text").to_pylist(), b.column("asked").to_pylist(), strict=True):
                found = Items([(0, a)], least).matches(t, coverage)
                share.append(found[0][1] if found else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc", "doc2", "item_id")), pa.array(share, pa.float64())], names=["doc", "doc2", "item_id", "share"])

    tiled = pairs.select("doc", "doc2", "item_id", "text", "asked").mapInArrow(run, "doc long, doc2 long, item_id long, share double").where("share is not null")
    best = F.max_by("item_id", F.struct("share", F.col("item_id").isNull(), -F.col("item_id")))
    # a list of the items that one text holds
    found = tiled.groupBy("doc", "doc2").agg(F.collect_list(F.struct(F.col("item_id").isNotNull().alias("k"), "item_id")).alias("ids"), best.alias("best_item"), F.max("share").alias("best_coverage"))
    found = materialize(found.select("doc", "doc2", F.transform(F.sort_array("ids"), lambda s: s["item_id"]).alias("item_ids"), "best_item", "best_coverage"))
    held = rows.withColumns({"doc": F.xxhash64("text"), "doc2": F.xxhash64(F.lit(1), "text")}).join(found, ["doc", "doc2"], "left")
    return held.select(*rows.columns, "item_ids", "best_item", F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"))


_FOUND = "item_ids array<long>, best_item long, best_coverage double"


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: keep, contaminated, n_items, item_ids (ascending, nulls first), best_item, best_coverage."""
    items = pick(benchmark, "item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = pick(docs, *dict.fromkeys([*keep, "text"]))
    df = (_broadcast if total <= block_bytes else _joined)(rows, items, least, coverage)
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return df.select(*keep, (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "best_item", "best_coverage")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
