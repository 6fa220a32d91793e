"""The trigram index: files, postings and, where asked for, texts in folders, published by a pointer.

An identifier stands for one state of a text: the hash of its path, size and version. So nothing is
ever relabelled or deleted in place: a refresh appends a segment with the postings of what is new or
changed, and writes the table of files anew; postings of identifiers that no file has any longer are
dead, and left out when they are read. Many segments, or many dead files, are merged into one. A
version becomes current when the pointer file is renamed, so readers see the old one or the new one;
what neither of these two names is deleted.

An index that keeps texts is a snapshot: a search reads the texts of its candidates from it, sorted
by identifier in small row groups and pages, and nothing else.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trawl.operators.lines import looks_binary
from trawl.plans.trigrams import Query
from trawl.schemas import BINARY, FILES, FORMAT_VERSION, POSTINGS, SCAN_ALWAYS, TEXTS

MAX_FILE_SIZE = 16 << 20
#: Postings that a Python worker sorts at once, the texts that they are of at most, and the rows that it hands over at once.
BLOCK_POSTINGS, BLOCK_TEXTS, ROWS_OUT = 1 << 21, 1 << 16, 1 << 18
#: Content that a Python worker is given at once while an index is written.
BATCH_BYTES = 8 << 20
#: Most candidates that the driver names one by one to the reader; beyond, every text is read.
MOST_IDS, IDS_A_TEST = 20_000, 400
#: The share of all texts up to which candidates are worth naming: kept texts lie many to a page, files by themselves.
WORTH_PAGES, WORTH_FILES, ALWAYS_WORTH = 1 / 150, 1 / 2, 20
#: Segments of an index, and dead files to a live one, above which they are merged.
MOST_SEGMENTS, MOST_DEAD = 8, 0.5


class IndexFault(RuntimeError):
    """There is no index, or it isn't one this version can read."""


def file_id() -> Column:
    return F.xxhash64("path", "size", "mtime")


def trigrams(content: Column) -> Column:
    """Distinct byte trigrams, ascending, in SQL alone; extract() and text_trigrams() are faster."""
    at = F.sequence(F.lit(1), F.octet_length(content) - 2)
    packed = F.transform(at, lambda i: F.conv(F.hex(F.substring(content, i, F.lit(3))), 16, 10).cast("int"))
    return F.when(F.octet_length(content) >= 3, F.sort_array(F.array_distinct(packed))).otherwise(F.array().cast("array<int>"))


def _distinct(contents: pa.Array) -> Iterator[np.ndarray]:
    """Of each content its distinct byte trigrams, ascending; read in place, one content at a time."""
    whole = pc.fill_null(contents, b"").cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1].tolist() if len(whole) else []
    held = np.frombuffer(data or b"", np.uint8)
    for x, y in zip(at, at[1:], strict=False):
        a = held[x:y].astype(np.int32)
        t = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        t.sort()
        first = np.ones(len(t), bool)
        np.not_equal(t[1:], t[:-1], out=first[1:])
        yield t[first]


def extract(rows: DataFrame) -> DataFrame:
    """file_id, content -> tri, file_id, each once; blocks of texts, in each of which the postings are sorted."""

    def block(tris: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        keys = np.concatenate(tris, dtype=np.int64)
        keys <<= 32
        keys |= np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in tris])
        tris.clear()
        keys.sort()
        of = np.array(ids, np.int64)
        for i in range(0, len(keys), ROWS_OUT):
            part = keys[i : i + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([pa.array((part >> 32).astype(np.int32)), pa.array(of[part & 0xFFFFFFFF])], names=["tri", "file_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tris, ids, n = [], [], 0
        for b in batches:
            for i, t in zip(b.column("file_id").to_pylist(), _distinct(b.column("content")), strict=True):
                tris.append(t)
                ids.append(i)
                n += len(t)
                if n >= BLOCK_POSTINGS or len(ids) >= BLOCK_TEXTS:
                    yield from block(tris, ids)
                    tris, ids, n = [], [], 0
        yield from block(tris, ids)

    return rows.select("file_id", "content").mapInArrow(run, POSTINGS)


def text_trigrams(corpus: DataFrame) -> DataFrame:
    """path, content -> path, tri, each once for a row; Python hands over an array for each text."""

    def arrays(paths: list[str], tris: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, tris)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tris)))], names=["path", "tris"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, tris, n = [], [], 0
            for p, t in zip(b.column("path").to_pylist(), _distinct(b.column("content")), strict=True):
                paths.append(p)
                tris.append(t)
                n += len(t)
                if n >= ROWS_OUT:
                    yield arrays(paths, tris)
                    paths, tris, n = [], [], 0
            if paths:
                yield arrays(paths, tris)

    return corpus.select("path", "content").mapInArrow(run, "path string, tris array<int>").select("path", F.explode("tris").alias("tri"))


def classified(corpus: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """corpus with file_id and flags; over the cap the content isn't looked at."""
    flags = F.when(F.col("size") > max_file_size, SCAN_ALWAYS).when(looks_binary(F.col("content")), BINARY).otherwise(0)
    return corpus.withColumns({"file_id": file_id(), "flags": flags.cast("int")})


def files_of(corpus: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """The table of files; of those over the cap no content is read."""
    small = classified(corpus.where(F.col("size") <= max_file_size), max_file_size).select(*FILES.names)
    large = corpus.where(F.col("size") > max_file_size).select(file_id().alias("file_id"), "path", "size", "mtime", F.lit(SCAN_ALWAYS).alias("flags"))
    return small.unionByName(large)


def changes(corpus: DataFrame, files: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """path, action: reuse (same size and version, on the same side of the cap), large, extract; files that are gone: gone."""
    old = files.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), ((F.col("flags").bitwiseAND(SCAN_ALWAYS)) != 0).alias("was_large"))
    large = F.col("size") > max_file_size
    same = F.col("old_size").eqNullSafe(F.col("size")) & F.col("old_mtime").eqNullSafe(F.col("mtime")) & (F.col("was_large") == large)
    action = F.when(F.col("size").isNull(), "gone").when(same, "reuse").when(large, "large").otherwise("extract")
    return corpus.select("path", "size", "mtime").join(old, "path", "full").select("path", action.alias("action"), F.col("old_size").isNotNull().alias("known"))


def candidates(postings: DataFrame, query: Query) -> DataFrame:
    """file_ids that may match: one pass over the wanted postings for any tree."""
    wanted = sorted(query.trigrams())
    if query.kind == "none":
        return postings.select("file_id").where(F.lit(False))
    hits = postings.where(F.col("tri").isin(wanted))
    if all(p.kind == "tri" for p in query.parts) and query.kind != "or":
        return hits.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file_id")
    flags = [F.bool_or(F.col("tri") == t).alias(f"t{t}") for t in wanted]
    return hits.groupBy("file_id").agg(*flags).where(query.column(lambda t: F.col(f"t{t}"))).select("file_id")


def one_of(column: Column, ids: list[int]) -> Column:
    """column is one of ids, as a balanced tree of short tests, each of which Parquet's reader prunes by."""
    tests = [column.isin(ids[i : i + IDS_A_TEST]) for i in range(0, len(ids), IDS_A_TEST)] or [F.lit(False)]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


class CorpusIndex:
    """An index in a folder that driver and executors share; with keep_texts also of the texts themselves."""

    def __init__(self, spark: SparkSession, folder: str, keep_texts: bool = False):
        self.spark, self.folder, self.keep_texts = spark, folder.rstrip("/"), keep_texts
        self._torn: str | None = None  # the version that a lookup could not read
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        # lists of up to so many values prune row groups and pages one by one, not by their range
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(IDS_A_TEST))

    def _pointer(self) -> dict | None:
        at = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except (ValueError, Py4JJavaError) as e:
            raise IndexFault(f"{self.folder} has a broken pointer") from e
        finally:
            stream.close()

    def _publish(self, meta: dict) -> dict:
        aside = self._path(f"{self.folder}/CURRENT.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        current = self._path(f"{self.folder}/CURRENT")
        if not self._fs.rename(aside, current):
            self._fs.delete(current, False)
            self._fs.rename(aside, current)
        return meta

    @property
    def meta(self) -> dict:
        meta = self._pointer()
        if meta is None:
            raise IndexFault(f"{self.folder} has no index")
        if not isinstance(meta, dict) or meta.get("format") != FORMAT_VERSION:
            raise IndexFault(f"{self.folder} has another format than {FORMAT_VERSION}")
        return meta

    def validate(self) -> dict:
        """meta, if every table that it names was written to its end; else IndexFault."""
        meta = self.meta
        if meta["version"] == self._torn:
            raise IndexFault(f"{self.folder} can't be read")
        for part in [f"v={meta['version']}/files", *(f"s={s}/postings" for s in meta["segments"])]:
            if not self._fs.exists(self._path(f"{self.folder}/{part}/_SUCCESS")):
                raise IndexFault(f"{self.folder}/{part} is missing or torn")
        return meta

    def exists(self) -> bool:
        return self._pointer() is not None

    def files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/v={self.meta['version']}/files")

    def _segments(self, meta: dict, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/s={s}/{table}" for s in meta["segments"]])

    def postings(self) -> DataFrame:
        """Of live files."""
        meta = self.meta
        every = self._segments(meta, "postings", POSTINGS)
        return every.join(self.files().select("file_id"), "file_id", "left_semi").select(*POSTINGS.names) if meta["dead"] else every

    def orphans(self) -> DataFrame:
        """Postings that no file has, dead ones left aside; an index that is whole has none."""
        return self.postings().join(self.files(), "file_id", "left_anti")

    def lookup(self, query: Query) -> list[int] | None:
        """Candidates among the indexed texts, or None where they are so many, or so damaged, that they narrow nothing."""
        if query.kind in ("all", "none"):
            return None if query.kind == "all" else []
        meta = self.meta
        most = min(MOST_IDS, max(ALWAYS_WORTH, int(meta["files_total"] * (WORTH_PAGES if self.keep_texts else WORTH_FILES))))
        try:
            rows = candidates(self._segments(meta, "postings", POSTINGS), query).limit(most + 1).collect()
        except (PySparkException, Py4JJavaError):
            self._torn = meta["version"]  # the next refresh builds anew
            return None
        return [r.file_id for r in rows] if len(rows) <= most else None

    def texts_of(self, ids: list[int]) -> DataFrame:
        """The kept texts of these files and of those always scanned, as rows of a corpus."""
        meta = self.meta
        rows = self._segments(meta, "texts", TEXTS).where(one_of(F.col("file_id"), ids) | (F.col("flags") == SCAN_ALWAYS))
        if meta["dead"]:
            live = self.files().where(one_of(F.col("file_id"), ids) | (F.col("flags") == SCAN_ALWAYS))
            rows = rows.join(live.select("file_id"), "file_id", "left_semi")
        return rows.select("path", "content", "size", "mtime")

    def all_texts(self) -> DataFrame:
        """The kept texts of all live files."""
        meta = self.meta
        rows = self._segments(meta, "texts", TEXTS)
        return rows.join(self.files().select("file_id"), "file_id", "left_semi") if meta["dead"] else rows

    def _texts(self, rows: DataFrame, segment: str) -> DataFrame:
        # small row groups and pages, sorted: a lookup reads little beside what it wants
        sorted_ = rows.select(*TEXTS.names).repartitionByRange("file_id").sortWithinPartitions("file_id")
        sorted_.write.option("parquet.block.size", 16 << 20).option("parquet.page.size", 64 << 10).parquet(f"{self.folder}/s={segment}/texts")
        return self.spark.read.schema(TEXTS).parquet(f"{self.folder}/s={segment}/texts")

    def _postings(self, postings: DataFrame, segment: str) -> None:
        """As they come, sorted block by block. A row group holds few identifiers, so that Parquet's dictionary tells each in two bytes or less."""
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(key)
        conf.set(key, str(BATCH_BYTES))
        try:
            postings.select(*POSTINGS.names).write.option("parquet.block.size", 16 << 20).parquet(f"{self.folder}/s={segment}/postings")
        finally:
            conf.set(key, before)

    def _version(self, files: DataFrame, segments: list[str], reused: int, max_file_size: int, dead: int) -> dict:
        before, version = self._pointer_or_none(), f"{time.time_ns()}"
        files.select(*FILES.names).repartitionByRange("file_id").sortWithinPartitions("file_id").write.parquet(f"{self.folder}/v={version}/files")
        flag = F.col("flags")
        stats = self.spark.read.schema(FILES).parquet(f"{self.folder}/v={version}/files").agg(
            F.count("*").alias("files_total"), F.count_if(flag == 0).alias("indexed"), F.count_if(flag.bitwiseAND(BINARY) != 0).alias("binary"),
            F.count_if(flag.bitwiseAND(SCAN_ALWAYS) != 0).alias("scan_always"),
        ).first().asDict()
        meta = self._publish({"format": FORMAT_VERSION, "version": version, "segments": segments, "dead": dead, "refreshed": time.time(), "reused": reused, "max_file_size": max_file_size, **stats})
        needed = {f"v={m['version']}" for m in (meta, before) if m} | {f"s={s}" for m in (meta, before) if m for s in m["segments"]}
        for at in self._fs.listStatus(self._path(self.folder)):
            name = at.getPath().getName()
            if name[:2] in ("v=", "s=", "t=") and name not in needed:
                self._fs.delete(at.getPath(), True)
        return meta

    def _pointer_or_none(self) -> dict | None:
        try:
            return self.meta
        except IndexFault:
            return None

    def build(self, corpus: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> dict:
        return self._whole(corpus, max_file_size, 0)

    def _whole(self, corpus: DataFrame, max_file_size: int, reused: int) -> dict:
        """All of the corpus in one new segment."""
        segment = uuid.uuid4().hex
        if self.keep_texts:
            rows = self._texts(classified(corpus, max_file_size), segment)
            files = rows.select(*FILES.names)
        else:
            files, rows = files_of(corpus, max_file_size), classified(corpus.where(F.col("size") <= max_file_size), max_file_size)
        self._postings(extract(rows.where("flags = 0")), segment)
        return self._version(files, [segment], reused, max_file_size, 0)

    def refresh(self, corpus: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> dict:
        """Reads only new and changed texts; an index that can't be read to its end is built anew."""
        try:
            return self._refreshed(corpus, max_file_size)
        except (IndexFault, PySparkException, Py4JJavaError):
            return self.build(corpus, max_file_size)

    def _refreshed(self, corpus: DataFrame, max_file_size: int) -> dict:
        meta, old = self.validate(), self.files()
        aside = f"{self.folder}/t={uuid.uuid4().hex}"
        changes(corpus, old, max_file_size).where("action <> 'reuse'").write.parquet(aside)
        steps = self.spark.read.parquet(aside)
        n, lost = steps.agg(F.count("*"), F.count_if("known")).first()
        if not n:
            self._fs.delete(self._path(aside), True)
            return self._publish(meta | {"refreshed": time.time(), "reused": meta["files_total"]})
        dead, reused = meta["dead"] + lost, meta["files_total"] - lost
        merge = len(meta["segments"]) >= MOST_SEGMENTS or dead > MOST_DEAD * reused
        if merge and self.keep_texts:  # the corpus has every live text: read once, none is brought together with its old state
            return self._whole(corpus, max_file_size, reused)
        changed = corpus.join(F.broadcast(steps.where("action <> 'gone'").select("path")) if n <= MOST_IDS else steps.where("action <> 'gone'").select("path"), "path", "left_semi")
        kept, segment = old.join(steps.select("path"), "path", "left_anti"), uuid.uuid4().hex
        live = kept.select("file_id")
        if self.keep_texts:
            added = self._texts(classified(changed, max_file_size), segment)
            files = kept.unionByName(added.select(*FILES.names))
        else:
            files = kept.unionByName(files_of(changed, max_file_size))
            added = classified(changed.where(F.col("size") <= max_file_size), max_file_size)
        postings = extract(added.where("flags = 0"))
        if merge:
            before = self._segments(meta, "postings", POSTINGS).join(live, "file_id", "left_semi").select(*POSTINGS.names)
            postings = postings.unionByName(before.sortWithinPartitions("tri", "file_id"))
        self._postings(postings, segment)
        segments = [segment] if merge else [*meta["segments"], segment]
        return self._version(files, segments, reused, max_file_size, 0 if merge else dead)

    def status(self) -> DataFrame:
        """One row: files, trigrams, postings, seconds since the last refresh."""
        age = F.lit(time.time() - self.meta["refreshed"]).alias("age_s")
        posted = self.postings().agg(F.count_distinct("tri").alias("trigrams"), F.count("*").alias("postings"))
        return self.files().agg(F.count("*").alias("files")).crossJoin(posted).select("files", "trigrams", "postings", age)  # one row each

    def forget(self) -> bool:
        return self._fs.delete(self._path(self.folder), True)
