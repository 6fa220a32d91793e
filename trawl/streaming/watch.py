"""An index that is kept fresh: a streaming query whose batches list the corpus anew and refresh what changed.

Spark's file source tells new paths only, not changed or deleted ones, so each trigger lists again.
A trigger's interval gathers a burst of changes into one refresh and can't be starved by it.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trawl.operators.index import MAX_FILE_SIZE, CorpusIndex, IndexFault, classified, extract
from trawl.schemas import FILES, POSTINGS
from trawl.sources.store import BEAT_S, beat


def refresh_if_changed(index: CorpusIndex, corpus: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> bool:
    """Whether anything was new, changed or gone; only then a new version is written."""
    try:
        before = index.meta["version"]
    except IndexFault:
        before = None
    return index.refresh(corpus, max_file_size)["version"] != before


@contextmanager
def beating(folder: str | None, every_s: float = BEAT_S) -> Iterator[None]:
    """Beats for as long as the work inside takes, and once after it."""
    if folder is None:
        yield
        return
    done = threading.Event()

    def go() -> None:
        beat(folder)
        while not done.wait(every_s):
            beat(folder)

    thread = threading.Thread(target=go, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        beat(folder)


def watch(spark: SparkSession, index: CorpusIndex, listed: Callable[[], DataFrame], heartbeat: str | None = None, interval_s: float = BEAT_S, max_file_size: int = MAX_FILE_SIZE, retries: int = 3) -> StreamingQuery:
    """Runs until it is stopped; listed() gives the corpus as it is now, heartbeat is a local folder for beat().

    A refresh that fails is tried again after 1, 2, 4 ... seconds.
    """

    def batch(_: DataFrame, __: int) -> None:
        with beating(heartbeat):
            for k in range(retries + 1):
                try:
                    refresh_if_changed(index, listed(), max_file_size)
                    break
                except Exception:
                    if k == retries:
                        raise
                    time.sleep(2**k)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).trigger(processingTime=f"{interval_s} seconds").start()


def stream_postings(arrivals: DataFrame, folder: str, checkpoint: str, max_file_size: int = MAX_FILE_SIZE) -> StreamingQuery:
    """Files and postings of a stream of new texts (path, content, size, mtime), appended exactly once by batch."""

    def batch(df: DataFrame, number: int) -> None:
        rows = classified(df, max_file_size).persist()
        rows.select(*FILES.names).write.mode("overwrite").parquet(f"{folder}/files/batch={number}")
        extract(rows.where("flags = 0")).select(*POSTINGS.names).sortWithinPartitions("tri").write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        rows.unpersist()

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream(lines: DataFrame, test, watermark: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """lines: ts, line. Matching lines per window of event time, late ones up to the watermark included."""
    return lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).where(test(F.col("line"))).groupBy(F.window("ts", window)).agg(F.count("*").alias("matches")).select("window.start", "window.end", "matches")
