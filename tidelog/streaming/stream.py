"""Mutations as streams: a stateful fold, an exactly-once sink into a store, a store's log as a source.

A fold keyed on the sequence needs no watermark: late or reordered records
change nothing they should not. State holds one record a key, tombstones too,
and those are hidden above it. Windowed rates over event time do use one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidelog.model import MUTATION, PUT
from tidelog.operators.fold import fold_by_aggregate
from tidelog.store import Store


def streaming_fold(log: DataFrame) -> DataFrame:
    """The newest record of each key as a streaming aggregation; write it in complete or update mode."""
    return fold_by_aggregate(log)


def hide_deleted(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("op") == PUT).select("key", "value")


def streaming_rates(rows: DataFrame, ts: str, every: str, late: str, slide: str | None = None, *by: Column) -> DataFrame:
    """Counts by tumbling (or sliding) windows of event time; rows later than ``late`` are dropped by Spark's watermark."""
    at = F.window(ts, every, slide) if slide else F.window(ts, every)
    return rows.withWatermark(ts, late).groupBy(at.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(rows: DataFrame, ts: str, gap: str, late: str, *by: str) -> DataFrame:
    """Counts by session: stretches of a key's events without a longer gap."""
    return rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def store_sink(batches: DataFrame, store: Store, app: str, checkpoint: str, max_pending: int | None = None) -> DataStreamWriter:
    """Writes (ord, op, key, value) micro-batches into a store; a batch that is replayed commits once.

    ``max_pending``: flush when so many level-0 runs have gathered.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        store.write(df, txn=(app, batch_id))
        if max_pending and store._l0_runs() >= max_pending:
            store.compact() or store.flush()

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _records(uri: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(f"{uri}/{path}")
                with files.open_input_file(at) as source:
                    for rows in pq.ParquetFile(source).iter_batches(columns=["key", "seq", "op", "value"]):
                        yield rows

    return run


def store_source(store: Store, max_commits: int = 100) -> DataFrame:
    """Committed records as a stream, each once: what users' commits added, ``max_commits`` of them a trigger.

    The commit log is the source, so a run that no commit names never shows, and runs that flushes and compactions
    rewrote are not read again. A run that was vacuumed before it was read fails the stream.
    """
    kind = "version bigint, add array<struct<path string, level int, flushed boolean>>"
    log = store.spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", max_commits).text(store.files.uri("_log/*.json"))
    outer = log.select(F.from_json("value", "crc32 bigint, edit string").alias("c")).where(F.crc32(F.col("c.edit").cast("binary")) == F.col("c.crc32"))
    runs = outer.select(F.explode(F.from_json("c.edit", kind)["add"]).alias("run")).where("run.level = 0 and not run.flushed")
    return runs.select("run.path").mapInArrow(_records(store.files.uri()), MUTATION)
