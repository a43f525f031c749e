"""Schemas of the engine's relations, and how any table becomes a mutation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1
LEVELS = 7
MAX_SEQ = (1 << 56) - 1

MUTATION = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("value", T.BinaryType())])
KV = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType())])
BATCH = T.StructType([T.StructField("ord", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType())])
_KEY = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("op", T.ByteType())])
RUN_FILE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("size", T.LongType()), T.StructField("smallest", _KEY), T.StructField("largest", _KEY)])


class StatusError(Exception):
    """Base of the engine's errors; the text is 'Kind: message', or 'Kind' alone."""

    code, kind = -1, "Unknown"

    def __str__(self) -> str:
        said = super().__str__()
        return f"{self.kind}: {said}" if said else self.kind


class NotFound(StatusError):
    code, kind = 1, "NotFound"


class Corruption(StatusError):
    code, kind = 2, "Corruption"


class NotSupported(StatusError):
    code, kind = 3, "Not supported"


class InvalidArgument(StatusError):
    code, kind = 4, "Invalid argument"


class StoreIOError(StatusError):
    code, kind = 5, "IO error"


def to_mutations(df: DataFrame, key: Column, seq: Column, delete_when: Column, value: Column, *keep: Column) -> DataFrame:
    """``df`` as a mutation log (key, seq, op, value, *keep); a row whose ``delete_when`` holds is a tombstone."""
    gone = F.coalesce(delete_when, F.lit(False))
    return df.select(
        key.cast("binary").alias("key"), seq.cast("bigint").alias("seq"), F.when(gone, F.lit(DELETE)).otherwise(F.lit(PUT)).cast("tinyint").alias("op"),
        F.when(~gone, value.cast("binary")).alias("value"), *keep,
    )


class WriteBatch:
    """An ordered list of puts and deletes; record i of a commit gets sequence base + i, so later ones win."""

    HEADER = 12

    def __init__(self) -> None:
        self.records: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.records.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.records.append((DELETE, bytes(key), None))
        return self

    def clear(self) -> None:
        self.records.clear()

    def append(self, other: WriteBatch) -> None:
        self.records += list(other.records)

    def count(self) -> int:
        return len(self.records)

    def approximate_size(self) -> int:
        from tidelog.functions.codecs import varint_length

        return self.HEADER + sum(1 + varint_length(len(k)) + len(k) + (0 if v is None else varint_length(len(v)) + len(v)) for _, k, v in self.records)

    def iterate(self, handler) -> None:  # noqa: ANN001
        """Calls handler.put(key, value) or handler.delete(key) for each record in order."""
        for op, key, value in self.records:
            handler.put(key, value) if op == PUT else handler.delete(key)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, op, k, v) for i, (op, k, v) in enumerate(self.records)], BATCH)


def empty(spark: SparkSession, schema: T.StructType = KV) -> DataFrame:
    """The constant empty source."""
    return spark.createDataFrame([], schema)
