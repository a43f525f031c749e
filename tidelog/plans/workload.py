"""Workload generation and verification, each row computed from its number alone.

Draws come from a counter-based generator, so rows are made in parallel and any
row can be made again. Mixes: A half reads half updates, B 95/5, C reads only,
D 95 reads and 5 inserts of the latest, F half reads half read-modify-writes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidelog.functions import codecs

# The published mixes (read, update, insert, read-modify-write) and the usual skew.
MIXES = {"A": (0.5, 0.5, 0.0, 0.0), "B": (0.95, 0.05, 0.0, 0.0), "C": (1.0, 0.0, 0.0, 0.0), "D": (0.95, 0.0, 0.05, 0.0), "F": (0.5, 0.0, 0.0, 0.5)}
THETA = 0.99


def dice(row: Column, seed: int) -> Column:
    """A uniform double in [0, 1) for each row number (from 1)."""

    @pandas_udf("double")
    def draw(n: pd.Series) -> pd.Series:
        return pd.Series(codecs.unit(codecs.splitmix(seed, n.to_numpy())))

    return draw(row)


def op_of(u: Column, mix: str) -> Column:
    """The operation a draw selects, by cumulative shares."""
    read, update, insert, _ = MIXES[mix]
    return F.when(u < read, "read").when(u < read + update, "update").when(u < read + update + insert, "insert").otherwise("rmw")


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    """The sum of i^-theta, i from 1 to n."""
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.col("id").cast("double"), F.lit(-theta)))).first()[0]


def zipfian(u: Column, n: int, zeta_n: float, theta: float = THETA) -> Column:
    """Item 0 to n - 1 from a uniform draw, item 0 the likeliest, in closed form."""
    zeta_2 = 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta_2 / zeta_n)
    tail = F.least(F.floor(n * F.pow(eta * u - eta + 1, F.lit(1 / (1 - theta)))), F.lit(n - 1))
    return F.when(u * zeta_n < 1, 0).when(u * zeta_n < zeta_2, 1).otherwise(tail).cast("bigint")


def choose(u: Column, distribution: str, n: int, zeta_n: float) -> Column:
    """A record number: uniform, latest (near the end), or zipfian scattered by a hash."""
    if distribution == "uniform":
        return F.floor(u * n)
    z = zipfian(u, n, zeta_n)
    return n - 1 - z if distribution == "latest" else F.pmod(codecs.fnv64_col(z), F.lit(n)).cast("bigint")


def load_phase(spark: SparkSession, n: int, value_bytes: int = 100, seed: int = 42) -> DataFrame:
    """(key, value) of n records."""

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = -(-value_bytes // 8)
        for pdf in parts:
            rows = pdf["id"].to_numpy()
            draws = codecs.splitmix(seed, (rows[:, None] * words + np.arange(1, words + 1)).ravel()).view(np.uint8).reshape(len(rows), -1)[:, :value_bytes]
            yield pd.DataFrame({"id": rows, "value": [r.tobytes() for r in (32 + draws % 95).astype(np.uint8)]})

    return spark.range(n).mapInPandas(values, "id bigint, value binary").select(codecs.ycsb_key(F.col("id")).cast("binary").alias("key"), "value", "id")


def operations(spark: SparkSession, mix: str, count: int, records: int, distribution: str = "zipfian", seed: int = 42) -> DataFrame:
    """(row, op, item, key) of a run; inserts take new numbers by row."""
    zn = zeta(spark, records)
    rows = spark.range(1, count + 1).select(F.col("id").alias("row"), dice(F.col("id"), seed).alias("u"), dice(F.col("id"), seed + 1).alias("v"))
    op = op_of(F.col("u"), mix)
    item = F.when(op == "insert", F.lit(records) + F.col("row")).otherwise(choose(F.col("v"), distribution, records, zn))
    return rows.select("row", op.alias("op"), item.cast("bigint").alias("item")).withColumn("key", codecs.ycsb_key(F.col("item")).cast("binary"))


def summarize(samples: DataFrame, begin: int, end: int) -> DataFrame:
    """By operation, of (op, intended_ns, actual_ns, done_ns) rows that begin and end in the window: count, rate, mean latency (from the intended start) and service time."""
    inside = samples.where((F.col("intended_ns") >= begin) & (F.col("done_ns") <= end))
    return inside.groupBy("op").agg(F.count("*").alias("ops"), (F.count("*") / F.lit((end - begin) / 1e9)).alias("per_second"), F.avg(F.col("done_ns") - F.col("intended_ns")).alias("latency_ns"), F.avg(F.col("done_ns") - F.col("actual_ns")).alias("service_ns"))


def overloaded(throughput: Column, offered: Column) -> Column:
    return throughput < 0.95 * offered


def stress_values(rows: DataFrame, key: str, counter: str, size: int = 120) -> DataFrame:
    """Adds ``value``: key, counter and their checksum, padded by a rule, so any torn value shows."""

    @pandas_udf("string")
    def make(k: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([stress_value(a, b, size) for a, b in zip(k, c, strict=True)])

    return rows.withColumn("value", make(key, counter))


def stress_value(key: int, counter: int, size: int) -> str:
    head = f"{key}|{counter}|"
    head += f"{codecs.crc32c(head.encode())}|"
    return head + "".join(chr(ord("a") + (counter + k) % 26) for k in range(len(head), size))


def parse_stress_value(value: str) -> tuple[int, int] | None:
    """(key, counter), or None if the value is not whole."""
    parts = value.split("|")
    if len(parts) != 4 or not all(p.isdigit() for p in parts[:3]):
        return None
    key, counter = int(parts[0]), int(parts[1])
    return (key, counter) if stress_value(key, counter, len(value)) == value else None


def verify(acked: DataFrame, stored: DataFrame) -> DataFrame:
    """(status, keys): lost (absent, or older than acknowledged), corrupt (stored counter null), ok."""
    last = acked.groupBy("key").agg(F.max("counter").alias("acked"))
    both = last.join(stored.select("key", F.col("counter").alias("found"), F.lit(True).alias("there")), "key", "left")
    status = F.when(F.col("there").isNull(), "lost").when(F.col("found").isNull(), "corrupt").when(F.col("found") < F.col("acked"), "lost").otherwise("ok")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("keys"))


def rates(samples: DataFrame, at: str, total: str) -> DataFrame:
    """Per-interval rate of a cumulative counter; lag runs over samples, one row an interval."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(F.lit(0)).orderBy(at)
    return samples.withColumn("rate", F.col(total) - F.lag(total, 1, 0).over(by))


def medians(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median over repetitions; the mean of the middle two if even."""
    return results.groupBy(*by).agg(F.median(value).alias("median"), F.count("*").alias("reps"))


def paired(before: DataFrame, after: DataFrame, on: list[str], value: str) -> DataFrame:
    """Two engines' or commits' results side by side, and their ratio."""
    a, b = (x.select(*on, F.col(value).alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, on).withColumn("ratio", F.col("after") / F.col("before"))


def crash_summary(runs: DataFrame) -> DataFrame:
    """By mode: iterations, failures, median and longest time to open."""
    return runs.groupBy("mode").agg(F.count("*").alias("iterations"), F.sum((~F.col("ok")).cast("bigint")).alias("failures"), F.median("open_ms").alias("open_ms_p50"), F.max("open_ms").alias("open_ms_max"))


def read_modify_write(live: DataFrame, keys: DataFrame, change: Column) -> DataFrame:
    """New puts (key, value) from the present values of ``keys``; ``change`` is over ``value``."""
    return live.join(keys.select("key").distinct(), "key", "left_semi").select("key", change.alias("value"))


def bloom_theory(bits_per_key: Column) -> Column:
    """The expected share of false matches."""
    k = F.greatest(F.lit(1), F.least(F.lit(30), F.floor(bits_per_key * 0.69)))
    return F.pow(1 - F.exp(-k / bits_per_key), k)


def bloom_sweep(spark: SparkSession, keys: int, lookups: int, bits: tuple[int, ...] = (4, 6, 8, 10, 14)) -> DataFrame:
    """(bits, measured, theory): false matches of absent keys against filters over even keys."""
    filters = {b: codecs.bloom_build([b"key%010d" % (2 * i) for i in range(keys)], b) for b in bits}

    @pandas_udf("boolean")
    def match(key: pd.Series, size: pd.Series) -> pd.Series:
        out = np.zeros(len(key), bool)
        for b, bloom in filters.items():
            on = (size == b).to_numpy()
            out[on] = codecs.bloom_may_match([bytes(k) for k in key[on]], bloom)
        return pd.Series(out)

    asked = spark.range(lookups).select(F.format_string("key%010d", 2 * F.pmod(F.col("id") * 7919, F.lit(keys)) + 1).cast("binary").alias("key"))
    asked = asked.withColumn("bits", F.explode(F.array(*map(F.lit, bits))))
    return asked.select("bits", match("key", "bits").cast("double").alias("hit")).groupBy("bits").agg(F.avg("hit").alias("measured")).withColumn("theory", bloom_theory(F.col("bits")))
