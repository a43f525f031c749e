"""Log-linear histograms as relations: (bucket, cnt), merged by adding up.

A value below 2^bits has its own bucket; above, each power of two has 2^bits
buckets. The highest bit comes from the length of the binary digits, which is
exact. The engine's histograms have 5 bits, the reporting ones 7.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENGINE_BITS, REPORT_BITS, CLAMP_EXP = 5, 7, 42
#: Bounds of exported buckets, in nanoseconds.
LADDER_NS = (1000, 2000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000, 2000000, 5000000, 10000000, 20000000, 50000000, 100000000, 200000000, 500000000, 1000000000, 2000000000, 5000000000, 10000000000)


def bucket(v: Column, bits: int = REPORT_BITS, max_exp: int = CLAMP_EXP) -> Column:
    sub = 1 << bits
    top = F.least(v.cast("bigint"), F.lit((1 << (max_exp + 1)) - 1))
    shift = F.length(F.bin(top)) - 1 - bits
    index = (shift + 1) * sub + (F.expr("1") * F.call_function("shiftright", top, F.greatest(shift, F.lit(0))) - sub)
    return F.when(v < sub, v.cast("bigint")).otherwise(index.cast("bigint"))


def upper_edge(index: Column, bits: int = REPORT_BITS) -> Column:
    """The largest value of a bucket."""
    sub = 1 << bits
    shift = F.floor(index / sub) - 1
    edge = F.call_function("shiftleft", (index % sub + sub + 1).cast("bigint"), F.greatest(shift, F.lit(0)).cast("int")) - 1
    return F.when(index < sub, index.cast("bigint")).otherwise(edge)


def histogram(rows: DataFrame, value: str, bits: int = REPORT_BITS, with_top: bool = False) -> DataFrame:
    """(bucket, cnt); ``with_top`` adds each bucket's largest value, which caps percentiles."""
    more = [F.max(value).alias("top")] if with_top else []
    return rows.where(F.col(value).isNotNull()).groupBy(bucket(F.col(value), bits).alias("bucket")).agg(F.count("*").alias("cnt"), *more)


def merge(*parts: DataFrame) -> DataFrame:
    """Histograms added up."""
    return reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.sum("cnt").alias("cnt"))


def _running(hist: DataFrame) -> DataFrame:
    """Buckets are some thousands at most, whatever the data, so one ordered window holds them."""
    rising = Window.partitionBy(F.lit(0)).orderBy("bucket")
    return hist.withColumn("below", F.sum("cnt").over(rising)).withColumn("total", F.sum("cnt").over(Window.partitionBy(F.lit(0))))


def percentiles(hist: DataFrame, ps: tuple[float, ...], bits: int = REPORT_BITS) -> DataFrame:
    """(p, value): the upper edge of the bucket with the nearest rank, at most the largest ``top`` if the histogram has it."""
    cap = F.max("top").over(Window.partitionBy(F.lit(0))) if "top" in hist.columns else F.lit(None).cast("bigint")
    hist = hist.withColumn("cap", cap)
    ranked = _running(hist).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    rank = F.greatest(F.ceil(F.col("p") / 100 * F.col("total")), F.lit(1))
    hit = ranked.where(F.col("below") >= rank).groupBy("p").agg(F.min("bucket").alias("bucket"), F.min("cap").alias("cap"))
    return hit.select("p", F.least(upper_edge(F.col("bucket"), bits), "cap").cast("bigint").alias("value"))


def cdf(hist: DataFrame, bits: int = REPORT_BITS) -> DataFrame:
    """(value, fraction) for each bucket that has values."""
    return _running(hist).select(upper_edge(F.col("bucket"), bits).alias("value"), (F.col("below") / F.col("total")).alias("fraction"))


def ladder(hist: DataFrame, bits: int = ENGINE_BITS, bounds: tuple[int, ...] = LADDER_NS) -> DataFrame:
    """(le_ns, cumulative) at fixed bounds, and one row of null for all; a bucket across a bound counts at the next."""
    edges = hist.select(upper_edge(F.col("bucket"), bits).alias("edge"), "cnt")
    sums = [F.coalesce(F.sum(F.when(F.col("edge") <= b, F.col("cnt"))), F.lit(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = edges.agg(*sums, F.coalesce(F.sum("cnt"), F.lit(0)).alias("all"))
    rows = [F.struct(F.lit(b).cast("bigint").alias("le_ns"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("bigint").alias("le_ns"), F.col("all").alias("cumulative")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
