"""The canonical inputs of the queries, over the provided tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import to_mutations
from tidelog.operators import levels

RUN = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(c: Column) -> Column:
    return F.concat(F.lit("user"), F.lpad(c.cast("string"), 10, "0"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: key by user, an error deletes, props is the value; ``run`` of a thousand events."""
    e = table(spark, sf_dir, "events")
    return to_mutations(e, user_key(F.col("user_id")), F.col("event_id") + 1, F.col("event_type") == "error", F.col("props"), F.floor(F.col("event_id") / RUN).alias("run"), "user_id", "event_id")


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each run, the newest at level 0."""
    m = mutations(spark, sf_dir)
    newest = F.max("number").over(levels.Window.partitionBy(F.lit(0)))  # one row a run by then
    f = m.groupBy(F.col("run").alias("number")).agg(F.sum(levels.payload()).cast("bigint").alias("size"), F.min("key").alias("smallest"), F.max("key").alias("largest"))
    return f.withColumn("level", F.least(F.lit(6), newest - F.col("number")).cast("int"))


def deep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest records, in files of disjoint key ranges with gaps between."""
    m = mutations(spark, sf_dir).withColumn("file", F.floor(F.col("user_id") / 15))
    return m.where((F.col("run") <= 2) & (F.col("file") % 2 == 0))


def deep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deep_records(spark, sf_dir)
    return d.groupBy(F.col("file").alias("number")).agg(F.sum(levels.payload()).cast("bigint").alias("size"), F.min("key").alias("smallest"), F.max("key").alias("largest"))


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations(spark, sf_dir).where("run >= 5")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.round(F.col("value") * 1000).cast("bigint").alias("v"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a sorted base: unique keys, the status as value."""
    o = table(spark, sf_dir, "orders")
    return to_mutations(o, F.format_string("key%010d", "o_orderkey"), F.col("o_orderkey") + 1, F.lit(False), F.col("o_orderstatus"))


#: The same relations in SQL, as the beginning of a WITH.
M = """m AS (SELECT 'user' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value,
  event_id // 1000 AS run, user_id, event_id FROM events)"""
FOLD = M + """, folded AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
live AS (SELECT key, value FROM folded WHERE op = 1)"""
SIZE = "length(key) + coalesce(length(value), 0)"
RUNS = M + f""", f0 AS (SELECT run AS number, CAST(sum({SIZE}) AS BIGINT) AS size, min(key) AS smallest, max(key) AS largest FROM m GROUP BY run),
files AS (SELECT *, CAST(least(6, (SELECT max(number) FROM f0) - number) AS INTEGER) AS level FROM f0),
shape AS (SELECT CAST(l.level AS INTEGER) AS level, count(f.number) AS files, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS bytes
  FROM range(7) l(level) LEFT JOIN files f ON f.level = l.level GROUP BY l.level)"""
DEEP = M + f""", deep AS (SELECT *, user_id // 15 AS file FROM m WHERE run <= 2 AND (user_id // 15) % 2 = 0),
deep_files AS (SELECT file AS number, CAST(sum({SIZE}) AS BIGINT) AS size, min(key) AS smallest, max(key) AS largest FROM deep GROUP BY file),
marked AS (SELECT u.*, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn,
  EXISTS (SELECT 1 FROM deep_files d WHERE u.key BETWEEN d.smallest AND d.largest) AS covered FROM m u WHERE run >= 5)"""
V = "v AS (SELECT event_id, event_type, CAST(round(value * 1000) AS BIGINT) AS v FROM events)"


def bucket_sql(v: str, bits: int) -> str:
    sub = 1 << bits
    msb = f"(length(bin({v})) - 1)"
    return f"CASE WHEN {v} < {sub} THEN {v} ELSE ({msb} - {bits} + 1) * {sub} + (({v} >> CAST({msb} - {bits} AS BIGINT)) - {sub}) END"


def edge_sql(b: str, bits: int) -> str:
    sub = 1 << bits
    return f"CASE WHEN {b} < {sub} THEN {b} ELSE ((({b} % {sub}) + {sub} + 1) << CAST({b} // {sub} - 1 AS BIGINT)) - 1 END"


def hist_sql(bits: int) -> str:
    return V + f", h AS (SELECT {bucket_sql('v', bits)} AS bucket, count(*) AS cnt FROM v WHERE v IS NOT NULL GROUP BY 1), r AS (SELECT bucket, cnt, sum(cnt) OVER (ORDER BY bucket) AS below, sum(cnt) OVER () AS total FROM h)"
