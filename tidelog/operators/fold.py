"""Reads of a mutation log: the newest version of each key, seen at a sequence, deletions hidden.

Key predicates and the sequence cut go below the fold, where Catalyst pushes
them to the Parquet scan; the tombstone filter and any predicate on values stay
above it. The fold is a row_number of 1, which Spark plans as a group limit
before and after its one exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.model import PUT


def visible(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The records a reader at ``seq`` may see."""
    return log if seq is None else log.where(F.col("seq") <= seq)


def fold(log: DataFrame, *ties: Column) -> DataFrame:
    """The newest record of each key, tombstones included; ``ties`` order records of one sequence."""
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc(), *ties)
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def fold_by_aggregate(log: DataFrame) -> DataFrame:
    """The same as an aggregation, which also runs on streams."""
    return log.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("_new")).select("key", "_new.*")


def live(log: DataFrame, seq: int | None = None) -> DataFrame:
    """(key, value) of the keys alive at ``seq``."""
    return fold(visible(log, seq)).where(F.col("op") == PUT).select("key", "value")


def successor(prefix: bytes) -> bytes | None:
    """The least string above all that begin with ``prefix``; None if there is none."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def key_range(start: bytes | None = None, end: bytes | None = None) -> Column:
    """start <= key < end, either side open if None; a form that reaches the scan."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("key") >= F.lit(start))
    return out if end is None else out & (F.col("key") < F.lit(end))


def get(log: DataFrame, key: bytes, seq: int | None = None) -> DataFrame:
    """One row, or none if the key is absent or deleted."""
    return live(log.where(F.col("key") == F.lit(key)), seq)


def scan(log: DataFrame, start: bytes | None = None, end: bytes | None = None, limit: int | None = None, seq: int | None = None, keys_only: bool = False, reverse: bool = False) -> DataFrame:
    """Live rows of a key range in key order."""
    rows = live(log.where(key_range(start, end)), seq)
    rows = (rows.select("key") if keys_only else rows).orderBy(F.col("key").desc() if reverse else "key")
    return rows if limit is None else rows.limit(limit)


def prefix(log: DataFrame, head: bytes, seq: int | None = None) -> DataFrame:
    return scan(log, head or None, successor(head), seq=seq)


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """(key, value, found) for each distinct key asked for. The keys cut the log before the fold; Spark picks the join by their size."""
    asked = keys.select("key").distinct()
    found = live(log.join(asked, "key", "left_semi"), seq).withColumn("found", F.lit(True))
    return asked.join(found, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def diff(log: DataFrame, before: int, after: int) -> DataFrame:
    """(key, old, new, change) of keys that differ between two sequences; only keys written in between are folded."""
    touched = log.where((F.col("seq") > before) & (F.col("seq") <= after)).select("key").distinct()
    some = log.join(touched, "key", "left_semi")
    old, new = (live(some, s).select("key", F.col("value").alias(n), F.lit(True).alias(f"in_{n}")) for s, n in ((before, "old"), (after, "new")))
    both = old.join(new, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")) | F.col("in_old").isNull() | F.col("in_new").isNull())
    return both.select("key", "old", "new", F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed").alias("change"))


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All records of sorted runs, the newest run first; ``src`` is a run's place in the list."""
    if not runs:
        raise ValueError("no runs: use model.empty")
    return reduce(DataFrame.unionByName, [r.withColumn("src", F.lit(k)) for k, r in enumerate(runs)])


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """A total order by key; equal keys in the order of their runs, the newest first."""
    return union_runs(runs).orderBy("key", "src", F.col("seq").desc())


def internal_order(log: DataFrame) -> DataFrame:
    """Key ascending, sequence descending."""
    return log.orderBy("key", F.col("seq").desc())


def order_violations(rows: DataFrame, key: str = "key", part: str = "part", place: str = "place") -> DataFrame:
    """One row: how many rows, and how many keys that do not rise strictly as the rows stand, by ``place`` in each ``part``."""
    before = F.lag(key).over(Window.partitionBy(part).orderBy(place))
    return rows.select((F.col(key) <= before).alias("bad")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("violations"))


def stored(rows: DataFrame) -> DataFrame:
    """Rows read from files, with the file as ``part`` and the row's number in it as ``place``."""
    return rows.withColumns({"part": F.col("_metadata.file_path"), "place": F.col("_metadata.row_index")})
