"""Run metadata: level shape, scores, overlaps, compaction planning and its accounting.

Everything here is a relation over ``run_file`` rows (level, number, size,
smallest, largest as user keys) or over records and those rows. Ranges of files
are joined by interval predicates; the file side is metadata, and is broadcast
only by Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.model import LEVELS

L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 4, 8, 12
L1_BYTES, MULTIPLIER, FILE_BYTES = 10 << 20, 10, 2 << 20


def payload(key: str = "key", value: str = "value") -> Column:
    """User bytes of a record; a tombstone counts its key."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def target_bytes(level: Column, base: int = L1_BYTES, multiplier: int = MULTIPLIER) -> Column:
    return (F.lit(float(base)) * F.pow(F.lit(float(multiplier)), F.greatest(level - 1, F.lit(0)))).cast("bigint")


def level_shape(files: DataFrame) -> DataFrame:
    """(level, files, bytes) of all seven levels."""
    every = files.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    sums = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return every.join(sums, "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def scores(files: DataFrame, trigger: int = L0_TRIGGER, base: int = L1_BYTES, multiplier: int = MULTIPLIER) -> DataFrame:
    """(level, score): level 0 by files, deeper ones by bytes; the last level has none."""
    shape = level_shape(files).where(F.col("level") < LEVELS - 1)
    by_bytes = F.col("bytes").cast("double") / target_bytes(F.col("level"), base, multiplier)
    return shape.select("level", F.when(F.col("level") == 0, F.col("files").cast("double") / trigger).otherwise(by_bytes).alias("score"))


def pick_level(files: DataFrame, **settings: int) -> DataFrame:
    """One row: the level of the highest score, the lower one of equals."""
    return scores(files, **settings).orderBy(F.col("score").desc(), "level").limit(1)


def pending_bytes(files: DataFrame, trigger: int = L0_TRIGGER, base: int = L1_BYTES, multiplier: int = MULTIPLIER) -> DataFrame:
    """One row: bytes that compactions are still to write."""
    shape = level_shape(files)
    target = target_bytes(F.col("level"), base, multiplier)
    over = F.when((F.col("level").between(1, LEVELS - 2)) & (F.col("bytes") > target), (F.col("bytes") - target) * (multiplier + 1)).otherwise(0)
    crowded = F.max(F.when(F.col("level") == 0, F.col("files")).otherwise(0)) >= trigger
    top = F.sum(F.when(F.col("level") <= 1, F.col("bytes")).otherwise(0))
    return shape.agg((F.when(crowded, top).otherwise(0) + F.sum(over)).cast("bigint").alias("pending_bytes"))


def overlapping(files: DataFrame, begin: bytes | str | None, end: bytes | str | None) -> DataFrame:
    """Files that meet the closed range [begin, end]; None is unbounded."""
    if begin is not None:
        files = files.where(F.col("largest") >= F.lit(begin))
    return files if end is None else files.where(F.col("smallest") <= F.lit(end))


def find_file(files: DataFrame, key: bytes | str) -> DataFrame:
    """The first file of a sorted level whose largest key is at or above ``key``."""
    return files.where(F.col("largest") >= F.lit(key)).orderBy("largest").limit(1)


def files_probed(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, files): files whose range covers each key."""
    hit = keys.join(files.select("number", "smallest", "largest"), F.col("key").between(F.col("smallest"), F.col("largest")), "left")
    return hit.groupBy("key").agg(F.count("number").alias("files"))


def compaction_inputs(files: DataFrame, level: int) -> DataFrame:
    """(number, overlaps, overlap_bytes, grandparent_bytes) of each file of a level against the two below."""
    own = files.where(F.col("level") == level).select("number", "smallest", "largest")

    def below(n: int, name: str) -> DataFrame:
        f = files.where(F.col("level") == n).select(F.col("smallest").alias("s"), F.col("largest").alias("l"), F.col("size").alias("b"))
        met = own.join(f, (F.col("s") <= F.col("largest")) & (F.col("l") >= F.col("smallest")), "left")
        return met.groupBy("number").agg(F.count("b").alias(f"{name}s"), F.coalesce(F.sum("b"), F.lit(0)).alias(f"{name}_bytes"))

    return below(level + 1, "overlap").join(below(level + 2, "grandparent"), "number").select("number", "overlaps", "overlap_bytes", "grandparent_bytes")


def trivial_moves(files: DataFrame, level: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Files that move down a level by metadata alone: nothing below overlaps, and little two levels down."""
    return compaction_inputs(files, level).where((F.col("overlaps") == 0) & (F.col("grandparent_bytes") <= 10 * file_bytes)).select("number")


def marked(records: DataFrame, deeper: DataFrame) -> DataFrame:
    """Each record of a compaction's input with its ``fate``: put, tombstone (kept: a deeper file's range holds its key), shadowed or dropped."""
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    ranked = records.withColumn("_rank", F.row_number().over(newest))
    ranges = deeper.select(F.col("smallest").alias("_s"), F.col("largest").alias("_l")).distinct()
    gone = ranked.where("_rank = 1 and op = 0").select("key")
    kept = gone.join(ranges, F.col("key").between(F.col("_s"), F.col("_l")), "left_semi").withColumn("_kept", F.lit(True))
    fate = F.when(F.col("_rank") > 1, "shadowed").when(F.col("op") == 1, "put").when(F.col("_kept"), "tombstone").otherwise("dropped")
    return ranked.join(kept, "key", "left").withColumn("fate", fate).drop("_rank", "_kept")


def compact(records: DataFrame, deeper: DataFrame) -> DataFrame:
    """What a compaction writes: the newest of each key, less tombstones that hide nothing deeper."""
    return marked(records, deeper).where(F.col("fate").isin("put", "tombstone")).drop("fate")


def replay(edits: DataFrame) -> DataFrame:
    """Live files after all edits (version, action 'add' or 'delete', level, number): of each file and level the last action, if it adds."""
    last = Window.partitionBy("level", "number").orderBy(F.col("version").desc(), F.col("action"))
    return edits.withColumn("_rank", F.row_number().over(last)).where("_rank = 1 and action = 'add'").drop("_rank", "action")


def named(edits: DataFrame, keep: int) -> DataFrame:
    """(number): files that any of the last ``keep`` versions of ``edits`` names: those in the first of them, and those added since."""
    first = (edits.agg(F.max("version")).first()[0] or 0) - (keep - 1)
    return replay(edits.where(F.col("version") <= first)).select("number").union(edits.where((F.col("version") > first) & (F.col("action") == "add")).select("number")).distinct()


def obsolete(listing: DataFrame, live: DataFrame, pending: DataFrame) -> DataFrame:
    """Files found that neither a live version nor a pending output names."""
    return listing.join(live.select("number").union(pending.select("number")), "number", "left_anti")


def missing(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Files a version names that are not there."""
    return expected.join(listing.select("number"), "number", "left_anti")


def greedy_groups(writes: DataFrame, by: str, order: str, size: str, small: int = 128 << 10, most: int = 1 << 20) -> DataFrame:
    """``writes`` with the group each commits in: a leader takes followers until its bound is passed.

    The bound is ``most`` bytes, but a leader of at most ``small`` bytes takes only that many more. The running
    sum begins anew with each leader, which no window expresses; rows of one ``by`` are read in order in batches.
    """
    schema = f"{writes.schema.simpleString()[7:-1]},group_no:bigint"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, group, used, bound = None, 0, 0, 0
        for pdf in parts:
            out = []
            for who, n in zip(pdf[by], pdf[size], strict=True):
                if who != owner:
                    owner, group, used, bound = who, 0, int(n), (n + small if n <= small else most)
                elif used + n > bound:
                    group, used, bound = group + 1, int(n), (n + small if n <= small else most)
                else:
                    used += int(n)
                out.append(group)
            yield pdf.assign(group_no=out)

    return writes.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)
