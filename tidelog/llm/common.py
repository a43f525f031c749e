"""What the operators share: reading tables, and components of a graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import cut, scratch, shared_dir, tidy

__all__ = ["connected_components", "cut", "packed", "quoted", "scratch", "shared_dir", "sieved", "table", "tidy", "together"]
#: Rows of 64 bits that a sieve has at most: 4 MB, whatever is sieved.
SIEVE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name such that no character in it has a meaning."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> Column:
    """Every column of a row as one struct."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def together(texts: Sequence[str | None], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of at most ``rows`` texts and ``chars`` characters, or of one longer text."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        size = len(t or "")
        if b > a and (b - a >= rows or held + size > chars):
            yield a, b
            a, held = b, 0
        held += size
    if a < len(texts):
        yield a, len(texts)


def sieved(df: DataFrame, name: str, some: DataFrame) -> DataFrame:
    """The rows of ``df`` whose column ``name`` is among those of ``some``, and a few others.

    A bitmap of SIEVE words is all that is broadcast. It lets more through as ``some`` grows, so it only spares
    rows a shuffle; the exact join has to follow.
    """
    h = F.xxhash64(name)
    word, bit = F.pmod(F.shiftrightunsigned(h, 6), F.lit(SIEVE)), h.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    marks = some.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = df.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(marks), "_word")
    return rows.where(F.expr("shiftright(_bits, _bit) & 1L = 1L")).select(*[F.col(quoted(c)) for c in df.columns])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every root with a smaller neighbour goes below the smallest of these, so each pass at least halves the roots that have links."""
    t = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    names, at = np.unique(np.concatenate([t.column(0).to_numpy(), t.column(1).to_numpy()]), return_inverse=True)
    low, a, b = np.arange(len(names)), at[: t.num_rows], at[t.num_rows :]
    while len(a):
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low != low[low]).any():
            low = low[low]
        a, b = low[a], low[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[low])], ["node", "root"])


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: of one type with an order); root is the smallest node reachable.

    Up to ``few`` edges, which have to be bigints then, are settled by one task; more of them as follows.

    Alternating large-star and small-star contractions. Each is an aggregation
    with map-side combining and an equi-join, so a hub's edges are never in one
    task; the driver sees only a count and a checksum. Null ends and loops are
    ignored; no edges give no rows.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if few and edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_rooted, "node bigint, root bigint")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join shuffles both sides for itself and Spark can split a hub's rows.
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
