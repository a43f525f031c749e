"""From raw documents to encoded training text, stage by stage.

Every stage reads what its predecessor kept, written as Parquet, and all but the
last return the columns of ``documents``, whatever further columns there are and
whatever their names. In every stage a null text is the empty text, rows with
null ids are worked on like any others, texts are read whole however long, and an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from tidelog.llm.common import scratch, table
from tidelog.llm.queries import vocabulary
from tidelog.session import Files

#: Five-word shingles: texts whose shingles mostly agree.
SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go: empty texts by the base rule, repeated rows alike. Without labels only the base rule judges."""
    return quality_rules.filter_documents(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that duplicate an earlier one, by id and line number, go; the rest of each text stays. Null ids come last; repeated rows keep or lose lines together; a text may be left empty, and null stays null."""
    return line_dedup.remove(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near copies of one that stays go; of any group the smallest id stays, null ids last, and of repeated rows one. Texts without words are copies of each other."""
    return simhash.keep_one(docs, width=SHINGLE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go, repeated rows alike; an empty benchmark, or null or very short items, remove nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with their number, and the digests of ids and of the decoded text; no tokens for an empty text."""
    out = bpe.encode(docs, vocabulary("word_bpe_49k.json"))
    ids, said = F.array_join("ids", " "), F.col("decoded")
    return out.select("doc_id", F.col("ids").alias("token_ids"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(said.cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:  # nothing reads what the stage before the last has written
            Files(spark, before).delete("")
        before = at
    return docs


#: Learned rules, fingerprints, alignments and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
