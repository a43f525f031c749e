"""The queries of the pipeline operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, language_id, line_dedup, quality_rules, simhash, suffix_dedup, toxicity, url_filter, warc
from tidelog.llm.common import scratch, table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; it is read there."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), remainder != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted", "threshold", "flagged")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.learn(docs, vocabulary("piece_bpe_32k.model"), ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join("removed", ","))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), scratch(spark, "warc"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_language_id, op4_url_filter, op5_bpe, op6_decontaminate, op7_quality_rules, op8_line_dedup, op9_suffix_dedup, op10_warc)}

#: Lines within one edit share their first or their last half; that narrows the pairs and loses none.
_LINES = """WITH RECURSIVE occ AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, trim(unnest(ls), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
lines AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n, row_number() OVER (ORDER BY min((doc_id, line_no))) AS id FROM occ WHERE line <> '' GROUP BY line),
halves AS (SELECT id, line, n, m, left(line, m // 2) AS a, right(line, m - m // 2) AS z FROM (SELECT *, n AS m FROM lines UNION ALL SELECT *, n - 1 FROM lines) WHERE n >= 20 AND m >= 20),
pairs AS (SELECT x.id AS i, y.id AS j, x.line AS s, y.line AS t FROM halves x JOIN halves y ON x.m = y.m AND x.a = y.a AND x.id < y.id AND greatest(x.n, y.n) - 1 <= x.m AND least(x.n, y.n) = x.m
  UNION SELECT x.id, y.id, x.line, y.line FROM halves x JOIN halves y ON x.m = y.m AND x.z = y.z AND x.id < y.id AND greatest(x.n, y.n) - 1 <= x.m AND least(x.n, y.n) = x.m),
links AS (SELECT i, j FROM pairs WHERE levenshtein(s, t) <= 1),
both_ways AS (SELECT i, j FROM links UNION SELECT j, i FROM links),
reach(i, j) AS (SELECT DISTINCT i, i FROM both_ways UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON r.j = b.i),
class AS (SELECT i, min(j) AS low FROM reach GROUP BY i),
keep AS (SELECT l.line, coalesce(f.first, l.first) AS keep FROM lines l LEFT JOIN class c ON c.i = l.id LEFT JOIN lines f ON f.id = c.low)
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * (k // 4) + 1}, 5) AS INTEGER) >> {15 - 5 * (k % 4)}) & 31), 1)" for k in range(32))

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": _LINES
    + """SELECT o.doc_id, count(*) FILTER (WHERE o.line <> '') AS n_lines, count(*) FILTER (WHERE (o.doc_id, o.line_no) <> k.keep) AS n_removed,
 coalesce(string_agg(CAST(o.line_no AS VARCHAR), ',' ORDER BY o.line_no) FILTER (WHERE (o.doc_id, o.line_no) <> k.keep), '') AS removed
 FROM occ o LEFT JOIN keep k ON o.line = k.line GROUP BY o.doc_id""",
    "op9_suffix_dedup": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS i FROM t)),
again AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
starts AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)) || CASE WHEN final THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN cut USING (doc_id)""",
    "op10_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
