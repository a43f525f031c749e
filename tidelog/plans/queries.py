"""The engine's queries over the provided tables, each with the SQL of its answer where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import codecs, exposition, histogram
from tidelog.operators import fold, levels
from tidelog.plans import inputs, workload
from tidelog.plans.inputs import DEEP, FOLD, M, RUNS, SIZE, V, edge_sql, hist_sql
from tidelog.session import scratch
from tidelog.store import Options, Store
from tidelog.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def text(df: DataFrame, *cols: str) -> DataFrame:
    """Binary columns as text."""
    for c in cols or ("key", "value"):
        df = df.withColumn(c, F.col(c).cast("string")) if c in df.columns else df
    return df


log = inputs.mutations
HIT, GONE, MISS = b"user0000000007", b"user0000000005", b"user9999999999"


# -- reads -----------------------------------------------------------------------


@query(f"WITH {FOLD} SELECT key, value FROM live")
def live_fold(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.live(log(spark, d)))


@query(f"WITH {FOLD} SELECT key, value FROM live")
def live_fold_max_by(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.fold_by_aggregate(log(spark, d).select("key", "seq", "op", "value")).where("op = 1").select("key", "value"))


@query(f"WITH {FOLD} SELECT key, value FROM live WHERE key = 'user0000000007'")
def get_hit(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.get(log(spark, d), HIT))


@query(f"WITH {FOLD}, gone AS (SELECT min(key) AS key FROM folded WHERE op = 0) SELECT live.key, live.value FROM live JOIN gone ON live.key = gone.key")
def get_tombstone(spark: SparkSession, d: str) -> DataFrame:
    gone = fold.fold(log(spark, d)).where("op = 0").agg(F.min("key").alias("key")).where("key is not null")
    return text(fold.live(log(spark, d).join(gone, "key", "left_semi")))


@query(f"WITH {FOLD} SELECT key, value FROM live WHERE key = 'user9999999999'")
def get_miss(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.get(log(spark, d), MISS))


@query(f"WITH {FOLD}, asked AS (SELECT DISTINCT 'user' || lpad(CAST(c_custkey * 3 AS VARCHAR), 10, '0') AS key FROM customer WHERE c_custkey < 100) SELECT asked.key, value, live.key IS NOT NULL AS found FROM asked LEFT JOIN live ON asked.key = live.key")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    asked = inputs.table(spark, d, "customer").where("c_custkey < 100").select(inputs.user_key(F.col("c_custkey") * 3).cast("binary").alias("key"))
    return text(fold.multi_get(log(spark, d), asked))


@query(f"WITH {M} SELECT key, value FROM (SELECT * FROM m WHERE seq <= 4000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def as_of_seq(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.live(log(spark, d), 4000))


def _diff_sql(a: int, b: int) -> str:
    at = lambda s: f"(SELECT key, value FROM (SELECT * FROM m WHERE seq <= {s} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1)"
    return f"""WITH {M}, o AS {at(a)}, n AS {at(b)} SELECT coalesce(o.key, n.key) AS key, o.value AS old, n.value AS new,
 CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM o FULL JOIN n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.value IS DISTINCT FROM n.value"""


@query(_diff_sql(4000, 4200))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.diff(log(spark, d).select("key", "seq", "op", "value"), 4000, 4200), "key", "old", "new")


@query(f"WITH {FOLD} SELECT key, value FROM live ORDER BY key")
def scan_full(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.scan(log(spark, d)))


@query(f"WITH {FOLD} SELECT key, value FROM live WHERE key >= 'user0000000020' AND key < 'user0000000090' ORDER BY key")
def scan_range(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.scan(log(spark, d), b"user0000000020", b"user0000000090"))


@query(f"WITH {FOLD} SELECT key, value FROM live WHERE key >= 'user0000000033' ORDER BY key LIMIT 10")
def seek_limit(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.scan(log(spark, d), b"user0000000033", limit=10))


@query(f"WITH {FOLD} SELECT key, value FROM live WHERE key LIKE 'user000000001%' ORDER BY key")
def scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.prefix(log(spark, d), b"user000000001"))


@query(f"WITH {FOLD} SELECT key FROM live ORDER BY key")
def scan_keys_only(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.scan(log(spark, d), keys_only=True))


@query("SELECT 'key' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderstatus AS value FROM orders WHERE o_orderkey BETWEEN 100 AND 399")
def scan_base(spark: SparkSession, d: str) -> DataFrame:
    return text(fold.scan(inputs.base(spark, d), b"key0000000100", b"key0000000400"))


# -- merges and batches ----------------------------------------------------------


@query(f"WITH {M} SELECT key, src, seq, op, value, row_number() OVER (PARTITION BY key ORDER BY src, seq DESC) AS place FROM (SELECT *, 9 - run AS src FROM m WHERE run BETWEEN 7 AND 9)")
def merge_ties(spark: SparkSession, d: str) -> DataFrame:
    m = log(spark, d).select("key", "seq", "op", "value", "run")
    merged = fold.union_runs([m.where(F.col("run") == r).drop("run") for r in (9, 8, 7)])
    place = F.row_number().over(Window.partitionBy("key").orderBy("src", F.col("seq").desc()))
    return text(merged.select("key", F.col("src").cast("bigint").alias("src"), "seq", F.col("op").cast("int").alias("op"), "value", place.cast("bigint").alias("place")))


@query("SELECT user_id, count(*) AS records, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq, CAST(sum(seq * ord) AS BIGINT) AS mix FROM (SELECT user_id, ord, 1 + coalesce(base, 0) + ord AS seq FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events) e JOIN (SELECT user_id AS u, sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)) b ON e.user_id = b.u) GROUP BY user_id")
def batch_sequences(spark: SparkSession, d: str) -> DataFrame:
    """A batch for each user, committed in user order; record ord of a batch gets its base + 1 + ord."""
    e = inputs.table(spark, d, "events")
    sizes = e.groupBy("user_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("user_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("user_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ords = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("ord"))
    seq = 1 + F.col("base") + F.col("ord")
    return ords.join(bases, "user_id").groupBy("user_id").agg(F.count("*").alias("records"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.sum(seq * F.col("ord")).alias("mix"))


@query("""WITH b AS (SELECT ord, CASE WHEN del THEN o_custkey // 2 * 2 ELSE o_custkey END AS k, CASE WHEN del THEN NULL ELSE o_orderstatus END AS v FROM
 (SELECT 2 * o_orderkey AS ord, o_custkey, o_orderstatus, false AS del FROM orders UNION ALL SELECT 2 * o_orderkey + 1, o_custkey, NULL, true FROM orders WHERE o_orderkey % 3 = 0))
SELECT 'cust' || lpad(CAST(k AS VARCHAR), 10, '0') AS key, v AS value FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1) WHERE v IS NOT NULL""")
def batch_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """One batch of a put for each order, and after every third a delete of a neighbouring customer: later records win."""
    o, key = inputs.table(spark, d, "orders"), lambda k: F.concat(F.lit("cust"), F.lpad(k.cast("string"), 10, "0")).cast("binary")
    puts = o.select((2 * F.col("o_orderkey")).alias("seq"), F.lit(1).cast("tinyint").alias("op"), key(F.col("o_custkey")).alias("key"), F.col("o_orderstatus").cast("binary").alias("value"))
    gone = o.where("o_orderkey % 3 = 0").select((2 * F.col("o_orderkey") + 1).alias("seq"), F.lit(0).cast("tinyint").alias("op"), key(F.floor(F.col("o_custkey") / 2) * 2).alias("key"), F.lit(None).cast("binary").alias("value"))
    return text(fold.live(puts.union(gone)))


@query("SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS writers, round(sum(n) / count(*), 6) AS mean_size FROM (SELECT event_id // 8 AS g, count(*) AS n FROM events GROUP BY 1)")
def group_commit_fixed(spark: SparkSession, d: str) -> DataFrame:
    groups = inputs.table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 8).alias("g")).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("writers"), F.round(F.sum("n") / F.count("*"), 6).alias("mean_size"))


@query(f"""WITH RECURSIVE {M}, w AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY event_id) AS i, 12 + {SIZE} AS n FROM m),
g(run, i, grp, used, bound) AS (SELECT run, i, 0, n, n + 200 FROM w WHERE i = 1
 UNION ALL SELECT w.run, w.i, CASE WHEN used + n > bound THEN grp + 1 ELSE grp END, CASE WHEN used + n > bound THEN n ELSE used + n END, CASE WHEN used + n > bound THEN n + 200 ELSE bound END FROM g JOIN w ON w.run = g.run AND w.i = g.i + 1)
SELECT CAST(run AS BIGINT) AS run, CAST(grp AS BIGINT) AS group_no, count(*) AS writers FROM g GROUP BY 1, 2""")
def group_commit_greedy(spark: SparkSession, d: str) -> DataFrame:
    writes = log(spark, d).select("run", "event_id", (12 + levels.payload()).cast("bigint").alias("n"))
    grouped = levels.greedy_groups(writes, "run", "event_id", "n", small=200, most=200)
    return grouped.groupBy("run", "group_no").agg(F.count("*").alias("writers"))


# -- levels ----------------------------------------------------------------------


@query(f"WITH {M} SELECT run, count(*) AS entries_in, count(DISTINCT key) AS entries_out FROM m GROUP BY run")
def flush_dedup(spark: SparkSession, d: str) -> DataFrame:
    per_key = log(spark, d).groupBy("run", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("run").agg(F.sum("n").alias("entries_in"), F.count("*").alias("entries_out"))


@query(f"WITH {DEEP} SELECT CASE WHEN rn > 1 THEN 'shadowed' WHEN op = 1 THEN 'put' WHEN covered THEN 'tombstone' ELSE 'dropped' END AS fate, count(*) AS n FROM marked GROUP BY 1")
def compaction_drops(spark: SparkSession, d: str) -> DataFrame:
    return levels.marked(inputs.upper(spark, d), inputs.deep_files(spark, d)).groupBy("fate").agg(F.count("*").alias("n"))


@query(f"WITH {DEEP} SELECT key, seq FROM marked WHERE rn = 1 AND op = 0 AND covered")
def tombstones_retained(spark: SparkSession, d: str) -> DataFrame:
    return text(levels.marked(inputs.upper(spark, d), inputs.deep_files(spark, d)).where("fate = 'tombstone'").select("key", "seq"))


@query(f"WITH {DEEP} SELECT key, seq, op, value FROM marked WHERE rn = 1 AND (op = 1 OR covered)")
def compaction_output(spark: SparkSession, d: str) -> DataFrame:
    out = levels.compact(inputs.upper(spark, d), inputs.deep_files(spark, d))
    return text(out.select("key", "seq", F.col("op").cast("int").alias("op"), "value"))


@query(f"WITH {RUNS} SELECT level, files, bytes FROM shape")
def level_shape(spark: SparkSession, d: str) -> DataFrame:
    return levels.level_shape(inputs.run_files(spark, d))


_SCORE = "CASE WHEN level = 0 THEN files / 4.0 ELSE bytes / CAST(10000 * pow(10, level - 1) AS BIGINT) END"


@query(f"WITH {RUNS} SELECT level, round(CAST({_SCORE} AS DOUBLE), 9) AS score FROM shape WHERE level < 6")
def level_score(spark: SparkSession, d: str) -> DataFrame:
    return levels.scores(inputs.run_files(spark, d), base=10000).select("level", F.round("score", 9).alias("score"))


@query(f"WITH {RUNS} SELECT level, round(CAST({_SCORE} AS DOUBLE), 9) AS score FROM shape WHERE level < 6 ORDER BY score DESC, level LIMIT 1")
def pick_level(spark: SparkSession, d: str) -> DataFrame:
    return levels.pick_level(inputs.run_files(spark, d), base=10000).select("level", F.round("score", 9).alias("score"))


@query(f"""WITH {RUNS}, t AS (SELECT *, CAST(10000 * pow(10, greatest(level - 1, 0)) AS BIGINT) AS target FROM shape)
SELECT CAST(CASE WHEN max(CASE WHEN level = 0 THEN files END) >= 1 THEN sum(CASE WHEN level <= 1 THEN bytes ELSE 0 END) ELSE 0 END
 + sum(CASE WHEN level BETWEEN 1 AND 5 AND bytes > target THEN (bytes - target) * 11 ELSE 0 END) AS BIGINT) AS pending_bytes FROM t""")
def pending_bytes(spark: SparkSession, d: str) -> DataFrame:
    return levels.pending_bytes(inputs.run_files(spark, d), trigger=1, base=10000)


def _three_levels(spark: SparkSession, d: str) -> DataFrame:
    """Single users' files over the deep ones."""
    up = inputs.upper(spark, d).where("user_id % 4 = 1").groupBy(F.col("user_id").alias("number")).agg(F.sum(levels.payload()).cast("bigint").alias("size"), F.min("key").alias("smallest"), F.max("key").alias("largest"))
    deep = inputs.deep_files(spark, d).withColumn("number", F.col("number") + 100000)
    return up.withColumn("level", F.lit(1)).unionByName(deep.withColumn("level", F.when(F.col("number") % 4 == 0, 2).otherwise(3)))


_THREE = DEEP + f""", up AS (SELECT user_id AS number, CAST(sum({SIZE}) AS BIGINT) AS size, min(key) AS smallest, max(key) AS largest FROM m WHERE run >= 5 AND user_id % 4 = 1 GROUP BY user_id),
d3 AS (SELECT *, CASE WHEN (number + 100000) % 4 = 0 THEN 2 ELSE 3 END AS level FROM deep_files),
ins AS (SELECT up.number, count(a.number) FILTER (a.level = 2) AS "overlaps", CAST(coalesce(sum(a.size) FILTER (a.level = 2), 0) AS BIGINT) AS overlap_bytes, CAST(coalesce(sum(a.size) FILTER (a.level = 3), 0) AS BIGINT) AS grandparent_bytes
 FROM up LEFT JOIN d3 a ON a.smallest <= up.largest AND a.largest >= up.smallest GROUP BY up.number)"""


@query(f'WITH {_THREE} SELECT number, "overlaps", overlap_bytes, grandparent_bytes FROM ins')
def overlapping_inputs(spark: SparkSession, d: str) -> DataFrame:
    return levels.compaction_inputs(_three_levels(spark, d), 1)


@query(f'WITH {_THREE} SELECT number FROM ins WHERE "overlaps" = 0 AND grandparent_bytes <= 10 * 100')
def trivial_moves(spark: SparkSession, d: str) -> DataFrame:
    return levels.trivial_moves(_three_levels(spark, d), 1, file_bytes=100)


@query(f"WITH {DEEP} SELECT number, size FROM deep_files WHERE largest >= 'user0000000035' AND smallest <= 'user0000000100'")
def overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    return levels.overlapping(inputs.deep_files(spark, d), b"user0000000035", b"user0000000100").select("number", "size")


@query(f"WITH {DEEP} SELECT number FROM deep_files WHERE largest >= 'user0000000050' ORDER BY largest LIMIT 1")
def find_file(spark: SparkSession, d: str) -> DataFrame:
    return levels.find_file(inputs.deep_files(spark, d), b"user0000000050").select("number")


@query(f"WITH {DEEP} SELECT k.key, count(f.number) AS files FROM (SELECT DISTINCT key FROM m) k LEFT JOIN deep_files f ON k.key BETWEEN f.smallest AND f.largest GROUP BY k.key")
def files_probed(spark: SparkSession, d: str) -> DataFrame:
    return text(levels.files_probed(log(spark, d).select("key").distinct(), inputs.deep_files(spark, d)))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    """Each run is added at level 0 by its version; later ones move every third and delete every fourth."""
    r = inputs.run_files(spark, d).select("number")
    add = r.select(F.col("number").alias("version"), F.lit("add").alias("action"), F.lit(0).alias("level"), "number")
    third = r.where("number % 3 = 0")
    moved = third.select((F.col("number") + 2).alias("version"), F.explode(F.array(F.struct(F.lit("delete").alias("action"), F.lit(0).alias("level")), F.struct(F.lit("add").alias("action"), F.lit(1).alias("level")))).alias("e"), "number").select("version", "e.*", "number")
    gone = r.where("number % 4 = 1").select((F.col("number") + 5).alias("version"), F.lit("delete").alias("action"), F.lit(0).alias("level"), "number")
    return add.unionByName(moved).unionByName(gone)


_EDITS = RUNS + """, edits AS (SELECT number AS version, 'add' AS action, 0 AS level, number FROM files
 UNION ALL SELECT number + 2, 'delete', 0, number FROM files WHERE number % 3 = 0 UNION ALL SELECT number + 2, 'add', 1, number FROM files WHERE number % 3 = 0
 UNION ALL SELECT number + 5, 'delete', 0, number FROM files WHERE number % 4 = 1),
now AS (SELECT level, number FROM edits QUALIFY row_number() OVER (PARTITION BY level, number ORDER BY version DESC, action) = 1 AND action = 'add')"""


@query(f"WITH {_EDITS} SELECT * FROM now")
def manifest_replay(spark: SparkSession, d: str) -> DataFrame:
    return levels.replay(_edits(spark, d)).select("level", "number")


@query(f"WITH {_EDITS} SELECT number FROM files WHERE number NOT IN (SELECT number FROM now) AND number <> 5")
def obsolete_files(spark: SparkSession, d: str) -> DataFrame:
    files = inputs.run_files(spark, d).select("number")
    return levels.obsolete(files, levels.replay(_edits(spark, d)), files.where("number = 5"))


@query(f"WITH {_EDITS} SELECT level, number FROM now WHERE number % 5 = 3")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    listing = inputs.run_files(spark, d).where("number % 5 <> 3")
    return levels.missing(levels.replay(_edits(spark, d)), listing).select("level", "number")


@query(f"""WITH {_EDITS}, upto AS (SELECT e.*, v.v FROM edits e JOIN (SELECT DISTINCT version AS v FROM edits) v ON e.version <= v.v),
held AS (SELECT v, level, number FROM upto QUALIFY row_number() OVER (PARTITION BY v, level, number ORDER BY version DESC, action) = 1 AND action = 'add')
SELECT DISTINCT number FROM held WHERE v >= (SELECT max(version) - 4 FROM edits)""")
def live_versions(spark: SparkSession, d: str) -> DataFrame:
    """Files that any of the last versions names."""
    return levels.named(_edits(spark, d), keep=5)


# -- counters, histograms, windows -----------------------------------------------


@query(f"WITH {M} SELECT CASE WHEN op = 1 THEN 'put' ELSE 'delete' END AS kind, count(*) AS ops, CAST(sum({SIZE}) AS BIGINT) AS user_bytes FROM m GROUP BY 1")
def ops_by_type(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy(F.when(F.col("op") == 1, "put").otherwise("delete").alias("kind")).agg(F.count("*").alias("ops"), F.sum(levels.payload()).cast("bigint").alias("user_bytes"))


@query(f"WITH {M} SELECT CAST(sum({SIZE}) AS BIGINT) AS user_bytes FROM m")
def user_bytes(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).agg(F.sum(levels.payload()).cast("bigint").alias("user_bytes"))


@query(f"""WITH {FOLD}, s AS (SELECT sum({SIZE}) AS u FROM m), fl AS (SELECT sum({SIZE}) AS f FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1)), c AS (SELECT sum({SIZE}) AS c FROM live)
SELECT CAST(u AS BIGINT) AS user_bytes, CAST(f AS BIGINT) AS flush_bytes, CAST(c AS BIGINT) AS compaction_bytes, round((u + f + c) / u, 6) AS write_amp FROM s, fl, c""")
def write_amp(spark: SparkSession, d: str) -> DataFrame:
    """Payload written by log, flush of each run and one full compaction, over what users wrote."""
    m = log(spark, d)
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("seq").desc()))
    ranked = m.withColumn("in_run", newest("run", "key")).withColumn("in_all", newest("key")).withColumn("n", levels.payload())
    sums = ranked.agg(F.sum("n").cast("bigint").alias("user_bytes"), F.sum(F.when(F.col("in_run") == 1, F.col("n"))).cast("bigint").alias("flush_bytes"), F.sum(F.when((F.col("in_all") == 1) & (F.col("op") == 1), F.col("n"))).cast("bigint").alias("compaction_bytes"))
    return sums.withColumn("write_amp", F.round((F.col("user_bytes") + F.col("flush_bytes") + F.col("compaction_bytes")) / F.col("user_bytes"), 6))


@query("SELECT user_id, round(CASE WHEN h + ms = 0 THEN 0 ELSE h / (h + ms) END, 6) AS ratio FROM (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS h, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS ms FROM events GROUP BY user_id)")
def hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Views as hits, clicks as misses; nothing asked gives 0."""
    sums = inputs.table(spark, d, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "view").cast("int")).alias("h"), F.sum((F.col("event_type") == "click").cast("int")).alias("m"))
    return sums.select("user_id", F.round(F.when(F.col("h") + F.col("m") == 0, F.lit(0.0)).otherwise(F.col("h") / (F.col("h") + F.col("m"))), 6).alias("ratio"))


@query("SELECT event_type AS reason, count(*) AS stalls, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS micros FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1")
def stall_totals(spark: SparkSession, d: str) -> DataFrame:
    stalls = inputs.latencies(spark, d).where(F.col("event_type").isin("error", "purchase", "signup"))
    return stalls.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("stalls"), F.sum("v").alias("micros"))


def _hist(spark: SparkSession, d: str, bits: int = 7) -> DataFrame:
    return histogram.histogram(inputs.latencies(spark, d), "v", bits)


@query(f"WITH {hist_sql(7)} SELECT CAST(bucket AS BIGINT) AS bucket, cnt FROM h")
def hdr_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _hist(spark, d)


_PS = (50.0, 90.0, 95.0, 99.0, 99.9, 100.0)


@query(f"WITH {hist_sql(7)}, p AS (SELECT unnest([50.0, 90.0, 95.0, 99.0, 99.9, 100.0])::DOUBLE AS p), x AS (SELECT p, min(bucket) AS b FROM p, r WHERE below >= greatest(ceil(p / 100 * total), 1) GROUP BY p) SELECT p, CAST(least({edge_sql('b', 7)}, (SELECT max(v) FROM v)) AS BIGINT) AS value FROM x")
def hdr_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return histogram.percentiles(histogram.histogram(inputs.latencies(spark, d), "v", with_top=True), _PS)


@query(f"WITH {hist_sql(5)}, p AS (SELECT unnest([50.0, 90.0, 95.0, 99.0, 99.9, 100.0])::DOUBLE AS p), x AS (SELECT p, min(bucket) AS b FROM p, r WHERE below >= greatest(ceil(p / 100 * total), 1) GROUP BY p) SELECT p, CAST({edge_sql('b', 5)} AS BIGINT) AS value FROM x")
def engine_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return histogram.percentiles(_hist(spark, d, 5), _PS, 5)


@query(f"WITH {hist_sql(7)} SELECT CAST({edge_sql('bucket', 7)} AS BIGINT) AS value, round(below / total, 9) AS fraction FROM r")
def hdr_cdf(spark: SparkSession, d: str) -> DataFrame:
    return histogram.cdf(_hist(spark, d)).select("value", F.round("fraction", 9).alias("fraction"))


@query(f"WITH {hist_sql(7)} SELECT CAST(bucket AS BIGINT) AS bucket, CAST(cnt AS BIGINT) AS cnt FROM h")
def hdr_merge(spark: SparkSession, d: str) -> DataFrame:
    v = inputs.latencies(spark, d)
    return histogram.merge(*[histogram.histogram(v.where(F.col("event_id") % 3 == k), "v") for k in range(3)])


@query(f"WITH {V}, r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM v WHERE v IS NOT NULL) SELECT p, CAST(max(v) AS BIGINT) AS value FROM (SELECT unnest([50.0, 99.0])::DOUBLE AS p) q, r WHERE i = greatest(ceil(p / 100 * n), 1) GROUP BY p")
def exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rank over the values themselves."""
    v = inputs.latencies(spark, d)
    one = v.agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by v)").cast("bigint").alias(f"p{int(p)}") for p in (50.0, 99.0)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{int(p)}").alias("value")) for p in (50.0, 99.0)])).alias("r")).select("r.*")


_BOUNDS = ", ".join(map(str, histogram.LADDER_NS))


@query(f"WITH {hist_sql(5)}, e AS (SELECT {edge_sql('bucket', 5)} AS edge, cnt FROM h), b AS (SELECT unnest([{_BOUNDS}])::BIGINT AS le_ns) SELECT le_ns, CAST(coalesce(sum(cnt) FILTER (edge <= le_ns), 0) AS BIGINT) AS cumulative FROM b, e GROUP BY le_ns UNION ALL SELECT NULL, CAST(sum(cnt) AS BIGINT) FROM e")
def prom_ladder(spark: SparkSession, d: str) -> DataFrame:
    return histogram.ladder(_hist(spark, d, 5))


@query("""WITH c AS (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1) SELECT 'ops_total{op="' || t || '"} ' || CAST(n AS VARCHAR) AS line FROM c
UNION ALL SELECT '# HELP ops_total Operations' UNION ALL SELECT '# TYPE ops_total counter'""")
def prom_text(spark: SparkSession, d: str) -> DataFrame:
    counts = inputs.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    rows = counts.select(F.lit("ops_total").alias("name"), F.create_map(F.lit("op"), "event_type").alias("labels"), F.lit("counter").alias("type"), F.col("n").cast("double").alias("value"), F.lit("Operations").alias("help"))
    return exposition.prometheus(rows).select("line")


@query("WITH s AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1) SELECT t, CAST(n AS BIGINT) AS rate FROM s")
def rate_per_hour(spark: SparkSession, d: str) -> DataFrame:
    """Rates from a cumulative counter sampled hourly."""
    hours = inputs.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("t"))
    return workload.rates(hours.select("t", total.alias("total")), "t", "total").select("t", F.col("rate").cast("bigint").alias("rate"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def rate_per_day(spark: SparkSession, d: str) -> DataFrame:
    return inputs.table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("""WITH k AS (SELECT o_orderkey, o_orderkey // 1000 AS part, 'key' || lpad(CAST(CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey - 1 WHEN o_orderkey % 89 = 7 THEN o_orderkey + 3 ELSE o_orderkey END AS VARCHAR), 10, '0') AS key FROM orders),
b AS (SELECT key, lag(key) OVER (PARTITION BY part ORDER BY o_orderkey) AS before FROM k) SELECT count(*) AS rows, count(*) FILTER (key <= before) AS violations FROM b""")
def scan_sorted_check(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a thousand orders in which every 97th key repeats the one before and every 89th jumps ahead."""
    n = F.col("o_orderkey")
    key = codecs.ordered_key(F.when(n % 97 == 5, n - 1).when(n % 89 == 7, n + 3).otherwise(n))
    return fold.order_violations(inputs.table(spark, d, "orders").select(F.floor(n / 1000).alias("part"), n.alias("place"), key.alias("key")))


@query(f"WITH {M} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violations FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)")
def store_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of the records in the files of a flushed store, as they stand there."""
    with _stored(spark, d) as store:
        store.flush()
        return fold.order_violations(fold.stored(store.snapshot().mutations()))


@query(f"WITH {M} SELECT key, seq, op, value FROM m")
def store_stream(spark: SparkSession, d: str) -> DataFrame:
    """The committed records of a store as a stream, each once, though they were rewritten and a run without a commit lies beside them."""
    with _stored(spark, d) as store:
        stray = spark.createDataFrame([(b"stray", 1, 1, b"never committed")], "key binary, seq bigint, op tinyint, value binary")
        stray.write.parquet(store.files.uri("data/999999999999-stray"))
        store.flush()
        out = scratch(spark, "streamed")
        source = stream.store_source(store)
        source.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch(spark, "offsets")).format("parquet").start(out).awaitTermination()
    return text(spark.read.schema(source.schema).parquet(out).withColumn("op", F.col("op").cast("int")))


# -- workload and verification ---------------------------------------------------


@query(f"""WITH {M}, acked AS (SELECT key, max(seq) AS a FROM m GROUP BY key), stored AS (SELECT key, CASE WHEN user_id % 11 = 3 THEN NULL WHEN user_id % 7 = 2 THEN min(seq) ELSE max(seq) END AS c FROM m WHERE user_id % 13 <> 5 GROUP BY key, user_id)
SELECT CASE WHEN s.key IS NULL THEN 'lost' WHEN c IS NULL THEN 'corrupt' WHEN c < a THEN 'lost' ELSE 'ok' END AS status, count(*) AS keys FROM acked LEFT JOIN stored s ON acked.key = s.key GROUP BY 1""")
def acked_vs_stored(spark: SparkSession, d: str) -> DataFrame:
    m = log(spark, d)
    stored = m.where("user_id % 13 <> 5").groupBy("key", "user_id").agg(F.max("seq").alias("hi"), F.min("seq").alias("lo"))
    stored = stored.select("key", F.when(F.col("user_id") % 11 == 3, F.lit(None)).when(F.col("user_id") % 7 == 2, F.col("lo")).otherwise(F.col("hi")).alias("counter"))
    return workload.verify(m.select("key", F.col("seq").alias("counter")), stored)


_FNV = "list_reduce(list_prepend(14695981039346656037::UBIGINT, [CAST((i >> (8 * k)) & 255 AS UBIGINT) FOR k IN range(8)]), lambda h, o: CAST(CAST(xor(h, o) AS HUGEINT) * 1099511628211 % 18446744073709551616 AS UBIGINT))"


@query(f"SELECT i, 'user' || CAST({_FNV} AS VARCHAR) AS key FROM (SELECT o_orderkey AS i FROM orders)")
def fnv_key(spark: SparkSession, d: str) -> DataFrame:
    return inputs.table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), codecs.ycsb_key(F.col("o_orderkey")).alias("key"))


_MOD = "18446744073709551616"


def _splitmix_sql(seed: int) -> str:
    a, b, c = codecs.SPLITMIX
    return f"""z0 AS (SELECT i, CAST(({seed}::HUGEINT + CAST(i AS HUGEINT) * {a}::HUGEINT) % {_MOD}::HUGEINT AS UBIGINT) AS z FROM n),
z1 AS (SELECT i, CAST(CAST((xor(z, z >> 30) >> 32) AS HUGEINT) * {b}::HUGEINT % 4294967296::HUGEINT * 4294967296::HUGEINT % {_MOD}::HUGEINT + CAST((xor(z, z >> 30) & 4294967295::UBIGINT) AS HUGEINT) * {b}::HUGEINT % {_MOD}::HUGEINT AS HUGEINT) % {_MOD}::HUGEINT AS h FROM z0),
z2 AS (SELECT i, CAST(h AS UBIGINT) AS z FROM z1),
z3 AS (SELECT i, CAST(CAST((xor(z, z >> 27) >> 32) AS HUGEINT) * {c}::HUGEINT % 4294967296::HUGEINT * 4294967296::HUGEINT % {_MOD}::HUGEINT + CAST((xor(z, z >> 27) & 4294967295::UBIGINT) AS HUGEINT) * {c}::HUGEINT % {_MOD}::HUGEINT AS HUGEINT) % {_MOD}::HUGEINT AS h FROM z2),
z4 AS (SELECT i, CAST(h AS UBIGINT) AS z FROM z3),
u AS (SELECT i, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992.0 AS u FROM z4)"""


@query(f"WITH n AS (SELECT o_orderkey + 1 AS i FROM orders), {_splitmix_sql(42)} " + "SELECT mix, op, count(*) AS ops FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS mix, CASE WHEN u < {r} THEN 'read' WHEN u < {r + p} THEN 'update' WHEN u < {r + p + i} THEN 'insert' ELSE 'rmw' END AS op FROM u" for k, (r, p, i, _) in workload.MIXES.items()) + ") GROUP BY 1, 2")
def ycsb_mix(spark: SparkSession, d: str) -> DataFrame:
    u = inputs.table(spark, d, "orders").select(workload.dice(F.col("o_orderkey") + 1, 42).alias("u"))
    ops = F.array(*[F.struct(F.lit(k).alias("mix"), workload.op_of(F.col("u"), k).alias("op")) for k in workload.MIXES])
    return u.select(F.explode(ops).alias("r")).groupBy("r.mix", "r.op").agg(F.count("*").alias("ops"))


@query("SELECT event_type, median(v) AS median, count(*) AS reps FROM (SELECT event_type, CAST(round(value * 1000) AS DOUBLE) AS v FROM events) GROUP BY 1")
def median_reps(spark: SparkSession, d: str) -> DataFrame:
    return workload.medians(inputs.latencies(spark, d).withColumn("v", F.col("v").cast("double")), ["event_type"], "v")


@query(f"WITH {V}, s AS (SELECT event_type, CASE WHEN event_id < 5000 THEN 0 ELSE 1 END AS half, CAST(sum(v) AS BIGINT) AS t FROM v GROUP BY 1, 2) SELECT a.event_type, a.t AS before, b.t AS after, round(b.t / a.t, 9) AS ratio FROM s a JOIN s b ON a.event_type = b.event_type AND a.half = 0 AND b.half = 1")
def paired_results(spark: SparkSession, d: str) -> DataFrame:
    v = inputs.latencies(spark, d)
    a, b = (v.where(c).groupBy("event_type").agg(F.sum("v").alias("t")) for c in ("event_id < 5000", "event_id >= 5000"))
    return workload.paired(a, b, ["event_type"], "t").withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {FOLD} SELECT key, value || '+' AS value FROM live WHERE key < 'user0000000050'")
def read_modify_write(spark: SparkSession, d: str) -> DataFrame:
    now = text(fold.live(log(spark, d)))
    return workload.read_modify_write(now, now.where(F.col("key") < "user0000000050").select("key"), F.concat("value", F.lit("+")))


@query("SELECT DISTINCT v, round(CASE WHEN v <= 0 THEN 0 ELSE floor(v / pow(10, floor(log10(v)) - 1)) * pow(10, floor(log10(v)) - 1) END, 6) AS rounded FROM (SELECT CAST(round(value * 1000) AS BIGINT) AS v FROM events)")
def headline_rounding(spark: SparkSession, d: str) -> DataFrame:
    return inputs.latencies(spark, d).select("v").distinct().select("v", F.round(exposition.floor_figures(F.col("v").cast("double"), 2), 6).alias("rounded"))


@query("SELECT o_orderkey AS n, greatest(1, CAST(ceil(length(bin(o_orderkey)) / 7.0) AS INTEGER)) AS bytes, (o_orderkey << 8) | 1 AS tag FROM orders")
def varint_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    return inputs.table(spark, d, "orders").select(n.alias("n"), codecs.varint_length_col(n).alias("bytes"), codecs.pack_tag(n, F.lit(1)).alias("tag"))


@query()
def crc32c(spark: SparkSession, d: str) -> DataFrame:
    crc = codecs.crc32c_col(F.col("text").cast("binary"))
    return inputs.table(spark, d, "documents").select("doc_id", crc.alias("crc")).withColumn("masked", codecs.mask_crc(F.col("crc")))


@query()
def murmur64(spark: SparkSession, d: str) -> DataFrame:
    """Hash and shard of each key."""
    h = codecs.murmur64_col(F.format_string("key%010d", "o_orderkey").cast("binary"))
    return inputs.table(spark, d, "orders").select("o_orderkey", h.alias("hash")).withColumn("shard", F.pmod("hash", F.lit(8)))


@query()
def bloom_fp(spark: SparkSession, d: str) -> DataFrame:
    return workload.bloom_sweep(spark, 20_000, 20_000)


@query()
def ycsb_operations(spark: SparkSession, d: str) -> DataFrame:
    return workload.operations(spark, "A", 10_000, 10_000).groupBy("op").agg(F.count("*").alias("ops"), F.countDistinct("item").alias("items"))


# -- the store and streams -------------------------------------------------------


def _stored(spark: SparkSession, d: str, **options: int) -> Store:
    """events committed in four batches."""
    store = Store.open(spark, scratch(spark, "store"), Options(inline_compaction=False, **options))
    quarter = (inputs.table(spark, d, "events").agg(F.max("event_id")).first()[0] or 0) // 4 + 1
    m = log(spark, d)
    for k in range(4):
        part = m.where((F.col("event_id") >= k * quarter) & (F.col("event_id") < (k + 1) * quarter))
        store.write(part.select((F.col("event_id") - k * quarter).alias("ord"), "op", "key", "value"))
    return store


@query(f"WITH {FOLD} SELECT key, value FROM live")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Committed, flushed, compacted, closed, recovered, read."""
    with _stored(spark, d, l1_bytes=20_000) as store:
        store.flush()
        store.compact_all()
        path = store.files.uri()
    return text(Store.open(spark, path, read_only=True).snapshot().live())


@query(f"WITH {M} SELECT key, value FROM (SELECT * FROM m WHERE seq <= 3000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def store_as_of(spark: SparkSession, d: str) -> DataFrame:
    with _stored(spark, d) as store:
        return text(store.as_of(3000))


@query(f"WITH {FOLD} SELECT key, value FROM live WHERE key >= 'user0000000020' AND key < 'user0000000030'")
def store_scan(spark: SparkSession, d: str) -> DataFrame:
    with _stored(spark, d) as store:
        store.flush()
        return text(store.scan(b"user0000000020", b"user0000000030"))


@query(f"WITH {M} SELECT count(*) AS entries, CAST(sum(op) AS BIGINT) AS puts, CAST(sum(1 - op) AS BIGINT) AS tombstones, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq FROM m")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the description of a store's files."""
    with _stored(spark, d) as store:
        return store.describe_runs().agg(F.sum("entries").alias("entries"), F.sum("puts").alias("puts"), F.sum("tombstones").alias("tombstones"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


@query("SELECT count(*) AS records, 1 + count(DISTINCT event_id // ((SELECT max(event_id) FROM events) // 4 + 1)) AS commits FROM events")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    with _stored(spark, d) as store:
        return store.describe_log().agg(F.sum("records").alias("records"), F.count("*").alias("commits"))


@query(f"WITH {FOLD} SELECT key, value FROM live")
def streaming_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold kept as state over a stream of files, read to its end."""
    e = spark.readStream.schema(inputs.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    m = e.select(inputs.user_key(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("op"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"))
    out = scratch(spark, "folded")
    run = stream.streaming_fold(m).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", scratch(spark, "offsets")).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    run.awaitTermination()
    return stream.hide_deleted(spark.read.parquet(out))


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, CAST(time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS TIMESTAMP) AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def windowed_rates(spark: SparkSession, d: str) -> DataFrame:
    return stream.streaming_rates(inputs.table(spark, d, "events"), "ts", "1 hour", "1 day", None, F.col("event_type"))
