from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.model import MUTATION
from tidelog.operators import fold
from tidelog.store import Options, Store
from tidelog.streaming import stream


def test_sink_commits_each_batch_once_and_source_reads_it(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(0, 1, b"k%d" % i, b"v"), (1, 0, b"k0", None)], "ord bigint, op tinyint, key binary, value binary").coalesce(1).write.mode("append").parquet(str(src))
    with Store.open(spark, str(tmp_path / "s"), Options(inline_compaction=False)) as db:
        batches = spark.readStream.schema("ord bigint, op tinyint, key binary, value binary").option("maxFilesPerTrigger", 1).parquet(str(src))
        for _ in range(2):  # a restart finds nothing new
            q = stream.store_sink(batches, db, "app", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
        assert db.state.txns["app"] == 2
        version = db.state.version
        db.write(spark.createDataFrame([(0, 1, b"q", b"v")], "ord bigint, op tinyint, key binary, value binary"), txn=("app", 2))
        assert db.state.version == version
        q = stream.streaming_fold(stream.store_source(db)).writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
        q.awaitTermination()
        got = stream.hide_deleted(spark.table("folded"))
        assert sorted(bytes(r["key"]) for r in got.collect()) == sorted(k for k, _ in db.snapshot().iterate())


def test_source_shows_committed_records_once(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), Options(inline_compaction=False)) as db:
        for k in range(23):  # past a commit that carries the whole state
            db.put(b"k%d" % (k % 7), b"%d" % k)
        spark.createDataFrame([(b"stray", 9, 1, b"x")], MUTATION).write.parquet(str(tmp_path / "s/data/000000099999-stray"))
        db.flush()
        q = stream.store_source(db).writeStream.format("memory").queryName("source").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted((bytes(r["key"]), r["seq"]) for r in spark.table("source").collect()) == sorted((b"k%d" % (k % 7), k + 1) for k in range(23))
        assert db.vacuum() == [] and db.vacuum(older_than_s=0)


def test_late_records_change_nothing_wrong(spark, tmp_path):
    rows = [(b"k", 3, 1, b"new"), (b"k", 1, 1, b"old"), (b"j", 2, 0, None), (b"j", 1, 1, b"x")]
    for r in rows:
        spark.createDataFrame([r], MUTATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    live = spark.readStream.schema(MUTATION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    q = stream.streaming_fold(live).writeStream.outputMode("complete").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [bytes(r["value"]) for r in stream.hide_deleted(spark.table("late")).collect()] == [b"new"]
    assert fold.live(spark.read.parquet(str(tmp_path / "m"))).count() == 1


def test_windows(spark):
    rows = spark.range(120).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("k"))
    assert stream.streaming_rates(rows, "ts", "1 hour", "1 day").count() == 2
    assert {r["n"] for r in stream.sessions(rows, "ts", "5 minutes", "1 day", "k").collect()} == {60}
