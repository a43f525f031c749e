from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.model import MUTATION, WriteBatch, empty
from tidelog.operators import fold, levels


def log(spark, rows):
    return spark.createDataFrame([(k, s, int(v is not None), v) for k, s, v in rows], MUTATION)


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_out_of_order_versions(spark):
    m = log(spark, [(b"k", 3, b"v3"), (b"k", 1, b"v1"), (b"k", 2, None)])
    assert pairs(fold.get(m, b"k")) == [(b"k", b"v3")]
    assert pairs(fold.get(m, b"k", 2)) == []
    assert pairs(fold.get(m, b"k", 1)) == [(b"k", b"v1")]


def test_binary_and_empty_keys(spark):
    m = log(spark, [(b"", 1, b""), (b"a\0b\xff", 2, b"\0\0\1\x80"), (b"a", 3, b"x"), (b"\xff\xff", 4, b"y")])
    assert pairs(fold.scan(m)) == [(b"", b""), (b"a", b"x"), (b"a\0b\xff", b"\0\0\1\x80"), (b"\xff\xff", b"y")]
    assert pairs(fold.prefix(m, b"\xff")) == [(b"\xff\xff", b"y")]
    assert pairs(fold.prefix(m, b"a")) == [(b"a", b"x"), (b"a\0b\xff", b"\0\0\1\x80")]
    assert len(pairs(fold.prefix(m, b""))) == 4


def test_successor():
    assert [fold.successor(p) for p in (b"", b"a", b"a\xff", b"\xff\xff", b"ab")] == [None, b"b", b"b", None, b"ac"]


def test_tombstones_in_scans(spark):
    m = log(spark, [(b"a", 1, b"1"), (b"c", 2, b"2"), (b"b", 3, b"3"), (b"c", 4, None), (b"d", 5, b"5")])
    assert [k for k, _ in pairs(fold.scan(m))] == [b"a", b"b", b"d"]
    assert [k for k, _ in pairs(fold.scan(m, b"c", limit=1))] == [b"d"]
    assert [k for k, _ in pairs(fold.scan(m, reverse=True, limit=2))] == [b"d", b"b"]
    assert [k for k, _ in pairs(fold.scan(m, seq=3))] == [b"a", b"b", b"c"]


def test_merge_ties_newest_run_first(spark):
    newest, oldest = log(spark, [(b"a", 9, b"n"), (b"b", 9, b"n")]), log(spark, [(b"b", 9, b"o"), (b"c", 9, b"o")])
    assert pairs(fold.merge_runs([newest, oldest])) == [(b"a", b"n"), (b"b", b"n"), (b"b", b"o"), (b"c", b"o")]
    assert pairs(fold.live(fold.union_runs([newest, oldest]))) and pairs(fold.fold(fold.union_runs([newest, oldest]), F.col("src")).orderBy("key"))[1] == (b"b", b"n")
    with pytest.raises(ValueError):
        fold.union_runs([])


def test_empty_log(spark):
    none = empty(spark, MUTATION)
    assert pairs(fold.scan(none)) == []
    asked = spark.createDataFrame([(bytearray(b"k"),), (bytearray(b"k"),)], "key binary")
    assert [(r["found"], r["value"]) for r in fold.multi_get(none, asked).collect()] == [(False, None)]


def test_fold_against_a_dict(spark):
    r = random.Random(12345)
    rows, model = [], {}
    for seq in range(1, 3000):
        key = b"key%04d" % r.randrange(200)
        value = None if r.random() < 0.25 else b"%d" % seq
        rows.append((key, seq, value))
        model[key] = value
    want = sorted((k, v) for k, v in model.items() if v is not None)
    r.shuffle(rows)
    m = log(spark, rows + rows[:100])  # replayed records change nothing
    assert pairs(fold.scan(m)) == want
    assert sorted(pairs(fold.fold_by_aggregate(m).where("op = 1").select("key", "value"))) == want


def test_order_violations(spark):
    rows = lambda keys: spark.createDataFrame([(k, i // 5, i) for i, k in enumerate(keys)], "key int, part int, place int")
    assert tuple(fold.order_violations(rows([1, 2, 3, 3, 5])).first()) == (5, 1)
    assert tuple(fold.order_violations(rows([5, 1, 4, 2, 3])).first()) == (5, 2)
    assert tuple(fold.order_violations(rows([1, 2, 3, 4, 5, 1, 2])).first()) == (7, 0)


def test_plan_prunes(spark, tmp_path):
    log(spark, [(b"k%03d" % i, i, b"v") for i in range(100)]).write.parquet(str(tmp_path / "m"))
    plan = fold.scan(spark.read.parquet(str(tmp_path / "m")), b"k010", b"k020", keys_only=True)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert "value" not in plan.split("ReadSchema")[1]


def test_batch(spark):
    b = WriteBatch().put(b"x", b"1").put(b"y", b"2").delete(b"x")
    other = WriteBatch().put(b"z", b"3")
    b.append(other)
    seen = []

    class Handler:
        def put(self, k, v):
            seen.append((k, v))

        def delete(self, k):
            seen.append((k, None))

    b.iterate(Handler())
    assert seen == [(b"x", b"1"), (b"y", b"2"), (b"x", None), (b"z", b"3")] and b.count() == 4
    assert b.approximate_size() == 12 + 5 + 5 + 3 + 5
    b.clear()
    assert b.count() == 0


def test_compaction_fates(spark):
    m = log(spark, [(b"a", 1, b"1"), (b"a", 2, None), (b"m", 3, None), (b"z", 4, b"4")])
    deep = spark.createDataFrame([(bytearray(b"l"), bytearray(b"n"))], "smallest binary, largest binary")
    got = {(bytes(r["key"]), r["seq"]): r["fate"] for r in levels.marked(m, deep).collect()}
    assert got == {(b"a", 1): "shadowed", (b"a", 2): "dropped", (b"m", 3): "tombstone", (b"z", 4): "put"}


def test_greedy_groups(spark):
    w = spark.createDataFrame([("a", i, n) for i, n in enumerate([100, 100, 100, 1000, 50, 50])], "w string, i int, n bigint")
    got = [r["group_no"] for r in levels.greedy_groups(w, "w", "i", "n", small=150, most=500).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3]
