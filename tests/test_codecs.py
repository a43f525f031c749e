from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codecs as c
from tidelog.functions import exposition, histogram
from tidelog.model import Corruption
from tidelog.plans import workload
from tidelog.sources import connectors, formats


def test_crc32c_vectors():
    assert c.crc32c(b"123456789") == 0xE3069283
    assert c.crc32c(bytes(32)) == 0x8A9136AA and c.crc32c(b"\xff" * 32) == 0x62A8AB43
    assert c.crc32c(b"world", c.crc32c(b"hello ")) == c.crc32c(b"hello world")


def _murmur(data, seed=c.HASH_SEED):
    m, mask = c.MURMUR_MULTIPLIER, (1 << 64) - 1
    h = seed ^ (len(data) * m & mask)
    whole = len(data) // 8 * 8
    for i in range(0, whole, 8):
        k = int.from_bytes(data[i : i + 8], "little") * m & mask
        k = (k ^ k >> 47) * m & mask
        h = (h ^ k) * m & mask
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ h >> 47) * m & mask
    return h ^ h >> 47


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20))
def test_murmur_many(data):
    assert c.murmur64_many(data).tolist() == [_murmur(d) for d in data]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, (1 << 64) - 1))
def test_varint(n):
    b = c.varint(n)
    assert c.read_varint(b) == (n, len(b)) and c.varint_length(n) == len(b)
    with pytest.raises(ValueError):
        c.read_varint(b[:-1])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=6), st.binary(max_size=6))
def test_separators(a, b):
    if a < b:
        s = c.shortest_separator(a, b)
        assert a <= s < b and len(s) <= max(len(a), 1)
    assert c.short_successor(a) >= a


def test_internal_keys():
    assert c.parse_internal_key(c.pack_internal_key(b"k", 7, 1)) == (b"k", 7, 1)
    for bad in (b"short", b"k" + (7 << 8 | 2).to_bytes(8, "little")):
        with pytest.raises(ValueError):
            c.parse_internal_key(bad)
    assert c.escape(b"a\x00\xff'", but=b"'") == "a\\x00\\xff\\x27" and c.escape(b"abcdef", 3) == "abc..."
    assert c.json_escape(b'a"\n\x80') == 'a\\"\\n\\u0080'


def test_splitmix_is_random_access():
    want, state, mask = [], 42, (1 << 64) - 1
    for _ in range(5):
        state = (state + c.SPLITMIX[0]) & mask
        z = (state ^ state >> 30) * c.SPLITMIX[1] & mask
        z = (z ^ z >> 27) * c.SPLITMIX[2] & mask
        want.append(z ^ z >> 31)
    assert c.splitmix(42, np.arange(1, 6)).tolist() == want


def test_bloom():
    keys, absent = [b"key%010d" % (2 * i) for i in range(5000)], [b"key%010d" % (2 * i + 1) for i in range(5000)]
    bloom = c.bloom_build(keys)
    assert bloom[-1] == 6 and c.bloom_may_match(keys, bloom).all()
    assert c.bloom_may_match(absent, bloom).sum() < 100
    assert len(c.bloom_build([])) == 9 and not c.bloom_may_match([b"x"], c.bloom_build([])).any()
    assert not c.bloom_may_match([b"x"], b"").any() and c.bloom_may_match([b"x"], b"\0\x1f").all()


def test_columns(spark):
    def fnv(v):
        h = c.FNV_BASIS
        for _ in range(8):
            h = (h ^ (v & 255)) * c.FNV_PRIME % (1 << 64)
            v >>= 8
        return h

    ids = [0, 1, 255, 256, 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "i bigint")
    assert [int(r[0]) for r in df.select(c.fnv64_col(F.col("i"))).collect()] == [fnv(i) for i in ids]
    crc = spark.createDataFrame([(bytearray(b"123456789"),), (None,), (bytearray(b""),)], "b binary").select(c.crc32c_col(F.col("b")).alias("c"))
    assert [r["c"] for r in crc.collect()] == [0xE3069283, None, 0]
    turned = crc.where("c is not null").select("c", c.mask_crc(F.col("c")).alias("m")).withColumn("back", c.unmask_crc(F.col("m")))
    assert all(r["c"] == r["back"] and r["m"] == formats.mask(r["c"]) for r in turned.collect())
    fixed = spark.createDataFrame([(bytearray((1 << 63).to_bytes(8, "little")),)], "b binary").select(c.fixed_decode(F.col("b")))
    assert int(fixed.first()[0]) == 1 << 63


def test_histogram_error(spark):
    r = random.Random(1)
    values = [int(r.expovariate(1 / 50000)) for _ in range(3000)] + [0, 1, 127, 128, 255, 256, (1 << 43) + 5]
    h = histogram.histogram(spark.createDataFrame([(v,) for v in values], "v bigint"), "v")
    values.sort()
    for p, v in {r["p"]: r["value"] for r in histogram.percentiles(h, (0.0, 50.0, 90.0, 99.0)).collect()}.items():
        exact = values[max(1, -(-int(p * len(values)) // 100)) - 1]
        assert exact <= v <= exact * 1.0079 + 1
    cdf = histogram.cdf(h).orderBy("value").collect()
    assert cdf[-1]["fraction"] == 1.0 and cdf[-1]["value"] == (1 << 43) - 1
    steps = [r["cumulative"] for r in histogram.ladder(histogram.histogram(spark.createDataFrame([(v,) for v in values], "v bigint"), "v", 5)).collect()]
    assert steps == sorted(steps) and steps[-1] == len(values)


def test_exposition(spark):
    rows = spark.createDataFrame([("b", {"l": 'q"\\\n'}, "gauge", 1.5), ("a", {}, "counter", 3.0), ("a", {"x": "1", "k": "2"}, "counter", float("inf"))], "name string, labels map<string,string>, type string, value double")
    lines = [r["line"] for r in exposition.prometheus(rows).orderBy("ord").collect()]
    assert lines == ["# HELP a ", "# TYPE a counter", "a 3", 'a{k="2",x="1"} +Inf', "# HELP b ", "# TYPE b gauge", 'b{l="q\\"\\\\\\n"} 1.5']
    n = spark.createDataFrame([(10,), (2048,), (3 << 20,)], "n bigint")
    assert [r[0] for r in n.select(exposition.human_bytes(F.col("n"))).collect()] == ["10 B", "2.0 KiB", "3.00 MiB"]
    assert [round(r[0], 9) for r in spark.createDataFrame([(1987.0,), (0.0,), (0.0456,)], "v double").select(exposition.floor_figures(F.col("v"), 2)).collect()] == [1900.0, 0.0, 0.045]


def test_log_framing_and_damage():
    payloads = [b"", b"a" * 100, b"b" * 40_000, b"c" * (formats.BLOCK - 7 - 14), b"d" * 250_000, b"e"]
    data = formats.write_log(payloads)
    log = formats.read_log(data)
    assert [r[2] for r in log.records] == payloads and not log.damage and not log.torn
    torn = formats.read_log(data[:-3])
    assert torn.torn and not torn.damage and [r[2] for r in torn.records] == payloads[:-1]
    assert formats.recover_log(data[:-3], "tolerate_tail") == payloads[:-1]
    with pytest.raises(Corruption):
        formats.recover_log(data[:-3], "absolute")
    flipped = bytearray(data)
    flipped[50] ^= 1  # in the second record: later blocks are sound
    assert formats.read_log(bytes(flipped)).damage
    with pytest.raises(Corruption):
        formats.recover_log(bytes(flipped), "tolerate_tail")
    assert formats.recover_log(bytes(flipped), "point_in_time") == payloads[:1]
    tail = formats.write_log([b"x" * 10, b"y" * 10])
    assert formats.recover_log(tail + bytes(3000), "tolerate_tail") == [b"x" * 10, b"y" * 10]
    grown = formats.write_log([b"1"]) + formats.write_log([b"2"], at=8)
    assert [r[2] for r in formats.read_log(grown).records] == [b"1", b"2"]


def test_batches_and_edits():
    records = [(1, b"foo", b"bar"), (0, b"box", None), (1, b"baz", b"")]
    assert formats.decode_batch(formats.encode_batch(100, records)) == [(100, 1, b"foo", b"bar"), (101, 0, b"box", None), (102, 1, b"baz", b"")]
    good = formats.encode_batch(100, records)
    for bad in (good[:5], good[:-1], good + b"\x07", good[:8] + b"\x09\0\0\0" + good[12:]):
        with pytest.raises(Corruption):
            formats.decode_batch(bad)
    edit = {"comparator": "bytewise", "log_number": 1 << 50, "next_file": 3, "last_seq": 4, "pointers": [(1, b"p")], "deleted": [(2, 9)], "added": [(3, 7, 1 << 40, b"a", b"z")]}
    assert formats.decode_edit(formats.encode_edit(edit)) == edit
    with pytest.raises(Corruption):
        formats.decode_edit(b"\x63")
    assert [formats.parse_name(n) for n in ("000123.log", "7.sst", "MANIFEST-5", "CURRENT", "x.sst", "99999999999999999999.log")] == [("log", 123), ("sst", 7), ("manifest", 5), ("current", 0), None, None]


@pytest.mark.parametrize("interval", [1, 2, 16, 1024])
def test_blocks(interval):
    entries = [(b"key%05d" % i, b"v" * (i % 7)) for i in range(300)]
    assert formats.read_block(formats.build_block(entries, interval)) == entries


def test_sources(spark, tmp_path):
    connectors.register(spark)
    records = [(b"k%04d" % i, 10 + i, 1, b"v%d" % i) for i in range(2000)] + [(b"z", 5, 0, None)]
    data = formats.write_table(records, block_bytes=200)
    table = formats.Table(data)
    assert [r for b in range(table.blocks()) for r in table.records(b)] == records
    assert table.get(b"k0042") == (52, 1, b"v42") and table.get(b"nope") is None and table.get(b"z") == (5, 0, None)
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises(Corruption):
        list(formats.Table(bytes(broken)).records(0))
    (tmp_path / "000001.sst").write_bytes(data)
    (tmp_path / "000002.log").write_bytes(formats.write_log([formats.encode_batch(1, [(1, b"a", b"1"), (0, b"b", None)])]))
    (tmp_path / "MANIFEST-000003").write_bytes(formats.write_log([formats.encode_edit({"comparator": "c", "added": [(0, 1, 2, b"a", b"b")]})]))
    read = lambda kind: spark.read.format(f"tidelog_{kind}").load(str(tmp_path))
    assert read("table").count() == 2001
    assert [(bytes(r["key"]), r["seq"], r["op"]) for r in read("log").orderBy("seq").collect()] == [(b"a", 1, 1), (b"b", 2, 0)]
    assert [(r["comparator"], r["added"]) for r in read("manifest").collect()] == [("c", 1)]
    out = str(tmp_path / "out")
    read("table").repartitionByRange(3, "key").sortWithinPartitions("key").write.format("tidelog_table").mode("append").save(out)
    back = spark.read.format("tidelog_table").load(out)
    assert back.drop("file").exceptAll(read("table").drop("file")).count() == 0 and back.count() == 2001


def test_workload(spark):
    assert workload.load_phase(spark, 100).select("key").distinct().count() == 100
    ops = {r["op"]: r["n"] for r in workload.operations(spark, "B", 5000, 1000).groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert 0.93 < ops["read"] / 5000 < 0.97
    top = workload.operations(spark, "C", 5000, 1000).groupBy("item").count().orderBy(F.desc("count")).first()
    assert top["count"] > 400
    assert workload.parse_stress_value(workload.stress_value(5, 9, 120)) == (5, 9) and workload.parse_stress_value(workload.stress_value(5, 9, 120)[:-1] + "!") is None
    sweep = {r["bits"]: r for r in workload.bloom_sweep(spark, 2000, 2000, (4, 10)).collect()}
    assert sweep[10]["measured"] < 0.03 and abs(sweep[4]["measured"] - sweep[4]["theory"]) < 0.05
