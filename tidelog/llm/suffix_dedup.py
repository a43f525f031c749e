"""Removes every byte that lies in a repeated window of ``WINDOW`` bytes.

Suffixes are ordered only through WINDOW bytes, by most-significant-digit radix
passes; equal groups are exactly the repeated windows. The first, distributed
digit is a gram of ``GRAM`` bytes: of each window the gram with the least hash
is its anchor, so equal windows have their anchor at the same place, and only
the anchors (about one in 85 bytes) are shuffled. Anchors whose gram occurs
once fall out. The others bring the bytes around them, and the windows of a
gram are ordered by radix passes over eight-byte digits to both sides; a window
is a pair of a left and a right class, and repeated if another anchor of the
gram has the same pair.

Before that, anchors are dealt into cells: a cell holds those that agree in all
bytes which windows of a range of offsets share; the gram is that for all
offsets. Anchors of a cell with equal surroundings are counted, by a 128-bit
hash, and are repeated in all their windows; one of them goes on for the others.
If more than ``CELL`` go on, the offsets are halved: either half shares more
bytes, the next digit, by which it is dealt into smaller cells. At a single
offset the bytes are the window, so passes end.

Texts are known by a 64-bit hash and their length, so exact copies are worked
on once, and are removed whole. Defined results: null is the empty text; texts
shorter than WINDOW lose nothing; texts may be of any length; a repeated row is
a copy, whatever its id; an empty table gives no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, quoted, scratch, sieved

#: A cell that is worked on in one piece holds CELL contexts of 368 bytes at most, 1.5 MB.
WINDOW, GRAM, CELL = 200, 32, 4096
SIDE = WINDOW - GRAM
#: Bytes of text hashed together, and the place bits that go with it.
FLAT, PLACE = 1 << 21, np.uint64(22)
#: Anchors whose contexts a task works on together, or one group's if that has more.
TOGETHER = 8192


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes from each place, by doubling."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    width = 1
    for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        h = h[:-width] * np.uint64(factor) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of all windows; each text has at least WINDOW bytes and all together at most 2 * FLAT."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(data)
    key = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    low, width = key, 1
    while 2 * width <= SIDE + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SIDE + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    ends = np.cumsum(sizes)
    starts = ends - sizes
    valid = np.ones(len(low), bool)
    for e in ends[:-1]:
        valid[e - WINDOW + 1 : e] = False
    place = np.unique((low[valid] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64))
    text = np.searchsorted(ends, place, "right")
    return text, place - starts[text], h[place].view(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, the long ones in pieces that overlap by a window less one byte, in lists of about FLAT bytes: text, offset, bytes."""
    held: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), FLAT - WINDOW + 1):
            if len(part := t[at : at + FLAT]) < WINDOW:
                continue
            if size + len(part) > FLAT:
                yield held
                held, size = ([], [], []), 0
            for x, v in zip(held, (k, at, part), strict=True):
                x.append(v)
            size += len(part)
    if size:
        yield held


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at in range(0, batch.num_rows, 1000):
            raw = batch.column(2).slice(at, 1000).to_pylist()
            for which, offset, parts in _pieces(raw):
                text, place, h = anchors(parts)
                row = at + np.array(which)[text]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k[row]), pa.array(n[row]), pa.array((place + np.array(offset)[text]).astype(np.int32))], ["h", "k", "n", "pos"])


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors of each text; of neighbouring rows with one text only the first counts."""
    names = ["cell", "k", "n", "pos", "context"]
    last = None
    for batch in batches:
        k, n, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        for row in range(batch.num_rows):
            if last == (last := (k[row], n[row])):
                continue
            x = found[row].values
            pos = np.unique(x.field("pos").to_numpy(), return_index=True)
            order, pos = pos[1], pos[0].astype(np.int64)
            raw = np.zeros(n[row] + SIDE + WINDOW, np.uint8)
            raw[SIDE : SIDE + n[row]] = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8)
            for at in range(0, len(pos), TOGETHER):
                p = pos[at : at + TOGETHER]
                around = raw[p[:, None] + np.arange(SIDE + WINDOW)]
                context = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIDE + WINDOW), len(p), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
                some = order[at : at + TOGETHER]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.field("h").to_numpy()[some]), pa.array(np.full(len(p), k[row])), pa.array(np.full(len(p), n[row])), pa.array(p.astype(np.int32)), context], names)


def radix(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by (group, digits), and how many leading bytes each shares with the row before (-1: another group).

    Each pass takes the next eight-byte digit and deals only rows that still tie with a neighbour.
    """
    full = 8 * words.shape[1]
    order = np.argsort(group, kind="stable")
    shared = np.where(np.r_[True, group[order][1:] != group[order][:-1]], -1, full)
    for d in range(words.shape[1]):
        tie = shared == full
        on = np.flatnonzero(tie | np.r_[tie[1:], False])
        if not len(on):
            break
        segment, digit = np.cumsum(~tie)[on], words[order[on], d]
        by = np.lexsort((digit, segment))
        order[on], digit = order[on][by], digit[by]
        split = np.flatnonzero((segment[1:] == segment[:-1]) & (digit[1:] != digit[:-1]))
        differ = digit[split] ^ digit[split + 1]
        lead = np.zeros(len(split), np.int64)
        for b in range(1, 8):
            lead += differ < (np.uint64(1) << np.uint64(64 - 8 * b))
        shared[on[split + 1]] = 8 * d + lead
    return order, shared


class Windows:
    """The windows around some anchors, by their class at each offset from ``lo`` to ``hi``."""

    def __init__(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, around: np.ndarray, pos: np.ndarray, n: np.ndarray):
        self.size = len(group)
        self.lo, self.hi = np.maximum(lo, WINDOW - (n - pos)), np.minimum(hi, pos)
        digits = lambda x: np.ascontiguousarray(x).view(">u8").astype(np.uint64)
        self.left = radix(group, digits(around[:, SIDE - 1 :: -1]))
        self.right = radix(group, digits(around[:, SIDE:]))

    def classes(self, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a window from ``offset`` bytes before the anchor, and the class of each window."""
        rows = np.flatnonzero((self.lo <= offset) & (offset <= self.hi))
        out = np.zeros(self.size, np.int64)
        for (order, shared), depth in ((self.left, offset), (self.right, WINDOW - offset)):
            own = np.empty(self.size, np.int64)
            own[order] = np.cumsum(shared < depth)
            out = out * (self.size + 1) + own
        return rows, out[rows]


def _match_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows; rows come sorted by cell, and whole cells are worked on."""

    def done(t: pa.Table) -> pa.RecordBatch:
        names = ("cell", "k", "n", "pos", "lo", "hi")
        at = np.stack([t.column(c).to_numpy() for c in names[:4]])  # a text that is there twice may bring an anchor twice
        t = t.filter(pa.array(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0)]))
        cell, k, n, pos, lo, hi = (t.column(c).to_numpy() for c in names)
        around = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint8).reshape(-1, SIDE + WINDOW)
        pos = pos.astype(np.int64)
        windows = Windows(cell, lo, hi, around, pos, n)
        first, last = np.full(len(cell), SIDE + 1), np.full(len(cell), -1)
        for offset in range(int(lo.min()), int(hi.max()) + 1):
            rows, cls = windows.classes(offset)
            if not len(rows):
                continue
            by = np.argsort(cls, kind="stable")
            same = cls[by][1:] == cls[by][:-1]
            twice = rows[by[np.r_[False, same] | np.r_[same, False]]]
            first[twice] = np.minimum(first[twice], offset)
            last[twice] = np.maximum(last[twice], offset)
        on = np.flatnonzero(last >= 0)
        ends = (pos[on] - last[on], pos[on] - first[on] + WINDOW)
        return pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(n[on]), *(pa.array(x.astype(np.int32)) for x in ends)], ["k", "n", "start", "end"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < TOGETHER:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cell = t.column("cell").to_numpy()
        new = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        end = int(new[-1]) if len(new) else 0
        if end:
            yield done(t.slice(0, end))
        held = t.slice(end).to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held).combine_chunks())


def _written(df: DataFrame, kind: str) -> DataFrame:
    at = scratch(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)


def repeats(rows: DataFrame) -> DataFrame:
    """(k, n, start, end): spans of the windows repeated within a cell of (cell, lo, hi, k, n, pos, context); a row may be there twice."""
    out, keys = None, ["cell", "c1", "c2"]
    while True:
        rows = rows.withColumn("a", F.greatest("lo", WINDOW - (F.col("n") - F.col("pos")))).withColumn("b", F.least("hi", "pos")).where("a <= b")
        seen = F.expr(f"substring(context, {SIDE} - b + 1, {WINDOW} + b - a)")
        rows = rows.withColumn("c1", F.xxhash64("a", "b", seen)).withColumn("c2", F.xxhash64("b", "a", seen)).withColumn("mine", F.xxhash64("k", "n", "pos"))
        rows = _written(rows, "cells")
        # Aggregates are written before they are joined: the join then shuffles both sides for itself, and Spark can split a hot key.
        alike = cut(rows.groupBy(*keys).agg(F.min("mine").alias("lead"), F.max("mine").alias("other")))
        again = rows.select(*keys, "k", "n", "pos", "a", "b").join(alike.where("lead <> other").select(*keys), keys)
        again = again.select("k", "n", (F.col("pos") - F.col("b")).cast("int").alias("start"), (F.col("pos") - F.col("a") + WINDOW).cast("int").alias("end"))
        kinds = cut(alike.groupBy("cell").agg(F.count("*").alias("kinds")).where("kinds > 1").select("cell", (F.col("kinds") > CELL).alias("hot")))
        heads = cut(alike.join(kinds, "cell").select(*keys, "lead", "hot"))
        leads = sieved(rows, "mine", heads.select(F.col("lead").alias("mine"))).join(heads, keys).where("mine = lead")
        leads = leads.select("cell", "lo", "hi", "k", "n", "pos", "a", "b", "context", "hot")
        more = kinds.where("hot").limit(1).count() > 0
        leads = _written(leads, "leads") if more else leads
        few = leads.where("not hot").repartition("cell").sortWithinPartitions("cell", "k", "n", "pos").mapInArrow(_match_batches, "k bigint, n int, start int, end int")
        out = again.union(few) if out is None else out.union(again).union(few)
        if not more:
            return out
        halves = F.expr("array(struct(lo as lo, int((lo + hi) div 2) as hi), struct(int(1 + (lo + hi) div 2) as lo, hi as hi))")
        rows = leads.where("hot").withColumn("half", F.explode(halves)).where("greatest(a, half.lo) <= least(b, half.hi)")
        digit = F.expr(f"substring(context, {SIDE} - half.lo + 1, {WINDOW} - half.hi + half.lo)")
        rows = rows.select(F.xxhash64("cell", "half.lo", digit).alias("cell"), F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"), "k", "n", "pos", "context")


def spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts as (k, n, _raw and all columns), and the spans to remove as (k, n, spans array<struct<start, end>>)."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.withColumn("_raw", raw).withColumn("k", F.xxhash64("_raw")).withColumn("n", F.octet_length("_raw"))
    long = texts.where(F.col("n") >= WINDOW).select("k", "n", "_raw")
    found = _written(long.mapInArrow(_anchor_batches, "h bigint, k bigint, n int, pos int"), "anchors")
    place = F.xxhash64("k", "n", "pos")
    again = cut(found.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h"))
    of_text = cut(found.join(again, "h").groupBy("k", "n").agg(F.collect_set(F.struct("h", "pos")).alias("found")))
    contexts = long.join(of_text, ["k", "n"]).select("k", "n", "_raw", "found").mapInArrow(_context_batches, "cell bigint, k bigint, n int, pos int, context binary")
    out = repeats(contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(SIDE)))
    copies = texts.where(F.col("n") >= WINDOW).groupBy("k", "n").agg(F.count("*").alias("times")).where("times > 1")
    out = out.union(copies.select("k", "n", F.lit(0).alias("start"), F.col("n").alias("end")))
    return texts, cut(out.groupBy("k", "n").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and adjoining spans as maximal runs."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    first = np.r_[True, start[1:] > reach[:-1]]
    return start[first], reach[np.r_[first[1:], True]]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, runs, rest = [], [], []
        for raw, found in zip(batch.column(1), batch.column(2), strict=True):
            raw = raw.as_py()
            if found.is_valid:
                x = found.values
                a, b = merged(x.field("start").to_numpy(), x.field("end").to_numpy())
                rest.append(b"".join(raw[p:q] for p, q in zip([0, *b], [*a, len(raw)], strict=True)))
                runs.append(len(a))
            else:
                rest.append(raw)
                runs.append(0)
            gone.append(len(raw) - len(rest[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(rest, pa.binary())], ["_id", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary) for every row; a cut may fall inside a character."""
    texts, found = spans(docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text")), "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.join(found, ["k", "n"], "left").select("_id", "_raw", "spans").mapInArrow(_cut_batches, f"_id {kind}, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.col("_id").alias(id_col), (F.octet_length("kept") + F.col("n_removed")).cast("bigint").alias("n_bytes"), "n_removed", "n_spans", "kept")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
