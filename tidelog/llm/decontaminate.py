"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Alignment gives +1 for an equal word, -1 for another or a gap. The score is the
best local alignment over the item's length; ``LEAST`` is that of an item of
which a fifth of the words were replaced. What cannot score it is not aligned:

* An alignment of m item words that scores s has at most m - s faults, so a run
  of m / (m - s + 1) equal words is left. Every run of that many words, ``SEED``
  at most, is a seed of the item, and a document without one is no candidate.
* Its runs hold s - 1 or more pairs of neighbours, in 2 * m - s words of the
  document. A stretch around the seeds without so many is not aligned.

Neither bound looks at how often a seed occurs, so all that score ``LEAST`` or
more are found, in however many documents they are.

The benchmark may be of any size: it is worked through in blocks of about
``BLOCK`` words, and a block is all that is sent to executors. Documents are
never shuffled. Defined results: null and empty texts match nothing; items with
fewer than WORDS words are no evidence and match nothing; equal items are
reported each by its id; repeated rows are reported each; several passages of
an item in one text give its best; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import packed, quoted, together

SEED, WORDS, LEAST, BLOCK = 3, 5, 0.6, 2_000_000
#: Cells of one row of alignments that are worked on together.
CELLS = 500_000
#: Texts, and characters of them, that are read together; a longer text is read alone.
TEXTS, CHARS = 1000, 4_000_000
_WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, items: list[tuple[int, str]], least: float = LEAST):
        self.number: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in items:
            words = words_of(text)
            if len(words) >= WORDS:
                self.ids.append(item)
                self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64))
        self.need = [max(1, math.ceil(least * len(w) - 1e-9)) for w in self.words]
        width = [min(SEED, -(-len(w) // max(1, len(w) - s + 1))) for w, s in zip(self.words, self.need, strict=True)]
        self.widths = sorted(set(width))
        self.pairs = [np.unique(self.codes(w, 2)) for w in self.words]
        places = [(code, k, at) for k, w in enumerate(self.words) for at, code in enumerate(self.codes(w, width[k]).tolist())]
        places.sort()
        self.code = np.array([p[0] for p in places], np.uint64)
        self.item = np.array([p[1] for p in places], np.int64)
        self.at = np.array([p[2] for p in places], np.int64)
        self.seeds, self.first, self.times = np.unique(self.code, return_index=True, return_counts=True)

    @staticmethod
    def codes(numbers: np.ndarray, width: int) -> np.ndarray:
        """A 64-bit code of each window of ``width`` known words."""
        n = len(numbers) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, width, np.uint64)
        x = numbers.astype(np.uint64)
        for k in range(width):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
        return out

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's word numbers (0: in no item), and the place and seed of each window that is a seed."""
        words = words_of(text)
        known = np.fromiter(map(self.number.get, words, chain([0] * len(words))), np.int64, len(words))
        places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            code = self.codes(known, width)
            seed = np.minimum(np.searchsorted(self.seeds, code), len(self.seeds) - 1)
            place = np.flatnonzero(self.seeds[seed] == code)
            places.append(place)
            seeds.append(seed[place])
        return known, np.concatenate(places), np.concatenate(seeds)

    def candidates(self, known: np.ndarray, place: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, first word, end, seeds shared) of each stretch of a text to align."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, s in zip(place.tolist(), seed.tolist(), strict=True):
            for x in range(self.first[s], self.first[s] + self.times[s]):
                found[int(self.item[x])].append((p, int(self.at[x])))
        pairs = self.codes(known, 2) if found else None
        for item, hits in found.items():
            long, need = len(self.words[item]), self.need[item]
            spans = sorted((max(0, p - q - (long - need)), min(len(known), p + long - q + (long - need))) for p, q in hits)
            n = len({q for _, q in hits})
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a > merged[-1][1]:
                    merged.append([a, b])
                merged[-1][1] = max(merged[-1][1], b)
            for lo, hi in merged:
                total = np.cumsum(np.r_[0, np.isin(pairs[lo : hi - 1], self.pairs[item])])
                wide = min(2 * long - need - 1, len(total) - 1)
                if (total[wide:] - total[: len(total) - wide]).max() >= need - 1:
                    yield item, lo, hi, n


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best local score of each pair and the text place where it ends. A 0 in a text equals nothing."""
    tall, wide = max(map(len, items)), max(map(len, texts))
    a = np.full((len(items), tall), -1, np.int32)
    b = np.zeros((len(texts), wide), np.int32)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    ramp = np.arange(wide + 1, dtype=np.int32)
    row = np.zeros((len(items), wide + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    each = np.arange(len(items))
    for i in range(tall):
        now = np.zeros_like(row)
        now[:, 1:] = np.maximum(row[:, :-1] + np.where(b == a[:, i : i + 1], 1, -1), row[:, 1:] - 1)
        row = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + ramp, axis=1) - ramp, 0)
        at = row.argmax(1)
        top = row[each, at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best, end


def matches(items: Items, texts: list[str | None], least: float = LEAST) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item id, score, seeds shared, first word, end) of the pairs whose score is ``least`` or more."""
    work = []
    for k, text in enumerate(texts):
        known, place, seed = items.read(text)
        if len(place):
            work += [(k, item, lo, known[lo:hi], n) for item, lo, hi, n in items.candidates(known, place, seed)]
    work.sort(key=lambda w: len(w[3]))
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    while work:
        take = max(1, min(len(work), CELLS // max(1, len(work[-1][3]))))
        some, work = work[-take:], work[:-take]
        rows, parts = [items.words[w[1]] for w in some], [w[3] for w in some]
        top, end = align(rows, parts)
        good = [x for x in range(take) if top[x] >= least * len(rows[x]) - 1e-9]
        if not good:
            continue
        _, back = align([rows[x][::-1] for x in good], [parts[x][::-1] for x in good])
        for x, b in zip(good, back, strict=True):
            k, item, lo, part, n = some[x]
            got = (float(top[x]) / len(rows[x]), n, lo + len(part) - int(b), lo + int(end[x]))
            if (k, item) not in best or (got[0], -got[2]) > (best[k, item][0], -best[k, item][2]):
                best[k, item] = got
    return [(k, items.ids[item], *v) for (k, item), v in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, least: float = LEAST, block: int = BLOCK) -> Iterator[Items]:
    """The benchmark in blocks."""
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).distinct()
    size = rows.agg(F.sum(F.size(F.split("_text", r"\W+")))).first()[0] or 0
    n = -(-int(size) // block)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(n)) == k) if n > 1 else rows
        yield Items(sorted((r["_id"], r["_text"]) for r in part.collect()), least)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(id_col, item_col, score, n_seeds, start_word, end_word) of each document and item it has a copy of."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"_id {kind}, _item {item_kind}, score double, n_seeds int, start_word int, end_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, item_col, item_text_col, least, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in together(texts, TEXTS, CHARS):
                    if got := matches(sent.value, texts[a:b], least):
                        rows, item, score, n, start, end = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(rows)), pa.array(item), pa.array(score), pa.array(n, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["_id", "_item", "score", "n_seeds", "start_word", "end_word"])

        out = out.union(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema))
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that have a copy of no item, with their columns; ids play no part."""
    for items in blocks(benchmark, item_col, item_text_col, least, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        rows = docs.select(packed(docs).alias("_row"), F.col(quoted(text_col)).alias("_text"))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in together(texts, TEXTS, CHARS):
                    stay = np.ones(b - a, bool)
                    stay[[m[0] for m in matches(sent.value, texts[a:b], least)]] = False
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(stay))], ["_row"])

        docs = rows.mapInArrow(run, T.StructType([rows.schema["_row"]])).select("_row.*")
    return docs
