"""SimHash near-duplicates: 64-bit fingerprints joined with themselves in a binary trie.

``fingerprints`` hashes word shingles with XXH64 in Arrow batches. ``links``
finds all fingerprints at most ``budget`` bits apart: the bits are read in
budget + 1 rotations, in one of which the first block agrees; below each such
block a binary trie is walked against itself, both nodes of a pair together,
adding up differing bits and pruning a pair once it has more than the budget.
A block with more fingerprints than ``CELL`` is dealt out first: its node pairs
eight bits further down become cells of their own, level by level, until they
are small, so no task holds an unbounded group. Every cell reports a spanning
forest of its links, not the pairs, and ``components`` contracts those.
``keep_one`` looks for copies by the Jaccard similarity of shingles. Its
candidates are texts whose fingerprints are few bits apart: at 0.8 some 10 of 64
bits differ, so it takes a larger budget, and as no block of one fingerprint
then has to agree, blocks of several fingerprints (``plan``).

Defined results: null and empty texts have fingerprint zero and are linked like
any other; equal texts and repeated rows share a fingerprint; a null id gets a
fingerprint and the smallest non-null id of its component; an empty table gives
no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import connected_components, cut, packed, quoted, sieved, tidy

BITS, SEED, SHINGLE, BUDGET = 64, 42, 3, 2
#: Fingerprints that one trie walk holds; a larger cell is split by its next STEP bits.
CELL, STEP = 1024, 8
#: ``keep_one``: share of the pairs at the least similarity that agree in no block; texts in a block's cell, on average, and least bits of a block.
MISS, OCCUPANCY, LEAST_BITS = 1e-4, 64, 8
#: ``keep_one``: texts, and bytes of them, of a component that one task settles; and of how many times that the texts are settled so one after the other, larger components in rounds.
WHOLE, WHOLE_BYTES, STRETCHES = 4096, 1 << 25, 16
#: ``keep_one``: links between candidates that one task makes components of, 16 MB.
LINKS = 1 << 20
#: ``keep_one``: texts under a key that are all paired, else how many of them are with all at first, and at most; heads of a block, and texts that one copy of it serves.
CROWD, PIVOTS, MOST_PIVOTS, BLOCK, HEAD = 64, 8, 512, 16, 128
_FLUSH = 200_000


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each window of ``width`` words of UTF-8 text, A-Z lower-cased, joined by single spaces."""
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One uint64 per run of ``hashes``: a bit is 1 if set in over half of the run."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint_batches(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        held: list[int] = []
        rows: list[int] = []
        starts: list[int] = []

        def flush() -> None:
            if held:
                begin = np.array(starts, np.int64)
                out[rows] = majority(np.array(held, np.uint64), begin, np.diff(np.append(begin, len(held))))
                held.clear(), rows.clear(), starts.clear()

        for k, text in enumerate(batch.column(1)):
            if found := shingle_hashes(text.as_py() or b"", width):
                if len(found) > _FLUSH:
                    out[k] = _long(found)
                    continue
                rows.append(k)
                starts.append(len(held))
                held += found
                if len(held) >= _FLUSH:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["_id", "_fp"])


def _long(found: list[int]) -> np.uint64:
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(found), _FLUSH):
        h = np.array(found[at : at + _FLUSH], np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(found)).view(">u8")[0].astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(_id, _fp bigint) for every row; one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(lambda b: _fingerprint_batches(width, b), f"_id {kind}, _fp bigint")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(start, width) of budget + 1 blocks of the 64 bits, from the high end."""
    edges = [round(k * BITS / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def walk(keys: np.ndarray, group: np.ndarray, side: np.ndarray, err: np.ndarray, depth: np.ndarray, budget: int, leaf: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked pairs. Rows are sorted by (group, side, key); bits above ``depth`` are settled with ``err``.

    Side 0: the cell is a node paired with itself; 1 and 2: its two nodes differ.
    The frontier holds the node pairs of all cells at one level of the trie. Node
    pairs with at most ``leaf`` pairs of keys leave it, and their keys' bits are counted.
    """
    none = np.zeros(0, np.int64)
    if not len(keys):
        return none, none
    cell_at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1])])
    cell_end = np.r_[cell_at[1:], len(keys)]
    first_right = np.array([a + np.searchsorted(side[a:b], 2) for a, b in zip(cell_at, cell_end, strict=True)])
    own = side[cell_at] == 0
    a0, a1 = cell_at, np.where(own, cell_end, first_right)
    b0, b1 = np.where(own, cell_at, first_right), cell_end
    e, d = err[cell_at].astype(np.int64), depth[cell_at].astype(np.int64)
    live = np.where(own, cell_end - cell_at > 1, (a1 > a0) & (b1 > b0))
    front = np.stack([a0, a1, b0, b1, e, own.astype(np.int64), d])[:, live]
    left, right = [], []
    for level in range(BITS):
        if not front.shape[1]:
            break
        waits = front[6] > level
        held, now = front[:, waits], front[:, ~waits]
        if now.shape[1]:
            bit = (keys >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones = np.r_[0, np.cumsum(bit.astype(np.int64))]
            a0, a1, b0, b1, e, own, d = now
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            cross = own == 0
            kids = [
                np.stack([a0, am, b0, bm, e, own, d]), np.stack([am, a1, bm, b1, e, own, d]),
                np.stack([a0, am, bm, b1, e + 1, np.zeros_like(own), d]), np.stack([am, a1, b0, bm, e + 1, np.zeros_like(own), d])[:, cross],
            ]
            now = np.concatenate(kids, axis=1)
            alive = (now[4] <= budget) & np.where(now[5] == 1, now[1] - now[0] > 1, (now[1] > now[0]) & (now[3] > now[2]))
            now = now[:, alive]
        front = np.concatenate([held, now], axis=1)
        if leaf:
            few = (front[6] <= level + 1) & ((front[1] - front[0]) * (front[3] - front[2]) <= leaf)
            for i, j in _leaves(front[:, few]):
                near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                left.append(i[near])
                right.append(j[near])
            front = front[:, ~few]
    for x in range(front.shape[1]):
        a0, a1, b0, b1, _, own, _ = front[:, x]
        if not own:
            left.append(np.repeat(np.arange(a0, a1), b1 - b0))
            right.append(np.tile(np.arange(b0, b1), a1 - a0))
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _leaves(front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of keys of the node pairs, each once."""
    for at in range(0, front.shape[1], 20_000):
        a0, a1, b0, b1, _, own, _ = front[:, at : at + 20_000]
        wide, many = b1 - b0, (a1 - a0) * (b1 - b0)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        i, j = np.repeat(a0, many) + nth // np.repeat(wide, many), np.repeat(b0, many) + nth % np.repeat(wide, many)
        once = (np.repeat(own, many) == 0) | (i < j)
        yield i[once], j[once]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links."""
    low = np.arange(n)
    while len(left):
        m = np.minimum(low[left], low[right])
        np.minimum.at(low, left, m)
        np.minimum.at(low, right, m)
        low = low[low]
        if (low[left] == low[right]).all():
            break
    while not (low == low[low]).all():
        low = low[low]
    return low


def _walk_cells(budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; whole cells are walked, several at a time."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> pa.RecordBatch:
        cell, side, err, depth, key, fp = (t.column(k).to_numpy() for k in range(6))
        key = key.view(np.uint64)
        order = np.lexsort((key, side, cell))
        cell, side, err, depth, key, fp = (x[order] for x in (cell, side, err, depth, key, fp))
        left, right = walk(key, cell, side, err, depth, budget)
        low = forest(len(key), left, right)
        on = np.flatnonzero(low != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(fp[on]), pa.array(fp[low[on]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 4 * CELL:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cells = t.column(0).to_numpy()
        end = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
        for part in _pieces(t.slice(0, end)):
            yield done(part)
        held = t.slice(end).to_batches()
    if held:
        for part in _pieces(pa.Table.from_batches(held).combine_chunks()):
            yield done(part)


def _pieces(t: pa.Table) -> Iterator[pa.Table]:
    """Runs of whole cells of about 4 * CELL rows."""
    if not t.num_rows:
        return
    cells = t.column(0).to_numpy()
    ends = np.r_[np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(cells)]
    at = 0
    while at < len(cells):
        to = ends[max(np.searchsorted(ends, at + 4 * CELL, "right") - 1, np.searchsorted(ends, at, "right"))]
        yield t.slice(at, to - at)
        at = to


def _rotated(start: int):
    fp = F.col("fp")
    return fp if start == 0 else F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, BITS - start))


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): a spanning forest of each cell's links between the distinct values of ``fp`` (bigint)."""
    masks = [0, *(sum(1 << b for b in c) for n in range(1, budget + 1) for c in combinations(range(STEP), n))]
    turned = [distinct.select(F.xxhash64(F.lit(r), F.shiftrightunsigned(_rotated(s), BITS - w)).alias("cell"), F.lit(0).alias("side"), F.lit(0).alias("err"), F.lit(w).alias("depth"), _rotated(s).alias("key"), "fp") for r, (s, w) in enumerate(_blocks(budget))]
    rows = turned[0]
    for t in turned[1:]:
        rows = rows.union(t)
    rows, out = cut(rows), None
    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.max("depth").alias("at"))
        # A cell with one node of a pair has no links; one whose bits are all read has at most a link.
        sizes = cut(sizes.where("n > 1 and (hi = 0 or lo < hi)").select("cell", ((F.col("n") > CELL) & (F.col("at") + STEP <= BITS)).alias("hot")))
        rows = cut(rows.join(sizes, "cell"))
        cold = rows.where("not hot").drop("hot")
        found = cold.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _walk_cells(budget, b), "u bigint, v bigint")
        out = found if out is None else out.union(found)
        if rows.where("hot").limit(1).count() == 0:
            return out.distinct()
        now = F.shiftrightunsigned(F.expr("shiftleft(key, depth)"), BITS - STEP)
        step = rows.where("hot").withColumn("a", now).withColumn("m", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])))
        step = step.withColumn("b", F.col("a").bitwiseXOR(F.col("m"))).withColumn("err", (F.col("err") + F.bit_count("m")).cast("int")).where(F.col("err") <= budget)
        same = (F.col("side") == 0) & (F.col("m") == 0)
        side = F.when(same, 0).when(F.col("side") != 0, F.col("side")).when(F.col("a") < F.col("b"), 1).otherwise(2)
        step = step.withColumn("to", side)
        one, two = (F.when((F.col("side") != 2) & (F.col("to") != 2) | (F.col("side") == 0) & same, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
        rows = step.select(F.xxhash64("cell", one, two).alias("cell"), F.col("to").cast("int").alias("side"), "err", (F.col("depth") + STEP).cast("int").alias("depth"), "key", "fp")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """(id_col, fingerprint hex, component_id) for every row."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("first"))
    nodes = cut(nodes)
    roots = connected_components(links(nodes.select("fp"), budget))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    out = prints.join(named, prints["_fp"] == named["fp"])
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def small(df: DataFrame) -> DataFrame:
    """For the joins of rounds: merged, as each broadcast takes the driver some MB until its garbage is collected, and rounds may be many."""
    return df.hint("merge")


def jaccard(a: bytes, b: bytes, width: int) -> float:
    """Of the two texts' sets of shingles; two texts without words are equal."""
    x, y = set(shingle_hashes(a, width)), set(shingle_hashes(b, width))
    return len(x & y) / len(x | y) if x or y else 1.0


def plan(texts: int, least: float) -> tuple[int, int, int, int, int, int]:
    """For texts of a similarity of ``least`` or more: bits of a block, blocks of a text, its fingerprints, and the bits that may differ in the one with the block, in that and the next, and in all.

    A bit differs in the share of pairs that the angle of their shingles takes of a half turn. All but MISS of the
    pairs at ``least`` agree in some block, and the budgets are four deviations above the mean.
    """
    differ = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    width = min(32, max(LEAST_BITS, math.ceil(math.log2(max(texts, 1) / OCCUPANCY))))
    blocks = 1 if not differ else math.ceil(math.log(MISS) / math.log1p(-((1 - differ) ** width)))
    over = lambda bits: math.ceil(bits * differ + 4 * math.sqrt(bits * differ * (1 - differ)))
    prints = max(2, math.ceil(blocks / (BITS // width)))
    return width, blocks, prints, over(BITS - width), over(2 * BITS - width), over(prints * BITS)


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Hashes of the hashes, for the fingerprint of each turn."""
    x = hashes + np.uint64((turn * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _several(found: list[int], prints: int) -> np.ndarray:
    """SimHash fingerprints of a text's set of shingles. A tie of votes goes as the least hash, else short texts would crowd at zero."""
    some = np.unique(np.array(found, np.uint64))
    out = np.zeros(prints, np.uint64)
    if len(some):
        least = some[:1]
        for turn in range(prints):
            votes = np.zeros(BITS, np.int64)
            for at in range(0, len(some), _FLUSH):
                votes += np.unpackbits(_mixed(some[at : at + _FLUSH], turn).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
            tie = np.unpackbits(_mixed(least, turn).astype(">u8").view(np.uint8))
            out[turn] = np.packbits(2 * votes + tie > len(some)).view(">u8")[0]
    return out


def _print_batches(width: int, prints: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_several(shingle_hashes(text.as_py() or b"", width), prints) for text in batch.column(1)]
        starts = pa.array(np.arange(0, len(made) * prints + 1, prints, dtype=np.int32))
        flat = np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(flat))], ["node", "prints"])


def _near_in_cells(one: int, two: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the texts of a cell that have others within both budgets, under a key for each component of these."""

    def done(t: pa.Table) -> pa.RecordBatch:
        cell, node, key, more, depth = (t.column(k).to_numpy() for k in range(5))
        key = key.view(np.uint64)
        order = np.lexsort((key, cell))
        cell, node, key, more, depth = (x[order] for x in (cell, node, key, more, depth))
        none = np.zeros(len(key), np.int64)
        left, right = walk(key, cell, none, none, depth, one, leaf=64)
        near = np.bitwise_count(key[left] ^ key[right]).astype(int) + np.bitwise_count((more[left] ^ more[right]).view(np.uint64)) <= two
        low = forest(len(key), left[near], right[near])
        on = np.flatnonzero(np.bincount(low, minlength=len(low))[low] > 1)
        names = cell.view(np.uint64)[on] ^ _mixed(key[low[on]], 1)
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(node[on])], ["key", "node"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 4 * CELL:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cells = t.column(0).to_numpy()
        end = int(np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])[-1])  # the last cell may go on in the next batch
        for part in _pieces(t.slice(0, end)):
            yield done(part)
        held = t.slice(end).to_batches()
    if held:
        for part in _pieces(pa.Table.from_batches(held).combine_chunks()):
            yield done(part)


def near_keys(docs: DataFrame, texts: int, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, node): texts of ``docs`` (node, text) whose fingerprints are few bits apart share a key. And (node, prints): all fingerprints.

    Cells are the blocks of the rotated fingerprints, walked as tries as in ``links``, with the budgets of ``plan``.
    A cell with more than CELL texts is one key, whatever the bits below.
    """
    bits, blocks, prints, one, two, _ = plan(texts, least)
    made = docs.mapInArrow(lambda b: _print_batches(width, prints, b), "node bigint, prints array<bigint>")
    made = cut(made.groupBy("node").agg(F.first("prints").alias("prints")))
    per = BITS // bits
    place = made.select("node", "prints", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    place = place.withColumn("of", F.expr(f"cast(block div {per} as int)")).withColumn("by", F.expr(f"cast(block % {per} * {bits} as int)"))
    place = place.select("node", "block", "by", F.expr("prints[of]").alias("fp"), F.expr(f"prints[(of + 1) % {prints}]").alias("more"))
    rows = place.select("node", "block", F.expr(f"shiftleft(fp, by) | shiftrightunsigned(fp, ({BITS} - by) % {BITS})").alias("key"), "more")
    rows = rows.select(F.xxhash64("block", F.shiftrightunsigned("key", BITS - bits)).alias("cell"), "node", "key", "more", F.lit(bits).alias("depth"))
    hot = cut(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("cell"))
    cold = rows.join(hot, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell")
    found = cold.mapInArrow(lambda b: _near_in_cells(one, two, b), "key bigint, node bigint")
    return found.union(rows.join(hot, "cell", "left_semi").select(F.col("cell").alias("key"), "node")), made


#: Columns of ``_settle``.
_STRETCH = "root bigint, stretch int, last int, place int, node bigint, prints array<bigint>, text binary, as int"
_GONE, _HEAD, _WAITS = range(3)


def _settle(width: int, least: float, budget: int, now: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component, stretch and place: first the heads of the stretch before ``now``, then a stretch's texts.

    A text that is a copy of a head goes. Of the stretch ``now`` the others become heads, against which its later
    texts are held too; those of later stretches wait. Heads are returned only if a later stretch needs them.
    """
    at, heads, prints = None, [], np.zeros((0, 0), np.uint64)
    for batch in batches:
        rows, kinds = [], []
        for nth, (root, stretch, last, _, _, own, text, kind) in enumerate(zip(*batch.columns, strict=True)):
            mine, own = np.unique(np.array(shingle_hashes(text.as_py(), width), np.uint64)), own.values.to_numpy().view(np.uint64)
            if (here := (root.as_py(), stretch.as_py())) != at:
                at, heads, prints = here, [], np.zeros((16, len(own)), np.uint64)
            given = kind.as_py() == _HEAD
            for k in () if given else np.flatnonzero(np.bitwise_count(prints[: len(heads)] ^ own).sum(1, dtype=np.int64) <= budget):
                both = len(np.intersect1d(heads[k], mine, assume_unique=True))
                if both >= least * (len(heads[k]) + len(mine) - both):
                    rows.append(nth)
                    kinds.append(_GONE)
                    break
            else:
                if given or at[1] == now:
                    if len(heads) == len(prints):
                        prints = np.concatenate([prints, np.zeros_like(prints)])
                    prints[len(heads)] = own
                    heads.append(mine)
                if not given and now < last.as_py():
                    rows.append(nth)
                    kinds.append(_HEAD if at[1] == now else _WAITS)
        some, kind = batch.take(pa.array(rows, pa.int64())), pa.array(kinds, pa.int32())
        body = pc.if_else(pc.equal(kind, _GONE), pa.scalar(b""), some.column(6))
        yield pa.RecordBatch.from_arrays([*some.columns[:6], body, kind], batch.schema.names)


def _settled(rows: DataFrame, stretches: int, width: int, least: float, budget: int) -> DataFrame:
    """(node) of what goes; ``rows`` are those of ``_settle``. Each stretch of a component is one task's, after those before it."""
    gone = None
    for now in range(stretches):
        place = ["root", "stretch"]
        dealt = rows.repartition(*place).sortWithinPartitions(*place, F.col("as") != _HEAD, "place")
        made = cut(dealt.mapInArrow(lambda b, now=now: _settle(width, least, budget, now, b), _STRETCH))
        went = made.where(F.col("as") == _GONE).select("node")
        gone = went if gone is None else gone.union(went)
        later = made.where(F.col("as") == _HEAD).withColumn("stretch", F.explode(F.sequence(F.lit(now + 1), F.col("last"))))
        rows = made.where(F.col("as") == _WAITS).union(later)
        tidy(rows.sparkSession)
    return cut(gone)


def _copies(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts have a Jaccard similarity of ``least`` or more.

    Heads that texts have in common form blocks of about BLOCK; a text is sent once to each block that it has
    pairs in, and a block's heads once for each HEAD of its texts.
    """

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, {}
        for batch in batches:
            left, right = [], []
            for lead, chunk, part, node, of, text in zip(*batch.columns, strict=True):
                if (here := (lead.as_py(), chunk.as_py(), part.as_py())) != at:
                    at, heads = here, {}
                mine = np.unique(np.array(shingle_hashes(text.as_py(), width), np.uint64))
                if not of.is_valid:
                    heads[node.as_py()] = mine
                    continue
                for a in of.as_py():
                    both = len(np.intersect1d(heads[a], mine, assume_unique=True))
                    if both >= least * (len(heads[a]) + len(mine) - both):
                        left.append(a)
                        right.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    firsts = pairs.groupBy("b").agg(F.min("a").alias("lead"))
    led = cut(pairs.join(small(firsts), "b").groupBy("a").agg(F.min("lead").alias("lead")))
    sizes = led.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    blocks = cut(led.join(small(sizes), "lead").select("a", "lead", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk")))
    mine = cut(pairs.join(small(blocks), "a").groupBy("lead", "chunk", "b").agg(F.collect_list("a").alias("of")))
    parts = cut(mine.groupBy("lead", "chunk").agg(F.ceil(F.count("*") / HEAD).alias("parts")))
    dealt = mine.join(small(parts), ["lead", "chunk"]).select("lead", "chunk", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"), "of")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    heads = blocks.join(small(parts), ["lead", "chunk"]).select("lead", "chunk", every, F.col("a").alias("node"), F.lit(None).cast("array<bigint>").alias("of"))
    rows = dealt.union(heads).join(small(texts), "node").select("lead", "chunk", "part", "node", "of", "text")
    place = ["lead", "chunk", "part"]
    return rows.repartition(*place).sortWithinPartitions(*place, F.col("of").isNotNull()).mapInArrow(alike, "a bigint, b bigint")


def _beaten(edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) of what goes if, by rank, a node stays unless an earlier one that stays has an edge (a, b) to it; and the edges left open.

    Of nodes that are not ``known`` earlier edges may be missing, so nothing follows from their having none.
    """
    gone = edges.select(F.col("b").alias("node")).limit(0)
    while True:
        firsts = edges.select(F.col("a").alias("node")).distinct().join(small(known), "node", "left_semi")
        firsts = firsts.join(small(edges.select(F.col("b").alias("node")).distinct()), "node", "left_anti").select(F.col("node").alias("a"))
        now = cut(edges.join(small(firsts), "a", "left_semi").select(F.col("b").alias("node")).distinct())
        if not now.limit(1).count():
            return gone, edges
        gone, out = gone.union(now), small(now)
        edges = cut(edges.join(out, edges.a == out.node, "left_anti").join(out, F.col("b") == out.node, "left_anti"))


def _pairs(live: DataFrame, heads: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): each text with the earlier heads of its keys, if one of the two is ``known``; nothing follows from others.

    Heads meet a key's texts as one list of at most MOST_PIVOTS, and a text's lists are one before they are spread.
    """
    mark = small(known.withColumn("known", F.lit(True)))
    flagged = lambda d: d.join(mark, d["rank.node"] == mark["node"], "left").drop("node")
    lists = flagged(heads).groupBy("key").agg(F.collect_list(F.struct("rank", "known")).alias("heads"))
    mine = flagged(live.select("key", "rank")).join(small(lists), "key")
    first = F.filter("heads", lambda x: (x["rank"] < F.col("rank")) & (F.col("known").isNotNull() | x["known"].isNotNull()))
    found = mine.select(F.col("rank.node").alias("b"), F.transform(first, lambda x: x["rank"]["node"]).alias("as")).where(F.size("as") > 0)
    return found.groupBy("b").agg(F.array_distinct(F.flatten(F.collect_list("as"))).alias("as")).select(F.explode("as").alias("a"), "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those whose text is a copy of one that stays and comes first by id.

    A copy's shingles have a Jaccard similarity of ``least`` or more with the other's. Texts that share one of the
    keys of their SimHash fingerprints are candidates: by ``plan`` all but some 1 in 10,000 pairs. A component of
    candidates of at most WHOLE texts and WHOLE_BYTES is settled by one task, text by text in their order: a text is
    compared with those that stay whose fingerprints are within the budget. Up to STRETCHES times that are settled
    likewise, a stretch of the order after the other, each held against what stays of those before it. Larger ones go in rounds. All texts of
    a key are held against each other, or if it has more than CROWD against its first PIVOTS ones; what that
    settles leaves its keys, and the rest goes on until all is settled, with as many more pivots as fewer rows
    are left, so that a round has at most PIVOTS pairs for each row of the first. So no two candidates that both stay are
    copies, and what goes is a copy of a text that stays. Null ids come last; null is the empty text; of rows
    that repeat an id and a text one stays; a text goes or stays whatever other texts have its id.
    """
    body = F.coalesce(F.col(quoted(text_col)).cast("binary"), F.lit(b""))
    named = docs.select(packed(docs).alias("_row"), F.col(quoted(id_col)).alias("_id"), body.alias("text")).withColumn("node", F.xxhash64("text"))
    times = cut(named.groupBy("_id", "node").agg(F.count("*").alias("times")))
    firsts = cut(times.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id")).alias("first")))
    some = named.select("node", "text")
    count = firsts.count()
    keys, prints = near_keys(some, count, width, least)
    keys = cut(keys.distinct())
    stars = keys.join(small(keys.groupBy("key").agg(F.min("node").alias("u"))), "key").select("u", F.col("node").alias("v"))
    groups = cut(connected_components(stars, LINKS))
    near = cut(groups.select("node"))
    texts = cut(sieved(some, "node", near).join(small(near), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))
    sizes = groups.join(small(texts), "node").select("root", "node", F.length("text").cast("bigint").alias("bytes"))
    totals = sizes.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    bounded = totals.where((F.col("n") <= STRETCHES * WHOLE) & (F.col("bytes") <= STRETCHES * WHOLE_BYTES))
    at_once = (F.col("n") <= WHOLE) & (F.col("bytes") <= WHOLE_BYTES)
    bounded = bounded.select("root", F.when(at_once, 0.0).otherwise(1.0).alias("share"))
    ranked = Window.partitionBy("root").orderBy("first", "node")
    share = F.greatest(F.lit(1 / max(WHOLE, 1)), F.col("bytes") / F.lit(float(WHOLE_BYTES))) * F.col("share")
    own = sizes.join(small(bounded), "root").join(small(firsts), "node").withColumn("share", share)
    own = own.select("root", "node", F.row_number().over(ranked).alias("place"), F.floor(F.sum("share").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - F.col("share")).cast("int").alias("stretch"))
    own = cut(own.withColumn("last", F.max("stretch").over(Window.partitionBy("root"))))
    tidy(docs.sparkSession)
    budget = plan(count, least)[-1]
    rows = own.join(small(prints), "node").join(small(texts), "node").select("root", "stretch", "last", "place", "node", "prints", "text", F.lit(_WAITS).alias("as"))
    beaten = _settled(rows, 1 + (own.agg(F.max("last")).first()[0] or 0), width, least, budget)
    live = cut(keys.join(small(own.select("node")), "node", "left_anti").join(small(firsts), "node").select("key", F.struct("first", "node").alias("rank")))
    whole = None
    while True:
        sizes = cut(live.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        live = cut(live.join(small(sizes), "key").select("key", "rank", "n"))
        rows = live.count()
        if not rows:
            break
        whole = whole or rows
        pivots = min(MOST_PIVOTS, PIVOTS * whole // rows)
        crowd = max(CROWD, pivots)
        place = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
        heads = live.withColumn("place", place).where(F.col("place") <= crowd).where((F.col("n") <= crowd) | (F.col("place") <= pivots))
        heads = cut(heads.select("key", "rank"))
        both = live.select(F.col("rank.node").alias("node"), F.lit(1).alias("n")).union(heads.select(F.col("rank.node").alias("node"), F.lit(-1).alias("n")))
        known = cut(both.groupBy("node").agg(F.sum("n").alias("n")).where("n = 0").select("node"))
        edges = cut(_copies(cut(_pairs(live, heads, known)), texts, width, least))
        gone, left = _beaten(edges, known)
        beaten = beaten.union(gone)
        stays = known.join(small(left.select(F.col("b").alias("node")).distinct()), "node", "left_anti")
        settled = small(gone.union(stays).distinct())
        live = live.select("key", "rank").join(settled, F.col("rank.node") == settled.node, "left_anti")
        tidy(docs.sparkSession)
    stay = firsts.join(small(beaten.distinct()), "node", "left_anti").select(F.col("first._id").alias("_own"), F.col("node").alias("_node"))
    stay = cut(stay.join(times, stay["_own"].eqNullSafe(times["_id"]) & (stay["_node"] == times["node"])).select("_own", "_node", "times"))
    rows = named.drop("text")

    def of(stay: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(stay, rows["_id"].eqNullSafe(stay["_own"]) & (rows["node"] == stay["_node"]))

    many = stay.where("times > 1")
    once = of(many, sieved(rows, "node", many.select(F.col("_node").alias("node")))).groupBy("_id", "node").agg(F.first("_row").alias("_row"))
    return of(stay.where("times = 1"), rows).select("_row").union(once.select("_row")).select("_row.*")
