"""Line dedup: an edit-distance join of lines, in DataFrame operations only.

Lines are compared without the blanks around them. Equal lines are one class;
so are lines of ``MIN_CHARS`` code points or more at an edit distance of
``threshold`` or less, and what such links connect. The first line of a class,
by document id and line number, stays.

Links come from a segment-partition join: a line is cut into threshold + 1
segments, of which an equal one must survive in any line within the threshold.
Segments are indexed under (length, number, content); a line meets lines of its
own length by its index rows, and probes the lengths up to ``threshold`` below
its own, at the start places that position and length allow. A key under which
more than ``CROWD`` lines meet is not paired: what is left of its lines without
the segment has the same threshold to keep, so it is cut and indexed again,
level by level. Once no more than ``threshold`` characters are left, all lines
of a key are within the threshold, and each is linked to the first of them. So
candidates are at most CROWD times the index rows. (At thresholds of 2 or more,
the probes of a key are paired with its index rows at that level.) Pairs
are screened by letter counts and verified by a banded bit-parallel edit
distance.

Line texts are shuffled only for lines that share a key; lists of keys and lines
are sieved by a bitmap of bounded size before they are shuffled.

Defined results: null is the empty text; blank lines are never duplicates and
stay; null ids come last; rows that repeat an id and a text stay or lose lines
together; long lines are compared whole; an empty table gives no rows. Ids may
be of any type with an order. Only the id and text columns are read; the other
columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import connected_components, cut, quoted, scratch, sieved

THRESHOLD, MIN_CHARS = 1, 20
#: Rows that may meet under a key without being cut again.
CROWD = 32
LETTERS = "aeinorst"
_BLANK = " \t\r\x0b\x0c"


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def _cuts(size: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i (from 0) of a string: the last ones are the longer."""
    base, extra = F.floor(size / parts).cast("int"), (size % parts).cast("int")
    more = F.lit(i) - (parts - extra)
    return base * i + F.greatest(F.lit(0), more), base + (more >= 0).cast("int")


def slots(threshold: int) -> list[tuple[int, int, int]]:
    """(delta, segment, shift) of the rows of a line: its own segments first, with delta -1, then its probes.

    A probe looks for segment i of a line ``delta`` shorter, ``shift`` places on from where that line has it. Probes
    with neither are in a line's own segments, and come last: only what is left of a probe's line needs them.
    """
    t = threshold
    probes = [(d, i, s) for d in range(t + 1) for i in range(t + 1) for s in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)]
    probes.sort(key=lambda p: p[0] == p[2] == 0)
    return [(-1, i, 0) for i in range(t + 1)] + probes


def _places(size: Column, threshold: int) -> list[tuple[int, int, Column, Column, Column]]:
    """(delta, segment, size of the line meant, start, length) of each slot."""
    out = []
    for delta, i, shift in slots(threshold):
        own = size - max(0, delta)
        start, n = _cuts(own, i, threshold + 1)
        out.append((delta, i, own, start + shift, n))
    return out


def _key(seed: Column, own: Column, i: int, text: Column, start: Column, n: Column) -> Column:
    return F.xxhash64(seed, own.cast("int"), F.lit(i), F.substring(text, start + 1, n))


def line_keys(line: Column, size: Column, threshold: int) -> Column:
    """The keys of a line of more than 2 * threshold code points, by slot."""
    places = _places(size, threshold)[: -(threshold + 1)]
    return F.array(*[_key(F.lit(0), own, i, line, start, n) for _, i, own, start, n in places])


def _cut_again(hot: DataFrame, threshold: int) -> DataFrame:
    """Rows of what is left of each row's string without its segment; ``text`` is that string."""
    size, parts = F.char_length("text"), _places(F.char_length("text"), threshold)
    here = F.get(F.array(*[F.struct(start.alias("start"), n.alias("n")) for *_, start, n in parts]), F.col("slot"))
    hot = hot.withColumn("_at", here)
    rest = F.concat(F.expr("substring(text, 1, _at.start)"), F.expr("substring(text, _at.start + _at.n + 1)"))
    deltas = F.array(*[F.lit(delta) for delta, *_ in parts])
    hot = hot.select("id", F.col("key").alias("seed"), F.get(deltas, F.col("slot")).alias("delta"), rest.alias("text")).withColumn("size", F.char_length("text"))
    text, size, seed = F.col("text"), F.col("size"), F.col("seed")
    last = len(parts) - (threshold + 1)  # own segments come with their line's probes of its own length
    mine = [(F.col("delta") == delta) | (F.col("delta") == -1) & F.lit(delta == 0 and k < last) for k, (delta, *_) in enumerate(parts)]
    keys = [F.when(is_mine & (n > 0) & (start >= 0) & (start + n <= size), _key(seed, own, i, text, start, n)) for is_mine, (_, i, own, start, n) in zip(mine, _places(size, threshold), strict=True)]
    if threshold == 1:  # one character is left of the shorter line: it may be the longer one's last, by its slot, or first
        keys.append(F.when((F.col("delta") == 1) & (size == 2), _key(seed, size - 1, 1, text, F.lit(0), F.lit(1))))
    found = hot.select("id", "text", F.posexplode(F.array(*keys)).alias("slot", "key")).where("key is not null")
    return found.withColumn("slot", F.when(F.col("slot") == len(parts), slots(1).index((1, 1, 1))).otherwise(F.col("slot")))


def candidates(keyed: DataFrame, texts, threshold: int = THRESHOLD, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(a, b), a < b: ids of lines that may be within the threshold, all links kept up to what they connect; and the texts of all lines in them.

    ``keyed`` has (id, keys); ``texts(ids)`` gives (id, line) and more of the lines with these ids.
    """
    seen = keyed.select("id", F.posexplode("keys").alias("slot", "key"))
    own = F.col("slot") <= threshold
    live = seen.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("slot").alias("slot")).where((F.col("lo") < F.col("hi")) & own)
    live = cut(live.select("key"))
    rows = cut(sieved(seen, "key", live).join(live, "key").distinct())
    lines = cut(texts(rows.select("id").distinct()))
    level, out = 0, []
    while True:
        # Written first, so that the join shuffles both sides for itself and Spark can split a key with many rows.
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("slot").alias("slot"), F.min(F.when(own, F.col("id"))).alias("head"))
        sizes = cut(sizes.where((F.col("lo") < F.col("hi")) & own).select("key", "head", (F.col("n") > crowd).alias("hot")))
        rows = cut(rows.join(sizes, "key"))
        out.append(_pairs(rows.where("not hot"), threshold))
        hot = rows.where("hot")
        if hot.limit(1).count() == 0:
            return reduce(DataFrame.union, out).distinct(), lines
        if not level:
            hot = hot.join(lines.select("id", F.col("line").alias("text")), "id")
        hot, level = cut(hot), level + 1
        left = F.char_length("text") - F.get(F.array(*[n + max(0, delta) for delta, _, _, _, n in _places(F.char_length("text"), threshold)]), F.col("slot"))
        delta = F.get(F.array(*[F.lit(max(0, delta)) for delta, *_ in slots(threshold)]), F.col("slot"))
        few = left <= threshold
        close = own if threshold > 1 else left + delta <= threshold
        out.append(hot.where(few & close & (F.col("id") != F.col("head"))).select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")))
        if threshold > 1:
            out.append(_pairs(hot.where(few), threshold, own_pairs=False))
            hot = hot.where(~few)
        else:
            hot = hot.where(left > 0)
        rows = cut(_cut_again(hot, threshold))


def _pairs(rows: DataFrame, threshold: int, own_pairs: bool = True) -> DataFrame:
    """Each index row with the probes of its key, and with the index rows of larger ids."""
    one, other = rows.where(F.col("slot") <= threshold).select("key", F.col("id").alias("x")), rows.select("key", F.col("id").alias("y"), F.col("slot").alias("_slot"))
    probe = (F.col("_slot") > threshold) & (F.col("x") != F.col("y"))
    both = one.join(other, "key").where(probe | (F.col("x") < F.col("y")) if own_pairs else probe)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _same_start(a: Column, b: Column) -> Column:
    """How many code points two strings have in common from the start; the shorter one's length and more if they are equal."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(differ, F.lit(True)), F.lit(0)) - 1, F.char_length(a)).cast("int")


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """``banded_distance`` of what is left of two strings without their common start and end.

    threshold + 1 code points stay on the left, which the band needs; the strings have 2 * threshold + 2 or more.
    """
    m, n = F.char_length(a), F.char_length(b)

    def middle(start: Column, end: Column) -> Column:
        skip = F.greatest(F.lit(0), start - (threshold + 1))
        end = F.least(end, F.least(m, n) - F.greatest(start, skip + threshold + 1))
        return F.struct(F.substring(a, skip + 1, m - skip - end).alias("a"), F.substring(b, skip + 1, n - skip - end).alias("b"))

    both = _let(_same_start(a, b), lambda start: _let(_same_start(F.reverse(a), F.reverse(b)), lambda end: middle(start, end)))
    return _let(both, lambda mid: banded_distance(mid["a"], mid["b"], threshold))


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of strings of more than ``threshold`` code points whose lengths differ by no more; above the threshold, some value above it.

    Bit-parallel over a band of 2 * threshold + 1 rows, after Hyyrö (2003): bit k of a column's vectors is row
    column - threshold + k. The distance follows the band's lowest diagonal, then the last row.
    """
    return _let(F.split(a, ""), lambda p: _let(F.split(b, ""), lambda t: _banded(p, t, F.size(p), F.size(t), threshold)))


def _banded(p: Column, t: Column, m: Column, n: Column, threshold: int) -> Column:
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, width - 1

    def equal(j: Column) -> Column:
        """Which rows of the band hold the column's character."""
        return _let(F.get(t, j - 1), lambda char: reduce(lambda u, v: u.bitwiseOR(v), [F.when(F.coalesce((j - threshold + k >= 1) & (F.get(p, F.greatest(F.lit(0), j - threshold + k - 1)) == char), F.lit(False)), _long(1 << k)).otherwise(_long(0)) for k in range(width)]))

    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(_long(1)).cast("int")

    def column(acc: Column, x: Column) -> Column:
        vp, vn, j = acc["vp"], acc["vn"], acc["j"]
        d0 = x.bitwiseAND(vp) + vp
        return _let(d0.bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(_long(mask)), lambda d0: turn(acc, j, vp, vn, d0))

    def turn(acc: Column, j: Column, vp: Column, vn: Column, d0: Column) -> Column:
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(_long(mask))
        hn = d0.bitwiseAND(vp)
        last = m - j + threshold  # the bit of the last row
        at = lambda v: reduce(lambda u, k: F.when(last == k, bit(v, k)).otherwise(u), range(width), F.lit(0))
        d = acc["d"] + F.when(j <= m - threshold, 1 - bit(d0, top)).otherwise(at(hp) - at(hn))
        down = F.shiftright(d0, 1)
        return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(_long(mask)).alias("vp"), down.bitwiseAND(hp).alias("vn"), d.alias("d"), (j + 1).alias("j"))

    first = F.struct(_long(mask - ((1 << threshold) - 1)).alias("vp"), _long(0).alias("vn"), F.lit(threshold).alias("d"), F.lit(1).alias("j"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), equal), first, column, lambda acc: acc["d"])


def _alike(threshold: int) -> Column:
    """Letter counts of lines within the threshold differ by no more than it, each."""
    count = lambda c, x: F.char_length(F.replace(F.col(x), F.lit(c), F.lit("")))
    near = F.abs(F.char_length("s") - F.char_length("t")) <= threshold
    for c in LETTERS:
        left, right = (F.char_length(x) - count(c, x) for x in ("s", "t"))
        near = near & (F.abs(left - right) <= threshold)
    return near


def links(keyed: DataFrame, texts, threshold: int = THRESHOLD, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(a, b): ids of lines (see ``candidates``) within the threshold, with their texts' columns as structs ``x`` and ``y``; and the texts."""
    pairs, lines = candidates(keyed, texts, threshold, crowd)
    one, two = (lines.select(F.col("id").alias(i), F.struct(*lines.columns).alias(c)) for i, c in (("a", "x"), ("b", "y")))
    both = cut(pairs).join(one, "a").join(two, "b").withColumn("s", F.col("x.line")).withColumn("t", F.col("y.line"))
    return both.where(_alike(threshold)).where(edit_distance(F.col("s"), F.col("t"), threshold) <= threshold).drop("s", "t"), lines


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, of, line_no, line, id, id2) of every line that is not blank: the document, a hash of its text, and 128 bits that stand for the line."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(text).alias("of"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_BLANK))).where("line <> ''")
    return rows.withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(1), "line"))


def _place(kind: T.DataType) -> Column:
    """What orders lines, by document and number; null documents come last."""
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.struct(F.col("doc").isNull().alias("last"), "doc", "line_no")
    place = F.coalesce(F.col("doc").cast("decimal(20,0)"), F.lit(str(10**19)).cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line_no")
    return place.cast("decimal(38,0)")


def _node(id_: Column, id2: Column) -> Column:
    """126 of the 128 bits as one number."""
    return (id_.cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.shiftrightunsigned(id2, 2).cast("decimal(20,0)")).cast("decimal(38,0)")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """(doc, of, removed array<int>): line numbers that go, for each text that loses lines."""
    if min_chars <= 2 * threshold + 1:
        raise ValueError("lines of 2 * threshold + 1 code points or fewer are not compared")
    occ = occurrences(docs, id_col, text_col).withColumn("size", F.char_length("line"))
    at = scratch(docs.sparkSession, "lines")
    keys = F.when(F.col("size") >= min_chars, line_keys(F.col("line"), F.col("size"), threshold))
    occ.select("doc", "of", "line_no", "id", "id2", keys.alias("keys")).write.parquet(at)
    rows = docs.sparkSession.read.parquet(at).withColumn("place", _place(docs.schema[id_col].dataType))

    def texts(ids: DataFrame) -> DataFrame:
        some = sieved(occ.where(F.col("size") >= min_chars).withColumn("place", _place(docs.schema[id_col].dataType)), "id", ids)
        return some.groupBy("id", "id2", "line").agg(F.min("place").alias("first")).join(ids, "id", "left_semi")

    found, lines = links(rows.where("keys is not null").select("id", "keys"), texts, threshold, crowd)
    node = lambda c: _node(F.col(f"{c}.id"), F.col(f"{c}.id2"))
    roots = connected_components(found.select(node("x").alias("u"), node("y").alias("v")))
    grouped = lines.select("id", "id2", "first", _node(F.col("id"), F.col("id2")).alias("node")).join(roots, "node")
    linked = grouped.join(cut(grouped.groupBy("root").agg(F.min("first").alias("keep"))), "root").select("id", "id2", "keep")
    alone = rows.groupBy("id", "id2").agg(F.min("place").alias("keep"), F.count("*").alias("times")).where("times > 1").select("id", "id2", "keep")
    known = cut(linked.union(alone).groupBy("id", "id2").agg(F.min("keep").alias("keep")))
    gone = sieved(rows.drop("keys"), "id", known).join(known, ["id", "id2"]).where("place <> keep")
    return gone.groupBy("doc", "of").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def _with_removed(docs: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:  # noqa: ANN003
    """Every row packed as ``_row``, with its id, text and ``removed``."""
    gone = duplicates(docs, id_col, text_col, **settings)
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"))
    rows = rows.withColumn("_of", F.xxhash64(F.coalesce("_text", F.lit(""))))
    return rows.join(gone, rows["_id"].eqNullSafe(gone["doc"]) & (rows["_of"] == gone["of"]), "left")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:  # noqa: ANN003
    """(id_col, n_lines, n_removed, removed) for every row: lines that are not blank, and the numbers (from 0) of those that go."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    gone = duplicates(docs, id_col, text_col, **settings)
    n = F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != ""))
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.xxhash64(text).alias("_of"), n.cast("bigint").alias("n_lines"))
    out = rows.join(gone, rows["_id"].eqNullSafe(gone["doc"]) & (rows["_of"] == gone["of"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.col("_id").alias(id_col), "n_lines", F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:  # noqa: ANN003
    """``docs`` with the lines gone that duplicate an earlier one; texts without such lines are as they were."""
    out = _with_removed(docs, id_col, text_col, **settings)
    left = F.array_join(F.filter(F.split("_text", "\n"), lambda x, k: ~F.array_contains("removed", k)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(left)
    return out.select(*[(text if c == text_col else F.col(f"_row.{quoted(c)}")).alias(c) for c in docs.columns])
