"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the rows that its spelling and its prefixes
hash to. Filters of several widths run over the words, each is max-pooled over
the whole text, and a logistic layer gives the score. All labelled rows are
learned from: log-odds of the words are counted over all of them, shards of
about ``SHARD`` rows each train from there by mini-batch Adam in numpy, both
classes weighing the same, and the model is the mean of the shards' changes.
Thresholds for the ``flagged`` column are calibrated for each language on the
rows kept out of the gradient, a fifth, all of them. Scoring is one narrow pass: embeddings and
filters fold into one table, so a text is a gather, a few sums and maxima.

Defined results: null and empty texts, and those without a word, get the score
of a text of padding; texts of any length are scored whole; equal texts get
equal scores; with no labelled rows of one class, that class's share is the
score of every text. The score reads the text alone; the language names only
the threshold of ``flagged`` (unknown or null: the common one).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, sieved, together

#: Labelled rows that one task trains on, on average, and values of the model that are summed together.
SHARD, CHUNK = 8000, 1 << 14
#: Steps of the scores that thresholds are chosen among.
STEPS = 100_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
PREFIXES = (4, 5)
CACHE_WORDS = 200_000
#: Texts, and characters of them, that are scored together; a longer text is scored alone.
TEXTS, CHARS = 200, 1_000_000
_WORDS = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def buckets(word: str) -> tuple[int, ...]:
    """Where the spelling and the prefixes of a word hash to."""
    raw = word.encode()
    return (zlib.crc32(b"w" + raw) % BUCKETS, *(zlib.crc32(b"%d" % n + word[:n].encode()) % BUCKETS for n in PREFIXES))


@dataclass
class Model:
    """``table``: a row of filter responses for each bucket; ``thresholds`` by language, "" for all others."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    const: float
    thresholds: dict[str, float]


def _columns() -> list[tuple[int, int, slice]]:
    """(width, place, columns of the table) of every word of every filter."""
    cols, at = [], 0
    for w in WIDTHS:
        for j in range(w):
            cols.append((w, j, slice(at, at + FILTERS)))
            at += FILTERS
    return cols


COLUMNS = _columns()
TOTAL = sum(WIDTHS) * FILTERS
PAD = max(WIDTHS) - 1


def convolve(rows: np.ndarray) -> np.ndarray:
    """Responses of all filters at every place that has ``PAD`` rows after it."""
    n = len(rows) - PAD
    out = np.zeros((n, len(WIDTHS) * FILTERS), rows.dtype)
    for w, j, cols in COLUMNS:
        at = WIDTHS.index(w) * FILTERS
        out[:, at : at + FILTERS] += rows[j : j + n, cols]
    return out


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts one after another, PAD rows of padding behind each and at least one place: starts, lengths, all rows."""
    places = np.maximum(sizes, 1)
    starts = np.cumsum(places + PAD) - (places + PAD)
    return starts, places, int((places + PAD).sum())


class Scorer:
    """Scores texts; remembers the responses of words."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, np.zeros((1, TOTAL), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if len(self.index) > CACHE_WORDS:
            self.index, self.rows = {}, self.rows[:1]
        split = [words_of(t or "") for t in texts]
        if new := sorted(set(chain.from_iterable(split)).difference(self.index)):
            at = np.array([buckets(w) for w in new])
            self.index.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, m.table[at].sum(1)])
        sizes = np.array([len(s) for s in split])
        starts, places, total = layout(sizes)
        word = np.zeros(total, np.int64)
        word[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64)
        made = convolve(self.rows[word])
        edges = np.stack([starts, np.minimum(starts + places, len(made))], 1).ravel()
        pooled = np.maximum.reduceat(np.concatenate([made, made[-1:]]), edges, axis=0)[::2]
        return 1 / (1 + np.exp(-np.clip(np.maximum(pooled + m.bias, 0) @ m.out + m.const, -30, 30).astype(float)))


def _shapes() -> list[tuple[int, ...]]:
    pools = len(WIDTHS) * FILTERS
    return [(BUCKETS, DIM), (DIM, TOTAL), (pools,), (pools,), (1,)]


def begin(seen: np.ndarray, totals: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """The parameters before training: ``seen`` texts of each class by bucket, of ``totals``."""
    rng = np.random.default_rng(seed)
    # The embeddings begin with the smoothed log-odds of a bucket among toxic texts, one filter of each width reading it.
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    emb = rng.normal(0, 0.05, (BUCKETS, DIM))
    emb[:, 0] = np.where(seen.sum(0) >= 3, odds, 0) / (1 + len(PREFIXES))
    kernel = rng.normal(0, 0.1, (DIM, TOTAL))
    for _, _, cols in COLUMNS:
        kernel[0, cols.start] = 0.5
    bias = np.zeros(len(WIDTHS) * FILTERS)
    out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS)
    out[::FILTERS] = 1.0
    return [emb, kernel, bias, out, np.array([-2.0])]


def fit(params: list[np.ndarray], texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
    """Adam on the rows, changing ``params``."""
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    vocab = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)), 1)}
    at = np.array([(0,) * (1 + len(PREFIXES)), *map(buckets, vocab)])
    docs = [np.fromiter(map(vocab.__getitem__, s), np.int64, len(s)) for s in split]
    emb, kernel, bias, out, const = params
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            sizes = np.array([len(docs[k]) for k in some])
            starts, places, total = layout(sizes)
            word = np.zeros(total, np.int64)
            for k, s in zip(some, starts, strict=True):
                word[s : s + len(docs[k])] = docs[k]
            used, back = np.unique(word, return_inverse=True)
            vec = emb[at[used]].sum(1) * (used > 0)[:, None]
            made = convolve((vec @ kernel)[back])
            pooled = np.empty((len(some), made.shape[1]))
            spot = np.empty(pooled.shape, np.int64)
            for i, (s, p) in enumerate(zip(starts, places, strict=True)):
                spot[i] = s + made[s : s + p].argmax(0)
            pooled = np.take_along_axis(made, spot, 0)
            hidden = np.maximum(pooled + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + const[0], -30, 30)))
            err = (p - y[some]) * weight[some] / len(some)
            gh = err[:, None] * out * (hidden > 0)
            grads = [np.zeros_like(emb), np.zeros_like(kernel), gh.sum(0), hidden.T @ err, np.array([err.sum()])]
            for w, j, cols in COLUMNS:
                f = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
                which = back[spot[:, f] + j]
                grads[1][:, cols] += np.einsum("nfd,nf->df", vec[which], gh[:, f])
                push = gh[:, f][:, :, None] * kernel[:, cols].T[None]
                real = used[which] > 0
                rows = at[used[which]][real]
                for c in range(rows.shape[1]):
                    np.add.at(grads[0], rows[:, c], push[real])
            step += 1
            for x, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def calibrate(score: np.ndarray, y: np.ndarray, langs: list[str | None], count: np.ndarray, least: int = 20) -> dict[str, float]:
    """The threshold of best F1 for each language with enough rows of both classes, and for all (""); each row stands for ``count``."""
    out = {}
    names = np.array([x or "" for x in langs], object)
    for lang in sorted({"", *names}):
        on = names == lang if lang else np.ones(len(y), bool)
        if not on.any() or lang and min((count * y)[on].sum(), (count * (1 - y))[on].sum()) < least:
            continue
        cuts, at = np.unique(np.r_[0.5, score[on]], return_inverse=True)
        hits = np.bincount(at[1:], count[on] * y[on], len(cuts))[::-1].cumsum()[::-1]
        taken = np.bincount(at[1:], count[on], len(cuts))[::-1].cumsum()[::-1]
        if len(cuts) > 1:
            cuts, hits, taken = (cuts[1:] + cuts[:-1]) / 2, hits[1:], taken[1:]
        f1 = 2 * hits / np.maximum(1, (count * y)[on].sum() + taken)
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        out[lang] = float(cuts[min(best, key=lambda k: abs(cuts[k] - 0.5))])
    return {"": 0.5} | out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by id, labels before texts; each text with each label of its id."""
    at, labels = None, []
    for batch in batches:
        rows, ys, kept = [], [], []
        for nth, (name, y, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)), strict=True)):
            if name != at:
                at, labels = name, []
            if y is not None:
                labels.append((y, k))
                continue
            for y, k in labels:
                rows.append(nth)
                ys.append(y)
                kept.append(k)
        some = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(ys, pa.int32()), pa.array(kept, pa.bool_())], batch.schema.names)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that have a bucket."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1), strict=True):
            if words := set(words_of(text.as_py() or "")):
                seen[y.as_py(), np.unique([buckets(w) for w in words])] += 1
    y, at = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(y, pa.int32()), pa.array(seen[y, at])], ["at", "y", "n"])


def _changes(start: list[np.ndarray], weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's changes of the parameters times its rows, and its rows where there is a change, in chunks."""
    t = pa.Table.from_batches(list(batches), pa.schema([("_id", pa.string()), ("_text", pa.string()), ("_y", pa.int32())]))
    if not t.num_rows:
        return
    y, params = t.column(2).to_numpy().astype(float), [x.copy() for x in start]
    fit(params, [x or "" for x in t.column(1).to_pylist()], y, weights[y.astype(int)])
    change = np.concatenate([(x - x0).ravel() for x, x0 in zip(params, start, strict=True)])
    for at in range(0, len(change), CHUNK):
        part = change[at : at + CHUNK]
        sums = np.concatenate([part, part != 0]) * len(y)
        yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["chunk", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw.as_py())
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "sums"])


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Learns from all labelled rows; what reaches the driver is bounded by the model, and by languages and STEPS."""
    spark = docs.sparkSession
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    rows = (rows if may_learn is None else rows.where(may_learn)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    # Ids alone say how many shards there are, so texts are shuffled once: a partition of what is written is a shard.
    ids = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_times"))
    is_kept = (F.pmod(F.xxhash64("_id", F.lit("kept")), F.lit(5)) == 0).alias("_kept")
    known = cut(ids.join(rows, "_id").select(F.col("_id").cast("string").alias("_id"), "_y", is_kept, "_times"))
    totals = np.zeros(2)
    for r in known.where("not _kept").groupBy("_y").agg(F.sum("_times").alias("n")).collect():
        totals[r["_y"]] = r["n"]
    mine = sieved(docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang")), "_id", known)
    shards = max(1, round(totals.sum() / SHARD))
    # The labels of an id come before its texts. A join in place of this would be free to deal the texts out anew.
    texts = mine.select("_id", "_text", "_lang", F.lit(None).cast("int").alias("_y"), F.lit(None).cast("boolean").alias("_kept"))
    both = known.select("_id", F.lit(None).cast("string").alias("_text"), F.lit(None).cast("string").alias("_lang"), "_y", "_kept").union(texts)
    dealt = both.repartition(shards, "_id").sortWithinPartitions("_id", F.col("_y").isNull(), "_text", "_y")
    found = cut(dealt.mapInArrow(_labelled, "_id string, _text string, _lang string, _y int, _kept boolean"))
    some = found.where("not _kept")
    if not totals.all():
        share = float(totals[1] / totals.sum()) if totals.any() else 0.0
        const = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
        return Model(np.zeros((BUCKETS, TOTAL), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), const, {"": 0.5})
    counted = some.select("_text", "_y").mapInArrow(_seen, "at int, y int, n bigint").groupBy("at", "y").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((2, BUCKETS))
    seen[counted["y"], counted["at"]] = counted["n"]
    start, weights = begin(seen, totals), totals.sum() / (2 * totals)
    sent = spark.sparkContext.broadcast((start, weights))
    changes = some.select("_id", "_text", "_y").mapInArrow(lambda b: _changes(*sent.value, b), "chunk int, sums binary")
    added = changes.repartition("chunk").mapInArrow(_added, "chunk int, sums binary").toPandas().sort_values("chunk")["sums"]
    parts = [np.frombuffer(x).reshape(2, -1) for x in added]
    sums, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    change, params, k = sums / np.maximum(n, 1), [], 0
    for x, shape in zip(start, _shapes(), strict=True):
        params.append(x + change[k : k + x.size].reshape(shape))
        k += x.size
    emb, kernel, bias, out, const = params
    model = Model((emb @ kernel).astype(np.float32), bias.astype(np.float32), out.astype(np.float32), float(const[0]), {"": 0.5})
    # Pairs of a row's text and label, by language and score; the labels ride in the id's place.
    kept = score(found.where("_kept"), model, "_y", "_text", "_lang", extra="_lang")
    grouped = kept.groupBy("_y", "_lang", F.round(F.col("score") * STEPS).alias("at")).count().toPandas()
    if len(grouped):
        model.thresholds = calibrate(grouped["at"].to_numpy() / STEPS, grouped["_y"].to_numpy(), [x if isinstance(x, str) else None for x in grouped["_lang"]], grouped["count"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", extra: str | None = None) -> DataFrame:
    """(id_col, score, predicted, threshold, flagged) for every row, and the language if it has a name as ``extra``. The model's size is fixed by BUCKETS."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in together(texts, TEXTS, CHARS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(scorer(texts[a:b]))], ["_id", "_lang", "score"])

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang")).mapInArrow(run, f"_id {kind}, _lang string, score double")
    threshold = F.lit(model.thresholds[""])
    for name, at in sorted(model.thresholds.items()):
        threshold = F.when(F.col("_lang") == name, F.lit(at)).otherwise(threshold) if name else threshold
    return out.withColumn("threshold", threshold).select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"), *([F.col("_lang").alias(extra)] if extra else []))
