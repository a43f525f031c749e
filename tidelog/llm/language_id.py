"""Language identification by unigram pieces, summed over all segmentations.

Each language gives every piece of a fixed public vocabulary a probability,
fitted by expectation maximisation (forward-backward over all segmentations of
the training words). A text's words are scored by the forward algorithm, which
sums the probability of every segmentation into pieces; a text's score is the
posterior of its best language with equal priors. The forward pass runs over
many distinct words at once in numpy; a bounded cache keeps word scores between
batches.

Defined results: ``und`` with score 0 for a null text, one without letters, and
when no language was learned; runs of letters of any length are scored whole;
ties go to the first language by name; equal rows get equal results; an empty
table gives no rows. Labels and ids are never inputs of a prediction. The sample
learned from is at most ``MAX_ROWS`` rows in all languages together, or one of
each; a run so long that its probability is no number teaches nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import together

#: Bound of the labelled rows learned from, shared evenly by the languages.
MAX_ROWS = 2400
#: Words remembered; letters of words that are scored together, or one longer word; texts and characters read together.
CACHE_WORDS, CELLS, TEXTS, CHARS = 300_000, 400_000, 500, 2_000_000
ROUNDS, SMOOTHING = 2, 0.05
_LETTERS = regex.compile(r"\p{L}+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
START = "▁"


def words_of(text: str) -> list[str]:
    return _LETTERS(text.lower())


class Vocabulary:
    """The pieces of a vocabulary file that are letters with or without the word-start mark, found by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        self.pieces = sorted(p for p in pieces if p == START or p.removeprefix(START).isalpha())
        max_piece = max(map(len, self.pieces))
        size = np.array([len(p) for p in self.pieces])
        flat = self.codes("".join(self.pieces))
        at = np.cumsum(size) - size
        code = np.zeros(len(size), np.uint64)
        for k in range(max_piece):
            on = size > k
            code[on] = code[on] * _BASE + flat[at[on] + k]
        order = np.argsort(code)
        self.hash, self.piece = code[order], order
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        self.max_piece = max_piece

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """A mixed 64-bit value for each code point."""
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        c = c * np.uint64(0xBF58476D1CE4E5B9)
        return c ^ (c >> np.uint64(29))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Words, each behind a start mark, as rows of one matrix: their lengths, the row order by length, and for
        each piece length the piece that begins at each place (-1: none)."""
        size = np.array([len(w) + 1 for w in words])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        width = int(size[0])
        place = np.arange(width)[None, :] < size[:, None]
        grid = np.zeros(place.shape, np.uint64)
        grid[place] = self.codes(START + START.join([words[k] for k in order]))
        found, code = [], np.zeros_like(grid)
        for n in range(1, self.max_piece + 1):
            if n > width:
                break
            code = code[:, : width - n + 1] * _BASE + grid[:, n - 1 :]
            maybe = self.filter[(code >> np.uint64(42)).astype(np.int64)] & place[:, n - 1 :]
            rows, cols = np.nonzero(maybe)
            want = code[rows, cols]
            at = np.minimum(np.searchsorted(self.hash, want), len(self.hash) - 1)
            hit = self.hash[at] == want
            ids = np.full(code.shape, -1, np.int32)
            ids[rows[hit], cols[hit]] = self.piece[at[hit]]
            found.append(ids)
        return size, order, found


def forward(size: np.ndarray, found: list[np.ndarray], prob: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, by word and language.

    ``prob`` has a row of language probabilities for each piece, and one of zeros at the end. A lone
    character that is no piece takes the probability ``unknown``. Sums are kept for as many places as the
    longest piece has, scaled at every place.
    """
    n, width, kinds = len(size), int(size[0]), prob.shape[1]
    out, log = np.zeros((n, kinds)), np.zeros(n)
    held = [np.ones((n, kinds))]  # the last places, the latest first
    ends = np.searchsorted(-size, -np.arange(width + 2), "right")  # rows are sorted by length, the longest first
    for t in range(1, width + 1):
        live, after = int(ends[t]), int(ends[t + 1])
        now = np.zeros((live, kinds))
        for k, before in enumerate(held, 1):
            ids = found[k - 1][:live, t - k]
            p = prob[ids]
            if k == 1:
                p = np.where((ids < 0)[:, None], unknown, p)
            now += before[:live] * p
        scale = now.max(1)
        scale[scale <= 0] = 1
        now /= scale[:, None]
        log[:live] += np.log(scale)
        out[after:live] = np.log(np.maximum(now[after:], 1e-300)) + log[after:live, None]
        held = [now, *(before[:live] / scale[:, None] for before in held)][: len(found)]
    return out


def _grouped(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of like length, with about CELLS letters in all when filled up to the longest."""
    size = np.array([len(w) + 1 for w in words])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        step = CELLS // int(size[order[at]]) + 1
        while to < len(order) and step:
            step //= 2
            while to + step <= len(order) and step and int(size[order[to + step - 1]]) * (to + step - at) <= CELLS:
                to += step
        yield order[at:to]
        at = to


@dataclass
class Model:
    """Probabilities of the pieces, by language; ``path`` names the vocabulary file."""

    path: str
    langs: list[str]
    prob: np.ndarray
    unknown: np.ndarray

    def scores(self, vocab: Vocabulary, words: list[str]) -> np.ndarray:
        """log P(word) for each word and language."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for some in _grouped(words):
            size, order, found = vocab.lattice([words[k] for k in some])
            out[some[order]] = forward(size, found, self.prob, self.unknown)
        return out


def fit(path: str, counts: dict[str, Counter], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Piece probabilities by expectation maximisation, from each language's word counts."""
    vocab = Vocabulary(path)
    langs = sorted(k for k, c in counts.items() if c)
    size_v = len(vocab.pieces)
    prob = np.zeros((size_v + 1, len(langs)))
    unknown = np.full(len(langs), 1e-7)
    for j, lang in enumerate(langs):
        words = sorted(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        lattices = []
        for some in _grouped(words):
            size, order, found = vocab.lattice([words[k] for k in some])
            lattices.append((size, weight[some[order]], found))
        mass = np.zeros(size_v + 1)
        for _, w, found in lattices:
            for ids in found:
                mass += np.bincount(ids.ravel() % (size_v + 1), np.repeat(w, ids.shape[1]), size_v + 1)
        for _ in range(rounds + 1):
            mass[-1] = 0
            p = np.append((mass[:-1] + smoothing) / (mass[:-1].sum() + smoothing * size_v), 0.0)
            prob[:, j] = p
            if _ == rounds:
                break
            mass = sum(expected(size, w, found, p, unknown[j]) for size, w, found in lattices)
    return Model(path, langs, prob, unknown)


def expected(size: np.ndarray, weight: np.ndarray, found: list[np.ndarray], p: np.ndarray, unknown: float) -> np.ndarray:
    """Expected uses of each piece over all segmentations, by forward and backward sums in plain scale."""
    n, width = len(size), int(size[0])
    put = lambda ids, k: np.where(ids < 0, unknown if k == 1 else 0.0, p[ids])
    ahead = np.zeros((width + 1, n))
    ahead[0] = 1
    for t in range(1, width + 1):
        for k in range(1, min(t, len(found)) + 1):
            ahead[t] += ahead[t - k] * put(found[k - 1][:, t - k], k)
    back = np.zeros((width + 1, n))
    back[size, np.arange(n)] = 1
    for t in range(width - 1, -1, -1):
        for k in range(1, min(width - t, len(found)) + 1):
            back[t] += back[t + k] * put(found[k - 1][:, t], k)
    total = back[0]
    share = np.where(total > 0, weight / np.maximum(total, 1e-300), 0)
    mass = np.zeros(len(p))
    for k, ids in enumerate(found, 1):
        at, row = ids.T, np.arange(n)
        places = at.shape[0]
        use = ahead[:places] * np.where(at < 0, 0, p[at]) * back[k : k + places] * share[row][None, :]
        mass += np.bincount(at.ravel() % len(p), use.ravel(), len(p))
    return mass


def predict_texts(model: Model, vocab: Vocabulary, texts: list[str | None], cache: dict[str, int], known: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text; ``cache`` and ``known`` hold word scores between calls."""
    split = [words_of(t or "") for t in texts]
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    if len(cache) > CACHE_WORDS:
        cache.clear()
        known[0] = known[0][:0]
    if new := list(set(chain.from_iterable(split)).difference(cache)):
        new.sort()
        cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
        known[0] = np.concatenate([known[0], model.scores(vocab, new)])
    size = np.array([len(s) for s in split])
    total = np.zeros((len(texts), len(model.langs)))
    if size.sum():
        word = np.fromiter(map(cache.__getitem__, chain.from_iterable(split)), np.int64)
        on = np.flatnonzero(size)
        total[on] = np.add.reduceat(known[0][word], (np.cumsum(size) - size)[on], axis=0, dtype=np.float64)
    best = total.argmax(1)
    score = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
    return [model.langs[k] if n else "und" for k, n in zip(best, size, strict=True)], np.where(size > 0, score, 0.0)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        lang, word, n = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def learn(docs: DataFrame, path: str, may_learn: Column | None = None, text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows with a label and ``may_learn``: at most max_rows / languages of each, those of the least hashes of their texts."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows if may_learn is None else rows.where(may_learn)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    kinds = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not kinds:
        return fit(path, {})
    share = F.lit(0)
    for lang, n in sorted(kinds.items()):
        share = F.when(F.col("lang") == lang, min(1_000_000, 2 * max_rows * 1_000_000 // (len(kinds) * n) + 1)).otherwise(share)
    h = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    ranked = rows.where(h < share).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(h, "text")))
    some = ranked.where(F.col("rank") <= max(1, max_rows // len(kinds))).select("lang", "text").mapInArrow(_count_batches, "lang string, word string, n bigint")
    counts: dict[str, Counter] = {}
    for lang, word, n in some.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        counts.setdefault(lang, Counter())[word] = int(n)
    return fit(path, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row; one narrow pass. The model is of the vocabulary's size."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        vocab, cache, known = Vocabulary(model.path), {}, [np.zeros((0, len(model.langs)), np.float32)]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in together(texts, TEXTS, CHARS):
                lang, score = predict_texts(model, vocab, texts[a:b], cache, known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang), pa.array(score)], ["_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)
