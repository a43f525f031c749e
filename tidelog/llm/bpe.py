"""BPE encoding and decoding with a public vocabulary, in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each round ranks
neighbouring pairs by binary search over the sorted pair keys, takes the lowest
rank of every word, and merges all its occurrences from the left; pairs beside a
merge are ranked anew, and finished words leave the array. A bounded cache keeps
the ids of the chunks between blanks from batch to batch (no word of the
vocabulary's pattern holds a blank); documents are gathered from it.

Defined results: null is the empty text, with no tokens and an empty decoding;
texts of any length are encoded whole; special tokens written in a text become
their ids; code points that the vocabulary lacks are spelt in bytes, which it
has in full. Equal rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks between blanks whose ids a Python worker remembers; beyond it the memory starts afresh.
CACHE_WORDS = 400_000
#: Characters of text that are encoded together.
TOGETHER = 2_000_000


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file of lower-cased words with an end-of-word suffix."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.size = max(self.tokens) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a, b = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = a * self.size + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int64)
        letters = byte_letters()
        self.plain = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.lines = regex.compile(split["pattern"]["Regex"] + "|\n").findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.cache_words = cache_words
        self._start()

    def _start(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.at = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        """The words and special tokens of a text, normalised."""
        out: list[str] = []
        for k, part in enumerate(self.parts(text) if any(t in text for t in self.special) else [text]):
            if k % 2:
                out.append(part)
            elif part:
                out += self.words(self.normal(part))
        return out

    @staticmethod
    def normal(text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ranks[at], len(self.ranks))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.plain[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = len(self.ranks)
        rank = np.full(len(sym), never)
        stale = np.ones(len(sym), bool)
        while len(sym):
            inner = np.r_[word[1:] == word[:-1], False]
            rank[~inner] = never
            look = np.flatnonzero(stale & inner)
            rank[look] = self._rank(sym[look], sym[look + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            over = np.repeat(lowest == never, sizes)
            if over.any():
                done.append((word[over], sym[over]))
                sym, word, rank = sym[~over], word[~over], rank[~over]
                if not len(sym):
                    break
                keep = lowest != never
                lowest, sizes = lowest[keep], sizes[keep]
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (at[1:] == at[:-1] + 1).any():  # x x x: of a run of hits every other one from the left
                first = np.r_[True, at[1:] != at[:-1] + 1]
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[np.maximum(at - 1, 0)] = True
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, rank, stale = sym[stay], word[stay], rank[stay], stale[stay]
        if not done:
            return sym, np.zeros(0, np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def learn(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks (texts without blanks) into the cache."""
        found = self.lines(self.normal("\n".join(chunks)))
        cut = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found))) if len(chunks) > 1 else []
        split = [found[a:b] for a, b in zip([0, *(k + 1 for k in cut)], [*cut, len(found)], strict=True)]
        for k, c in enumerate(chunks):
            if "<" in c and any(t in c for t in self.special):
                split[k] = self.split(c)
        number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split))) if w not in self.special}
        number = dict(zip(number, range(len(number)), strict=True))
        tokens, size = self.merge(list(number))
        for t, i in self.special.items():
            number[t], tokens, size = len(size), np.append(tokens, i), np.append(size, 1)
        words = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        found = tokens[spans(np.cumsum(size)[words] - size[words], size[words])]
        ends = np.r_[0, np.cumsum(size[words])][np.cumsum([len(s) for s in split])]
        used = self.at[-1]
        while used + len(found) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[used : used + len(found)] = found
        self.index.update(zip(chunks, range(len(self.at) - 1, len(self.at) - 1 + len(chunks)), strict=True))
        self.at = np.r_[self.at, used + ends]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if len(self.index) > self.cache_words:
            self._start()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if new := set(chain.from_iterable(split)).difference(self.index):
            self.learn(list(new))
        get = self.index.__getitem__
        chunk = np.fromiter(map(get, chain.from_iterable(split)), np.int64)
        size = (self.at[1:] - self.at[:-1])[chunk]
        ends = np.cumsum([len(s) for s in split])
        total = np.r_[0, np.cumsum(size)][ends]
        return self.flat[spans(self.at[chunk], size)], np.diff(np.r_[0, total])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces, as the file names no decoder; unknown ids are skipped."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start .. start + size - 1 of every span, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Speller:
    """Writes many ids at once: the bytes of each id's string and one space, gathered from one table."""

    def __init__(self, strings: list[str]):
        raw = [s.encode() + b" " for s in strings]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def write(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The strings of each run of ids, joined by single spaces, in UTF-8."""
        size = self.size[ids]
        out = memoryview(self.data[spans(self.start[ids], size)].tobytes())
        ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(2)
def loaded(path: str) -> tuple[WordBpe, Speller, Speller]:
    """One encoder for each Python worker and file, and the writers of its ids and of its tokens."""
    bpe = WordBpe(path)
    return bpe, Speller([str(i) for i in range(bpe.size)]), Speller([bpe.tokens.get(i, "") for i in range(bpe.size)])


def _together(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[list[str]]:
    for at in range(0, batch.num_rows, 500):
        yield from _together([t or "" for t in batch.column(k).slice(at, 500).to_pylist()])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded) for every row: the general interface."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _, said = loaded(path)
        for batch in batches:
            at = 0
            for texts in _texts(batch, 1):
                ids, n = bpe.encode_batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists, pa.array([str(d, "utf-8") for d in said.write(ids, n)], pa.string())], ["_id", "ids", "decoded"])
                at += len(texts)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for every row; one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, digits, said = loaded(path)
        sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts])
        for batch in batches:
            at = 0
            for texts in _texts(batch, 1):
                ids, n = bpe.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), sha(digits.write(ids, n)), sha(said.write(ids, n))], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
