"""Quality rules: a learned decision list over text statistics.

``text_statistics`` measures whole texts in Arrow batches. ``learn`` grows and
prunes conjunctions of thresholds by sequential covering on labelled rows (a
bounded sample, ``MAX_LABELLED``). ``DecisionList.verdict`` turns the rules into
one ordered Spark conditional expression, so applying them is a projection.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; texts of any length are measured whole; repeated rows are measured
each for itself; rows whose label is null teach nothing; with no labelled rows,
or only one class of them, the list is empty and the base rule decides alone.
Only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import packed, quoted

MIN_WORDS = 50
MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words")
#: name -> (numerator, denominator): the ratios that rules may test.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
}
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


def measure(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATISTICS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    n, repeated, number = len(words), 0, defaultdict(count().__next__)
    ids = np.fromiter((number[w] for w in words), np.int64, n)
    if n > 3:
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), n_dup, repeated,
        n_lines, len(raw.translate(None, _NOT_UPPER)), text.count("!") + text.count("?"), len(number),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_id", *STATISTICS]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = [measure(t.as_py()) for t in part.column(1)]
            cols = np.array(rows, np.int64).reshape(-1, len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, *STATISTICS) for every row; one narrow pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = out.mapInArrow(_measure_batches, f"_id {kind}, " + ", ".join(f"{s} bigint" for s in STATISTICS))
    return out.withColumnRenamed("_id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject if every (ratio, is_above, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            ratio = _ratio(name)
            out = out & ((ratio > F.lit(at)) if above else (ratio <= F.lit(at)))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.tests:
            out &= (x[name] > at) if above else (x[name] <= at)
        return out


def _ratio(name: str) -> Column:
    over, under = RATIOS[name]
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


def ratios(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: stats[a].astype(float) / np.maximum(stats[b], 1).astype(float) for k, (a, b) in RATIOS.items()}


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """True to keep: the first rule that holds rejects, else the document stays."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def fired(self) -> Column:
        """The position of the rule that rejects, else null."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules))):
            out = F.when(rule.column(), F.lit(k)).otherwise(out)
        return out


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int, cuts: int) -> list[tuple[str, bool, float]]:
    tests: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < max_tests:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n0 or not p0:
            break
        best = (1e-9, None)
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            edges = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)), np.quantile(v[b], np.linspace(0, 1, cuts))]))
            at = (edges[1:] + edges[:-1]) / 2
            if not len(at):
                continue
            below_p = np.searchsorted(np.sort(v[b]), at, "right")
            below_n = np.searchsorted(np.sort(v[~b]), at, "right")
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                gain = _gain(p0, n0, p.astype(float), n.astype(float))
                if gain[k := int(gain.argmax())] > best[0]:
                    best = (gain[k], (name, above, float(at[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= Rule((best[1],), 0).holds(x)
    return tests


def fit(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 16, max_tests: int = 4, cuts: int = 33, least_precision: float = 0.9, least_covered: int = 4, seed: int = 7) -> DecisionList:
    """Sequential covering: grow on two thirds, prune on the rest, drop what the rule covers, go on."""
    out, left = DecisionList(), np.ones(len(bad), bool)
    third = np.random.default_rng(seed).integers(0, 3, len(bad))
    while len(out.rules) < max_rules and (left & bad).sum() >= least_covered:
        take = lambda m: {k: v[m] for k, v in x.items()}
        growing, pruning = left & (third > 0), left & (third == 0)
        tests = _grow(take(growing), bad[growing], max_tests, cuts) if (growing & bad).any() else []
        if not tests:
            break
        px, pb = take(pruning), bad[pruning]

        def worth(k: int) -> float:
            hit = Rule(tuple(tests[:k]), 0).holds(px) if len(pb) else np.zeros(0, bool)
            p, n = int((hit & pb).sum()), int((hit & ~pb).sum())
            return (p - n) / (p + n) if p + n else -1.0

        size = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(tests[:size]), 0)
        hit = rule.holds(x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        precision = (p + 1) / (p + n + 2)
        if p < least_covered or precision < least_precision:
            break
        out.rules.append(Rule(rule.tests, precision))
        left &= ~hit
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Fits on at most ``max_labelled`` labelled rows, picked by a hash of their ids; label 0 is bad.

    Base-rule failures teach nothing, as no rule is asked about them. The ids
    picked and their statistics are all that reaches the driver.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked.select("_id").distinct()), "_id", "left_semi")
    some = some.groupBy("_id").agg(F.min("_text").alias("_text"))  # one text for an id, so the rows learned from are bounded
    rows = text_statistics(some, "_id", "_text").join(picked, "_id").where(~base_failed()).select(*STATISTICS, "_label", "_id").toPandas().sort_values(["_id", "n_words"])
    if rows.empty:
        return DecisionList()
    return fit(ratios({s: rows[s].to_numpy() for s in STATISTICS}), rows["_label"].to_numpy() == 0)


def apply(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, kept and the rule that fired, for every row."""
    stats = text_statistics(docs, id_col, text_col)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.verdict())).withColumn("rule", F.when(~F.col("base_failed"), rules.fired()))


def filter_documents(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; ids play no part."""
    rows = docs.select(packed(docs).alias("_row"), F.col(quoted(text_col)).alias("_text"))
    schema = T.StructType([rows.schema["_row"], *(T.StructField(s, T.LongType()) for s in STATISTICS)])
    out = rows.mapInArrow(_measure_rows, schema)
    return out.where(~base_failed() & rules.verdict()).select("_row.*")


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _measure_batches(batches):
        yield pa.RecordBatch.from_arrays(batch.columns, ["_row", *STATISTICS])
