"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, decontaminate, language_id, line_dedup, quality_rules, simhash, suffix_dedup, toxicity, url_filter, warc
from tidelog.llm.queries import vocabulary

WORDS = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " ", "\n\n", "\x00", "a", "word " * 300, "ÄÖÜ straße\tx\x0by\x0cz\r\n", "x" * 5000, "日本語 テキスト", "same text here", "same text here"]


def frame(spark, texts, **extra):
    rows = [(i, t, "src", 7, "key") for i, t in enumerate(texts)]
    rows.append((None, "text of no one", "src", 7, "key"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint, key string").withColumn("id", F.lit(1)).withColumn("size", F.lit("s")).withColumn("_id", F.lit("clash"))


def none(spark):
    return frame(spark, []).where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- 1 ---------------------------------------------------------------------------


def toxic_data(n=300, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeioubdfgkl") for _ in range(r.randint(2, 7))) for _ in range(150)]
    texts, y = [], []
    for k in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        if k % 4 == 0:
            words[r.randrange(len(words))] = r.choice(["vilething", "nastyword", "horrid"])
        texts.append(" ".join(words))
        y.append(int(k % 4 == 0))
    return texts, y


def test_toxicity(spark):
    texts, y = toxic_data()
    docs = spark.createDataFrame([(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score(docs, model).collect()
    held = [(r["predicted"], y[r["doc_id"]]) for r in got if r["doc_id"] % 5 == 0]
    assert sum(p == v for p, v in held) / len(held) > 0.9
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s"))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(other, model).collect()} == {r["doc_id"]: r["score"] for r in got}
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    scores = {r["doc_id"]: r["score"] for r in odd}
    assert scores[10] == scores[11] and scores[0] == scores[1] == scores[2]
    assert toxicity.score(none(spark), model).count() == 0
    alone = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(docs, alone).collect()} == {0}
    assert toxicity.learn(none(spark), labels).thresholds == {"": 0.5}


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """A word that only few of many labelled texts have is learned, in one shard and in several."""
    r = random.Random(2)
    rows = [(i, " ".join(str(r.randrange(300)) for _ in range(8)) + f" {'vile' if i % 2 else 'fine'}{i % 2000 // 2}", i % 2) for i in range(9000)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").drop("toxic"), spark.createDataFrame([x[::2] for x in rows], "doc_id bigint, toxic int")
    seen = []
    begin = toxicity.begin
    monkeypatch.setattr(toxicity, "begin", lambda s, t: seen.append(t.tolist()) or begin(s, t))
    for shard in (8000, 1500):
        monkeypatch.setattr(toxicity, "SHARD", shard)
        model = toxicity.learn(docs, labels)
        got = {x["doc_id"]: x["predicted"] for x in toxicity.score(docs, model).collect()}
        assert sum(got[i] == y for i, _, y in rows) > 8900
    assert seen[0] == seen[1] and sum(seen[0]) > 6800  # four fifths of 9000


def test_toxicity_shuffles_texts_once(spark, monkeypatch):
    """What is written is dealt into shards already, each text with each label of its id."""
    made, cut = [], toxicity.cut
    monkeypatch.setattr(toxicity, "cut", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(toxicity, "SHARD", 30)
    texts, y = toxic_data(120)
    docs = spark.createDataFrame([*enumerate(texts), (5, "again"), (5, "again")], "doc_id bigint, text string")
    toxicity.learn(docs, spark.createDataFrame([*enumerate(y), (5, 0), (999, 1)], "doc_id int, toxic int"))
    found = made[-1]
    learned = found.where("not _kept").count()
    assert found.rdd.getNumPartitions() == round(learned / 30) > 1
    assert found.count() == 120 + 2 * 2 + 1 and found.where("_id = 5").count() == 6


def test_convolution_by_hand():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.TOTAL)).astype(np.float32), rng.normal(size=24).astype(np.float32), rng.normal(size=24).astype(np.float32), 0.1, {"": 0.5})
    texts = ["one two three four", "", "solo", "a b", "long " * 50 + "end"]
    for text, got in zip(texts, toxicity.Scorer(model)(texts), strict=True):
        rows = [model.table[list(toxicity.buckets(w))].sum(0) for w in toxicity.words_of(text)] or [np.zeros(toxicity.TOTAL)]
        rows += [np.zeros(toxicity.TOTAL)] * toxicity.PAD
        pooled = np.full(24, -np.inf)
        for p in range(len(rows) - toxicity.PAD):
            for w, width in enumerate(toxicity.WIDTHS):
                one = sum(rows[p + j][cols] for ww, j, cols in toxicity.COLUMNS if ww == width)
                pooled[8 * w : 8 * w + 8] = np.maximum(pooled[8 * w : 8 * w + 8], one)
        want = 1 / (1 + np.exp(-np.clip(np.maximum(pooled + model.bias, 0) @ model.out + model.const, -30, 30)))
        assert abs(got - want) < 1e-4


# -- 2 ---------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    r = random.Random(3)
    base = [" ".join(r.choice(["AB", "c", "dé", "e1"]) + str(r.randrange(50)) for _ in range(120)) for _ in range(8)]
    texts = list(ODD)
    for b in base:
        for _ in range(6):
            words = b.split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    want = {i: fingerprint(t) for i, t in enumerate(texts)} | {None: fingerprint("text of no one")}
    got = by_id(simhash.components(frame(spark, texts)))
    assert {k: int(v["fingerprint"], 16) for k, v in got.items()} == want
    ids = [i for i in want if i is not None]
    low = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            low[a] = min(low[b] for b in ids if bin(want[a] ^ want[b]).count("1") <= 2)
    assert {i: got[i]["component_id"] for i in ids} == low
    assert simhash.components(none(spark)).count() == 0


@pytest.mark.parametrize("cell", [1024, 16])
def test_trie_join_of_hot_blocks(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(cell)
    values = {r.getrandbits(64) for _ in range(50)}
    hot = r.getrandbits(64)
    for _ in range(300):
        v = hot
        for _ in range(r.randint(0, 5)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")).collect()
    unsign = {s: v for v, s in signed.items()}
    assert all(bin(unsign[e["u"]] ^ unsign[e["v"]]).count("1") for e in edges)

    def groups(pairs):
        top = {v: v for v in values}

        def find(a):
            while top[a] != a:
                a = top[a]
            return a

        for a, b in pairs:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
        return {v: find(v) for v in values}

    brute = [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2]
    assert groups([(unsign[e["u"]], unsign[e["v"]]) for e in edges]) == groups(brute)


def test_keep_one(spark):
    r = random.Random(9)
    words = [str(r.randrange(1000)) for _ in range(400)]
    text, near = " ".join(words), edits(words, set(r.sample(range(400), 6)), "x")
    assert shingle_jaccard(text, near) >= 0.8
    texts = ["clean words that stand alone here", text, near, text, "", None]
    kept = simhash.keep_one(frame(spark, texts), width=5)
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == [0, 1, 4]
    assert kept.columns == frame(spark, texts).columns and kept.where("doc_id is null").count() == 1


def test_keep_one_of_repeated_ids_and_rows(spark):
    r = random.Random(10)
    text, other, third = (" ".join(str(r.randrange(1000)) for _ in range(100)) for _ in range(3))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (2, other, "c"), (3, third, "d"), (None, third, "e"), (None, "alone here", "f"), (None, "alone here", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `my col` string")
    kept = simhash.keep_one(docs, width=5)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[3], rows[4], rows[6]])
    assert simhash.keep_one(docs.where("false"), width=5).count() == 0


def edits(words, places, mark):
    return " ".join(f"{mark}{k}" if k in places else w for k, w in enumerate(words))


def shingle_jaccard(s, t):
    return simhash.jaccard(s.encode(), t.encode(), 5)


def test_keep_one_finds_copies_beyond_the_bit_budget(spark):
    r = random.Random(11)
    texts = []
    for _ in range(30):
        words = [str(r.randrange(5000)) for _ in range(300)]
        texts += [" ".join(words), edits(words, set(range(10, 300, 60)), "x")]
    bits = lambda t: int(simhash.majority(np.array(h := simhash.shingle_hashes(t.encode(), 5), np.uint64), np.array([0]), np.array([len(h)]))[0])
    pairs = list(zip(texts[::2], texts[1::2], strict=True))
    assert all(shingle_jaccard(a, b) >= 0.8 for a, b in pairs) and sum((bits(a) ^ bits(b)).bit_count() > 2 for a, b in pairs) > 20
    kept = simhash.keep_one(frame(spark, texts), width=5)
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == list(range(0, 60, 2))


@pytest.mark.parametrize(("crowd", "pivots"), [(64, 8), (3, 2)])
def test_keep_one_leaves_no_two_copies(spark, monkeypatch, crowd, pivots):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    r = random.Random(12)
    words = [str(r.randrange(5000)) for _ in range(300)]
    texts = [edits(words, set(range(0, 8 * k, 8)), "x") for k in range(30) for _ in range(2)]  # a chain that drifts, each twice
    left, want = list(enumerate(texts)), []
    for i, t in left:
        if all(shingle_jaccard(t, texts[k]) < 0.8 for k in want):
            want.append(i)
    assert len(want) > 2 and shingle_jaccard(texts[0], texts[-1]) < 0.8
    kept = simhash.keep_one(frame(spark, texts), width=5)
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == want


def test_keep_one_takes_candidates_from_simhash(spark, monkeypatch):
    """Pairs at 0.8 share a key of their fingerprints, in small cells and in cells too large to be walked; unrelated texts share none."""
    r = random.Random(13)
    texts = []
    for _ in range(100):
        words = [str(r.randrange(5000)) for _ in range(300)]
        texts += [" ".join(words), edits(words, set(range(10, 290, 48)), "x")]
    pairs = [shingle_jaccard(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert all(0.8 <= x < 0.82 for x in pairs)
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node bigint, text binary")
    for cell in (1024, 1):
        monkeypatch.setattr(simhash, "CELL", cell)
        keys, prints = simhash.near_keys(docs, len(texts), 5, 0.8)
        held = {}
        for x in keys.collect():
            held.setdefault(x["node"], set()).add(x["key"])
        assert all(held[k] & held[k + 1] for k in range(0, 200, 2))
        if cell > 1:
            assert not any(held[a] & held[b] for a in held for b in held if a // 2 < b // 2)
    differ = {x["node"]: np.array(x["prints"], np.int64).view(np.uint64) for x in prints.collect()}
    assert all(np.bitwise_count(differ[k] ^ differ[k + 1]).sum() <= simhash.plan(200, 0.8)[-1] for k in range(0, 200, 2))


@pytest.mark.parametrize(("whole", "cell"), [(4096, 1024), (0, 1024), (0, 8), (4096, 8)])
def test_keep_one_in_tasks_and_in_rounds(spark, monkeypatch, whole, cell):
    """A group whose texts are mostly not copies of each other, settled by one task or in rounds."""
    monkeypatch.setattr(simhash, "WHOLE", whole)
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "CROWD", 8)
    r = random.Random(14)
    words = [str(r.randrange(5000)) for _ in range(200)]
    texts, want = [edits(words, set(r.sample(range(200), r.randint(0, 7))), f"x{k % 3}") for k in range(120)], []
    for i, t in enumerate(texts):
        if all(shingle_jaccard(t, texts[k]) < 0.8 for k in want):
            want.append(i)
    assert 20 < len(want) < 100
    kept = simhash.keep_one(frame(spark, texts), width=5)
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == want


def test_keep_one_settles_stretch_by_stretch(spark, monkeypatch):
    """A component too large for one task takes a few checkpoints, not rounds with dozens each, and the same texts stay."""
    made, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "WHOLE", 16)
    monkeypatch.setattr(simhash, "CROWD", 8)
    monkeypatch.setattr(simhash, "cut", lambda df: made.append(1) or cut(df))
    r = random.Random(14)
    words = [str(r.randrange(5000)) for _ in range(200)]
    texts, want = [edits(words, set(r.sample(range(200), r.randint(0, 7))), f"x{k % 3}") for k in range(120)], []
    for i, t in enumerate(texts):
        if all(shingle_jaccard(t, texts[k]) < 0.8 for k in want):
            want.append(i)
    kept = simhash.keep_one(frame(spark, texts), width=5)
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == want
    assert len(made) <= 14 + -(-120 // 16)


def test_components_of_few_links(spark):
    r = random.Random(15)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(2000)] + [(None, 3), (7, 7), (-5, 2**62)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    assert sorted(common.connected_components(frame, 5000).collect()) == sorted(common.connected_components(frame).collect())
    assert common.connected_components(frame.where("false"), 5000).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 3)] + [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {k: 100 for k in range(100, 161)} | {k: 1000 for k in range(1000, 1100)}
    assert common.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# -- 3 ---------------------------------------------------------------------------


def test_language_id(spark):
    r = random.Random(4)
    parts = {"en": "the ing tion er th and st wh".split(), "fr": "eau tion ré ouè la que ment aux".split(), "de": "schaft ein ung ch ü der ge heit".split()}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    path = vocabulary("piece_bpe_32k.model")
    model = language_id.learn(docs, path, F.col("doc_id") % 4 != 2)
    got = {x["doc_id"]: x for x in language_id.predict(docs.drop("lang"), model).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows if i % 4 == 2]
    assert sum(held) / len(held) > 0.95
    odd = by_id(language_id.predict(frame(spark, [*ODD, "123 !? _", "½ ²", "① ②", "Ⅷ", "y" * 3000]), model))
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 4, 12, 13, 14, 15)] == ["und"] * 8 and odd[16]["lang_pred"] in model.langs and all(0 <= x["score"] <= 1 for x in odd.values())
    assert odd[5]["lang_pred"] != "und" and odd[8]["lang_pred"] in model.langs
    assert language_id.predict(none(spark), model).count() == 0
    assert {x["lang_pred"] for x in language_id.predict(docs, language_id.learn(docs.where("false"), path)).collect()} == {"und"}

    vocab = language_id.Vocabulary(path)
    index = {p: k for k, p in enumerate(vocab.pieces)}
    for word in ("the", "schaftung", "réal", "漢字", "x" * 64, "internationalisation" * 6):
        for j in range(len(model.langs)):
            marked, alpha = language_id.START + word, [1.0]
            for t in range(1, len(word) + 2):
                alpha.append(sum(alpha[s] * (model.prob[index[marked[s:t]], j] if marked[s:t] in index else model.unknown[j] if t - s == 1 else 0) for s in range(max(0, t - vocab.max_piece), t)))
            assert abs(model.scores(vocab, [word])[0, j] - np.log(alpha[-1])) < 1e-3


# -- 4 ---------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "net/", "http://NET", "http://A.Net/x", "x://e.example.NET/en/1?q", "a://example.com/de/", "a://sub.example.com/de", "a://b.org/fr/\n9#z", "a://xnet/", "a://org/fr/1", "://example.net/en/x/y/z/1/2/3/4/5", "a://b?c/d", "a://h#f", "a://q.x/a/b/c/d/e/f/g/spam/1", "a://q.x/a/b/c/d/e/f/g/news/1"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(1, "", "c")], "page_id bigint, url string, host string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(df.collect())
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for x in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[x["page_id"]] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        assert x["verdict"] == (verdict or "allow")
    assert url_filter.judge(df.where("false")).count() == 0


def test_url_templates(spark):
    rows = [(f"a://h.x/spam/{i}", 1) for i in range(30)] + [(f"a://h.x/news/{i}", 0) for i in range(30)] + [(f"a://h.x/tag/word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]}", None) for i in range(60)] + [("a://h.x/spam/new", None), ("a://g.x/1", None)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(df, rules=(), label=F.col("bad")).collect()}
    assert {got[i]["verdict"] for i in range(30)} == {"block"} and {got[i]["verdict"] for i in range(30, 60)} == {"allow"}
    assert len({got[i]["template"] for i in range(60, 120)}) == 1 and got[121]["verdict"] == "allow"


def test_url_trees_have_no_depth_limit(spark):
    deep = "a://h.x/" + "/".join("abcdefghij")
    rows = [(f"{deep}/spam/{'xyz'[i % 3]}{i}", 1) for i in range(30)] + [(f"{deep}/news/{'xyz'[i % 3]}{i}", 0) for i in range(30)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=(), label=F.col("bad")).collect()}
    assert {got[i] for i in range(30)} == {"block"} and {got[i] for i in range(30, 60)} == {"allow"}


def test_url_verdict_reaches_unlabelled_pages(spark):
    rows = [(f"a://h.x/spam/{i}", 1 if i < 100 else None) for i in range(130)] + [(f"a://h.x/news/{i}", 0 if i < 100 else None) for i in range(130)]
    rows += [(f"a://g.x/spam/{i}", 1 if i < 20 else None) for i in range(200)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=(), label=F.col("bad")).collect()}
    assert {got[i] for i in (*range(130), *range(260, 460))} == {"block"} and {got[i] for i in range(130, 260)} == {"allow"}


# -- 5 ---------------------------------------------------------------------------


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), bpe.WordBpe(path, cache_words=50)
    r = random.Random(1)
    letters = "aAbBzZ éÉßΣςσ İıſḰ̈'sStT'll 019²½ \t\n\r  \x1c\x85!?<|>$%漢字🙂👍🏽ﬁǅ"
    texts = [*ODD, "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "aaaaaaaaaaa", "it's we'll I'M 12345"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert mine.encode(t or "") == want
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)
    got = by_id(bpe.digests(frame(spark, texts[:200]), path))
    whole = by_id(bpe.encode(frame(spark, texts[:200]), path))
    for i, t in enumerate(texts[:200]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert (whole[i]["ids"], whole[i]["decoded"]) == (ids, said)
    assert bpe.digests(none(spark), path).count() == 0


# -- 6 ---------------------------------------------------------------------------


def local_score(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, now[-1] - 1))
        row, best = now, max(best, *now)
    return best


def test_decontaminate(spark):
    r = random.Random(6)
    vocab = [f"w{k}" for k in range(400)] + ["the", "of"] * 40
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(r.randint(15, 50)) for _ in range(12)] + [["one", "two"], []]
    texts = list(ODD)
    for k in range(60):
        words = say(r.randint(0, 150))
        if k % 2:
            item = list(items[k % 12])
            for _ in range(len(item) * (k % 5) // 10):
                p, kind = r.randrange(len(item)), r.random()
                item[p : p + 1] = [[], ["new"], [item[p], "more"]][int(kind * 3)]
            at = r.randint(0, len(words))
            words[at:at] = item
        texts.append(" ".join(words).upper() if k % 3 else ", ".join(words))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None)], "item_id bigint, text string")
    docs = frame(spark, texts)
    want = {}
    for i, t in enumerate(texts):
        words = decontaminate.words_of(t)
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for j, item in enumerate(items):
            shared = grams & {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
            if shared and (s := local_score(item, words) / len(item)) >= 0.6:
                want[i, j] = round(s, 9)
    got = {(x["doc_id"], x["item_id"]): round(x["score"], 9) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 20
    blocks = {(x["doc_id"], x["item_id"]): round(x["score"], 9) for x in decontaminate.contaminated(docs, bench, block=60).collect()}
    assert blocks == want
    odd = docs.select("doc_id", "text", F.lit(1).alias("my col"), F.lit(2).alias("a.b"))
    assert decontaminate.clean(odd, bench).columns == odd.columns
    kept = decontaminate.clean(docs, bench)
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})
    assert kept.columns == docs.columns
    assert decontaminate.contaminated(none(spark), bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_decontaminate_finds_an_edit_in_any_number_of_documents(spark):
    r = random.Random(61)
    item = [f"item{k}" for k in range(15)]
    copy = [f"new{k}" if k in (3, 9, 13) else w for k, w in enumerate(item)]  # one run of five words is left
    texts = [" ".join([*(str(r.randrange(1000)) for _ in range(20)), *copy, str(i)]) for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = decontaminate.contaminated(frame(spark, texts), bench).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(40)) and {x["score"] for x in got} == {0.6}
    assert [x["doc_id"] for x in decontaminate.clean(frame(spark, texts), bench).collect()] == [None]


def test_decontaminate_misses_no_alignment(spark):
    r = random.Random(62)
    vocab = [f"w{k}" for k in range(60)]
    items = [[r.choice(vocab) for _ in range(n)] for n in range(5, 41)]
    texts = []
    for k in range(400):
        words = list(items[k % 36])
        if k < 36:
            words[4::5] = ["new"] * len(words[4::5])
        elif k < 72:
            words[len(words) // 2] = "new"
        for _ in range(len(words) * (k // 72) // 10):
            p = r.randrange(len(words))
            words[p : p + 1] = r.choice([[], ["new"], [words[p], "more"], [r.choice(vocab), words[p]]])
        texts.append([r.choice(vocab) for _ in range(r.randint(0, 30))] + words + [r.choice(vocab) for _ in range(r.randint(0, 30))])
    want = {(i, j): round(s, 9) for i, t in enumerate(texts) for j, item in enumerate(items) if (s := local_score(item, t) / len(item)) >= 0.6 - 1e-9}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert sum(not grams(texts[i]) & grams(items[j]) for i, j in want) > 20
    block = decontaminate.Items([(j, " ".join(w)) for j, w in enumerate(items)])
    assert {(k, j): round(s, 9) for k, j, s, *_ in decontaminate.matches(block, [" ".join(t) for t in texts])} == want


# -- 7 ---------------------------------------------------------------------------


def test_quality_statistics(spark):
    r = random.Random(7)
    texts = ODD + ["\n".join(r.choice(["a b c", "a b c d", "# x", "", "Q!! $"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    got = by_id(quality_rules.apply(frame(spark, texts), quality_rules.DecisionList()))
    for i, t in enumerate(texts):
        words = re.findall(WORDS, t or "")
        times = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k in range(len(words) - 2) for j in range(3) if times[tuple(words[k : k + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if re.search(WORDS, x)]
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert x["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and x["kept"] == (not x["base_failed"])
    assert quality_rules.apply(none(spark), quality_rules.DecisionList()).count() == 0


def test_quality_rules_learn(spark):
    r = random.Random(8)
    rows, y = [], []
    for i in range(400):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(80)]
        bad = i % 5 == 0
        if bad and i % 2:
            words = [w + "$$" for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        y.append((i, int(not bad) if i % 97 else int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rules = quality_rules.learn(docs, spark.createDataFrame([*y, (None, 0), (3, None)], "doc_id bigint, quality int").where("doc_id is null or doc_id % 3 > 0"))
    got = {x["doc_id"]: x["kept"] for x in quality_rules.apply(docs, rules).collect()}
    assert rules.rules and sum(got[i] == (i % 5 != 0) for i in got) / len(got) > 0.97
    extra = docs.withColumn("my col", F.lit(1)).withColumn("n_words", F.lit("clash")).withColumn("lang", F.lit(None).cast("string"))
    kept = quality_rules.filter_documents(extra, rules)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, k in got.items() if k) and kept.columns == extra.columns
    assert quality_rules.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int")).rules == []


# -- 8 ---------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(r, text, most, least=8):
    b = list(text)
    for _ in range(r.randint(0, most)):
        k, o = r.randrange(len(b)), r.random()
        if o < 0.4:
            b[k] = r.choice("abxé")
        elif o < 0.7 and len(b) > least:
            del b[k]
        else:
            b.insert(k, r.choice("abé"))
    return "".join(b)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    r = random.Random(threshold)
    pairs = [(a := "".join(r.choice("abé") for _ in range(r.randint(8, 30))), edited(r, a, 4)) for _ in range(150)]
    df = spark.createDataFrame(pairs, "s string, t string").where(F.abs(F.char_length("s") - F.char_length("t")) <= threshold)
    for x in df.select("s", "t", line_dedup.banded_distance(F.col("s"), F.col("t"), threshold).alias("d"), line_dedup.edit_distance(F.col("s"), F.col("t"), threshold).alias("e")).collect():
        assert min(x["d"], threshold + 1) == min(x["e"], threshold + 1) == min(distance(x["s"], x["t"]), threshold + 1)


def groups_of(n, pairs):
    low = list(range(n))
    for _ in range(n):
        before = list(low)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return low
    return low


def edit_links(spark, lines, threshold, crowd):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id bigint, line string")
    keyed = df.select("id", line_dedup.line_keys(F.col("line"), F.char_length("line"), threshold).alias("keys"))
    found, _ = line_dedup.links(keyed, lambda ids: df.join(ids, "id"), threshold, crowd)
    return found


@pytest.mark.parametrize(("threshold", "crowd"), [(1, 1000), (1, 2), (2, 3), (3, 1000)])
def test_edit_join(spark, threshold, crowd):
    r = random.Random(threshold)
    lines = sorted({edited(r, r.choice(["the quick brown fox jumps over", "lorem ipsum dolor sit amet con"]), 3, 22) for _ in range(130)})
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= threshold}
    got = {(x["a"], x["b"]) for x in edit_links(spark, lines, threshold, crowd).collect()}
    assert got <= want and groups_of(len(lines), got) == groups_of(len(lines), want)
    assert crowd < 1000 or got == want


def test_edit_join_is_linear_in_a_group(spark):
    base = "a line that is the same in all but a single place of it"
    at = [base[:20] + chr(0x4E00 + k) + base[20:] for k in range(600)]
    lines = [base, *at, *(base[:20] + "zz" + base[21:] + chr(0x4E00 + k) for k in range(200)), *(x[:19] + x[20:] for x in at[:100])]
    pairs = [(i, j) for i, x in enumerate(lines) for j in range(i) if (y := lines[j]) and abs(len(x) - len(y)) <= 1 and distance_of_one(x, y)]
    found = edit_links(spark, lines, 1, 8).collect()
    assert groups_of(len(lines), [(x["a"], x["b"]) for x in found]) == groups_of(len(lines), pairs)
    assert len(pairs) > 100_000 and len(found) < 10 * len(lines)


def distance_of_one(x, y):
    k = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    return x[k + (len(x) >= len(y)) :] == y[k + (len(y) >= len(x)) :]


def test_line_dedup(spark):
    r = random.Random(5)
    pool = ["a short line", "", "  ", "a line that is long enough to compare", "another line that is also long enough"]
    texts = [*ODD, "dup line\ndup line\n\n dup line \r"]
    for _ in range(30):
        lines = [r.choice(pool) for _ in range(r.randint(0, 5))]
        texts.append("\n".join(edited(r, x, 1) if len(x) > 30 and r.random() < 0.4 else x for x in lines))
    docs = frame(spark, texts)
    seen = {}
    lines = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in [*enumerate(texts), (10**9, "text of no one")] for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    for i, k, x in lines:
        seen.setdefault(x, (i, k))
    root = {x: x for x in seen}
    for _ in seen:
        for x in seen:
            near = [y for y in seen if x == y or (min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1)]
            root[x] = min((root[y] for y in near), key=lambda y: seen[y])
    gone = {}
    for i, k, x in lines:
        if seen[root[x]] != (i, k):
            gone.setdefault(i, []).append(k)
    got = by_id(line_dedup.report(docs))
    assert {i: got[i]["removed"] for i in range(len(texts))} == {i: gone.get(i, []) for i in range(len(texts))}
    assert len(got) == len(texts) + 1 and got[None]["removed"] == []
    clean = by_id(line_dedup.remove(docs))
    assert line_dedup.remove(docs).columns == docs.columns
    for i, t in enumerate(texts):
        assert clean[i]["text"] == (t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))
    assert line_dedup.report(none(spark)).count() == 0


def test_line_dedup_of_odd_columns(spark):
    docs = spark.createDataFrame([("b", "one line\nanother line", 1, 2, 3), ("a", "one line", 1, 2, 3), (None, "another line", 1, 2, 3)], "doc string, `my text` string, removed int, `of.x y` int, _of int")
    got = line_dedup.remove(docs, "doc", "my text")
    assert got.columns == docs.columns and got.schema["removed"].dataType == docs.schema["removed"].dataType
    assert {x["doc"]: x["my text"] for x in got.collect()} == {"a": "one line", "b": "another line", None: ""}


# -- 9 ---------------------------------------------------------------------------


def without_repeats(texts):
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                hit[k : k + 200] = b"\1" * 200
        out.append((len(t), sum(hit), sum(1 for x in bytes(hit).split(b"\0") if x), hashlib.sha256(bytes(b for b, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("cell", [4096, 6])
def test_suffix_dedup(spark, monkeypatch, cell):
    monkeypatch.setattr(suffix_dedup, "CELL", cell)
    monkeypatch.setattr(suffix_dedup, "FLAT", 4096)
    r = random.Random(5)
    base = "".join(r.choice("abc dé") for _ in range(3000))
    texts = [*ODD, "a" * 5000, "ab" * 700, "q" * 199, base + "x" * 300 + base]
    for _ in range(150):
        o = r.randint(0, 2000)
        texts.append(base[: r.randint(0, 500)] + "".join(r.choice("xyzw") for _ in range(r.randint(0, 30))) + base[o : o + r.randint(150, 600)])
    want = without_repeats([(t or "").encode() for t in [*texts, "text of no one"]])
    got = by_id(suffix_dedup.digests(frame(spark, texts).repartition(3)))
    for i, w in enumerate(want):
        x = got[i if i < len(texts) else None]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == w
    assert suffix_dedup.digests(none(spark)).count() == 0


# -- 10 --------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = [(5, "http://a/é x", "same"), (3, "http://b", "same"), (9, None, "same"), (7, "u", None), (8, "u\r\nX: y", ""), (2, "u", "WARC/1.1\r\n\r\n" * 50), (None, "n", "same"), (None, "n", "only"), (3, "http://b", "same"), (1, "big", "é" * 3_000_000)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id bigint, url string, html string, payload string").repartition(3)
    folder = f"file://{tmp_path}/w"
    index = warc.write(df, folder)
    assert index.count() == len(pages)
    got = warc.read(index, folder).collect()
    payloads = {(p[2] or "").encode() for p in pages}
    first = {x: min(p[0] for p in pages if p[0] is not None and (p[2] or "").encode() == x) for x in payloads if x != b"only"}
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        refers = None if raw not in first or first[raw] == i else first[raw]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers, raw if refers is None else b""] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got) == want
    some = warc.read(index.where("page_id = 2"), folder).collect()
    assert [r["page_id"] for r in some] == [2]
    large = warc.read(warc.write(df, f"file://{tmp_path}/v", min_bytes=5), f"file://{tmp_path}/v")
    assert large.where("record_type = 'revisit'").count() == 0
    assert warc.read(warc.write(df.where("false"), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


def test_read_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.MAX_GAP, 5), ("a", 200_000, 5), ("b", 0, warc.MAX_READ), ("b", warc.MAX_READ, 1)]
    assert list(warc.ranges(rows)) == [(0, 3), (3, 4), (4, 5), (5, 6)] and list(warc.ranges([])) == []
