"""The pipeline's stages on a small corpus, each on what its predecessor kept, held against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from tidelog.llm import bpe, simhash
from tidelog.llm.queries import vocabulary


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(1)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = say(30)
    docs = [(i, "\n".join(say(30) for _ in range(4))) for i in range(60)]
    docs += [(100, "too short"), (101, None), (102, "same words again and again " * 30)]
    docs.append((103, docs[5][1] + "\n" + say(20)))  # its first lines are those of 5
    text = say(300)
    changed = set(r.sample(range(300), 4))
    docs += [(104, text), (105, " ".join("changed" if k in changed else w for k, w in enumerate(text.split(" "))))]
    assert simhash.jaccard(docs[-2][1].encode(), docs[-1][1].encode(), 5) >= 0.8
    docs.append((106, say(40) + " " + item + " " + say(40)))
    docs += [(200 + i, "\n".join(" ".join(w + "$$$" for w in say(30).split(" ")) for _ in range(3))) for i in range(30)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(200 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x["doc_id"]: x for x in now.collect()}
        assert name == "bpe_encoding" or now.columns == columns
    clean = set(range(60))
    assert set(kept["quality_rules"]) == clean | {103, 104, 105, 106}
    assert set(kept["line_dedup"]) == set(kept["quality_rules"])
    assert kept["line_dedup"][103]["text"] == docs[63][1].split("\n")[-1] and kept["line_dedup"][7]["text"] == docs[7][1]
    assert set(kept["simhash_near_dedup"]) == clean | {103, 104, 106}
    assert set(kept["benchmark_decontamination"]) == clean | {103, 104}
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for i, x in kept["bpe_encoding"].items():
        assert list(x["token_ids"]) == library.encode(kept["benchmark_decontamination"][i]["text"], add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["bpe_encoding"])


def test_encode_has_digests(spark):
    texts = ["some words here", "Ünï 漢字 <|x|>", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {x["doc_id"]: x for x in bpe.digests(docs, vocabulary("word_bpe_49k.json")).collect()}
    got = corpus_pipeline.encode(spark, docs, "").collect()
    assert len(got) == len(texts)
    for x in got:
        assert [x[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")] == [want[x["doc_id"]][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")]
        assert len(x["token_ids"]) == x["n_tokens"]
