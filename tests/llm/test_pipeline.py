import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .cases import prose
from .test_near_dup import brute
from .test_toxicity import labelled

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_decision_takes_effect(spark, tmp_path):
    rng = random.Random(8)
    train = labelled(400)
    docs = [(d, t) for d, t, _ in train]
    labels = [(d, 1, y) for d, _, y in train]
    toxic = {d for d, _, y in train if y}
    copies = [(1000 + d, t + " end") for d, t, y in train[:60] if not y]
    items = [(i, prose(3000 + i, 25, 10**6)) for i in range(10)]
    leaks = [(2000 + i, f"{prose(4000 + i, 200, 10**6)} {t} {prose(5000 + i, 80, 10**6)}") for i, t in items]
    private = [(3000 + i, f"{prose(6000 + i, 40, 10**6)} write to a{i}@b.example.org today") for i in range(20)]
    docs += copies + leaks + private + [(4000, None), (4001, "")]
    rng.shuffle(docs)
    tables(spark, str(tmp_path), docs, labels, items)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    clean = [(d, t) for d, t in docs if d not in toxic]
    of = brute(clean, 5, 80, 100)
    want = {d: t for d, t in clean if of[d][2] and not 2000 <= d < 3000}
    assert len(set(want) ^ set(got)) <= 3  # the first stage is learnt
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in set(want) & set(got):
        text = (want[d] or "").replace(f"a{d - 3000}@b.example.org", "[EMAIL]")
        assert got[d] == tokenizer.encode(text, add_special_tokens=False).ids


def test_stages_return_documents(spark, tmp_path):
    tables(spark, str(tmp_path), [(1, "a b c"), (1, "a b c"), (None, None), (2, "x")], [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() == 4
    assert len(corpus_pipeline.STAGES) == 5
    tables(spark, str(tmp_path / "empty"), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
