import random

import public_tokenizers
import pytest
import sentencepiece as library

import corpus_pipeline
from leontia.llm import mixing, pii, toxicity


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    clean = [" ".join(word() for _ in range(r.randrange(30, 90))) for _ in range(120)]
    texts = list(clean)
    texts += [t + " tail" for t in clean[:10] for _ in range(2)]  # near copies
    texts += [" ".join([*t.split()[:20], "grobble", *t.split()[20:], "snarkwit", "grobble"]) for t in [" ".join(word() for _ in range(60)) for _ in range(30)]]
    texts += [f"{' '.join(word() for _ in range(40))} bob@mail{i}.example.com" for i in range(5)] + ["", None]
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, 1, int(140 <= i < 170)) for i in range(170)]
    docs(texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_stages_and_run(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, path))
        assert docs.columns == columns
        seen.append(sorted(r.doc_id for r in docs.collect()))
    kept, once, clean, mixed = seen
    assert kept == [i for i in range(len(texts)) if not 140 <= i < 170]
    assert once == [i for i in kept if not 120 <= i < 140]
    assert clean == once and sorted(set(mixed)) == once
    bodies = {r.doc_id: r.text for r in docs.collect()}
    assert not any("bob@" in (t or "") for t in bodies.values()) and bodies[0] == texts[0]
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in out) == mixed
    lib = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.ids == lib.encode(bodies[r.doc_id] or "") and r.decoded == (bodies[r.doc_id] or "") for r in out)


def test_mixing_keeps_null_ids(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    some = docs.where("doc_id < 100 OR text IS NULL").selectExpr("IF(doc_id % 10 = 0 OR text IS NULL, NULL, doc_id) AS doc_id", *docs.columns[1:])
    mixed = corpus_pipeline.mixing_stage(spark, some, path)
    key = lambda r: (r.doc_id or -1, r.text or "")
    assert mixed.columns == docs.columns and {key(r) for r in mixed.collect()} == {key(r) for r in some.collect()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "pii", "mixing", "sentencepiece"]
    assert toxicity.THRESHOLD == 0.3 and pii.KINDS and mixing.DOMAINS
