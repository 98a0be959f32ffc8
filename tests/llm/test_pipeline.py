"""The pipeline's stages one by one on a small table."""

import random

import corpus_pipeline
from placelens.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids and out.count() == len(left)
        assert out.where("text is not null and n_chars <> length(text)").count() == 0 or name == "quality_rules"
        docs, ids = out, left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == ids
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, equal texts, an empty text and a column that a stage uses too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    own = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [(k, t, "en", f"host{k % 2}", len(t), "clash") for k, t in enumerate(own)]
    rows += [rows[0], (20, own[1], None, None, None, None), (None, own[2], "en", "host0", 1, ""), (21, None, "en", "host0", 0, ""), (22, "", "en", None, 0, ""), (None, None, None, None, None, None), (23, "w " * 30_000 + own[3], "en", "host1", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "words"], name
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.collect())
    # no words and one repeated word fail the rules; a whole text that repeats another goes line by line, and of the documents
    # that are left without words the least id stays; a null id stays, repeated rows are one document
    assert set(kept) <= {(False, 0), *((True, k) for k in (*range(6), 20))} and {k for _, k in kept} >= set(range(6))
    assert docs.where("doc_id = 20 and text <> ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {(r.doc_id is not None, r.doc_id or 0) for r in packed.collect()} == set(kept)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, words string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF))
        assert docs.count() == 0 and docs.columns[-1] == "words", name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
