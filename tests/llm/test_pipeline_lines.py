"""The pipeline's line dedup where copies fill a source."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_of_a_document_are_one_page(spark):
    copy = "a clean line\nand another clean line"
    texts = [copy] * 20 + [f"menu\nown line {k}" for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "site", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: copy if i < 20 else f"own line {i - 20}" for i in range(60)}
