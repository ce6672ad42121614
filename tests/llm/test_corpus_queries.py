"""Queries against SQL, the pipeline's contract, and awkward inputs for every operator."""

import pytest
from oracle import rows_of_duck, rows_of_spark

import corpus_pipeline
from siftwork.llm import fingerprint, html_extract, language, mixing, neardup, packing, queries, secret_scan, sharding, substring, topk

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of_spark(queries.queries()[name](spark, sf_dir)) == rows_of_duck(queries.oracle_sql()[name], sf_dir)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == DOCUMENT_COLUMNS, name
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > 0
    assert rows_of_spark(corpus_pipeline.run(spark, sf_dir)) == rows_of_spark(docs)


DOC_OPERATORS = {
    "mix": lambda d: mixing.mix_sources(d),
    "pack": lambda d: packing.pack_documents(d),
    "fingerprints": lambda d: fingerprint.fingerprints(d),
    "language": lambda d: language.keep_identified(d, language.TextModel.fit([("en", "alpha beta gamma word"), ("de", "straße über ähnlich")])),
    "passages": lambda d: substring.repeated_passages(d),
    "sharding": lambda d: sharding.shard_documents(d, shards=2),
    "secrets": lambda d: secret_scan.redact_secrets(d, secret_scan.fit_secret_model(d)),
    "findings": lambda d: secret_scan.find_secrets(d, secret_scan.fit_secret_model(d)),
    "near": lambda d: neardup.near_duplicates(d),
    "drop near": lambda d: neardup.drop_near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(DOC_OPERATORS))
def test_awkward_and_empty_documents(odd_docs, no_docs, name):
    assert DOC_OPERATORS[name](odd_docs).collect() is not None
    assert DOC_OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", ["mix", "language", "secrets", "drop near"])
def test_extra_columns_stay(odd_docs, name):
    """Each under its own name, or a numbered one where the operator makes a column of that name."""
    out = DOC_OPERATORS[name](odd_docs).columns
    assert len(set(out)) == len(out) == len(odd_docs.columns) + (name == "mix")


def test_awkward_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a.de/x", "<p>Ein Satz, und noch einer.</p>", 1), (1, None, None, 2), (None, "::", "", 3), (2, "u", "<" * 1000, 4)], "page_id long, url string, html string, content int")
    assert html_extract.extract_pages(pages).count() == 4
    model = language.TextModel.fit([("en", "the and of"), ("de", "der und die")])
    assert language.identify_pages(pages, model).count() == 4
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_neighbours(vectors, k=2, tile=2).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 1, 1, 1.0), (2, 2, 2, 1.0), (2, 2, 2, 1.0), (7, 1, 1, 0.0), (7, 2, 2, 0.0)]
    assert topk.top_neighbours(vectors.limit(0)).count() == 0
