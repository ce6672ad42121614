"""What every operator returns for nulls, empty and long texts, ties, repeated rows, empty and unlabelled tables."""

from collections import Counter

import pytest
from test_brute_force import _plain_identify, _plain_mix, _plain_shards

import corpus_pipeline
from siftwork.llm import fingerprint, html_extract, language, mixing, neardup, packing, queries, secret_scan, sharding, substring, topk


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_fingerprints(odd_docs):
    assert _rows(fingerprint.fingerprints(odd_docs), "doc_id", "first_doc_id", "copies") == sorted([(1, 1, 3), (1, 1, 3), (6, 1, 3), (2, 2, 1), (None, None, 1), (3, 3, 2), (4, 3, 2), (5, 5, 1)], key=repr)


def test_near_duplicates(odd_docs):
    """Rows with null, empty or blank texts are in no group; what two words and their superset are is up to their hashes."""
    one, two, _ = neardup.hashes(["alpha beta", "alpha beta gamma delta"])
    near = int(one[0] ^ one[1]).bit_count() <= neardup.RADIUS and int(two[0] ^ two[1]).bit_count() <= neardup.CONFIRM
    size = 3 + near
    assert _rows(neardup.near_duplicates(odd_docs), "doc_id", "duplicate_of", "group_size") == [(1, 1, size), (6, 1, size), *[(None, 1, size)] * near]
    kept = neardup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, *[None] * (not near)])


def test_of_equal_rows_every_run_keeps_the_same(spark):
    rows = [(7, "some words that two rows share", f"extra {i}") for i in range(40)]
    kept = {neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(n)).first().note for n in (1, 3, 7)}
    assert len(kept) == 1


def test_packing(odd_docs):
    out = packing.pack_documents(odd_docs).collect()
    assert Counter((r.doc_id, r.start_word, r.n_words) for r in out) == Counter({(1, 0, 4): 2, (6, 0, 4): 1, (None, 0, 2): 1} | {(5, 2048 * i, min(2048, 30_000 - 2048 * i)): 1 for i in range(15)})
    assert all(n <= packing.CAPACITY for n in Counter({b: sum(r.n_words for r in out if r.bin_id == b) for b in {r.bin_id for r in out}}).values())


def test_mixing(odd_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.select("doc_id", "text", "source").collect()]
    assert Counter(_rows(mixing.mix_sources(odd_docs), "doc_id", "text", "source")) == Counter(_plain_mix(rows))


def test_language(odd_docs):
    model = language.TextModel.fit([("en", "alpha beta gamma word"), ("de", "straße über ähnlich")])
    rows = odd_docs.select("doc_id", "lang", "source", "text").collect()
    want = [(r.doc_id, *j) for r, j in zip(rows, _plain_identify([(r.lang, r.source, r.text) for r in rows], model), strict=True)]
    got = _rows(language.identify_documents(odd_docs, model), "doc_id", "language", "probability", "accepted")
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want, key=repr)]
    assert Counter(r.doc_id for r in language.keep_identified(odd_docs, model).collect()) == Counter(a for a, *_, d in want if d)


def test_unlabelled_tables_identify_nothing(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    for docs in (no_docs, odd_docs.withColumn("lang", F.lit(None).cast("string")), odd_docs.withColumn("text", F.lit(None).cast("string"))):
        model = language.fit_text_model(docs)
        assert model.languages == []
        out = language.identify_documents(docs, model)
        assert out.columns == ["doc_id", "declared", "host", "language", "probability", "accepted"] and out.count() == docs.count()
        assert out.filter("accepted OR language IS NOT NULL OR probability IS NOT NULL").count() == 0
        assert language.keep_identified(docs, model).columns == docs.columns and language.keep_identified(docs, model).count() == 0


def test_passages(odd_docs):
    assert _rows(substring.repeated_passages(odd_docs), "doc_id", "start_word", "n_words", "copies", "first_doc_id", "removable") == [(5, 0, 30_000, 29_951, 5, True)]


def test_sharding(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert {d: (s, f) for d, s, f in _rows(sharding.shard_documents(odd_docs, shards=2), "doc_id", "shard", "first_shard")} == _plain_shards(rows, 2, sharding.ROUNDS, sharding.SLACK)


def test_secrets(odd_docs):
    model = secret_scan.fit_secret_model(odd_docs)
    assert secret_scan.find_secrets(odd_docs, model).count() == 0
    assert _rows(secret_scan.redact_secrets(odd_docs, model), "doc_id", "text", "n_chars") == _rows(odd_docs, "doc_id", "text", "n_chars")


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, None, "   <b> </b>"), (3, "v", "<p>One sentence, and one more.</p>"), (4, "w", "x" * 1_000_000)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted(((r.page_id, r.content if r.page_id != 4 else len(r.content), r.kept_nodes, r.all_nodes) for r in out), key=repr)
    assert got == sorted([(1, None, 0, 0), (1, None, 0, 0), (None, "", 0, 0), (2, "", 0, 0), (3, "One sentence, and one more.", 1, 1), (4, 1_000_000, 1, 1)], key=repr)


def test_names_for_vectors_and_a_query_set(spark):
    from pyspark.sql import functions as F

    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("c", [0.0, 1.0]), (None, [1.0, 0.0]), ("d", None)]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = _rows(topk.top_neighbours(vectors, k=1, tile=2), "vec_id", "place", "neighbour_id")
    assert got == [("a", 1, "b"), ("b", 1, "a"), ("c", 1, "c"), ("c", 1, "c")]
    assert _rows(topk.top_neighbours(vectors, k=2, tile=1, queries=F.col("vec_id") == "b"), "vec_id", "place", "neighbour_id") == [("b", 1, "a"), ("b", 2, "c")]
    assert topk.top_neighbours(vectors, queries=F.lit(False)).collect() == []


@pytest.fixture(scope="module")
def empty_dir(spark, no_docs, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    no_docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.mark.parametrize("name", [*sorted(queries.queries()), "pipeline"])
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    run = corpus_pipeline.run if name == "pipeline" else queries.queries()[name]
    assert run(spark, empty_dir).collect() == []


def test_pipeline_of_unlabelled_documents(spark, odd_docs, tmp_path):
    odd_docs.selectExpr("doc_id", "text", "cast(null as string) AS lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
