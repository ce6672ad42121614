"""Canonical exact digests of documents.

Pass one reads the texts and shuffles only (digest, doc_id). Pass two fetches the texts of documents
whose digest occurs again and groups them by digest and canonical bytes, so that equal digests of different
texts never merge; where all bytes of a digest agree, which is always but for a collision, documents get their
group by the digest alone. The list of repeated digests is broadcast only while it is small.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable, maybe_broadcast, only


def canonical(text: str, form: str = "NFKC") -> str:
    """Normalised, case-folded (and normalised again, as folding can undo it), white space folded to one blank."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize(form, unicodedata.normalize(form, text).casefold()).split())


def _digests(form: str, with_bytes: bool, digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            folded = [None if t is None else canonical(t, form).encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([None if b is None else digest(b) for b in folded], pa.binary())]
            names = ["doc_id", "digest"]
            if with_bytes:
                columns.append(pa.array(folded, pa.binary()))
                names.append("body")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fingerprints(docs: DataFrame, form: str = "NFKC", digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> DataFrame:
    """(doc_id, first_doc_id, copies) for every document.

    first_doc_id: the least doc_id whose canonical text has the same bytes; copies: how many rows have
    them. A null text equals nothing: it has no digest, is its own first and counts 1. An empty text is
    a text like any other, so all empty ones (and those of white space only) are copies. Repeated rows
    are copies of each other. A null doc_id sorts after all others. A text of any length is digested whole. An empty
    table gives an empty one.
    """
    docs = only(docs, ["doc_id", "text"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    narrow = durable(docs.mapInArrow(_digests(form, False, digest), f"doc_id {id_type}, digest binary"))
    repeated = durable(narrow.filter("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("twice")))
    side = maybe_broadcast(repeated, repeated.count(), 64)
    alone = narrow.join(side, F.col("digest") == F.col("twice"), "left_anti").select("doc_id", F.col("doc_id").alias("first_doc_id"), F.lit(1).cast("bigint").alias("copies"))
    bodies = docs.mapInArrow(_digests(form, True, digest), f"doc_id {id_type}, digest binary, body binary").join(side, F.col("digest") == F.col("twice"), "left_semi")
    # Copies meet as partial sums, not as rows: of a text that a third of the corpus shares, a task sends one.
    texts = durable(bodies.groupBy("digest", "body").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("copies")))
    several = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds"), F.first("first_doc_id").alias("_first"), F.first("copies").alias("_copies"))
    several = durable(several.withColumnRenamed("digest", "_digest"))
    one = several.filter("kinds = 1")
    same = narrow.join(maybe_broadcast(one, one.count(), 96), F.col("digest") == F.col("_digest")).select("doc_id", F.col("_first").alias("first_doc_id"), F.col("_copies").alias("copies"))
    out = alone.unionByName(same)
    clash = several.filter("kinds > 1").select("_digest")
    if clash.isEmpty():
        return out
    known = texts.join(clash, F.col("digest") == F.col("_digest"), "left_semi").select(F.col("digest").alias("_digest"), F.col("body").alias("_body"), "first_doc_id", "copies")
    return out.unionByName(bodies.join(known, (F.col("digest") == F.col("_digest")) & (F.col("body") == F.col("_body"))).select("doc_id", "first_doc_id", "copies"))


#: DuckDB has no NFKC and no full case folding; on texts without compatibility characters these are equal to it.
SQL = r"""
WITH folded AS (
  SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')) AS body FROM documents
)
SELECT doc_id,
  CASE WHEN body IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY body) END AS first_doc_id,
  CASE WHEN body IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY body) END AS copies
FROM folded
"""
