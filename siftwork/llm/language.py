"""Language identification by fusing Bayesian evidence.

The text gives a likelihood per language (character trigrams, naive Bayes); the declared language and
the address suffix give others, whose tables come from grouped aggregation over the corpus; the host
gives a prior, smoothed towards its domain, that towards its suffix, and that towards the corpus. The
texts are read once for their likelihoods; everything after it moves a few numbers a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, durable, maybe_broadcast, only, tidy
from .html_extract import visible_text

#: Buckets of the trigram table.
TABLE = 1 << 16
#: Labelled documents a language that the text model is fitted on (the least of a hash of doc_id).
FIT_ROWS = 300
#: Labels, the most frequent ones, that the text model knows; the bound is on fitting only.
LANGUAGES = 128
#: Characters that numpy works on at once.
STEP = 1 << 18
#: Pseudo-counts with which a level of the prior trusts the level above.
TRUST = 20.0
#: A text's likelihood counts as if it had at most this many independent trigrams, so that metadata can matter to short texts only.
EFFECTIVE = 200.0
#: Least mean log-likelihood of a trigram, against a uniform choice among buckets; below it the text is in none of the languages.
FLOOR = 0.0
#: Least posterior probability.
SURE = 0.5


_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
#: Code point of the lower-case letter, 32 for anything but letters.
_FOLD = np.array([ord(low) if is_letter and len(low := chr(i).lower()) == 1 else i if is_letter else 32 for i, is_letter in enumerate(_LETTER)], dtype=np.uint32)


def _fold(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points > 0xFFFF, points, _FOLD[np.minimum(points, 0xFFFF)])


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of the middle) of each trigram whose middle is a letter; anything but a letter is a blank."""
    h = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    keep = np.flatnonzero(points[1:-1] != 32)
    return h[keep], keep


def _parts(texts: list[str | None], size: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, where each text's trigrams begin and the end, folded points) of some ``size`` characters each.

    Short texts share a part; a long one is cut into several, each with a neighbour's character at the cut, so
    that its trigrams are the same wherever it is cut.
    """
    run: list[str] = []
    first = length = 0
    for i, text in enumerate(texts):
        text = text or ""
        long = len(text) > size
        if run and (long or length >= size):
            yield first, np.cumsum([0, *(len(t) + 1 for t in run)]), _fold(f" {' '.join(run)} ")
            run, length = [], 0
        if long:
            for at in range(0, len(text), size):
                piece = text[max(0, at - 1) : at + size + 1]
                yield i, np.array([0, min(size, len(text) - at)]), _fold((" " * (at == 0)) + piece + (" " * (at + size >= len(text))))
            continue
        if not run:
            first = i
        run.append(text)
        length += len(text) + 1
    if run:
        yield first, np.cumsum([0, *(len(t) + 1 for t in run)]), _fold(f" {' '.join(run)} ")


class TextModel:
    """log P(bucket | language) less that of a uniform choice, a column a language; a model may have no languages."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray], alpha: float = 0.1) -> TextModel:
        languages = sorted(counts)
        table = np.zeros((TABLE, len(languages)), dtype=np.float32)
        for j, lang in enumerate(languages):
            smooth = counts[lang] + alpha
            table[:, j] = np.log(smooth / smooth.sum()) + math.log(TABLE)
        return cls(languages, table)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        return cls.of_counts({lang: count_grams([t for x, t in rows if x == lang]) for lang in {lang for lang, _ in rows}})

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the table's entries, a column a language; number of trigrams) of each text."""
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), dtype=np.int64)
        for at, begins, points in _parts(texts):
            h, keep = _grams(points)
            cut = np.searchsorted(keep, begins)
            n = np.diff(cut)
            some = np.flatnonzero(n)
            if len(some):
                sums[at + some] += np.add.reduceat(self.table[h], cut[:-1][some], axis=0, dtype=np.float64)
            sizes[at : at + len(n)] += n
        return sums, sizes


def count_grams(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(TABLE, dtype=np.int64)
    for _, _, points in _parts(texts):
        out += np.bincount(_grams(points)[0], minlength=TABLE)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trigram counts of a partition's texts by language: one array of TABLE numbers for each."""
    seen: dict[str, np.ndarray] = {}
    for batch in bounded(batches, 1):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            seen[lang] = seen.get(lang, 0) + count_grams([t for x, t in zip(langs, texts, strict=True) if x == lang])
    for lang, counts in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.tobytes()], pa.binary())], ["lang", "counts"])


def _summed(parts: pa.Table) -> pa.Table:
    total = np.zeros(TABLE, dtype=np.int64)
    for counts in parts.column("counts").to_pylist():
        total += np.frombuffer(counts, np.int64)
    return pa.table({"lang": parts.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def fit_text_model(labelled: DataFrame, rows: int = FIT_ROWS, languages: int = LANGUAGES) -> TextModel:
    """Fits the text model on (doc_id, text, lang): at most ``rows`` labelled documents of each of the ``languages`` most frequent labels.

    Both bounds are on fitting only. Texts of any length are counted where they are; the driver gets TABLE numbers a
    language. Rows with null lang or text aren't labelled; rows that repeat a chosen doc_id and lang count each.
    An empty or unlabelled table gives a model of no languages, which identifies nothing.
    """
    labelled = only(labelled, ["doc_id", "text", "lang"]).filter("lang IS NOT NULL AND text IS NOT NULL")
    known = [r[0] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not known:
        return TextModel.of_counts({})
    labelled = labelled.filter(F.col("lang").isin(known))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id")
    ids = labelled.select("doc_id", "lang", F.row_number().over(order).alias("_n")).filter(F.col("_n") <= rows).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    chosen = labelled.join(maybe_broadcast(ids, rows * len(known), 128), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    counts = chosen.select("lang", "text").mapInArrow(_counted, "lang string, counts binary").groupBy("lang").applyInArrow(_summed, "lang string, counts binary")
    return TextModel.of_counts({r[0]: np.frombuffer(r[1], np.int64) for r in counts.collect()})  # TABLE numbers a language


def _likelihoods(model: TextModel, is_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, -1):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if is_html:
                texts = [None if t is None else visible_text(t) for t in texts]
            sums, n = model.score(texts)
            scaled = sums * np.where(n > 0, np.minimum(1.0, EFFECTIVE / np.maximum(n, 1)), 0)[:, None]
            level = np.where(n > 0, sums.max(axis=1) / np.maximum(n, 1), -np.inf)
            flat = pa.array(scaled.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scaled.size + 1, scaled.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(level), pa.array(n)], [*batch.schema.names[:-1], "_ll", "_level", "_grams"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    shifted = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per key the expected number of documents of each language, as an array, and their sum."""
    out = df.groupBy(*keys).agg(*[F.sum(F.col("_soft")[j]).alias(f"_s{j}") for j in range(k)])
    return out.select(*keys, F.array(*[F.col(f"_s{j}") for j in range(k)]).alias("_sum"))


def _size_join(left: DataFrame, right: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """A left join that is null-safe on ``key``; the right side (durable) is broadcast while small."""
    right = right.withColumnRenamed(key, "_right")
    side = F.broadcast(right) if right.count() * row_bytes <= BROADCAST_BYTES else right
    return left.join(side, F.col(key).eqNullSafe(F.col("_right")), "left").drop("_right")


def _table_join(df: DataFrame, key: str, spread: float, k: int) -> DataFrame:
    """Adds log P(value of ``key`` | language), smoothed; a null value or one seen nowhere tells nothing."""
    seen = durable(_sums(df.filter(F.col(key).isNotNull()), [key], k))
    values = max(1, seen.count())
    totals = seen.agg(*[F.coalesce(F.sum(F.col("_sum")[j]), F.lit(0.0)).alias(f"t{j}") for j in range(k)]).first()
    logs = F.array(*[F.log((F.col("_sum")[j] + spread) / F.lit(totals[j] + spread * values)) for j in range(k)])
    joined = _size_join(df, durable(seen.select(key, logs.alias("_told"))), key, 200)
    zeros = F.array(*[F.lit(0.0)] * k)
    return joined.withColumn("_logs", _add(F.col("_logs"), F.coalesce(F.col("_told"), zeros))).drop("_told")


def identify(rows: DataFrame, model: TextModel, is_html: bool = False) -> DataFrame:
    """Adds (language, probability, accepted) to rows of (..., declared, host, body); ``body`` goes.

    declared: the language that markup or metadata states, lower case. host: the site; its suffix is
    what follows the last dot, its domain the last two parts. The posterior is the product of the text's
    likelihood, P(declared | language), P(suffix | language) and the host's prior. Rejected (accepted is
    false): texts without letters (null and empty ones too; their language is null), those whose
    trigrams fit no language better than chance, and those whose best probability is under SURE. A null
    declared or host tells nothing, a null host's prior being the corpus's. Ties go to the first
    language of the alphabet. A text of any length is read whole, in steps of bounded memory. A model of
    no languages rejects every row, with null language and probability. Repeated rows are judged each. An
    empty table gives an empty one.
    """
    k = len(model.languages)
    others = [f for f in rows.schema if f.name != "body"]
    if not k:
        return rows.select(*[F.col(f"`{f.name}`") for f in others], F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("accepted"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    ordered = rows.select(*[F.col(f"`{f.name}`") for f in others], F.col("body").cast("string"))
    ll = durable(ordered.mapInArrow(_likelihoods(model, is_html), f"{shape}, _ll array<double>, _level double, _grams bigint"))
    parts = F.split("host", r"\.")
    told = F.size(parts) > 1
    ll = (
        ll.withColumn("_logs", F.col("_ll"))
        .withColumn("_soft", F.when(F.col("_grams") > 0, _softmax(F.col("_ll"))).otherwise(F.array(*[F.lit(0.0)] * k)))
        .withColumn("_suffix", F.when(told, F.element_at(parts, -1)))
        .withColumn("_domain", F.when(told, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("host")))
    )
    whole = ll.agg(*[F.coalesce(F.sum(F.col("_soft")[j]), F.lit(0.0)).alias(f"s{j}") for j in range(k)]).first()
    total = sum(whole)
    corpus = [(x + 1) / (total + k) for x in whole]
    # Priors level by level: corpus, suffix, domain, host. Each level's table has one row a key.
    hosts = durable(_sums(ll, ["host", "_domain", "_suffix"], k))

    def smooth(count: Column, n: Column, above: Column) -> Column:
        return F.zip_with(count, above, lambda c, p: (c + TRUST * p) / (n + TRUST))

    def up(key: list[str]) -> DataFrame:
        out = hosts.groupBy(*key).agg(*[F.sum(F.col("_sum")[j]).alias(f"_s{j}") for j in range(k)])
        return out.select(*key, F.array(*[F.col(f"_s{j}") for j in range(k)]).alias("_sum"))

    size = F.aggregate("_sum", F.lit(0.0), lambda a, x: a + x)
    root = F.array(*[F.lit(p) for p in corpus])
    suffixes = up(["_suffix"]).select(F.col("_suffix").alias("_s"), F.when(F.col("_suffix").isNull(), root).otherwise(smooth(F.col("_sum"), size, root)).alias("_above"))
    domains = up(["_domain", "_suffix"]).join(suffixes, F.col("_suffix").eqNullSafe(F.col("_s"))).select(F.col("_domain").alias("_d"), F.when(F.col("_domain").isNull(), root).otherwise(smooth(F.col("_sum"), size, F.col("_above"))).alias("_above"))
    prior = hosts.join(domains, F.col("_domain").eqNullSafe(F.col("_d"))).select("host", F.when(F.col("host").isNull(), root).otherwise(smooth(F.col("_sum"), size, F.col("_above"))).alias("_prior"))
    out = _table_join(_table_join(ll, "declared", 0.5, k), "_suffix", 0.5, k)
    out = _size_join(out, durable(prior), "host", 300)
    post = _softmax(_add(F.col("_logs"), F.transform("_prior", lambda p: F.log(p))))
    out = out.withColumn("_post", post).withColumn("_best", F.array_max("_post"))
    names = F.array(*[F.lit(x) for x in model.languages])
    known = F.col("_grams") > 0
    return out.select(
        *[F.col(f"`{f.name}`") for f in others],
        F.when(known, F.element_at(names, F.array_position("_post", F.col("_best")).cast("int"))).alias("language"),
        F.when(known, F.round("_best", 6)).alias("probability"),
        (known & (F.col("_level") >= FLOOR) & (F.col("_best") >= SURE)).alias("accepted"),
    )


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """(doc_id, declared, host, language, probability, accepted): lang is what the metadata declares, source the host."""
    docs = tidy(docs, ["doc_id", "text", "lang", "source"])
    return identify(docs.select("doc_id", F.lower("lang").alias("declared"), F.col("source").alias("host"), F.col("text").alias("body")), model)


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, declared, host, language, probability, accepted): declared by the html tag, host of the address."""
    pages = tidy(pages, ["page_id", "url", "html"])
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return identify(pages.select("page_id", F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.col("html").alias("body")), model, is_html=True)


def keep_identified(docs: DataFrame, model: TextModel) -> DataFrame:
    """The rows of ``docs`` that are accepted, all their columns unchanged; rows with equal (doc_id, text, lang, source) fare alike.

    What is null, empty or without letters is rejected as :func:`identify` says; a null doc_id is an id like any
    other. An empty table, or a model of no languages, gives an empty one. The decision is joined by doc_id. The rejected rows are few in a healthy corpus: they are broadcast
    while they are, and shuffled with the documents beyond that.
    """
    names = tidy(docs, ["doc_id", "text", "lang", "source"]).columns
    docs = tidy(docs, ["doc_id", "text", "lang", "source"], ("_id", "_key"))
    key = F.xxhash64("text", "lang", "source")
    judged = identify(docs.select("doc_id", key.alias("_key"), F.lower("lang").alias("declared"), F.col("source").alias("host"), F.col("text").alias("body")), model)
    out = durable(judged.filter(~F.col("accepted")).select(F.col("doc_id").alias("_id"), "_key").distinct())
    side = F.broadcast(out) if out.count() * 24 <= BROADCAST_BYTES else out
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_anti").toDF(*names)
