"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is its share of the target times the budget over its size. Every
document draws its own count by inverting a Poisson distribution at a number hashed from seed and
doc_id, so any executor, attempt or engine draws the same; rows are exploded by count and shuffled
globally. Only one row per source is ever joined to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, maybe_broadcast, tidy, unit_hash

SEED = "mix-1"
#: A rate above this is drawn as the sum of equal independent parts, so that exp(-rate) can't underflow.
PART = 500.0


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float = 1.0) -> DataFrame:
    """One row a source: (source, size, rate, parts, cdf of one part).

    size: characters of its texts. weights: target shares (any scale; a source that isn't named gets
    none); without them a source weighs the square root of its size. budget: characters of the mixture
    as a multiple of those of the input. A source without characters has rate 0. Null sources are a source; null and
    empty texts have no characters; repeated rows count each. An empty table gives an empty one.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weight = F.sqrt("size")
    else:
        named = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*named, F.lit(0.0))
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    totals = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    rates = sizes.crossJoin(F.broadcast(totals)).withColumn(
        "rate",
        F.when((F.col("size") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.lit(float(budget)) * F.col("all_size") / F.col("size")).otherwise(F.lit(0.0)),
    )
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART)).cast("int")))
    rates = rates.withColumn("mean", F.col("rate") / F.col("parts"))
    rates = rates.withColumn("terms", F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int"))
    first = F.exp(-F.col("mean"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.col("terms")),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * F.col("mean") / k)).alias("c")),
    )
    return rates.select("source", "size", "rate", "parts", walk["c"].alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float = 1.0, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (0, 1, ...), each document as often as it drew.

    Null sources form a source of their own. A null text counts as empty, and a null doc_id hashes as
    the word null. Rows that share a doc_id and a source draw the same count. An empty table gives an
    empty one. Extra columns stay (see ``tidy`` for clashing names).
    """
    names = tidy(docs, ["doc_id", "text", "source"], ("copy",)).columns
    docs = tidy(docs, ["doc_id", "text", "source"], ("copy", "_source", "_parts", "_cdf", "_drawn", "_key"))
    rates = durable(source_rates(docs, weights, budget).select(F.col("source").alias("_source"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    number, terms = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_cdf")), F.lit(0))).first()
    hit = docs.join(maybe_broadcast(rates, 200 * number + 8 * terms, 1), F.col("source").eqNullSafe(F.col("_source")))
    # One hash a part, made before the distribution is walked: inside that lambda it would be made for every term.
    numbers = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: unit_hash(F.lit(f"{seed}:"), name, F.lit(":"), j.cast("string")))
    drawn = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("_cdf"), lambda c: c <= u)))
    copies = hit.withColumn("_drawn", drawn).drop("_source", "_parts", "_cdf").filter("_drawn > 0")
    out = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_drawn") - 1))).drop("_drawn")
    names = [*names, "copy"]
    if not shuffle:
        return out.toDF(*names)
    key = F.xxhash64(F.lit(seed), name, F.col("copy"))
    return out.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key").drop("_key").toDF(*names)


SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source
), weighed AS (
  SELECT *, CASE WHEN size > 0 THEN sqrt(size) ELSE 0 END AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weighed) * 1.0::DOUBLE * (SELECT sum(size) FROM sizes) / size ELSE 0 END AS rate FROM weighed
), means AS (
  SELECT source, greatest(1, ceil(rate / 500))::BIGINT AS parts, rate / greatest(1, ceil(rate / 500)) AS mean FROM rates
), cdf AS (
  SELECT source, parts, mean, 0::BIGINT AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k + 1 <= ceil(mean + 12 * sqrt(mean) + 40)
), ids AS (
  SELECT DISTINCT source, coalesce(doc_id::VARCHAR, 'null') AS name FROM documents
), drawn AS (
  SELECT i.source, i.name, count(c.k) AS n
  FROM ids i JOIN means m ON i.source IS NOT DISTINCT FROM m.source, unnest(range(1, m.parts + 1)) AS j(j)
  JOIN cdf c ON c.source IS NOT DISTINCT FROM m.source AND c.c <= ('0x' || substr(md5('{SEED}:' || i.name || ':' || j.j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
  GROUP BY i.source, i.name
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.copy::INTEGER AS copy
FROM documents d JOIN drawn w ON d.source IS NOT DISTINCT FROM w.source AND coalesce(d.doc_id::VARCHAR, 'null') = w.name, unnest(range(0, w.n)) AS r(copy)
"""
