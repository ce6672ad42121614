"""Exact top-k neighbours of every vector.

Vectors are cut into shard tiles and those that ask into query tiles; each pair of both is one matrix product
with a partial selection, and the partial lists of a query merge in a tree of fan-in MERGE. Work and
replication are fixed by the numbers of tiles; nothing is broadcast and nothing comes to the driver but
the numbers of vectors and their dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, named, numbered, only, ranked

#: Partial lists that one merging task takes at a time.
MERGE = 8
#: Scores are equal if they agree to this many decimals.
DIGITS = 10


def _pack(batch: pa.Table) -> pa.Table:
    """One tile: its ids and its unit vectors as bytes."""
    batch = batch.sort_by("rank")
    ranks = np.asarray(batch.column("rank"), dtype=np.int64)
    vectors = batch.column("embedding").combine_chunks()
    flat = vectors.flatten() if not isinstance(vectors, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in vectors.chunks])
    return pa.table({"tile": batch.column("tile").slice(0, 1), "ids": pa.array([np.asarray(batch.column("vec_id"), dtype=np.int64).tobytes()], pa.binary()), "ranks": pa.array([ranks.tobytes()], pa.binary()), "vectors": pa.array([np.asarray(flat, dtype=np.float32).tobytes()], pa.binary())})


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best (score, id): higher score first, then lower id. All that tie with the k-th compete."""
    rows, n = scores.shape
    k = min(k, n)
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
        hits = scores >= floor[:, None]
    else:
        hits = np.ones(scores.shape, bool)
    r, c = np.nonzero(hits)
    s, i = scores[r, c], ids[c] if ids.ndim == 1 else ids[r, c]
    order = np.lexsort((i, -s, r))
    r, s, i = r[order], s[order], i[order]
    first = np.searchsorted(r, np.arange(rows))
    take = first[:, None] + np.arange(k)[None, :]
    return s[take], i[take]


def _score(k: int, dim: int):
    def unit(data: bytes) -> np.ndarray:
        x = np.frombuffer(data, np.float32).reshape(-1, dim).astype(np.float64)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_tile, q_ids, q_rank, q_vec, s_tile, s_ids, s_rank, s_vec = (batch.column(j)[row].as_py() for j in range(8))
                q_id, s_id, q, s = np.frombuffer(q_ids, np.int64), np.frombuffer(s_ids, np.int64), unit(q_vec), unit(s_vec)
                q_rank, s_rank = np.frombuffer(q_rank, np.int64), np.frombuffer(s_rank, np.int64)  # a vector's rank tells it from its equals
                own = np.searchsorted(s_rank, q_rank)
                own[(own == len(s_rank)) | (s_rank[np.minimum(own, len(s_rank) - 1)] != q_rank)] = -1
                step = max(1, (1 << 21) // max(1, len(s)))
                scores, ids = [], []
                for at in range(0, len(q), step):
                    part = np.round(q[at : at + step] @ s.T, DIGITS)
                    mine = own[at : at + len(part)]
                    part[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
                    a, b = best(part, s_id, k)
                    scores.append(a)
                    ids.append(b)
                a, b = np.concatenate(scores), np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([pa.array([q_tile], pa.int64()), pa.array([s_tile], pa.int64()), pa.array([q_id.tobytes()]), pa.array([a.shape[1]], pa.int64()), pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["q_tile", "s_tile", "q_ids", "width", "scores", "ids"])

    return run


def _merge(k: int):
    def run(lists: pa.Table) -> pa.Table:
        scores, ids = [], []
        for width, s, i in zip(lists.column("width").to_pylist(), lists.column("scores").to_pylist(), lists.column("ids").to_pylist(), strict=True):
            scores.append(np.frombuffer(s, np.float64).reshape(-1, width))
            ids.append(np.frombuffer(i, np.int64).reshape(-1, width))
        a, b = best(np.concatenate(scores, axis=1), np.concatenate(ids, axis=1), k)
        return pa.table({"q_tile": lists.column("q_tile").slice(0, 1), "s_tile": lists.column("s_tile").slice(0, 1), "q_ids": lists.column("q_ids").slice(0, 1), "width": pa.array([a.shape[1]], pa.int64()), "scores": pa.array([a.tobytes()], pa.binary()), "ids": pa.array([b.tobytes()], pa.binary())})

    return run


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for width, q, s, i in zip(batch["width"], batch["q_ids"], batch["scores"], batch["ids"], strict=True):
            scores, ids = np.frombuffer(s, np.float64), np.frombuffer(i, np.int64)
            out = pd.DataFrame({"vec_id": np.repeat(np.frombuffer(q, np.int64), width), "place": np.tile(np.arange(1, width + 1), len(scores) // width), "neighbour_id": ids, "score": np.round(scores, 6) + 0.0})
            yield out[np.isfinite(scores)]


def top_neighbours(vectors: DataFrame, k: int = 10, tile: int = 4096, queries: Column | None = None) -> DataFrame:
    """(vec_id, place, neighbour_id, score): for each query its k nearest among all other vectors by cosine, place 1 the nearest.

    queries: a condition on vec_id; without one every vector is a query, and work grows with the square of their number.
    Equal scores (to DIGITS decimals) go by lower id. A vector is never its own neighbour, but a repeated row
    with the same id is another vector. Ids may be of any type that has an order. Rows with a null id, a null or zero
    vector, a null or infinite element, or another dimension than most rows (the greater of equally frequent ones) have no
    direction: they are no queries and no neighbours. With fewer than k others all are listed. An empty table gives an
    empty one.
    """
    schema = "vec_id bigint, place bigint, neighbour_id bigint, score double"
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    vectors = only(vectors, ["vec_id", "embedding"]).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), asks.alias("_asks"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sane = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sane, F.lit(False)))
    common = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_asks").alias("q")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None or not common[2]:
        return vectors.sparkSession.createDataFrame([], schema.replace("bigint", kind) if kind not in ("tinyint", "smallint", "int") else schema).select("vec_id", F.col("place").cast("bigint").alias("place"), "neighbour_id", "score")
    dim, rows, asking = common
    vectors, names = numbered(vectors.filter(F.size("embedding") == dim), "vec_id")
    whole = durable(ranked(vectors.withColumn("_all", F.lit(0)), ["_all"], ["vec_id", "embedding"], rows).select("vec_id", "embedding", "_asks", "rank"))

    def tiles_of(df: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Tiles of some ``tile`` vectors: of equal ranges of ranks where all are in, of hashes of ranks else."""
        tiles = math.ceil(n / tile)
        number = F.expr(f"cast(rank div {tile} as bigint)") if n == rows else F.pmod(F.xxhash64("rank"), F.lit(tiles))
        return durable(df.select("vec_id", "embedding", "rank", number.alias("tile")).groupBy("tile").applyInArrow(_pack, "tile bigint, ids binary, ranks binary, vectors binary")), tiles

    packed, tiles = tiles_of(whole, rows)
    asked, q_tiles = (packed, tiles) if queries is None else tiles_of(whole.filter("_asks"), asking)
    spark = vectors.sparkSession
    pairs = spark.range(q_tiles * tiles).select((F.col("id") / tiles).cast("bigint").alias("q"), (F.col("id") % tiles).alias("s"))
    left = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    right = packed.select(*[F.col(c).alias(f"s_{c}") for c in packed.columns])
    work = pairs.join(left, F.col("q") == F.col("q_tile")).join(right, F.col("s") == F.col("s_tile")).select(*left.columns, *right.columns)
    tasks = max(1, min(q_tiles * tiles, 4 * spark.sparkContext.defaultParallelism))
    lists = work.repartition(tasks, "q_tile", "s_tile").mapInArrow(_score(k, dim), "q_tile bigint, s_tile bigint, q_ids binary, width bigint, scores binary, ids binary")
    shape = lists.schema
    while tiles > 1:
        tiles = math.ceil(tiles / MERGE)
        lists = lists.withColumn("s_tile", F.expr(f"s_tile div {MERGE}")).groupBy("q_tile", "s_tile").applyInArrow(_merge(k), shape)
    return named(lists.mapInPandas(_flat, schema), names, "vec_id", "neighbour_id")


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 10) AS s
  FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS place FROM pairs
)
SELECT vec_id, place, neighbour_id, round(s, 6) + 0.0::DOUBLE AS score FROM placed WHERE place <= 10
"""
