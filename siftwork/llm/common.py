"""What the corpus operators share: column hygiene, durable intermediate tables, distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows times this many bytes stay under the bound.
BROADCAST_BYTES = 32 << 20


def tidy(df: DataFrame, needed: list[str], made: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with unambiguous names, whatever extra columns it carries.

    Each needed name goes to the first column that is spelled so, else to the first that differs by
    case only. Any other column keeps its name unless that equals a needed name, a name that the
    operator makes, or an earlier column's (Spark ignores case); it then gets a number: ``text_2``.
    """
    names = df.columns
    place: dict[int, str] = {}
    for want in needed:
        free = [i for i in range(len(names)) if i not in place]
        hit = next((i for i in free if names[i] == want), None)
        if hit is None:
            hit = next((i for i in free if names[i].lower() == want.lower()), None)
        if hit is None:
            raise ValueError(f"column {want!r} is missing; there are {names}")
        place[hit] = want
    taken = {x.lower() for x in (*needed, *made)}
    out = []
    for i, name in enumerate(names):
        if i in place:
            out.append(place[i])
            continue
        new, n = name, 2
        while new.lower() in taken:
            new, n = f"{name}_{n}", n + 1
        taken.add(new.lower())
        out.append(new)
    return df.toDF(*out)


def only(df: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns of ``df``, by the rule of :func:`tidy`."""
    return tidy(df, needed).select(*[F.col(f"`{c}`") for c in needed])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="siftwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that lost executors cost no recomputation.

    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siftwork/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where ``rows`` of ``row_bytes`` are known to stay under ``limit``; else a shuffled join's side."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def ranked(df: DataFrame, group: list[str], order: list[str], rows: int, name: str = "rank", chunk: int = 200_000) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each group, without ever putting a whole group into one task.

    Rows of a group are spread by hash over ceil(rows / chunk) buckets; a row's rank is the size of its
    group's earlier buckets plus its place in its own. ``df`` is read twice, so it should be durable.
    Rows that are equal in ``order`` share a bucket and get neighbouring ranks in either order.
    """
    buckets = max(1, math.ceil(rows / chunk))
    put = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = put.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return put.withColumn("_place", place).join(offsets, keys).withColumn(name, F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_before")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(``df`` with ``key`` as bigint, the table (_number, _id) that gives the old ids back or None where they were whole numbers).

    Ids of other types get numbers in their own order, so that least ids stay least. Null stays null.
    """
    kind = df.schema[key].dataType.simpleString()
    others = [F.col(f"`{c}`") for c in df.columns if c != key]
    if kind in _WHOLE:
        return df.select(F.col(key).cast("bigint").alias(key), *others), None
    ids = df.select(F.col(key).alias("_id")).filter("_id IS NOT NULL").distinct().orderBy("_id")
    names = durable(ids.select(F.monotonically_increasing_id().alias("_number"), "_id"))
    found = df.join(names, F.col(key) == F.col("_id"), "left")
    return found.select(F.col("_number").alias(key), *others), names


def named(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``df`` with the ids back that :func:`numbered` took from these columns."""
    if names is None:
        return df
    kept = df.columns
    for c in columns:
        df = df.withColumnRenamed(c, "_old").join(names, F.col("_old") == F.col("_number"), "left").withColumnRenamed("_id", c).drop("_old", "_number")
    return df.select(*[F.col(f"`{c}`") for c in kept])


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (strings) has about ``most`` bytes in each piece, whatever lengths its texts have; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column % batch.num_columns)), 0), dtype=np.int64)
        room = np.maximum((np.cumsum(sizes) - sizes) // most, np.arange(len(sizes)) // rows)
        # A piece begins where the bytes or the rows before it fill another share.
        starts = np.flatnonzero(np.concatenate([[True], room[1:] != room[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True):
            yield batch.slice(a, b - a)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 digest; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
