"""Sending the package to the Python workers of a session, and the folder that executors share."""

from __future__ import annotations

import hashlib
import io
import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent
_SENT = "_siftwork_sent"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where it is unset, a temporary folder in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="siftwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def spread(df: DataFrame, least_bytes: int = 1 << 20, most_rows: int | None = None) -> DataFrame:
    """``df`` over all cores, none with much more than its share of the rows; as it is where its files give that already.

    A row group can't be split: of a file's splits some get a whole one and others nothing, so rows are
    counted by partition (of Parquet, only footers are read). most_rows: for narrow rows that are much
    work, how many a partition may have; then tasks don't grow with the table.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < least_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = [r[1] for r in df.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()]
    rows, most = sum(parts), max(parts, default=0)
    if most * cores <= 1.25 * rows and most <= (most_rows or most):
        return df
    return df.repartition(max(cores, math.ceil(rows / (most_rows or rows)), size >> 26))


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors. It goes when the JVM ends."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/siftwork/{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def _zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(_ROOT.parent))), p.read_bytes())
    return out.getvalue()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in every Python worker, once a context; harmless where it is installed already."""
    sc = spark.sparkContext
    if not getattr(sc, _SENT, False):
        data = _zipped()
        path = f"{shared_dir(spark)}/siftwork-{hashlib.sha256(data).hexdigest()[:16]}.zip"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
        stream = fs.create(hadoop, True)
        stream.write(bytearray(data))
        stream.close()
        sc.addPyFile(path)
        setattr(sc, _SENT, True)
    return spark
