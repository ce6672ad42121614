"""What outlives a scan: baselines, feedback and the scan cache, each a folder of Parquet files."""

from __future__ import annotations

import datetime
import hashlib
import os
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import detect, state
from ..operators.detect import FINDING, FINDING_COLUMNS
from ..session import held

BASELINE = "path string, line_number int, rule_id string, snippet_hash string"
FEEDBACK = "rule_id string, snippet_hash string, file_pattern string, is_false_positive boolean, created_at string"
CACHE = "path string, file_hash string, matches array<struct<line_number:int,rule_id:string,severity:string>>, scanned_at bigint, config_hash string"
#: The folder of a project's cache, which scans pass over.
CACHE_FOLDER = ".scan-cache"


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, where: str) -> bool:
    path, files = _path(spark, where)
    return files.exists(path)


def replace(df: DataFrame, where: str) -> None:
    """Writes ``df``, which may read from there, and puts it in the place of what was there."""
    spark, new, old = df.sparkSession, f"{where.rstrip('/')}.new-{uuid.uuid4().hex}", f"{where.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    (path, files), (fresh, _), (former, _) = _path(spark, where), _path(spark, new), _path(spark, old)
    if files.exists(path):
        files.rename(path, former)
    files.rename(fresh, path)
    files.delete(former, True)


# Baselines.


def save_baseline(findings: DataFrame, where: str, now: str | None = None) -> int:
    """Makes the findings the baseline; returns how many there are. Every row carries version and time."""
    now = now or datetime.datetime.now(datetime.UTC).isoformat()
    replace(state.baseline_entries(findings).withColumns({"version": F.lit(state.BASELINE_VERSION), "created_at": F.lit(now)}), where)
    return findings.sparkSession.read.parquet(where).count()


def load_baseline(spark: SparkSession, where: str) -> DataFrame:
    """(path, line_number, rule_id, snippet_hash, version, created_at)."""
    if not exists(spark, where):
        raise FileNotFoundError(f"no baseline at {where}; save one first")
    out = spark.read.parquet(where)
    if not set(state.ENTRY) <= set(out.columns):
        raise ValueError(f"{where} isn't a baseline")
    return out


def show_baseline(spark: SparkSession, where: str) -> DataFrame:
    """(path, line_number, rule_id) of the baseline by path and line."""
    return load_baseline(spark, where).select("path", "line_number", "rule_id").orderBy("path", "line_number", "rule_id")


def diff_baseline(findings: DataFrame, where: str) -> tuple[DataFrame, dict[str, int], int]:
    """(distinct entries with their change, how many new, removed and unchanged, exit code): the code is 1 if any is new."""
    changes = held(state.baseline_diff(state.baseline_entries(findings), load_baseline(findings.sparkSession, where)))
    counts = dict.fromkeys(("new", "removed", "unchanged"), 0) | {r[0]: r[1] for r in changes.groupBy("change").count().collect()}
    return changes, counts, int(counts["new"] > 0)


# Feedback.


def load_feedback(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(where) if exists(spark, where) else spark.createDataFrame([], FEEDBACK)


def mark_false_positives(findings: DataFrame, where: str, now: str | None = None) -> int:
    """Adds the findings' entries to the store, each once however often it is marked; returns how many there are then."""
    now = now or datetime.datetime.now(datetime.UTC).isoformat()
    known = load_feedback(findings.sparkSession, where)
    marked = state.mark_false_positives(known, findings)
    replace(marked.withColumn("created_at", F.coalesce("created_at", F.lit(now))), where)
    return findings.sparkSession.read.parquet(where).count()


def list_feedback(spark: SparkSession, where: str) -> DataFrame:
    """(rule_id, file_pattern, created_at) of the store."""
    return load_feedback(spark, where).select("rule_id", "file_pattern", "created_at").orderBy("created_at", "rule_id", "file_pattern")


def clear_feedback(spark: SparkSession, where: str) -> int:
    """Empties the store; returns how many entries went."""
    n = load_feedback(spark, where).count()
    if n:
        replace(spark.createDataFrame([], FEEDBACK), where)
    return n


def finding_at(findings: DataFrame, line: int) -> DataFrame:
    """The finding of a scanned file at a line: its first by rule, or none."""
    return findings.filter(F.col("line_number") == line).orderBy("path", "rule_id").limit(1)


# The scan cache.


def config_hash(config: Config, deep: bool = False) -> str:
    """Of what decides which findings a text has."""
    told = {k: v for k, v in asdict(config).items() if k in ("entropy_threshold", "whitelist", "skip_minified_threshold", "entropy_skip_regex_context", "allow_regexes", "disable", "custom", "marker")}
    return hashlib.sha256(repr((sorted(told.items()), deep)).encode()).hexdigest()[:16]


def cache_folders(config: Config, root: str, user: str | None = None) -> list[str]:
    """Where entries are kept, by ``cache_location``: project, user or both."""
    project = os.path.join(root if os.path.isdir(root) else os.path.dirname(os.path.abspath(root)), CACHE_FOLDER)
    user = user or os.path.expanduser("~/.cache/siftwork/scan")
    chosen = {"project": [project], "user": [user], "both": [project, user]}[config.cache_location]
    return [f"file://{os.path.abspath(x)}" if "://" not in x else x for x in chosen]


def load_cache(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The folders' entries, one a path; a later folder wins."""
    found = [spark.read.parquet(f) for f in folders if exists(spark, f)]
    return reduce(state.cache_upsert, found) if found else spark.createDataFrame([], CACHE)


def clear_cache(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def cached_findings(hits: DataFrame) -> DataFrame:
    """Findings of files that the cache knows (path, matches): they have no snippet, context or score."""
    m = hits.select("path", F.explode("matches").alias("m"))
    made = {"path": F.col("path"), "line_number": F.col("m.line_number"), "snippet": F.lit(""), "context": F.array().cast("array<string>"), "severity": F.col("m.severity"), "description": F.concat(F.lit("Cached: "), F.col("m.rule_id")), "rule_id": F.col("m.rule_id")}
    kinds = {f.name: f.dataType for f in hits.sparkSession.createDataFrame([], FINDING).schema}
    return m.select(*[(made[c] if c in made else F.lit(None)).cast(kinds[c]).alias(c) for c in FINDING_COLUMNS])


def scan_with_cache(docs: DataFrame, config: Config, folders: list[str], deep: bool = False) -> DataFrame:
    """Findings of (path, text, file_hash): unchanged files from the cache, the others scanned and cached.

    The two kinds of files part by one join on path and hash; fresh findings are written once, for the result and the cache.
    """
    spark, mark = docs.sparkSession, config_hash(config, deep)
    saved = held(load_cache(spark, folders))
    split = state.cache_split(docs.select("path", "text", "file_hash"), saved, mark)
    misses = split.filter("NOT hit").select("path", "text", "file_hash")
    fresh = held(detect.scan(misses.select("path", "text"), config, deep).select(*FINDING_COLUMNS))
    entries = held(state.cache_entries(misses.select("path", "file_hash"), fresh).withColumn("config_hash", F.lit(mark)))
    if not entries.isEmpty():
        merged = held(state.cache_upsert(saved, entries))
        for folder in folders:
            replace(merged, folder)
    known = state.cache_split(docs.select("path", "file_hash"), saved, mark).filter("hit").select("path", "matches")
    return fresh.unionByName(cached_findings(known))
