"""Findings against what is known: baselines, feedback, caches, changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..functions.text import sha256_hex, snippet_fingerprint

BASELINE_VERSION = "1"
ENTRY = ["path", "line_number", "rule_id", "snippet_hash"]


def baseline_entries(findings: DataFrame) -> DataFrame:
    """The fingerprint of each finding: (path, line_number, rule_id, snippet_hash)."""
    return findings.select("path", F.col("line_number").cast("int").alias("line_number"), "rule_id", snippet_fingerprint(F.col("snippet")).alias("snippet_hash"))


def baseline_diff(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Distinct entries of both with ``change``: new, removed or unchanged. One shuffle: a tagged union grouped by entry."""
    tagged = current.select(*ENTRY, F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(saved.select(*ENTRY, F.lit(0).alias("c"), F.lit(1).alias("s")))
    both = tagged.groupBy(*ENTRY).agg(F.max("c").alias("c"), F.max("s").alias("s"))
    return both.select(*ENTRY, F.when(F.col("s") == 0, "new").when(F.col("c") == 0, "removed").otherwise("unchanged").alias("change"))


def feedback_entry(findings: DataFrame) -> DataFrame:
    """What marking findings as false positives stores: (rule_id, snippet_hash, file_pattern, is_false_positive)."""
    ext = extension(F.col("path"))
    return findings.select("rule_id", sha256_hex(F.col("snippet")).alias("snippet_hash"), F.when(ext.isNotNull(), F.concat(F.lit("*."), ext)).otherwise("*").alias("file_pattern"), F.lit(True).alias("is_false_positive"))


def mark_false_positives(feedback: DataFrame, findings: DataFrame) -> DataFrame:
    """Feedback with the findings' entries; an entry that is there isn't added again."""
    new = feedback_entry(findings).dropDuplicates(["rule_id", "snippet_hash", "file_pattern"])
    return feedback.unionByName(new.join(feedback, ["rule_id", "snippet_hash", "file_pattern"], "left_anti"), allowMissingColumns=True)


def without_false_positives(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Findings whose (snippet, rule) isn't known as a false positive."""
    known = feedback.filter("is_false_positive").select(F.col("rule_id").alias("_rule"), F.col("snippet_hash").alias("_hash")).distinct()
    return findings.join(known, (F.col("rule_id") == F.col("_rule")) & (sha256_hex(F.col("snippet")) == F.col("_hash")), "left_anti")


def in_changed_lines(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings inside a half-open range (path, start, end) of their file; files without any range are kept whole."""
    r = ranges.select(F.col("path").alias("_path"), "start", "end")
    listed = r.groupBy("_path").agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))
    joined = findings.join(listed, F.col("path") == F.col("_path"), "left")
    inside = F.exists("_ranges", lambda x: (x["start"] <= F.col("line_number")) & (F.col("line_number") < x["end"]))
    return joined.filter(F.col("_ranges").isNull() | inside).drop("_path", "_ranges")


def cache_split(files: DataFrame, cache: DataFrame, config_hash: str | None = None) -> DataFrame:
    """Files (path, file_hash) with ``hit`` and, for hits, the cached ``matches``. Entries of another configuration don't hit."""
    c = cache.select(F.col("path").alias("_path"), F.col("file_hash").alias("_hash"), "matches", *([F.col("config_hash").alias("_config")] if config_hash else []))
    if config_hash:
        c = c.filter(F.col("_config") == config_hash).drop("_config")
    hit = files.join(c, (F.col("path") == F.col("_path")) & (F.col("file_hash") == F.col("_hash")), "left")
    return hit.withColumn("hit", F.col("_path").isNotNull()).drop("_path", "_hash")


def cache_entries(files: DataFrame, findings: DataFrame) -> DataFrame:
    """What to cache for scanned files (path, file_hash): their findings as matches, none for clean files."""
    m = findings.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_number", "rule_id", "severity"))).alias("matches"))
    none = F.expr("cast(array() as array<struct<line_number:int,rule_id:string,severity:string>>)")
    return files.select("path", "file_hash").join(m, "path", "left").withColumn("matches", F.coalesce("matches", none)).withColumn("scanned_at", F.unix_timestamp())


def cache_upsert(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved entries with the new ones over them, by path; the later wins."""
    return saved.join(new.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)
