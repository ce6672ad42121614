"""Added lines of commits, as ``sources.git.history`` gives them, through the rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.kept import kept
from ..functions.paths import entropy_threshold
from ..functions.text import trimmed
from .detect import DETAIL, FINDING_COLUMNS, first_hit, with_hit


_CONTEXT = ("_prev", "line", "_none")


@kept
def _history_hit(config: Config) -> Column:
    threshold = entropy_threshold(F.col("path"), config.entropy_threshold, history=True)
    return first_hit(F.col("_said"), F.col("path"), F.array(*_CONTEXT), threshold, replace(config, allow_regexes=()), skip_regex_code=True)


def scan_history(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings in added lines, with the first 8 digits of the commit and no confidence.

    A line's context is the line before it in its hunk, itself and nothing. Markers, allowlists and scope
    don't count here. One shuffle, by hunk.
    """
    hunk = Window.partitionBy("commit", "path", "hunk").orderBy("seq")
    rows = lines.withColumn("_prev", F.coalesce(F.lag("line").over(hunk), F.lit(""))).withColumn("_said", trimmed(F.col("line"))).filter((F.col("origin") == "+") & (F.col("_said") != ""))
    context = F.array(*_CONTEXT)
    found = with_hit(rows.withColumn("_none", F.lit("")), _history_hit(config))
    nulls = {"verified": "boolean", "confidence": "float", "confidence_factors": "array<string>", "confidence_level": "string", "verification_detail": DETAIL, "ml_score": "float"}
    made = {"path": F.col("path"), "line_number": F.col("new_line").cast("int"), "snippet": F.col("_said"), "context": context, "severity": F.col("hit.severity"), "description": F.col("hit.description"), "rule_id": F.col("hit.rule_id"), "commit_hash": F.substring("commit", 1, 8)}
    return found.select(*[(made[c] if c in made else F.lit(None).cast(nulls[c])).alias(c) for c in FINDING_COLUMNS])


def history_stats(lines: DataFrame) -> DataFrame:
    """One row: commits, files changed in them, and lines added and removed."""
    changed = F.count_distinct("commit", "path")
    return lines.agg(F.count_distinct("commit").alias("commits"), changed.alias("files"), F.count_if(F.col("origin") == "+").alias("added"), F.count_if(F.col("origin") == "-").alias("removed"))
