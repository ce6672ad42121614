"""Monitoring log streams: alerts, alerts by window, and rules that change while a stream runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.redact import redact_log_line
from ..operators.detect import rule_matches, scan_logs
from ..sources.rule_files import load_rules


def fan_in(*streams: DataFrame) -> DataFrame:
    """Streams of (source, line_number, line) as one."""
    return reduce(DataFrame.unionByName, streams)


def alerts(lines: DataFrame) -> DataFrame:
    """(source, line_number, snippet, severity, description, rule_id, ts): every built-in rule that matches a line, when it was seen."""
    return scan_logs(lines).withColumn("ts", F.current_timestamp())


def mortal_counts(found: DataFrame) -> DataFrame:
    """Alerts so far by severity; a streaming aggregate for complete or update mode."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def windowed(found: DataFrame, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """(start, end, keys, n): rows by window of event time; state of windows older than the watermark is dropped."""
    keys = by or ["rule_id"]
    bounds = F.window(time, size, slide) if slide else F.window(time, size)
    out = found.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(bounds.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def monitor(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rules_dir: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that hands each batch's alerts to ``sink``; the rules of ``rules_dir`` are read anew for every batch."""

    def batch(frame: DataFrame, number: int) -> None:
        found = alerts(frame)
        own = load_rules(rules_dir, strict=False) if rules_dir else []
        if own:
            hits = frame.select(*[c for c in frame.columns if c != "line"], "line", F.explode(rule_matches(F.col("line"), own)).alias("hit"))
            more = hits.select(*[c for c in frame.columns if c != "line"], F.col("line").alias("snippet"), F.col("hit.severity").alias("severity"), F.col("hit.description").alias("description"), F.col("hit.rule_id").alias("rule_id"), F.current_timestamp().alias("ts"))
            found = found.unionByName(more.withColumn("snippet", redact_log_line(F.col("snippet"))))
        sink(found, number)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
