"""Entry points: scanning a directory, a text, a table or a repository's history."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import detect
from ..operators.complexity import complexity_findings
from ..operators.detect import FINDING, FINDING_COLUMNS, as_findings, dedup_snippets
from ..operators.history import scan_history
from ..operators.iac import iac_findings
from ..operators.state import in_changed_lines, without_false_positives
from ..session import ship
from ..sources import git
from ..sources.files import from_text, read_tree
from .reports import exit_code, ordered, render
from .store import cache_folders, scan_with_cache


def scan_table(docs: DataFrame, config: Config = Config(), deep: bool = False, complexity: bool = False, feedback: DataFrame | None = None) -> DataFrame:
    """Findings of (path, text) rows, each document a content scan of its own; no shuffle but for complexity and feedback."""
    ship(docs.sparkSession)
    out = detect.scan(docs.select("path", "text"), config, deep)
    if complexity:
        out = out.unionByName(as_findings(complexity_findings(docs)))
    return without_false_positives(out, feedback) if feedback is not None else out


def scan_text(spark: SparkSession, text: str, config: Config = Config(), deep: bool = False) -> DataFrame:
    """Findings of one text, whose path is <stdin>."""
    return scan_table(from_text(spark, text), config, deep)


def scan_path(spark: SparkSession, root: str, config: Config = Config(), deep: bool = False, complexity: bool = False, diff: bool = False, staged: bool = False, since: str | None = None, mortal_only: bool = False, feedback: DataFrame | None = None, infrastructure: bool = False) -> DataFrame:
    """Findings below a file or directory, by path and line.

    At most one of diff (what differs from HEAD), staged (the index) and since (a commit; only its changed
    lines count) restricts the files. deep adds decoded texts, history and removal of repeated snippets.
    """
    if sum(map(bool, (diff, staged, since))) > 1:
        raise ValueError("diff, staged and since exclude each other")
    paths = git.changed_files(root) if diff else git.staged_files(root) if staged else git.changed_since(root, since) if since else None
    if paths is not None:
        paths = [p for p in paths if os.path.isfile(p)]
    docs = read_tree(ship(spark), root, config, paths)
    if config.cache_enabled:
        parts = [scan_with_cache(docs, config, cache_folders(config, root), deep)]
        if feedback is not None:
            parts[0] = without_false_positives(parts[0], feedback)
    else:
        parts = [scan_table(docs, config, deep, feedback=feedback)]
    if deep and paths is None:
        told = F.col("snippet") != ""  # what the cache knows has no snippet to repeat
        parts[0] = dedup_snippets(parts[0].filter(told)).unionByName(parts[0].filter(~told))
    if deep and os.path.isdir(os.path.join(root, ".git")):
        parts.append(scan_history(git.history(spark, root), config))
    if complexity:
        parts.append(as_findings(complexity_findings(docs)))
    if infrastructure:
        parts.append(as_findings(iac_findings(docs)))
    out = reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])
    if since:
        out = in_changed_lines(out, git.line_ranges(spark, root, since))
    return ordered(out.filter("severity = 'mortal'") if mortal_only else out)


def run(spark: SparkSession, root: str, kind: str = "terminal", config: Config = Config(), ci: bool = False, **options) -> tuple[str, int]:
    """(report, exit code): 1 if there is a mortal finding."""
    found = scan_path(spark, root, config, **options)
    return render(found, kind, config, ci), exit_code(found)


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


def findings_by(findings: DataFrame, *columns: str) -> DataFrame:
    """Counts by every grouping set of the columns (an extension): null stands for all."""
    return findings.cube(*columns).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("snippet").alias("snippets"))
