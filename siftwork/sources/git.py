"""Git repositories as tables, by the git program: changed files, changed lines and history."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RANGES = "path string, start int, `end` int"
HISTORY = "commit string, path string, hunk int, seq int, new_line int, origin string, line string"
_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", errors="replace")


def _listed(repo: str, out: str) -> list[str]:
    return sorted({str(Path(repo, x)) for x in out.split("\0") if x})


def changed_files(repo: str) -> list[str]:
    """Files that differ from HEAD, and untracked ones."""
    return _listed(repo, git(repo, "diff", "--name-only", "-z", "HEAD") + git(repo, "ls-files", "--others", "--exclude-standard", "-z"))


def staged_files(repo: str) -> list[str]:
    """Files whose index entry is new, modified, renamed or of another type."""
    return _listed(repo, git(repo, "diff", "--cached", "--name-only", "-z", "--diff-filter=AMRT"))


def _commit(repo: str, ref: str) -> str:
    try:
        return git(repo, "rev-parse", "--verify", "--end-of-options", ref + "^{commit}").strip()
    except ValueError as e:
        raise ValueError(f"{ref!r} isn't a commit") from e


def changed_since(repo: str, ref: str) -> list[str]:
    """Files that changed between a commit and HEAD and still exist."""
    return [p for p in _listed(repo, git(repo, "diff", "--name-only", "-z", _commit(repo, ref), "HEAD")) if Path(p).exists()]


def _hunks(out: str) -> Iterator[tuple[str, str]]:
    """(path, line of the diff) for every line below a file's header."""
    path, old, inside = "unknown", "unknown", False
    for line in out.split("\n"):
        if line.startswith("diff --git "):
            path = old = "unknown"
            inside = False
        elif not inside and line.startswith("--- "):
            old = line[6:].removesuffix("\t") if line[4:6] == "a/" else "unknown"
        elif not inside and line.startswith("+++ "):
            path = line[6:].removesuffix("\t") if line[4:6] == "b/" else old
        elif line.startswith("@@ "):
            inside = True
            yield path, line
        elif inside:
            yield path, line


def line_ranges(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """(path, start, end): half-open ranges of lines that hunks cover since a commit; empty ones where lines only went."""
    rows = []
    for path, line in _hunks(git(repo, "diff", "-U3", "--no-color", "--no-ext-diff", _commit(repo, ref), "HEAD")):
        if m := _HUNK.match(line):
            start, n = int(m[1]), int(m[2] or 1)
            rows.append((str(Path(repo, path)), start, start + n))
    return spark.createDataFrame(rows, RANGES)


def _show(repo: str, commit: str) -> Iterator[tuple]:
    hunk, at, seq = -1, 0, 0
    out = git(repo, "diff-tree", "-p", "-U1", "--minimal", "--no-color", "--no-ext-diff", "--no-commit-id", f"{commit}^1", commit)
    for path, line in _hunks(out):
        if m := _HUNK.match(line):
            hunk, at = hunk + 1, int(m[1])
        elif line[:1] in ("+", " "):
            yield commit, path, hunk, seq, at, line[0], line[1:].rstrip()
            at, seq = at + 1, seq + 1


def history(spark: SparkSession, repo: str, per_task: int = 64) -> DataFrame:
    """(commit, path, hunk, seq, new_line, origin, line): added lines (+) and context ( ) of every commit against its first parent.

    Commits without a parent have none. The list of commits is all that the driver reads; executors, which
    see the repository at the same path, ask for the differences of a few commits each.
    """
    commits = [x.split() for x in git(repo, "rev-list", "--parents", "HEAD").splitlines()]
    able = [(c[0],) for c in commits if len(c) > 1]
    if not able:
        return spark.createDataFrame([], HISTORY)
    listed = spark.createDataFrame(able, "commit string").repartition(max(1, len(able) // per_task))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0].strip("`") for x in HISTORY.split(", ")]
        for frame in frames:
            for commit in frame["commit"]:
                rows = list(_show(repo, commit))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return listed.mapInPandas(read, HISTORY)
