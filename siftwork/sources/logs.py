"""Log streams: text files as they arrive, and growing files by byte offsets."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import lines_of

SCHEMA = "source string, line_number bigint, line string"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, line: int):
        self.path, self.start, self.end, self.line = path, start, end, line


def _whole_lines(path: str, start: int, end: int) -> tuple[int, int]:
    """(where the last complete line of a byte range ends, number of its lines)."""
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read(end - start)
    cut = data.rfind(b"\n") + 1
    return start + cut, data[:cut].count(b"\n")


class TailReader(DataSourceStreamReader):
    """Offsets are {path: [bytes, lines]}, so a restart continues where the checkpoint says and line numbers need no state."""

    def __init__(self, options: dict):
        self.pattern, self.from_end = options["path"], options.get("from", "end") == "end"

    def _paths(self) -> list[str]:
        return sorted(p for p in glob.glob(self.pattern) if os.path.isfile(p))

    def initialOffset(self) -> dict:
        if not self.from_end:
            return {}
        return {p: list(_whole_lines(p, 0, os.path.getsize(p))) for p in self._paths()}

    def latestOffset(self) -> dict:
        out = dict(getattr(self, "_last", None) or self.initialOffset())
        for p in self._paths():
            at, lines = out.get(p, (0, 0))
            size = os.path.getsize(p)
            if size < at:  # the file was replaced
                at = lines = 0
            if size > at:
                end, n = _whole_lines(p, at, size)
                out[p] = [end, lines + n]
        self._last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for p, (to, _) in sorted(end.items()):
            at, lines = start.get(p, (0, 0))
            if to < at:
                at = lines = 0
            if to > at:
                out.append(_Range(p, at, to, lines))
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            data = f.read(part.end - part.start)
        for i, line in enumerate(data.split(b"\n")[:-1]):
            yield part.path, part.line + i + 1, line.decode("utf-8", errors="replace").rstrip()


class TailSource(DataSource):
    """``spark.readStream.format("siftwork_tail").option("path", GLOB).option("from", "end" or "start")``."""

    @classmethod
    def name(cls) -> str:
        return "siftwork_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def tail(spark: SparkSession, pattern: str, start: str = "end") -> DataFrame:
    """Lines that are added to files from now on (``end``), or all of them (``start``): (source, line_number, line)."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("siftwork_tail").option("path", pattern).option("from", start).load()


def arriving(spark: SparkSession, directory: str, glob_filter: str = "*") -> DataFrame:
    """Lines of text files that appear in a directory: (source, line_number, line). Each file is one row until it is split, so numbers are exact."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob_filter).load(directory)
    lines = files.select(F.col("_metadata.file_path").alias("source"), F.posexplode(lines_of(F.col("value"))).alias("i", "line"))
    return lines.select("source", (F.col("i") + 1).cast("bigint").alias("line_number"), "line")
