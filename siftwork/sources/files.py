"""Files of a directory tree as texts: which are read, and what counts as text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import Config
from ..functions.paths import check_scan_path, glob_regex, globs_regex

#: (offset, bytes) of media, archives, documents and executables, in hexadecimal.
_MAGIC = (
    (0, "FFD8FF"), (0, "89504E470D0A1A0A"), (0, "47494638"), (0, "424D"), (0, "49492A00"), (0, "4D4D002A"), (0, "00000100"), (8, "57454250"), (0, "38425053"),
    (0, "1A45DFA3"), (4, "66747970"), (0, "464C56"), (0, "000001BA"), (0, "494433"), (0, "FFFB"), (0, "4F676753"), (0, "664C6143"), (8, "57415645"), (8, "41564920"),
    (0, "504B0304"), (0, "504B0506"), (0, "504B0708"), (0, "1F8B08"), (0, "25504446"), (0, "7F454C46"),
)
#: Bytes in which a NUL makes a file binary.
PROBE = 8192
#: A larger file that isn't valid UTF-8 counts up to its first invalid line; a smaller one not at all.
STREAMED_MB = 10


def is_binary(content: Column) -> Column:
    """A known magic number of media, archives, documents and executables, or a NUL byte near the start."""
    head = F.hex(F.substring(content, 1, 64))
    magic = F.lit(False)
    for at, code in _MAGIC:
        magic = magic | (F.substring(head, 2 * at + 1, len(code)) == code)
    return magic | F.regexp_like(F.hex(F.substring(content, 1, PROBE)), F.lit(r"\A(?:..)*?00"))


@F.pandas_udf(StringType())
def valid_lines(contents: pd.Series) -> pd.Series:
    """The text up to the first line that isn't valid UTF-8; line ends become line feeds."""

    def one(data: bytes) -> str:
        out = []
        for line in bytes(data).split(b"\n"):
            try:
                out.append(line.removesuffix(b"\r").decode("utf-8"))
            except UnicodeDecodeError:
                break
        else:
            if out and out[-1] == "":
                out.pop()
        return "".join(x + "\n" for x in out)

    return contents.map(one)


def path_filter(path: Column, config: Config) -> Column:
    """Neither ignored, nor allowed by a file pattern."""
    out = F.lit(True)
    globs = [*config.ignore_paths, *config.allow_paths]
    if globs:
        out = out & ~F.regexp_like(path, F.lit(globs_regex(globs)))
    if config.allow_file_patterns:
        out = out & ~F.regexp_like(path, F.lit("|".join(f"(?:{x})" for x in config.allow_file_patterns)))
    return out


def as_texts(files: DataFrame, config: Config = Config()) -> DataFrame:
    """(path, text, file_hash) of (path, content, length) rows: not too large, not binary, valid UTF-8.

    A file over STREAMED_MB that turns invalid counts up to there. file_hash is the SHA-256 of the bytes.
    """
    kept = files.filter(path_filter(F.col("path"), config) & (F.col("length") <= config.max_file_size_mb << 20)).filter(~is_binary(F.col("content")))
    large = F.col("length") > STREAMED_MB << 20
    text = F.try_validate_utf8(F.col("content").cast("string"))
    whole = kept.select("path", text.alias("text"), F.sha2("content", 256).alias("file_hash")).filter("text IS NOT NULL")
    cut = kept.filter(large & ~F.is_valid_utf8(F.col("content").cast("string"))).select("path", valid_lines("content").alias("text"), F.sha2("content", 256).alias("file_hash"))
    return whole.unionByName(cut)


def _ignore_rules(root: str) -> Iterator[tuple[str, bool]]:
    """(regular expression on paths below the root, whether it ignores) of every .gitignore, outer files first."""
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d != ".git")
        if ".gitignore" not in names:
            continue
        base = os.path.relpath(folder, root)
        prefix = "" if base == "." else re.escape(base.replace(os.sep, "/")) + "/"
        for line in Path(folder, ".gitignore").read_text(errors="replace").splitlines():
            said = line.rstrip()
            if not said or said.startswith("#"):
                continue
            negated, said = said.startswith("!"), said.removeprefix("!").removeprefix("\\")
            only_dir, said = said.endswith("/"), said.rstrip("/")
            anchored, said = "/" in said, said.lstrip("/")
            body = re.sub(r"(?<!\\)\.\*", "[^/]*", glob_regex(said.replace("**", "\0"))).replace(re.escape("\0") + "/", "(?:.*/)?").replace("/" + re.escape("\0"), "/.*").replace(re.escape("\0"), ".*")
            yield prefix + ("" if anchored else "(?:.*/)?") + body + ("/.*" if only_dir else "(?:/.*)?"), not negated


def not_ignored(path: Column, root: str) -> Column:
    """False for paths that .gitignore files of a local tree exclude; a later rule overrides an earlier one."""
    start = root.rstrip("/") + "/"
    inner = F.substring(path, F.lit(len(start) + 1), F.length(path))
    out = F.lit(True)
    for regex, ignores in _ignore_rules(root):
        out = F.when(F.regexp_like(inner, F.lit(rf"(?s)\A(?:{regex})\z")), F.lit(not ignores)).otherwise(out)
    return out


def read_tree(spark: SparkSession, root: str, config: Config = Config(), paths: list[str] | None = None) -> DataFrame:
    """(path, text, file_hash) of a local or shared directory or file; hidden files count, .git and what .gitignore excludes don't.

    The size cap reaches the file source (it is pushed to file metadata), so larger files are never opened.
    ``paths`` restricts the scan to some files, as those that git lists.
    """
    real = check_scan_path(root)
    hidden = sorted(_hidden(real)) if paths is None else [p for p in paths if _is_hidden(p)]
    shown = [f"file://{real}"] if paths is None else [f"file://{p}" for p in paths if not _is_hidden(p)]
    parts = ([_visible(spark, shown, config)] if shown else []) + ([_opened(spark, hidden, config)] if hidden else [])
    if not parts:
        return spark.createDataFrame([], "path string, text string, file_hash string")
    named = reduce(DataFrame.unionByName, parts)
    if os.path.isdir(real):
        named = named.filter(not_ignored(F.col("path"), real))
    return as_texts(named, config)


def _is_hidden(path: str) -> bool:
    """Whether Spark's file sources pass over the file: a name on its way begins with a dot or an underscore."""
    return any(part[:1] in (".", "_") for part in path.split("/"))


def _hidden(root: str) -> Iterator[str]:
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d != ".git"]
        inner = os.path.relpath(folder, root)
        for name in names:
            if _is_hidden(name) or (inner != "." and _is_hidden(inner)):
                yield os.path.join(folder, name)


def _opened(spark: SparkSession, paths: list[str], config: Config) -> DataFrame:
    """(path, content, length) of files that Spark's own sources hide; executors open them."""
    cap = config.max_file_size_mb << 20

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                if os.path.isfile(p) and os.path.getsize(p) <= cap:
                    with open(p, "rb") as f:
                        data = f.read()
                    yield pd.DataFrame({"path": [p], "content": [data], "length": [len(data)]})

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(read, "path string, content binary, length bigint")


def _visible(spark: SparkSession, source: list[str], config: Config) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).filter(F.col("length") <= config.max_file_size_mb << 20)
    return raw.select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "content", "length")


def local_name(path: str) -> str:
    """A local path from a file URI."""
    return unquote(re.sub(r"\Afile:/+", "/", path))


def from_table(rows: DataFrame, text: str = "text", *path: str, suffix: str = ".txt") -> DataFrame:
    """(path, text) of a table: the path is made of columns, joined by slashes, and a suffix."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in path]
    return rows.select(F.concat(F.concat_ws("/", *parts), F.lit(suffix)).alias("path"), F.col(text).alias("text"))


def from_text(spark: SparkSession, text: str, path: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(path, text)], "path string, text string")
