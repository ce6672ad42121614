"""What a path tells: test files, configuration, thresholds, infrastructure files, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

_TEST_DIRS = ["tests", "test", "__tests__", "spec"]
_TEST_PARTS = ["testdata", "test_data", "fixtures"]
_TEST_ENDS = ["_test.py", "_test.rs", "_test.go", "_spec.rb"] + [f".{kind}.{ext}" for kind in ("spec", "test") for ext in ("js", "ts", "jsx", "tsx")]
#: What a lower-case path with forward slashes looks like if it is a test's.
TEST_PATH = r"(?:\A|/)(?:" + "|".join(_TEST_DIRS) + ")/|/(?:" + "|".join(_TEST_PARTS) + r")/|(?:\A|/)test_[^/]*\z|(?:" + "|".join(map(re.escape, _TEST_ENDS)) + r")\z|(?:\A|/)(?:conftest|fixtures)\.py\z"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Of the file name, without the dot; null for none and for names that only begin with a dot."""
    found = F.regexp_extract(file_name(path), r"(?s)\A.+\.([^.]*)\z", 1)
    return F.when(F.regexp_like(file_name(path), F.lit(r"(?s)\A.+\.[^.]*\z")), found)


def scope_extension(path: Column) -> Column:
    """All after the last dot, the whole path without one; lower case."""
    return F.lower(F.substring_index(path, ".", -1))


def is_test_path(path: Column) -> Column:
    return F.regexp_like(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit(TEST_PATH))


def is_config_path(path: Column) -> Column:
    lower = F.lower(path)
    return F.coalesce(extension(lower).isin("env", "yml", "yaml"), F.lit(False)) | contains_any(lower, [".config.", "/.env"])


def entropy_threshold(path: Column, base: float, history: bool = False) -> Column:
    """The base, raised or lowered by the kind of file; history scans have a shorter table."""
    ext = extension(path)
    low = {"env": -0.3, "config": -0.3, "properties": -0.3, "ini": -0.3, "json": -0.2, "yaml": -0.2, "yml": -0.2, "toml": -0.2}
    table = {"js": 0.5} | low if history else {"lock": 1.5, "svg": 0.8, "js": 0.5, "test": 0.5, "spec": 0.5, "md": 0.3} | low
    out = None if history else F.when(F.regexp_like(file_name(path), F.lit(r"\.min\.(?:js|css)\z")), F.lit(base + 1.0))
    for delta in sorted(set(table.values()), reverse=True):
        kinds = [k for k, d in table.items() if d == delta]
        out = (F if out is None else out).when(ext.isin(kinds), F.lit(base + delta))
    return out.otherwise(F.lit(base))


def is_iac_path(path: Column) -> Column:
    name = F.lower(file_name(path))
    return (name == "dockerfile") | F.startswith(name, F.lit("dockerfile.")) | F.coalesce(extension(path).isin("tf", "yaml", "yml"), F.lit(False))


def glob_regex(glob: str) -> str:
    """A regular expression for a glob in which * and ? cross slashes, ** is any number of directories, and [...] a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            else:
                out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def globs_regex(globs: list[str]) -> str:
    return r"(?s)\A(?:" + "|".join(map(glob_regex, globs)) + r")\z"


#: Sensitive places that are never scanned.
FORBIDDEN = ("/proc", "/sys", "/dev", "/etc/shadow", "/etc/passwd")


def check_scan_path(path: str) -> str:
    from pathlib import Path

    real = str(Path(path).resolve(strict=True))
    if any(real == f or real.startswith(f) for f in FORBIDDEN):
        raise ValueError(f"{real} is a system path and isn't scanned")
    return real
