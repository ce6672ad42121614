"""Where in a source file a line stands: documentation, comment, test function.

States that run forward are window expressions over (path, line_idx, line) tables; the backward
searches with resets are one Arrow UDF that sees each code file once and walks down it: no row carries
a file for each of its lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType

from ..functions.paths import is_test_path, scope_extension

_SLASH = "rs js ts jsx tsx mjs cjs go java kt cs c cpp h hpp swift scala".split()
_HASH = "py rb sh bash zsh yaml yml toml r".split()
_MARKUP = "html xml svg".split()
_BLOCK_DOCS = "js ts jsx tsx mjs java kt cs go rs scala".split()
_JS = "js ts jsx tsx mjs cjs".split()
LANGUAGES = sorted({"py", "rb", *_BLOCK_DOCS, *_JS})

_FIXTURES = frozenset(f"{a}{b}" for a in ("setUp", "tearDown") for b in ("", "Class")) | {"setUpTestData", "asyncSetUp", "asyncTearDown"}
_PY_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)")
_RS_FN = re.compile(r"[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+)?fn[ \t]+\w+")
_RS_TEST = re.compile(r"[ \t]*#\s*\[(?:tokio::)?test(?:[ \t]*\]|,)")
_JS_CALL = re.compile(r"[ \t]*(?:" + "|".join(["describe", "suite", "context", "specify", "it", "test"] + [a + b for a in ("before", "after") for b in ("Each", "All")]) + r")[ \t]*\(")
_GO_TEST = re.compile(r"func[ \t]+Test\w*[ \t]*\(")
_JAVA_TEST = re.compile(r"[ \t]*@(?:ParameterizedTest|Test|(?:Before|After)(?:Class|Each)?)")
_RUBY_TEST = re.compile(r"[ \t]*(?:def[ \t]+test_|(?:it|describe|context)[ \t]*[\"'])")


def _indent(line: str) -> int:
    return len(line.encode()) - len(line.lstrip().encode())


def _closed(line: str, opening: str, closing: str) -> int:
    """Closers less openers."""
    return sum(line.count(c) for c in closing) - sum(line.count(c) for c in opening)


def _opened(lines: list[str], at: int, back: int, opening: str, closing: str, net: list[int] | None = None):
    """Walks back from a line; yields (index, closers less openers so far). Send True to start the count anew. net: the lines' own, if known."""
    depth = 0
    for i in range(at, max(0, at - back) - 1, -1):
        depth += _closed(lines[i], opening, closing) if net is None else net[i]
        if (yield i, depth):
            depth = 0


def _in_python(lines: list[str], at: int) -> bool:
    own = _indent(lines[at])
    for line in reversed(lines[:at]):
        if not line.strip():
            continue
        depth, named = _indent(line), _PY_DEF.match(line)
        if depth < own and named:
            return named[1].startswith("test_") or named[1] in _FIXTURES
        if depth == 0:
            return bool(named) and named[1].startswith("test_")
    return False


def _in_rust(lines: list[str], at: int, net: list[int] | None = None) -> bool:
    first = max(0, at - 300)
    walk = _opened(lines, at, 300, "{", "}", net)
    step = next(walk, None)
    while step:
        i, depth = step
        if depth < 0:
            if "mod tests" in lines[i] or "mod test_" in lines[i]:
                return True
            if _RS_FN.match(lines[i]):
                for j in range(i - 1, max(first, i - 10) - 1, -1):
                    said = lines[j].strip()
                    if said and _RS_TEST.match(lines[j]):
                        return True
                    if said and not said.startswith(("#", "//")):
                        break
        try:
            step = walk.send(depth < 0)
        except StopIteration:
            break
    return False


def _in_call(lines: list[str], at: int, opening: str, closing: str, pattern: re.Pattern, net: list[int] | None = None) -> bool:
    return any(depth < 0 and pattern.match(lines[i]) for i, depth in _opened(lines, at, 200, opening, closing, net))


def _in_java(lines: list[str], at: int, net: list[int] | None = None) -> bool:
    first = max(0, at - 200)
    walk = _opened(lines, at, 200, "{", "}", net)
    step = next(walk, None)
    while step:
        i, depth = step
        if depth < 0:
            for j in range(i - 1, max(first, i - 5) - 1, -1):
                if _JAVA_TEST.match(lines[j]):
                    return True
                said = lines[j].strip()
                if said and not said.startswith("@"):
                    break
        try:
            step = walk.send(depth < 0)
        except StopIteration:
            break
    return False


def _in_ruby(lines: list[str], at: int) -> bool:
    own = _indent(lines[at])
    for i in range(at - 1, max(0, at - 100) - 1, -1):
        if not lines[i].strip() or _indent(lines[i]) >= own:
            continue
        if _RUBY_TEST.match(lines[i]):
            return True
        if lines[i].strip() == "end":
            break
    return False


def in_test_function(lines: list[str], at: int, ext: str, net: list[int] | None = None) -> bool:
    if ext == "py":
        return at > 0 and _in_python(lines, at)
    if ext == "rs":
        return _in_rust(lines, at, net)
    if ext in _JS:
        return _in_call(lines, at, "{(", "})", _JS_CALL, net)
    if ext == "go":
        return _in_call(lines, at, "{", "}", _GO_TEST, net)
    if ext in ("java", "kt"):
        return _in_java(lines, at, net)
    return ext == "rb" and _in_ruby(lines, at)


def in_docstring(lines: list[str], at: int, ext: str) -> bool:
    if ext == "py":
        return any(sum(x.count(q) for x in lines[: at + 1]) % 2 for q in ('"' * 3, "'" * 3))
    if ext not in _BLOCK_DOCS:
        return False
    inside = False
    for i, line in enumerate(lines[: at + 1]):
        inside = inside or line.lstrip().startswith(("/**", "/*!"))
        if i < at and "*/" in line:
            inside = False
    return inside


def in_comment(lines: list[str], at: int, ext: str) -> bool:
    said = lines[at].lstrip()
    if ext in _HASH:
        return said.startswith("#")
    if ext in _SLASH:
        depth = 0
        for line in lines[: at + 1]:
            depth += sum(1 if m == "/*" else -1 for m in re.findall(r"/\*|\*/", line))
        return said.startswith("//") or depth > 0 or said.startswith("* ") or said == "*"
    if ext in _MARKUP:
        inside = False
        for i, line in enumerate(lines[: at + 1]):
            inside = inside or "<!--" in line
            if i < at and "-->" in line:
                inside = False
        return inside
    return said.startswith(("#", "//"))


# The same for all lines of a file, in one walk down it.


def _blocks(lines: list[str], opens: Callable[[str], bool], closes: str) -> list[bool]:
    """Between a line that opens and the one that closes, both included."""
    out, inside = [], False
    for line in lines:
        inside = inside or opens(line)
        out.append(inside)
        inside = inside and closes not in line
    return out


def _python_tests(lines: list[str]) -> list[bool]:
    """:func:`_in_python` of every line. A definition is hidden by later ones that are indented no deeper, so a stack by indentation holds the rest."""
    out, depths, tests, base = [], [], [], False
    for line in lines:
        depth = _indent(line)
        k = bisect_left(depths, depth)
        out.append(tests[k - 1] if k else base)
        if not line.strip():
            continue
        named = _PY_DEF.match(line)
        if depth == 0:
            depths, tests, base = [], [], bool(named) and named[1].startswith("test_")
        if named:
            k = bisect_left(depths, depth)
            depths[k:], tests[k:] = [depth], [named[1].startswith("test_") or named[1] in _FIXTURES]
    return out


def file_scopes(lines: list[str], ext: str) -> list[int]:
    """For every line the sum of 1 (comment), 2 (documentation) and 4 (test function)."""
    n = len(lines)
    comment, docs = None, [False] * n
    if ext in _SLASH:
        depths = accumulate(sum(1 if m == "/*" else -1 for m in re.findall(r"/\*|\*/", x)) for x in lines)
        comment = [d > 0 or x.startswith(("//", "* ")) or x == "*" for d, x in zip(depths, (x.lstrip() for x in lines), strict=True)]
    elif ext in _MARKUP:
        comment = _blocks(lines, lambda x: "<!--" in x, "-->")
    else:
        signs = "#" if ext in _HASH else ("#", "//")
        comment = [x.lstrip().startswith(signs) for x in lines]
    if ext == "py":
        odd = [accumulate([x.count(q) for x in lines]) for q in ('"' * 3, "'" * 3)]
        docs = [(a | b) & 1 > 0 for a, b in zip(*odd, strict=True)]
    elif ext in _BLOCK_DOCS:
        docs = _blocks(lines, lambda x: x.lstrip().startswith(("/**", "/*!")), "*/")
    if ext == "py":
        tests = _python_tests(lines)
    else:
        opening, closing = ("{(", "})") if ext in _JS else ("{", "}")
        net = [_closed(x, opening, closing) for x in lines]
        tests = [in_test_function(lines, i, ext, net) for i in range(n)]
    return [a + 2 * b + 4 * c for a, b, c in zip(comment, docs, tests, strict=True)]


@F.pandas_udf(ArrayType(ByteType()))
def scopes_of(lines: pd.Series, ext: pd.Series) -> pd.Series:
    """:func:`file_scopes` of each row's lines; null for null."""
    return pd.Series([None if x is None else file_scopes(list(x), e) for x, e in zip(lines, ext, strict=True)], dtype=object)


def is_comment(bits: Column) -> Column:
    return F.getbit(bits, F.lit(0)) == 1


def is_docstring(bits: Column) -> Column:
    return F.getbit(bits, F.lit(1)) == 1


def is_in_test(bits: Column) -> Column:
    return F.getbit(bits, F.lit(2)) == 1


def with_suppression(rows: DataFrame) -> DataFrame:
    """Adds ``suppressed``, from ``scope``: the line is documentation, in a test function or in a test file. Comments alone aren't suppressed."""
    said = F.coalesce(is_docstring(F.col("scope")) | is_in_test(F.col("scope")), F.lit(False))
    return rows.withColumn("suppressed", said | is_test_path(F.coalesce("path", F.lit(""))))


# Forward states over (path, line_idx, line) tables.
def _down_to(last: int) -> WindowSpec:
    return Window.partitionBy("path").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, last)


def python_docstring(line: Column) -> Column:
    """Parity of triple quotes up to and including the line."""
    odd = [F.sum(F.regexp_count(line, F.lit(q * 3))).over(_down_to(0)) % 2 == 1 for q in "\"'"]
    return odd[0] | odd[1]


def doc_block(line: Column) -> Column:
    """Between a line that begins a documentation block and the line that ends it, both included."""
    opens = F.regexp_like(line, F.lit(r"(?U)\A\s*/\*[*!]"))
    event = F.when(F.contains(line, F.lit("*/")), "close").when(opens, "open")
    return opens | F.coalesce(F.last(event, ignorenulls=True).over(_down_to(-1)) == "open", F.lit(False))


def block_comment_depth(line: Column) -> Column:
    """Openings less closings of block comments up to and including the line."""
    return F.sum(F.regexp_count(line, F.lit(r"/\*")) - F.regexp_count(line, F.lit(r"\*/"))).over(_down_to(0))


def html_comment(line: Column) -> Column:
    opens = F.contains(line, F.lit("<!--"))
    event = F.when(F.contains(line, F.lit("-->")), "close").when(opens, "open")
    return opens | F.coalesce(F.last(event, ignorenulls=True).over(_down_to(-1)) == "open", F.lit(False))
