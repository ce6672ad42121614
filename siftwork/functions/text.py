"""Lines, quotes, hashes and byte entropy as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import java

EDGE_SPACE = java(r"^\s+|\s+\z")
QUOTED = r""""([^"]*)"|'([^']*)'|["'].*\z"""


def trimmed(text: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def lines_of(text: Column) -> Column:
    r"""The lines of a text: ends (\n or \r\n) are cut off, a final empty piece is dropped, null and empty texts have none."""
    pieces = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    last = F.size(pieces) - 1
    bare = F.transform(pieces, lambda x, i: F.when((i < last) | F.endswith(text, F.lit("\n")), F.regexp_replace(x, r"\r\z", "")).otherwise(x))
    return F.when(text != "", F.when(F.contains(text, F.lit("\r")), bare).otherwise(pieces)).otherwise(F.array().cast("array<string>"))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def quoted_strings(line: Column, longer_than: int = 20) -> Column:
    """Contents of quoted strings of more than so many bytes, left to right; the other quote means nothing inside one."""
    pieces = F.regexp_extract_all(line, F.lit(QUOTED), F.lit(0))
    closed = F.filter(pieces, lambda p: (F.length(p) > 1) & (F.substring(p, 1, 1) == F.substring(p, -1, 1)) & (F.octet_length(p) > longer_than + 2))
    return F.transform(closed, lambda p: F.substring(p, F.lit(2), F.length(p) - 2))


def byte_entropy(text: Column) -> Column:
    """Shannon entropy in bits a byte of the UTF-8 form; an empty text has 0.

    Bytes become characters (Latin-1), and each distinct one is counted by what its removal takes away, so
    the lambda runs over distinct bytes only.
    """
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    n = F.octet_length(text).cast("double")
    kinds = F.filter(F.array_distinct(F.split(latin, "")), lambda d: d != "")
    share = lambda d: (n - F.length(F.replace(latin, d, F.lit("")))) / n
    total = F.aggregate(F.transform(kinds, share), F.lit(0.0), lambda acc, x: acc - x * F.log2(x))
    return F.when(n > 0, F.abs(total)).otherwise(F.when(text.isNotNull(), F.lit(0.0)))


def rot13(text: Column) -> Column:
    a, b = "abcdefghijklm", "nopqrstuvwxyz"
    return F.translate(text, a + b + a.upper() + b.upper(), b + a + b.upper() + a.upper())


def printable(decoded: Column) -> Column:
    """At least 8 characters, all of them printable ASCII."""
    return F.coalesce(F.regexp_like(decoded, F.lit(r"\A[ -~]{8,}\z")), F.lit(False))


def decode_base64(run: Column) -> Column:
    """The text behind a strictly padded base64 run, if it is printable; else null."""
    raw = F.try_to_binary(run, F.lit("base64"))
    text = F.try_validate_utf8(raw.cast("string"))
    strict = F.regexp_replace(F.base64(raw), r"\s", "") == run
    return F.when(strict & printable(text), text)


def decode_hex(run: Column) -> Column:
    text = F.try_validate_utf8(F.unhex(run).cast("string"))
    return F.when(printable(text), text)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def snippet_fingerprint(snippet: Column) -> Column:
    """SHA-256 of at most 64 bytes of the trimmed snippet, cut between characters."""
    short = trimmed(snippet)
    cut = F.make_valid_utf8(F.substring(F.encode(short, "UTF-8"), 1, 64).cast("string"))
    return sha256_hex(F.regexp_replace(cut, "\ufffd+\\z", ""))


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_env(value: Column) -> Column:
    """A value for an env file: escapes, and quotes where a line feed, a hash sign or a blank needs them."""
    out = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(contains_any(value, ["\n", "#", " "]), F.concat(F.lit('"'), out, F.lit('"'))).otherwise(out)
