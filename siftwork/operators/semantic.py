"""Deep mode: decoded runs, rotated lines, concatenations and telling variable names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.kept import kept
from ..functions.paths import entropy_threshold
from ..functions.rules import MORTAL, VENIAL, java
from ..functions.text import byte_entropy, decode_base64, decode_hex, lines_of, rot13, trimmed

BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"
HEX_RUN = r"(?i)(?:[0-9a-f]{2}){10,}"
_Q = "[\"']"
CONCAT = rf"{_Q}([^\"']+){_Q}" + r"\s*\+\s*" + rf"{_Q}([^\"']+){_Q}"
TELLING_NAME = r"(?i)\b\w*(?:" + "|".join(["api_key", "auth", "credential", "db_pass", "key", "passwd", "password", "secret", "token"]) + rf")\w*\s*[=:]\s*{_Q}[^'\"]+{_Q}"
ASSIGNED = rf"[=:]\s*{_Q}([^'\"]+){_Q}"
TRIVIAL = r"(?i)\A(?:" + "|".join(["0", "1", "true", "false", "null", "none", "nil", "todo", "x{3,}", r"\*{3,}", "test", "fake", "demo", "dummy", "sample", "example", "changeme", "placeholder", "password", "secret"]) + r")\z"


def decoded_texts(line: Column) -> Column:
    """ARRAY<STRUCT<text, label>> to examine, in order: base64 runs of entropy over 3.5, hex runs, the rotated line."""
    runs = F.filter(F.regexp_extract_all(line, F.lit(BASE64_RUN), F.lit(0)), lambda r: byte_entropy(r) > 3.5)
    plain = F.transform(runs, lambda r: F.struct(decode_base64(r).alias("text"), F.lit("Base64").alias("label")))
    pairs = F.transform(F.regexp_extract_all(line, F.lit(HEX_RUN), F.lit(0)), lambda r: F.struct(decode_hex(r).alias("text"), F.lit("Hex").alias("label")))
    turned = F.struct(F.when(rot13(line) != line, rot13(line)).alias("text"), F.lit("ROT13").alias("label"))
    return F.filter(F.concat(plain, pairs, F.array(turned)), lambda d: d["text"].isNotNull())


def telling_value(line: Column) -> Column:
    """The value assigned to a variable with a telling name, unless it is trivial or under 4 bytes."""
    value = F.regexp_extract(line, java(ASSIGNED), 1)
    good = F.regexp_like(line, F.lit(java(TELLING_NAME))) & (value != "") & ~F.regexp_like(trimmed(value), F.lit(java(TRIVIAL))) & (F.octet_length(value) >= 4)
    return F.when(good, value)


def concatenated(line: Column) -> Column:
    """Both parts of the line's first concatenation of two quoted strings; empty without one."""
    return F.concat(F.regexp_extract(line, java(CONCAT), 1), F.regexp_extract(line, java(CONCAT), 2))


@kept
def _decoded_hit(config: Config) -> Column:
    from .detect import first_hit

    threshold = entropy_threshold(F.col("path"), config.entropy_threshold)
    hits = F.transform(decoded_texts(F.col("line")), lambda d: F.struct(first_hit(d["text"], F.col("path"), F.col("context"), threshold, config).alias("hit"), d["label"].alias("label")))
    return F.get(F.filter(hits, lambda h: h["hit"].isNotNull()), F.lit(0))


def deep_hits(rows: DataFrame, config: Config) -> DataFrame:
    """Lines with ``hit``: their own unless it is suppressed, else that of the first decoded text that has one, else of a telling variable name.

    A generator computes the latter once, and only for lines without a hit of their own; so the lines meet the cascade
    once, and a filter on projected columns isn't pushed below to compute them again.
    """
    own = F.col("hit")
    missed = own.isNull()
    both = F.struct(F.when(missed, _decoded_hit(config)).alias("best"), F.when(missed, telling_value(F.col("line"))).alias("telling"))
    found = rows.select("*", F.explode(F.array(both)).alias("_t")).select("*", "_t.*").filter((~missed & ~F.col("suppressed")) | F.col("best").isNotNull() | F.col("telling").isNotNull())
    best = F.col("best.hit")
    named = F.struct(F.lit("SUSPICIOUS_VARNAME").alias("rule_id"), F.lit(VENIAL).alias("severity"), F.lit("Variable with suspicious name contains non-trivial value").alias("description"))
    decoded = F.struct(best["rule_id"].alias("rule_id"), best["severity"].alias("severity"), F.concat(F.lit("["), F.col("best.label"), F.lit(" decoded] "), best["description"]).alias("description"))
    plain = F.struct(*[own[c].alias(c) for c in ("rule_id", "severity", "description")])
    context = F.when(missed & F.col("best").isNull(), F.array().cast("array<string>")).otherwise(F.col("context"))
    return found.select("path", "line_idx", "line", context.alias("context"), "near", F.when(~missed, plain).when(F.col("best").isNotNull(), decoded).otherwise(named).alias("hit"))


def concatenations(docs: DataFrame, config: Config) -> DataFrame:
    """Every line whose first concatenation is of high entropy; markers and vetoes don't count here."""
    lines = docs.select("path", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    joined = concatenated(F.col("line"))
    high = lines.filter(F.regexp_like("line", F.lit(java(CONCAT)))).filter(byte_entropy(joined) > config.entropy_threshold)
    return high.select("path", (F.col("i") + 1).alias("line_number"), trimmed(F.col("line")).alias("snippet"), F.array().cast("array<string>").alias("context"), F.lit(MORTAL).alias("severity"), F.lit("Concatenated string with high entropy detected").alias("description"), F.lit("CONCAT_SECRET").alias("rule_id"))
