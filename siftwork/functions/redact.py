"""Redaction as Column expressions. Cuts fall between characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kept import kept
from .rules import RULES, java
from .text import byte_entropy, quoted_strings

#: Quoted strings above this entropy are redacted, whatever threshold found them.
REDACT_ENTROPY = 4.5


def redact_secret(secret: Column, visible: int = 4) -> Column:
    short = F.octet_length(secret) < 2 * visible + 4
    return F.when(short, F.lit("[REDACTED]")).otherwise(F.concat(F.substring(secret, 1, visible), F.lit("****"), F.substring(secret, -visible, visible) if visible else F.lit("")))


def _redact_quoted(line: Column, visible: int, above: Column | float) -> Column:
    high = F.filter(quoted_strings(line), lambda q: byte_entropy(q) > above)
    return F.aggregate(high, line, lambda acc, q: F.replace(acc, q, redact_secret(q, visible)))


def redact_line(line: Column, rule_id: Column, visible: int = 4, enabled: bool = True, above: Column | float = REDACT_ENTROPY, extra: list | None = None) -> Column:
    """All occurrences of the rule's leftmost match are masked; so are high-entropy strings for HIGH_ENTROPY.

    Findings of other kinds come back unmasked, unless ``extra`` has their rules (custom ones).
    """
    if not enabled:
        return line
    out = F.when(rule_id == "HIGH_ENTROPY", _redact_quoted(line, visible, above))
    match = None
    for r in [*RULES, *(extra or [])]:
        match = (F if match is None else match).when(rule_id == r.id, F.regexp_substr(line, F.lit(java(r.pattern))))
    return out.otherwise(F.when(match.isNotNull(), F.replace(line, match, redact_secret(match, visible))).otherwise(line))


@kept
def masked_snippet(visible: int = 4, enabled: bool = True, extra: tuple = ()) -> Column:
    """:func:`redact_line` of the columns snippet and rule_id."""
    return redact_line(F.col("snippet"), F.col("rule_id"), visible, enabled, extra=list(extra))


def redact_log_line(line: Column) -> Column:
    return F.when(F.octet_length(line) <= 20, line).otherwise(F.concat(F.substring(line, 1, 8), F.lit("...REDACTED..."), F.substring(line, -8, 8)))
