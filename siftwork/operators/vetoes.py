"""Predicates that discard a match or a whole line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from ..functions.rules import java
from ..functions.text import contains_any, trimmed

_NAMES = ["example", "test", "fake", "sample", "demo", "placeholder"]
TEST_MARKS = ["#[test]", "#[cfg(test)", "def test_", "fn test_", "function test_"]
#: A context line, trimmed, that opens a documentation comment about an example.
DOC_COMMENT = r"(?i)\A(?:///\s*(?:{0})|/\*\*?\s*(?:{0})|#\s*(?:example|test)\b)".format("|".join(_NAMES))
#: A declaration whose identifier names an example.
EXAMPLE_NAME = r"(?i)(?:" + "|".join(["const", "let", "var", "api[_-]?key", "key", "token", "secret", "password"]) + r")\s+\w*(?:" + "|".join([*_NAMES, "dummy"]) + r")\w*\s*="
#: The line before, if it announces an example.
EXAMPLE_COMMENT = r"(?i)//\s*(?:{})|#\s*(?:example|test)|(?:example|test):".format("|".join(_NAMES))
_VALUE = "|".join([*_NAMES, "dummy"])
EXAMPLE_VALUE = rf"(?i)\A(?:(?:{_VALUE})[\d_-]*|[\d_-]*(?:{_VALUE}))\z"
PLACEHOLDER = (
    r"(?i)\A(?:x{3,}|\*{3,}|-{3,}|_{3,})\z"
    r"|(?:" + "|".join([r"your[-_]?api[-_]?key", r"insert[-_]?token", r"replace[-_]?me", "changeme", "placeholder", "todo"]) + r")[-_]?(?:here)?\z"
    r"|\A<[^>]+>\z"
    r"|\A.*(?:" + "|".join(["TODO", "FIXME", "CHANGEME", "REPLACE", "XXX"]) + r")\s*\z"
)
REGEX_CODE = ["regex", "new regexp", "define_regex!", "re.compile", "pattern:", "(?i)"]
#: Values that vendors print in their documentation, in lower case.
DOCUMENTED = {
    "AWS_ACCESS_KEY": ["akia" + "iosfodnn7" + "example"],
    "AWS_SECRET_KEY": ["wjalrxutnfemi" + "/k7mdeng" + "/bpxrficy" + "examplekey"],
    "GOOGLE_API_KEY": ["aizasya" + "1234567890" + "abcdefghijklmnopqrstu"],
    "SLACK_WEBHOOK": ["https://hooks.slack.com/services/" + "/".join(["t" + "0" * 8, "b" + "0" * 8, "x" * 24]), "-".join(["xoxb", "1234567890123", "1234567890123", "abcdefghijklmnopqrstuvwx"])],
}


def is_known_example(rule_id: Column, match: Column) -> Column:
    s = F.lower(trimmed(match))
    named = F.lit(False)
    for rule, values in DOCUMENTED.items():
        named = named | ((rule_id == rule) & s.isin(values))
    return named | F.regexp_like(s, F.lit(r"\A(?:test|example|fake|dummy|sample)_|(?:example|_test|_fake|_dummy)\z"))


def is_repetitive(match: Column) -> Column:
    same = (F.octet_length(match) >= 8) & F.regexp_like(match, F.lit(r"(?s)\A(.)\1*\z")) & (F.octet_length(match) == F.length(match))
    few = F.regexp_like(match, F.lit(r"\A[0-9]{12,}\z")) & (F.size(F.array_distinct(F.split(match, ""))) <= 3)
    return same | few


def is_placeholder(match: Column) -> Column:
    return F.regexp_like(trimmed(match), F.lit(java(PLACEHOLDER)))


def value_veto(match: Column) -> Column:
    """Values of at most 80 bytes that spell an example, repeat or hold a place."""
    return (F.octet_length(match) <= 80) & (F.regexp_like(trimmed(match), F.lit(java(EXAMPLE_VALUE))) | is_repetitive(match) | is_placeholder(match))


def line_veto(path: Column, line: Column, context: Column) -> Column:
    """What path, line and context tell, whatever the match."""
    return (
        is_test_path(path)
        | contains_any(line, TEST_MARKS)
        | F.exists(context, lambda x: contains_any(x, TEST_MARKS) | F.regexp_like(trimmed(x), F.lit(java(DOC_COMMENT))))
        | F.regexp_like(line, F.lit(java(EXAMPLE_NAME)))
        | F.regexp_like(F.element_at(context, 1), F.lit(java(EXAMPLE_COMMENT)))
    )


def is_regex_code(line: Column) -> Column:
    return contains_any(F.lower(line), REGEX_CODE)


def is_listed(match: Column, whitelist: tuple[str, ...]) -> Column:
    return contains_any(match, list(whitelist)) if whitelist else F.lit(False)


def is_allowed(match: Column, regexes: tuple[str, ...]) -> Column:
    return F.regexp_like(match, F.lit("|".join(f"(?:{java(r)})" for r in regexes))) if regexes else F.lit(False)
