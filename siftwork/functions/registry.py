"""The engine's functions for Spark SQL: scalar ones that the optimiser inlines, and a table function that scans a text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .paths import TEST_PATH
from .rules import RULES

_D = "regexp_replace(s, '[^0-9]', '')"


def _weighted(digits: str, weights: list[int]) -> str:
    return " + ".join(f"cast(substring({digits}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights))


def _eleven(total: str) -> str:
    return f"(case when ({total}) % 11 < 2 then 0 else 11 - ({total}) % 11 end)"


def _digit(digits: str, i: int) -> str:
    return f"cast(substring({digits}, {i + 1}, 1) as int)"


_FIRST = [*range(5, 1, -1), *range(9, 1, -1)]
_PAIRS = "regexp_extract_all(hex(encode(s, 'UTF-8')), '..', 0)"
#: name: (return type, body over the string s)
FUNCTIONS = {
    "luhn_valid": ("BOOLEAN", f"coalesce(length({_D}) between 13 and 16 and luhn_check({_D}), false)"),
    "cpf_valid": ("BOOLEAN", f"coalesce(length({_D}) = 11 and {_D} <> repeat(substring({_D}, 1, 1), 11) and ((({_weighted(_D, list(range(10, 1, -1)))}) * 10) % 11) % 10 = {_digit(_D, 9)} and ((({_weighted(_D, list(range(11, 1, -1)))}) * 10) % 11) % 10 = {_digit(_D, 10)}, false)"),
    "cnpj_valid": ("BOOLEAN", f"coalesce(length({_D}) = 14 and {_D} <> repeat(substring({_D}, 1, 1), 14) and {_eleven(_weighted(_D, _FIRST))} = {_digit(_D, 12)} and {_eleven(_weighted(_D, [6, *_FIRST]))} = {_digit(_D, 13)}, false)"),
    "nif_valid": ("BOOLEAN", f"coalesce(length({_D}) = 9 and substring({_D}, 1, 1) <> '0' and {_eleven(_weighted(_D, list(range(9, 1, -1))))} = {_digit(_D, 8)}, false)"),
    "ssn_valid": ("BOOLEAN", f"coalesce(length({_D}) = 9 and substring({_D}, 1, 3) not in ('000', '666') and substring({_D}, 1, 1) <> '9' and substring({_D}, 4, 2) <> '00' and substring({_D}, 6, 4) <> '0000', false)"),
    "byte_entropy": ("DOUBLE", f"abs(aggregate(transform(array_distinct({_PAIRS}), d -> cast(size(filter({_PAIRS}, p -> p = d)) as double) / size({_PAIRS})), 0D, (a, x) -> a - x * log2(x)))"),
    "redact_secret": ("STRING", "case when octet_length(s) < 12 then '[REDACTED]' else concat(left(s, 4), '****', right(s, 4)) end"),
    "is_test_path": ("BOOLEAN", f"regexp_like(lower(replace(s, '\\\\', '/')), r'{TEST_PATH}')"),
}


def _scan_lines_udtf():
    patterns = [(r.id, r.severity, r.pattern) for r in RULES]

    @udtf(returnType="line_number int, rule_id string, severity string, match string")
    class ScanLines:
        """Every built-in rule that matches a line of a text, without vetoes."""

        def __init__(self):
            import re

            self.rules = [(i, s, re.compile(p.replace(r"\z", r"\Z"))) for i, s, p in patterns]

        def eval(self, text: str):
            for n, line in enumerate((text or "").split("\n")):
                for rule, severity, pattern in self.rules:
                    m = pattern.search(line)
                    if m:
                        yield n + 1, rule, severity, m[0]

    return ScanLines


def register(spark: SparkSession) -> list[str]:
    """Registers FUNCTIONS as temporary SQL functions, and the table function ``scan_lines(text)``; returns their names."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("scan_lines", _scan_lines_udtf())
    return [*FUNCTIONS, "scan_lines"]
