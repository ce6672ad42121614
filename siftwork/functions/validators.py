"""Check-digit validators and structural confidence levels as Column expressions.

Levels are 0 info, 1 suspicious, 2 critical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

INFO, SUSPICIOUS, CRITICAL = 0, 1, 2
LEVELS = ("info", "suspicious", "critical")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
PLACEHOLDER_PASSWORDS = ["pass", "password", "secret", "test", "example", "changeme", "placeholder", "xxx", "your_pass", "your_password", "your-password"]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit(digits: Column, i: int) -> Column:
    return F.substring(digits, i + 1, 1).cast("int")


def _weighted(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(digits, i) * w
    return total


def _sized(digits: Column, n: int, test: Column) -> Column:
    """Null in, null out; a wrong length is false without looking at the digits."""
    return F.when(F.length(digits) == n, test).otherwise(F.when(digits.isNotNull(), F.lit(False)))


def luhn(text: Column) -> Column:
    d = digits_of(text)
    return F.when(F.length(d).between(13, 16), F.call_function("luhn_check", d)).otherwise(F.when(d.isNotNull(), F.lit(False)))


def _mixed(d: Column, n: int) -> Column:
    return d != F.repeat(F.substring(d, 1, 1), F.lit(n))


def cpf(text: Column) -> Column:
    d = digits_of(text)

    def check(n: int) -> Column:
        return ((_weighted(d, list(range(n + 1, 1, -1))) * 10) % 11) % 10 == _digit(d, n)

    return _sized(d, 11, _mixed(d, 11) & check(9) & check(10))


def _eleven(total: Column) -> Column:
    return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)


def cnpj(text: Column) -> Column:
    d = digits_of(text)
    first = [*range(5, 1, -1), *range(9, 1, -1)]
    return _sized(d, 14, _mixed(d, 14) & (_eleven(_weighted(d, first)) == _digit(d, 12)) & (_eleven(_weighted(d, [6, *first])) == _digit(d, 13)))


def nif(text: Column) -> Column:
    d = digits_of(text)
    return _sized(d, 9, (_digit(d, 0) != 0) & (_eleven(_weighted(d, list(range(9, 1, -1)))) == _digit(d, 8)))


def dni(text: Column) -> Column:
    clean = F.regexp_replace(text, R.java(r"[\s-]"), "")
    number = F.regexp_replace(F.substring(clean, 1, 8), "[+]", "").cast("int")
    letter = F.substring(F.lit(DNI_LETTERS), number % 23 + 1, F.lit(1))
    return F.when(F.regexp_like(clean, F.lit(r"\A(?:[0-9]{8}|[+][0-9]{7})[\x00-\x7f]\z")), F.upper(F.substring(clean, 9, 1)) == letter).otherwise(F.when(clean.isNotNull(), F.lit(False)))


def ssn(text: Column) -> Column:
    d = digits_of(text)
    area = F.substring(d, 1, 3).cast("int")
    return _sized(d, 9, (area != 0) & (area != 666) & (area < 900) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"))


def iban(text: Column) -> Column:
    clean = F.upper(F.regexp_replace(text, R.java(r"\s"), ""))
    turned = F.concat(F.substring(clean, F.lit(5), F.length(clean) - 4), F.substring(clean, 1, 4))
    code = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c <= "9", 10).otherwise(100) + code(c)) % 97))
    shape = F.regexp_like(clean, F.lit(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\z"))
    return F.when(shape, rest == 1).otherwise(F.when(clean.isNotNull(), F.lit(False)))


def dsn_password(text: Column) -> Column:
    """The password of a connection string; null where there is none or it is a placeholder."""
    p = F.regexp_extract(text, R.java(R.DSN.format("([^@]+)")), 1)
    return F.when((p != "") & ~F.lower(p).isin(PLACEHOLDER_PASSWORDS), p)


def _found(snippet: Column, pattern: str, valid) -> Column:
    m = F.regexp_substr(snippet, F.lit(R.java(pattern)))
    return F.when(m.isNull(), SUSPICIOUS).when(valid(m), CRITICAL).otherwise(INFO)


def aws_level(snippet: Column) -> Column:
    key = F.regexp_substr(snippet, F.lit(R.java("(AKIA|ASIA)[A-Z0-9]{16}")))
    return F.when(key.isNull(), SUSPICIOUS).when(F.substring(key, 5, 16) == F.repeat(F.substring(key, 5, 1), F.lit(16)), SUSPICIOUS).otherwise(CRITICAL)


def stripe_level(snippet: Column) -> Column:
    key = F.regexp_substr(snippet, F.lit(R.java(R.STRIPE)))
    return F.when(F.substring(key, 4, 5).eqNullSafe(F.lit("live_")) & (F.octet_length(key) >= 32), CRITICAL).otherwise(SUSPICIOUS)


def structural_level(snippet: Column, rule_id: Column) -> Column:
    """The level that a rule's own validator gives; null for rules without one."""
    return (
        F.when(rule_id == "AWS_ACCESS_KEY", aws_level(snippet))
        .when(rule_id == "STRIPE_SECRET", stripe_level(snippet))
        .when(rule_id == "BRAZILIAN_CPF", _found(snippet, R.CPF, cpf))
        .when(rule_id == "BRAZILIAN_CNPJ", _found(snippet, R.CNPJ, cnpj))
        .when(rule_id == "DSN_CREDENTIALS", F.when(dsn_password(snippet).isNotNull(), CRITICAL).otherwise(SUSPICIOUS))
        .when(rule_id == "NIF_PT", _found(snippet, R.NIF, nif))
        .when(rule_id == "DNI_ES", _found(snippet, R.DNI, dni))
        .when(rule_id == "SSN_US", _found(snippet, R.SSN, ssn))
        .when(rule_id == "IBAN", _found(snippet, R.IBAN, iban))
    )


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def level_of_score(score: Column) -> Column:
    return F.when(score >= 0.75, CRITICAL).when(score >= 0.4, SUSPICIOUS).otherwise(INFO)


def github_risk(scopes: Column) -> Column:
    """Risk of a token by its scopes: read_only, read_write or administrative; unknown scopes count as read_write."""
    return F.when(F.arrays_overlap(scopes, F.array(*map(F.lit, ["admin:org", "delete_repo", "admin:repo_hook"]))), "administrative").when(F.arrays_overlap(scopes, F.array(F.lit("repo"), F.lit("write:org"))), "read_write").when(F.size(scopes) > 0, "read_only").otherwise("read_write")


def stripe_risk(secret: Column) -> Column:
    return F.when(F.contains(secret, F.lit("_live_")), "catastrophic").otherwise("read_write")
