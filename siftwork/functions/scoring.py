"""Ensemble scores of candidates and the final confidence, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import is_config_path, is_test_path
from .rules import AWS_KEY, RULES, java
from .text import byte_entropy, contains_any
from .validators import SUSPICIOUS, level_name, level_of_score, structural_level

KEYWORDS = ["api_key", "api_url", "secret", "token", "password"]
SECRET_FROM = 0.55


@dataclass(frozen=True)
class Weights:
    entropy: float = 0.35
    char_frequency: float = 0.25
    structural: float = 0.25
    length: float = 0.15

    @property
    def total(self) -> float:
        return self.entropy + self.char_frequency + self.structural + self.length


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def entropy_score(candidate: Column) -> Column:
    return _clamp((byte_entropy(candidate) - 2.0) / 3.5)


def char_frequency_score(candidate: Column) -> Column:
    """More classes of characters, and none that dominates, score higher; characters over bytes."""
    n = F.octet_length(candidate)
    shares = [F.regexp_count(candidate, F.lit(c)) / n for c in ("[A-Z]", "[a-z]", "[0-9]", "(?s)[^A-Za-z0-9]")]
    classes = sum(((s > 0.05).cast("int") for s in shares), F.lit(0))
    score = F.when(classes <= 1, 0.1).when(classes == 2, 0.4).when(classes == 3, 0.75).otherwise(0.95)
    return F.when(n == 0, 0.0).when(F.greatest(*shares) > 0.9, score * 0.3).otherwise(score)


_CHARSETS = {"alphanum": "[A-Za-z0-9_-]", "base64": "[A-Za-z0-9+/=_.-]", "hex": "[0-9A-Fa-f]"}


def _of_rule(rule_id: Column, values: dict[str, str | int | None]) -> Column:
    """A value by rule from a constant map, which is one expression however many rules there are; null for other rules."""
    told = {k: v for k, v in values.items() if v is not None}
    return F.element_at(F.expr("map(" + ", ".join(f"'{k}', " + (str(v) if isinstance(v, int) else f"'{v}'") for k, v in told.items()) + ")"), rule_id)


def structural_score(candidate: Column, rule_id: Column) -> Column:
    n = F.octet_length(candidate)
    prefix, charset = _of_rule(rule_id, {r.id: r.prefix for r in RULES}), _of_rule(rule_id, {r.id: r.charset for r in RULES})
    low, high = (_of_rule(rule_id, {r.id: r.length and r.length[i] for r in RULES}) for i in (0, 1))
    fits = None
    for kind, chars in _CHARSETS.items():
        fits = (F if fits is None else fits).when(charset == kind, F.regexp_like(candidate, F.lit(rf"\A{chars}*\z")))
    parts = [(F.startswith(candidate, prefix), 0.25, -0.3), (n.between(low, high), 0.2, -0.2), (fits, 0.1, -0.1)]
    return _clamp(sum((F.when(test, good).when(~test, bad).otherwise(0.0) for test, good, bad in parts), F.lit(0.5)))


def length_score(candidate: Column, rule_id: Column) -> Column:
    n = F.octet_length(candidate)
    low, high = (F.coalesce(_of_rule(rule_id, {r.id: r.length and r.length[i] for r in RULES}), F.lit(d)) for i, d in ((0, 16), (1, 500)))
    return F.when(n.between(low, high), 1.0).when(n < low, n / low).otherwise(_clamp(1.0 - (n - high) / high * 0.5, 0.1))


def classify(candidate: Column, rule_id: Column, weights: Weights = Weights()) -> Column:
    """STRUCT(score, is_secret, entropy, char_frequency, structural, length)."""
    parts = {"entropy": entropy_score(candidate), "char_frequency": char_frequency_score(candidate), "structural": structural_score(candidate, rule_id), "length": length_score(candidate, rule_id)}
    score = sum((parts[k] * getattr(weights, k) for k in parts), F.lit(0.0)) / weights.total
    return F.struct(score.alias("score"), (score >= SECRET_FROM).alias("is_secret"), *[v.alias(k) for k, v in parts.items()])


def ensemble_factors(scores: Column) -> Column:
    """The parts of :func:`classify` as texts: entropy=0.91 and so on."""
    return F.array(*[F.concat(F.lit(f"{k}="), F.format_number(scores[k].cast("double"), 2)) for k in ("entropy", "char_frequency", "structural", "length")])


def nearby_bonus(near: Column, line: Column) -> Column:
    """What a keyword within five lines on either side and an assignment add to the ensemble score."""
    return F.when(near, 0.15).otherwise(0.0) + F.when(contains_any(line, ["=", ":"]), 0.1).otherwise(0.0)


def structure_boost(snippet: Column, rule_id: Column) -> Column:
    token = F.regexp_like(snippet, F.lit(java(r"\A[\p{IsAlphabetic}\p{N}_-]*(?:\.[\p{IsAlphabetic}\p{N}_-]*){2}\z")))
    return F.when(rule_id == "JWT_TOKEN", F.when(token, 0.2).otherwise(-0.3)).when(rule_id == "AWS_ACCESS_KEY", F.when(F.regexp_like(snippet, F.lit(AWS_KEY)), 0.25).otherwise(-0.2))


def confidence(path: Column, snippet: Column, rule_id: Column, verified: Column) -> Column:
    """STRUCT(confidence, confidence_factors, confidence_level): structure, verification and path; never below suspicious."""
    boost = structure_boost(snippet, rule_id)
    parts = [
        (boost.isNotNull(), boost, F.when(boost > 0, F.format_string("+%.2f valid_structure", boost)).otherwise(F.format_string("%.2f invalid_structure", boost))),
        (F.coalesce(verified, F.lit(False)), F.lit(0.3), F.lit("+0.3 verified_active")),
        (is_config_path(path), F.lit(0.1), F.lit("+0.1 config_file")),
        (is_test_path(path), F.lit(-0.2), F.lit("-0.2 test_file_path")),
    ]
    score = F.lit(0.5)
    for on, delta, _ in parts:
        score = score + F.when(on, delta).otherwise(0.0)
    score = _clamp(score)
    factors = F.array_compact(F.array(*[F.when(on, text) for on, _, text in parts]))
    own = level_of_score(F.round(score, 6))
    level = F.greatest(own, F.coalesce(structural_level(snippet, rule_id), own), F.lit(SUSPICIOUS))
    return F.struct(score.cast("float").alias("confidence"), F.when(F.size(factors) > 0, factors).alias("confidence_factors"), level_name(level).alias("confidence_level"))
