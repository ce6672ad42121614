"""The line cascade: which finding, if any, a line has.

A document is one row; its lines are an array, so context needs no window and no shuffle. Lines that no
rule can match fall out at a cheap trigger before anything else is computed for them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import validators as V
from ..functions.kept import kept
from ..functions.paths import entropy_threshold, scope_extension
from ..functions.redact import redact_log_line
from ..functions.rules import HIGH_ENTROPY, RULES, TRIGGER, Rule, java, needed_texts
from ..functions.scoring import KEYWORDS, classify, confidence, nearby_bonus
from ..functions.text import byte_entropy, contains_any, lines_of, quoted_strings, trimmed
from . import scope, semantic
from .vetoes import is_allowed, is_known_example, is_listed, is_regex_code, line_veto, value_veto

DETAIL = "struct<is_active boolean, identity string, permissions array<string>, risk_level string>"
FINDING = (
    "path string, line_number int, snippet string, context array<string>, severity string, description string, rule_id string, commit_hash string, "
    f"verified boolean, confidence float, confidence_factors array<string>, confidence_level string, verification_detail {DETAIL}, ml_score float"
)
FINDING_COLUMNS = [c.split(" ")[0] for c in FINDING.replace(DETAIL, "x").split(", ")]


def _hit(rule: Rule) -> list[Column]:
    return [F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.description).alias("description")]


def matches_rule(line: Column, pattern: str) -> Column:
    """Whether a rule matches; lines without a text that it needs never meet its expression."""
    found, texts = F.regexp_like(line, F.lit(java(pattern))), needed_texts(pattern)
    return contains_any(line, list(texts)) & found if texts else found


def rule_matches(line: Column, rules: list[Rule]) -> Column:
    """In rule order, the leftmost match of every rule that has one: ARRAY<STRUCT<rule_id, severity, description, builtin, match>>."""
    return F.array_compact(F.array(*[F.when(matches_rule(line, r.pattern), F.struct(*_hit(r), F.lit(r.builtin).alias("builtin"), F.regexp_substr(line, F.lit(java(r.pattern))).alias("match"))) for r in rules]))


def _vetoed(m: Column, config: Config) -> Column:
    """Whitelist, value, documented example, allowlist, check digits."""
    text, rule = m["match"], m["rule_id"]
    out = is_listed(text, config.whitelist) | value_veto(text) | (m["builtin"] & is_known_example(rule, text)) | is_allowed(text, config.allow_regexes)
    for name, valid in (("CREDIT_CARD", V.luhn), ("BRAZILIAN_CPF", V.cpf), ("BRAZILIAN_CNPJ", V.cnpj), ("DSN_CREDENTIALS", lambda x: V.dsn_password(x).isNotNull())):
        out = out | ((rule == name) & ~valid(text))
    return out


def first_hit(line: Column, path: Column, context: Column, threshold: Column, config: Config, skip_regex_code: bool | None = None) -> Column:
    """STRUCT(rule_id, severity, description, match) of the line's finding, or null.

    Built-in rules in order, then custom ones, then quoted strings of high entropy.
    """
    rules = [r for r in [*RULES, *config.custom] if r.id not in config.disable]
    found = F.filter(rule_matches(line, rules), lambda m: ~_vetoed(m, config))
    skip = config.entropy_skip_regex_context if skip_regex_code is None else skip_regex_code
    strings = F.filter(quoted_strings(line), lambda q: ~(is_listed(q, config.whitelist) | value_veto(q) | is_allowed(q, config.allow_regexes)) & (byte_entropy(q) > threshold))
    # One look-up each, of a finished struct: inside a conditional nothing is shared, so every field taken from an array would build that array anew.
    ruled = F.get(F.transform(found, lambda m: F.struct(*[m[c].alias(c) for c in ("rule_id", "severity", "description", "match")])), F.lit(0))
    high = F.get(F.transform(strings, lambda q: F.struct(*_hit(HIGH_ENTROPY), q.alias("match"))), F.lit(0))
    high = F.when(~is_regex_code(line), high) if skip else high
    # The veto last, as most lines have nothing to veto; a filter keeps the hit from being built for each use.
    return F.get(F.filter(F.array_compact(F.array(F.coalesce(ruled, high))), lambda _: ~line_veto(path, line, context)), F.lit(0))


def ignored_ranges(lines: Column, marker: str) -> Column:
    """ARRAY<STRUCT<s, e>> of closed ignore blocks, both ends inside; an unclosed start opens nothing, a second start changes nothing."""
    start, end = F.lit(f"{marker}:ignore-start"), F.lit(f"{marker}:ignore-end")
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def step(acc: Column, line: Column) -> Column:
        opens, closes = F.contains(line, start), F.contains(line, end) & ~F.contains(line, start)
        at, done = acc["at"], acc["done"]
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(opens & (at < 0), acc["i"]).when(closes, F.lit(-1)).otherwise(at).alias("at"),
            F.when(closes & (at >= 0), F.concat(done, F.array(F.struct(at.alias("s"), acc["i"].alias("e"))))).otherwise(done).alias("done"),
        )

    walked = F.aggregate(lines, F.struct(F.lit(0).alias("i"), F.lit(-1).alias("at"), none.alias("done")), step, lambda acc: acc["done"])
    return F.when(F.exists(lines, lambda x: F.contains(x, start)), walked).otherwise(none)


def numbered(docs: DataFrame, marker: str = "sift", keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, i, line, prev, next, inside, near, scope): one row a line that ``keep`` accepts.

    inside: in an ignore block. near: one of five lines on either side holds a keyword. scope: the bits of
    scope.file_scopes, null but for source code. What a line needs of its neighbours is put into its own
    struct before the explosion, so that no row carries the whole document.
    """
    base = docs.select("path", lines_of(F.col("text")).alias("lines"))  # no filter on them: it would be pushed below and split every text twice
    lines = F.col("lines")
    ext = scope_extension(F.coalesce("path", F.lit("")))
    base = base.withColumn("scopes", scope.scopes_of(F.when(ext.isin(scope.LANGUAGES), lines), ext))
    base = base.withColumn("ranges", ignored_ranges(lines, marker)).withColumn("flags", F.transform(lines, lambda x: contains_any(F.lower(x), KEYWORDS)))
    every = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    kept = every if keep is None else F.filter(every, lambda s: keep(s["line"]))
    # Single look-ups: a slice would copy the whole array for every line.
    near = lambda i: reduce(Column.__or__, [F.coalesce(F.get("flags", i + d), F.lit(False)) for d in (*range(-5, 0), *range(1, 6))])
    told = F.transform(
        kept,
        lambda s: F.struct(
            s["i"].alias("i"), s["line"].alias("line"), F.when(s["i"] > 0, F.get("lines", s["i"] - 1)).otherwise(F.lit("")).alias("prev"), F.coalesce(F.get("lines", s["i"] + 1), F.lit("")).alias("next"),
            F.exists("ranges", lambda r: s["i"].between(r["s"], r["e"])).alias("inside"), near(s["i"]).alias("near"), F.get("scopes", s["i"]).alias("scope"),
        ),
    )
    # The generator takes the expression itself: for a column of that name a filter on its size would be inferred, pushed below and computed again.
    return base.select("path", F.explode(told).alias("t")).select("path", "t.*")


def candidates(docs: DataFrame, config: Config, deep: bool) -> DataFrame:
    """(path, line_idx, line, context, near, scope): lines that aren't ignored, and can match unless ``deep``."""
    quick = not deep and not config.custom

    def keep(line: Column) -> Column:
        # CASE keeps the order: the length cap comes before the regular expression.
        cheap = ~F.contains(line, F.lit(f"{config.marker}:ignore")) & ~F.contains(line, F.lit(f"{config.marker}:honeytoken"))
        out = F.when(F.octet_length(line) > config.skip_minified_threshold, False)
        return (out.when(~F.regexp_like(line, F.lit(java(TRIGGER))), False) if quick else out).otherwise(cheap)

    return numbered(docs, config.marker, keep).filter(~F.col("inside")).select("path", F.col("i").alias("line_idx"), "line", F.array("prev", "line", "next").alias("context"), "near", "scope")


@kept
def _confidence(has_verified: bool) -> Column:
    return confidence(F.col("path"), F.col("snippet"), F.col("rule_id"), F.col("verified") if has_verified else F.lit(None).cast("boolean"))


@kept
def _ensemble(in_context: bool) -> Column:
    score = classify(F.col("snippet"), F.col("rule_id"))["score"]
    return F.least(F.lit(1.0), score + nearby_bonus(F.col("near"), F.col("line"))) if in_context else score


def as_findings(hits: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Finished findings from (path, line_number, snippet, context, severity, description, rule_id) and, if there, verified, near, line, commit_hash."""
    have = set(hits.columns)
    verified = F.col("verified") if "verified" in have else F.lit(None).cast("boolean")
    scored = hits.select("*", _confidence("verified" in have).alias("_conf"), _ensemble({"near", "line"} <= have).alias("_ml"))
    commit = F.col("commit_hash") if "commit_hash" in have else F.lit(None).cast("string")
    return scored.select(
        "path", F.col("line_number").cast("int").alias("line_number"), "snippet", "context", "severity", "description", "rule_id", commit.alias("commit_hash"), verified.alias("verified"),
        F.col("_conf.confidence").alias("confidence"), F.col("_conf.confidence_factors").alias("confidence_factors"), F.col("_conf.confidence_level").alias("confidence_level"), F.lit(None).cast(DETAIL).alias("verification_detail"), F.col("_ml").cast("float").alias("ml_score"), *(extra or []),
    )


def with_hit(rows: DataFrame, hit: Column, keep_missed: bool = False) -> DataFrame:
    """Adds ``hit`` and drops rows where it is null, unless they are kept.

    A generator computes it once; a filter on a projected column would be pushed below the projection, and
    the whole cascade would run twice.
    """
    return rows.select("*", F.explode(F.array(hit) if keep_missed else F.array_compact(F.array(hit))).alias("hit"))


@kept
def _core_hit(config: Config) -> Column:
    path = F.coalesce("path", F.lit(""))
    return first_hit(F.col("line"), path, F.col("context"), entropy_threshold(path, config.entropy_threshold), config)


def core_hits(docs: DataFrame, config: Config = Config(), deep: bool = False) -> DataFrame:
    """Candidates with their hit (null for none) and scope."""
    return scope.with_suppression(with_hit(candidates(docs, config, deep), _core_hit(config), deep))


def scan(docs: DataFrame, config: Config = Config(), deep: bool = False) -> DataFrame:
    """Findings of (path, text) rows, each a content scan of its own. No shuffle.

    A null or empty text has none, a null path counts as an empty one, and repeated rows report each.
    """
    rows = core_hits(docs, config, deep)
    columns = ["path", (F.col("line_idx") + 1).alias("line_number"), trimmed(F.col("line")).alias("snippet"), "context", F.col("hit.severity").alias("severity"), F.col("hit.description").alias("description"), F.col("hit.rule_id").alias("rule_id"), "near", "line"]
    if not deep:
        return as_findings(rows.filter(F.col("hit").isNotNull() & ~F.col("suppressed")).select(*columns))
    return as_findings(semantic.deep_hits(rows, config).select(*columns)).unionByName(as_findings(semantic.concatenations(docs, config)))


def scan_logs(lines: DataFrame) -> DataFrame:
    """Every built-in rule that matches a log line, without vetoes: (source, line_number, snippet, severity, description, rule_id) and the other columns."""
    hits = rule_matches(F.col("line"), list(RULES))
    able = lines.filter(F.regexp_like("line", F.lit(java(TRIGGER))))
    rest = [c for c in lines.columns if c != "line"]
    return able.select(*rest, redact_log_line(F.col("line")).alias("snippet"), F.explode(hits).alias("hit")).select(*rest, "snippet", F.col("hit.severity").alias("severity"), F.col("hit.description").alias("description"), F.col("hit.rule_id").alias("rule_id"))


def dedup_snippets(findings: DataFrame) -> DataFrame:
    """The first finding of each snippet by (path, line_number, rule_id).

    The least row with those columns first, so that no column travels twice; ask for the columns you need before.
    """
    lead = ["path", "line_number", "rule_id"]
    rest = [c for c in findings.columns if c not in (*lead, "snippet")]
    first = findings.groupBy("snippet").agg(F.min(F.struct(*lead, *rest)).alias("f"))
    return first.select("snippet", "f.*").select(*findings.columns)
