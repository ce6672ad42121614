"""The registered queries of the engine's own operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths as P
from ..functions import text as T
from ..functions import validators as V
from ..functions.redact import masked_snippet, redact_log_line, redact_secret
from ..functions.rules import RULES, custom_rule, java
from ..functions.scoring import KEYWORDS, classify, ensemble_factors
from ..operators import admission, complexity, detect, history, honeytokens, iac, remediation, scope, semantic, state, vetoes
from ..session import shared_dir, spread
from ..sources.files import as_texts, from_table, path_filter
from ..sources.rule_files import rule_table
from ..streaming import monitor
from . import oracles as O
from . import reports, store
from .synthetic import STREAM, TOKEN_LINES, cases, expression, token_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are work for all cores, however its files are cut."""
    return spread(_table(spark, sf_dir, name))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(_wide(spark, sf_dir, "documents"), "text", "source", "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir, "pages").withColumn("folder", F.lit("pages"))
    return from_table(rows, "html", "folder", "page_id", suffix=".html")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(_wide(spark, sf_dir, "conversations"), "text", "conv_id", "turn")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lines(spread(_table(spark, sf_dir, "orders").select("o_orderkey"), least_bytes=1 << 17, most_rows=100_000))


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(docs(spark, sf_dir))


def token_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(tokens(spark, sf_dir))


_KEPT = ["path", "line_number", "rule_id", "severity", "description", "snippet"]
_FOUND = "SELECT path, line_number, rule_id, severity, description, snippet FROM found"


# Lines and context.


@query(f"WITH {O.lines(O.DOCS)} SELECT path, i + 1 AS line_number, line FROM lines")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("path", F.posexplode(T.lines_of(F.col("text"))).alias("i", "line"))
    return rows.select("path", (F.col("i") + 1).alias("line_number"), "line")


@query(f"WITH {O.lines(O.DOCS)} SELECT path, i + 1 AS line_number, prev, line, next FROM lines")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.numbered(docs(spark, sf_dir)).select("path", (F.col("i") + 1).alias("line_number"), "prev", "line", "next")


@query(f"WITH {O.lines(O.DOCS)} SELECT path, i + 1 AS line_number, strlen(line) AS bytes FROM lines WHERE strlen(line) > 10000")
def minified_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("path", F.posexplode(T.lines_of(F.col("text"))).alias("i", "line"))
    return rows.filter(F.octet_length("line") > Config().skip_minified_threshold).select("path", (F.col("i") + 1).alias("line_number"), F.octet_length("line").cast("bigint").alias("bytes"))


_MARKS = "CASE WHEN (i + doc_id) % 11 = 2 THEN x || ' sift:ignore-start' WHEN (i + doc_id) % 11 = 5 THEN x || ' sift:ignore-end' WHEN (i + doc_id) % 11 = 8 THEN x || ' sift:ignore' ELSE x END"


@query(f"""WITH marked AS (
  SELECT concat(coalesce(source, 'null'), '/', coalesce(doc_id::VARCHAR, 'null'), '.txt') AS path, r.i AS i, {_MARKS.replace('x ', 'l[r.i + 1] ').replace('ELSE x', 'ELSE l[r.i + 1]').replace('(i +', '(r.i +')} AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text <> '') t, unnest(range(0, len(l))) AS r(i)
), kept AS (SELECT *, max(i) OVER (PARTITION BY path) AS top, last_value(line) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM marked), lines AS (
  SELECT path, i, line, CASE WHEN contains(line, 'sift:ignore-start') THEN 's' WHEN contains(line, 'sift:ignore-end') THEN 'e' END AS mark FROM kept WHERE NOT (i = top AND final = '')
), states AS (
  SELECT path, i, line, mark, last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now,
    last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(CASE WHEN mark = 'e' THEN 1 END) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ends FROM lines
)
SELECT path, i + 1 AS line_number FROM states WHERE NOT (coalesce((now = 's' OR (mark = 'e' AND before = 's')) AND ends > 0, false)) AND NOT contains(line, 'sift:ignore')""")
def ignore_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that markers leave, in documents with markers put in at some lines."""
    rows = _table(spark, sf_dir, "documents")
    mark = lambda x, i: F.when((i + F.col("doc_id")) % 11 == 2, F.concat(x, F.lit(" sift:ignore-start"))).when((i + F.col("doc_id")) % 11 == 5, F.concat(x, F.lit(" sift:ignore-end"))).when((i + F.col("doc_id")) % 11 == 8, F.concat(x, F.lit(" sift:ignore"))).otherwise(x)
    marked = rows.withColumn("text", F.when(F.col("text") != "", F.array_join(F.transform(F.split("text", "\n"), mark), "\n")))
    lines = detect.numbered(from_table(marked, "text", "source", "doc_id"))
    return lines.filter(~F.col("inside") & ~F.contains("line", F.lit("sift:ignore"))).select("path", (F.col("i") + 1).cast("bigint").alias("line_number"))


# Rules.


@query(f"WITH {O.hits(O.DOCS)} {_FOUND}")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_findings(spark, sf_dir).select(*_KEPT)


@query(f"WITH {O.hits(O.PAGES)} {_FOUND}")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(pages(spark, sf_dir)).select(*_KEPT)


@query(f"WITH {O.hits(O.CHATS)} {_FOUND}")
def conversation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(chats(spark, sf_dir)).select(*_KEPT)


@query(f"WITH {O.hits(O.TOKENS)} {_FOUND}")
def rules_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_findings(spark, sf_dir).select(*_KEPT)


_LOG_SNIPPET = "CASE WHEN strlen(line) <= 20 THEN line ELSE left(line, 8) || '...REDACTED...' || right(line, 8) END"
_ALL_HITS = f"WITH {O.lines(O.DOCS)}, every AS (SELECT path AS source, i + 1 AS line_number, {_LOG_SNIPPET} AS snippet, unnest({O.matches()}) AS h FROM lines) SELECT source, line_number, snippet, h.id AS rule_id, h.sev AS severity, h.d AS description FROM every"


@query(_ALL_HITS)
def rule_hits_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.col("path").alias("source"), F.posexplode(T.lines_of(F.col("text"))).alias("i", "line"))
    return detect.scan_logs(rows.select("source", (F.col("i") + 1).alias("line_number"), "line"))


@query(f"SELECT place, id AS rule_id, sev AS severity, des AS description, coalesce(lo, -1) AS min_length, coalesce(hi, -1) AS max_length, prefix, charset, 'builtin' AS origin FROM {O.RULE_VALUES}")
def rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_table(spark).drop("pattern").fillna(-1, ["min_length", "max_length"])


_CUSTOM = (("CUSTOM_ORDER", r"x[0-9a-f]{4}\b", "venial"), ("CUSTOM_REF", r"nothing [0-9a-f]+", "mortal"))


@query(f"""WITH {O.lines(O.TOKENS)}, able AS (SELECT * FROM lines WHERE NOT {O.line_veto()}), judged AS (
  SELECT path, i + 1 AS line_number, ({O.survivors()})[1] AS h, regexp_extract(line, {O.q(_CUSTOM[0][1])}) AS a, regexp_extract(line, {O.q(_CUSTOM[1][1])}) AS b FROM able
) SELECT path, line_number, CASE WHEN h IS NOT NULL AND h.id <> 'EVAL_CALL' THEN h.id WHEN a <> '' THEN 'CUSTOM_ORDER' ELSE 'CUSTOM_REF' END AS rule_id FROM judged WHERE (h IS NOT NULL AND h.id <> 'EVAL_CALL') OR a <> '' OR b <> ''""")
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules of one's own after the built-in ones, of which one is disabled."""
    config = Config(custom=tuple(custom_rule(i, p, s) for i, p, s in _CUSTOM), disable=("EVAL_CALL",))
    return detect.scan(tokens(spark, sf_dir), config).filter("rule_id <> 'HIGH_ENTROPY'").select("path", "line_number", "rule_id")


# Validators.

_KEY = "c_custkey"
_DIGITS = "lpad(cast((c_custkey * 7919 * 104729) % 100000000000 as string), 11, '0')"


def _with_digits(spark: SparkSession, sf_dir: str, text: str, test: Callable[[Column], Column]) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{text} AS value")
    return rows.select("k", "value", test(F.col("value")).alias("valid"))


def _valid(text: str, test: str) -> str:
    return f"SELECT k, value, {test} AS valid FROM (SELECT c_custkey AS k, {text} AS value FROM customer) s"


@query(f"WITH {O.lines(O.DOCS)}, cards AS (SELECT path, i + 1 AS line_number, unnest(regexp_extract_all(line, {O.q(next(r.pattern for r in RULES if r.id == 'CREDIT_CARD'))})) AS value FROM lines WHERE strlen(line) <= 10000) SELECT path, line_number, value, {O.luhn(O.digits('value'))} AS valid FROM cards")
def credit_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = java(next(r.pattern for r in RULES if r.id == "CREDIT_CARD"))
    rows = docs(spark, sf_dir).select("path", F.posexplode(T.lines_of(F.col("text"))).alias("i", "line")).filter(F.octet_length("line") <= 10_000)
    cards = rows.select("path", (F.col("i") + 1).alias("line_number"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("value"))
    return cards.withColumn("valid", V.luhn(F.col("value")))


def _check(total: str) -> str:
    return f"cast(((({total}) * 10) % 11) % 10 as string)"


def _at(d: str, weights: list[int]) -> str:
    return " + ".join(f"cast(substr({d}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights))


_NINE = f"substr({_DIGITS}, 1, 9)"
_TEN = f"concat({_NINE}, {_check(_at(_NINE, list(range(10, 1, -1))))})"
#: Every other number gets its right check digits.
_CPF = f"CASE WHEN c_custkey % 2 = 0 THEN concat({_TEN}, {_check(_at(_TEN, list(range(11, 1, -1))))}) ELSE {_DIGITS} END"
_FIRST = [*range(5, 1, -1), *range(9, 1, -1)]
_MOD = lambda total: f"cast(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END as string)"
_TWELVE = f"concat({_DIGITS}, '1')"
_THIRTEEN = f"concat({_TWELVE}, {_MOD(_at(_TWELVE, _FIRST))})"
_CNPJ = f"CASE WHEN c_custkey % 2 = 0 THEN concat({_THIRTEEN}, {_MOD(_at(_THIRTEEN, [6, *_FIRST]))}) ELSE concat({_DIGITS}, '123') END"
_EIGHT = f"substr({_DIGITS}, 4, 8)"
_NIF = f"CASE WHEN c_custkey % 2 = 0 THEN concat({_EIGHT}, {_MOD(_at(_EIGHT, list(range(9, 1, -1))))}) ELSE concat({_EIGHT}, '7') END"
_DNI = f"CASE WHEN c_custkey % 2 = 0 THEN concat({_EIGHT}, substr('{V.DNI_LETTERS}', cast(cast({_EIGHT} as int) % 23 + 1 as int), 1)) ELSE concat({_EIGHT}, '-a') END"
_SSN = f"concat(substr({_DIGITS}, 1, 3), '-', substr({_DIGITS}, 4, 2), '-', substr({_DIGITS}, 6, 4))"
#: Country DE is 1314 in the rotated number.
_IBAN_CHECK = f"lpad(cast(98 - (cast(concat({_DIGITS}, '1314', '00') as bigint) % 97) as string), 2, '0')"
_IBAN = f"CASE WHEN c_custkey % 2 = 0 THEN concat('DE', {_IBAN_CHECK}, {_DIGITS}) ELSE concat('GB', substr({_DIGITS}, 1, 2), 'NWBK ', {_DIGITS}) END"


@query(_valid(_CPF, O.cpf(O.digits("value"))))
def cpf_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digits(spark, sf_dir, _CPF, V.cpf)


@query(_valid(_CNPJ, O.cnpj(O.digits("value"))))
def cnpj_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digits(spark, sf_dir, _CNPJ, V.cnpj)


@query(_valid(_NIF, O.nif(O.digits("value"))))
def nif_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digits(spark, sf_dir, _NIF, V.nif)


@query(_valid(_DNI, O.dni("value")))
def dni_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digits(spark, sf_dir, _DNI, V.dni)


@query(_valid(_SSN, O.ssn(O.digits("value"))))
def ssn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digits(spark, sf_dir, _SSN, V.ssn)


@query(_valid(_IBAN, O.iban("value")))
def iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digits(spark, sf_dir, _IBAN, V.iban)


_DSN = "concat(CASE s_suppkey % 4 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' WHEN 2 THEN 'jdbc:oracle:thin' ELSE 'ftp' END, '://user:', CASE s_suppkey % 3 WHEN 0 THEN 'Password' ELSE md5(s_name) END, '@host/db')"


@query(f"SELECT k, {O.dsn_password('dsn')} AS password FROM (SELECT s_suppkey AS k, {_DSN} AS dsn FROM supplier) s")
def dsn_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", f"{_DSN} AS dsn")
    return rows.select("k", V.dsn_password(F.col("dsn")).alias("password"))


# Entropy, strings and vetoes over synthetic lines.


@query(f"SELECT p_partkey AS k, round({O.entropy('p_name')}, 4) AS entropy FROM part")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(T.byte_entropy(F.col("p_name")), 4).alias("entropy"))


@query(f"WITH t AS ({O.TOKENS}) SELECT path, unnest({O.quoted('text')}) AS value FROM t")
def quoted_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("path", F.explode(T.quoted_strings(F.col("text"))).alias("value"))


@query(f"WITH t AS ({O.TOKENS}), s AS (SELECT path, unnest({O.quoted('text')}) AS value FROM t) SELECT path, value, round({O.entropy('value')}, 4) AS entropy FROM s WHERE {O.entropy('value')} > {O.threshold('path')}")
def high_entropy_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).select("path", F.explode(T.quoted_strings(F.col("text"))).alias("value"))
    e = T.byte_entropy(F.col("value"))
    return rows.filter(e > P.entropy_threshold(F.col("path"), Config().entropy_threshold)).select("path", "value", F.round(e, 4).alias("entropy"))


_VETO_LINES = ("#[test]", "def test_{h4}():", "/// Example {h4}", "# test", "let api_key_example = {h8}", "const x{h2} = 1", "// placeholder {h4}", "example: {h4}", "password sample_{h4} = 1", "plain {h4}", "/** demo {h2}")
_VETO = f"SELECT k, path, line, prev, lead(line, 1, '') OVER (ORDER BY k) AS next FROM (SELECT p_partkey AS k, concat('src/p', cast(p_partkey as string), CASE WHEN p_partkey % 7 = 0 THEN '_test.go' ELSE '.c' END) AS path, {cases([expression(t, STREAM.format(key='p_partkey')) for t in _VETO_LINES], 'p_partkey')} AS line, {cases([expression(t, STREAM.format(key='p_partkey + 1')) for t in _VETO_LINES], '(p_partkey * 5 + 3)')} AS prev FROM part) s"


@query(f"SELECT k, {O.line_veto()} AS veto FROM ({_VETO.replace('lead(line, 1, ' + chr(39) * 2 + ') OVER (ORDER BY k)', chr(39) * 2)}) t")
def context_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _VETO.replace("lead(line, 1, '') OVER (ORDER BY k)", "''").replace("FROM part", "FROM {part}")
    rows = spark.sql(inner, part=_table(spark, sf_dir, "part"))
    return rows.select("k", vetoes.line_veto(F.col("path"), F.col("line"), F.array("prev", "line", "next")).alias("veto"))


_VALUES = ("example_{h4}", "test_{h4}", "{h8}_dummy", "1234-example", "fake123", "aaaaaaaa{h1}", "111122221111", "xxxx", "<token {h2}>", "your-api-key-here", "{h12}", "key {h2} TODO", "replace_me", "AKIA" + "IOSFODNN7" + "EXAMPLE", "------", "ééééééééé")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"{cases([expression(t, STREAM.format(key='p_partkey')) for t in _VALUES], 'p_partkey')} AS value")


_VALUE_ROWS = f"(SELECT p_partkey AS k, {cases([expression(t, STREAM.format(key='p_partkey')) for t in _VALUES], 'p_partkey')} AS value FROM part) s"


@query(f"SELECT k, value, {O.value_veto('value')} AS veto, {O.known_example(O.q('AWS_ACCESS_KEY'), 'value')} AS known, contains(value, 'dummy') OR contains(value, 'fake') AS listed, regexp_matches(value, '(?:^key )|(?:[0-9]{{12}})') AS allowed FROM {_VALUE_ROWS}")
def value_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples and placeholders, documented values, whitelist and allowlist."""
    v = F.col("value")
    return _values(spark, sf_dir).select("k", "value", vetoes.value_veto(v).alias("veto"), vetoes.is_known_example(F.lit("AWS_ACCESS_KEY"), v).alias("known"), vetoes.is_listed(v, ("dummy", "fake")).alias("listed"), vetoes.is_allowed(v, ("^key ", "[0-9]{12}")).alias("allowed"))


_PATHS = ("app.min.js", "Cargo.lock", "logo.svg", "x.test.js", "README.md", "prod.env", ".env", "conf/app.config.php", "a/package.json", "b.yml", "tests/unit.rs", "src/conftest.py", "my_fixtures/a.py", "testdata/z", "src/test_a.py", "Dockerfile", "dockerfile.prod", "main.tf", "LICENSE", "a.b/.env")
_PATH_ROWS = f"(SELECT p_partkey AS k, {cases([f'concat(p_type, {chr(39)}/{x}{chr(39)})' for x in _PATHS], 'p_partkey')} AS path FROM part) s"


@query(rf"SELECT k, path, round({O.threshold('path')}, 6) AS threshold, {O.test_path('path')} AS test, {O.config_path('path')} AS config, regexp_matches(lower(path), '(?:\A|/)dockerfile(?:\.[^/]*)?\z|[^/]\.(?:tf|yaml|yml)\z') AS iac FROM {_PATH_ROWS}")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", _PATH_ROWS.split("AS k, ")[1].split(" FROM part")[0])
    p = F.col("path")
    return rows.select("k", "path", F.round(P.entropy_threshold(p, 4.6), 6).alias("threshold"), P.is_test_path(p).alias("test"), P.is_config_path(p).alias("config"), P.is_iac_path(p).alias("iac"))


_GLOBS = ["**/tests/**", "*.min.js", "**/*.lock", "**/[A-R]*.md"]


@query(r"SELECT k, path, regexp_matches(path, '(?s)\A(?:(?:.*/)?tests/.*|.*\.min\.js|(?:.*/)?.*\.lock|(?:.*/)?[A-R].*\.md)\z') AS ignored FROM " + _PATH_ROWS)
def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", _PATH_ROWS.split("AS k, ")[1].split(" FROM part")[0])
    return rows.select("k", "path", F.regexp_like("path", F.lit(P.globs_regex(_GLOBS))).alias("ignored"))


# Scores.


@query(f"WITH {O.hits(O.TOKENS)} SELECT path, line_number, rule_id, round({O.ml()}, 4) AS score, {O.ml()} >= 0.55 AS is_secret FROM found LEFT JOIN {O.RULE_VALUES} ON id = rule_id")
def ml_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_findings(spark, sf_dir).withColumn("c", classify(F.col("snippet"), F.col("rule_id")))
    return found.select("path", "line_number", "rule_id", F.round("c.score", 4).alias("score"), F.col("c.is_secret").alias("is_secret"))


@query(f"WITH {O.hits(O.TOKENS)} SELECT path, line_number, rule_id, round({O.confidence()}, 4) AS confidence, {O.level()} AS confidence_level FROM found")
def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_findings(spark, sf_dir).select("path", "line_number", "rule_id", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "confidence_level")


@query(f"WITH {O.hits(O.DOCS)} SELECT path, line_number, rule_id, round(least(1, {O.ml()} + {O.nearby()}), 4) AS ml_score FROM found LEFT JOIN {O.RULE_VALUES} ON id = rule_id")
def contextual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_findings(spark, sf_dir).select("path", "line_number", "rule_id", F.round(F.col("ml_score").cast("double"), 4).alias("ml_score"))


@query(f"""WITH {O.lines(O.DOCS)}, marked AS (SELECT path, i, CASE WHEN {O.any_of('lower(line)', KEYWORDS)} THEN i END AS hit FROM lines)
SELECT path, i + 1 AS line_number, least(min(hit) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), min(hit) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) + 1 AS keyword_line FROM marked
QUALIFY keyword_line IS NOT NULL""")
def nearby_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line within five that holds a keyword, for lines that have one; arrays of a row, no shuffle."""
    rows = docs(spark, sf_dir).select("path", T.lines_of(F.col("text")).alias("lines"))
    flags = F.transform("lines", lambda x, i: F.when(T.contains_any(F.lower(x), KEYWORDS), i))
    rows = rows.withColumn("flags", flags).filter(F.exists("flags", lambda f: f.isNotNull()))
    around = lambda i: F.array(*[F.get("flags", i + d) for d in (*range(-5, 0), *range(1, 6))])
    first = rows.select("path", F.explode(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.array_min(around(i)).alias("first")))).alias("t"))
    return first.filter("t.first IS NOT NULL").select("path", (F.col("t.i") + 1).alias("line_number"), (F.col("t.first") + 1).alias("keyword_line"))


# Redaction.


@query(f"WITH {O.hits(O.TOKENS)} SELECT path, line_number, rule_id, {O.redacted()} AS snippet FROM found")
def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_findings(spark, sf_dir).select("path", "line_number", "rule_id", masked_snippet().alias("snippet"))


@query(f"WITH t AS ({O.TOKENS}) SELECT path, {O.redact_secret('text')} AS secret, {_LOG_SNIPPET.replace('line', 'text')} AS log FROM t")
def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("path", redact_secret(F.col("text")).alias("secret"), redact_log_line(F.col("text")).alias("log"))


# Deep mode.

_PLAIN = expression("plain {h8} text {x10}", STREAM.format(key="o_orderkey"))
_CODED = "CASE o_orderkey % 4 WHEN 0 THEN {b64} WHEN 1 THEN lower(hex({plain})) WHEN 2 THEN substr({b64}, 1, 30) ELSE {plain} END"
_ROT = "translate(c, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')"


@query(f"""WITH s AS (SELECT o_orderkey AS k, {_CODED.format(b64=f'base64(encode({_PLAIN}))', plain=_PLAIN)} AS c FROM orders)
SELECT k, CASE WHEN regexp_matches(c, '\\A(?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?\\z') AND k % 4 = 0 THEN {_PLAIN.replace('o_orderkey', 'k')} END AS from_base64, CASE WHEN k % 4 = 1 THEN {_PLAIN.replace('o_orderkey', 'k')} END AS from_hex, {_ROT} AS rotated FROM s""")
def decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    rows = orders.selectExpr("o_orderkey AS k", f"{_CODED.format(b64=f'base64({_PLAIN})', plain=_PLAIN)} AS c")
    strict = F.regexp_like("c", F.lit(r"\A[A-Za-z0-9+/]{20,}={0,2}\z")) & (F.col("k") % 4 != 1)
    hexed = F.regexp_like("c", F.lit(r"\A(?:[0-9a-f]{2})+\z"))
    return rows.select("k", F.when(strict, T.decode_base64(F.col("c"))).alias("from_base64"), F.when(hexed, T.decode_hex(F.col("c"))).alias("from_hex"), T.rot13(F.col("c")).alias("rotated"))


@query(rf"""WITH t AS ({O.TOKENS}), p AS (SELECT path, text, regexp_extract(text, {O.q(semantic.CONCAT)}, 1) || regexp_extract(text, {O.q(semantic.CONCAT)}, 2) AS joined FROM t)
SELECT path, 1 AS line_number, {O.trim('text')} AS snippet, 'CONCAT_SECRET' AS rule_id FROM p WHERE {O.entropy('joined')} > 4.6""")
def concat_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.concatenations(tokens(spark, sf_dir), Config()).select("path", "line_number", "snippet", "rule_id")


@query(rf"""WITH t AS ({O.TOKENS}), v AS (SELECT path, regexp_extract(text, {O.q(semantic.ASSIGNED)}, 1) AS value, regexp_matches(text, {O.q(semantic.TELLING_NAME)}) AS named FROM t)
SELECT path, value FROM v WHERE named AND value <> '' AND NOT regexp_matches({O.trim('value')}, {O.q(semantic.TRIVIAL)}) AND strlen(value) >= 4""")
def suspicious_varname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("path", semantic.telling_value(F.col("text")).alias("value")).filter(F.col("value").isNotNull())


@query()
def deep_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes of deep mode over documents and synthetic lines, repeated snippets removed."""
    both = docs(spark, sf_dir).unionByName(tokens(spark, sf_dir).select("path", "text"))
    return detect.dedup_snippets(detect.scan(both, deep=True).select(*_KEPT)).select(*_KEPT)


# Scope, complexity, infrastructure.

_CODE = ('def f_{h4}():', '    """doc {h4}', "    closing {h2} " + '"""', "    x = 1", "/** block {h4}", " * inside", " */ after", "/* c", "*/", "<!-- hidden", "--> shown", "''' odd {h2}")
_CODE_LINES = f"SELECT concat('n', cast(c_nationkey as string), '.py') AS path, c_custkey AS line_idx, {cases([expression(t.replace(chr(39), chr(96)), STREAM.format(key='c_custkey')) for t in _CODE], '(c_custkey * 7 + c_nationkey)')} AS line FROM customer"


@query(f"""WITH c AS (SELECT path, line_idx, replace(line, chr(96), chr(39)) AS line FROM ({_CODE_LINES}) s), n AS (
  SELECT *, (len(line) - len(replace(line, repeat(chr(34), 3), ''))) // 3 AS dq, (len(line) - len(replace(line, repeat(chr(39), 3), ''))) // 3 AS sq, (len(line) - len(replace(line, '/*', ''))) // 2 AS o, (len(line) - len(replace(line, '*/', ''))) // 2 AS e,
    regexp_matches(line, '\\A\\s*/\\*[*!]') AS db, CASE WHEN contains(line, '*/') THEN 'close' WHEN regexp_matches(line, '\\A\\s*/\\*[*!]') THEN 'open' END AS dev, contains(line, '<!--') AS hb, CASE WHEN contains(line, '-->') THEN 'close' WHEN contains(line, '<!--') THEN 'open' END AS hev FROM c
) SELECT path, line_idx, (sum(dq) OVER a) % 2 = 1 OR (sum(sq) OVER a) % 2 = 1 AS docstring, db OR coalesce(last_value(dev IGNORE NULLS) OVER b = 'open', false) AS doc_block, (sum(o - e) OVER a)::BIGINT AS depth, hb OR coalesce(last_value(hev IGNORE NULLS) OVER b = 'open', false) AS html
FROM n WINDOW a AS (PARTITION BY path ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY path ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def scope_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation and comment states that run down a file, over a table with a row a line."""
    rows = spark.sql(_CODE_LINES.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf_dir, "customer")).withColumn("line", F.translate("line", "`", "'"))
    x = F.col("line")
    return rows.select("path", "line_idx", scope.python_docstring(x).alias("docstring"), scope.doc_block(x).alias("doc_block"), scope.block_comment_depth(x).alias("depth"), scope.html_comment(x).alias("html"))


@query()
def scope_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scope flag of every line of synthetic source files in eight languages."""
    files = _code_files(spark, sf_dir)
    bits = scope.scopes_of(T.lines_of(F.col("text")), P.scope_extension(F.col("path")))
    rows = files.select("path", F.posexplode(bits).alias("line_idx", "s"))
    s = F.col("s")
    return rows.select("path", "line_idx", scope.is_comment(s).alias("in_comment"), scope.is_docstring(s).alias("in_docstring"), scope.is_in_test(s).alias("in_test_function"))


_SOURCE = ("def test_{h2}():", "    x = {h4}", "fn run_{h2}() {", "  if a && b {", "    for i in 0..9 {", "      while x || y { }", "}", "#[test]", "describe('{h2}', () => {", "func TestA{h2}(t) {", "  @Test", "end", "", "function g{h2}() {", "    match v { case 1 }", "  } else if z {")
_SOURCE_SQL = cases([expression(t.replace("'", "`"), STREAM.format(key="c_custkey")) if t else "''" for t in _SOURCE], "(c_custkey * 11 + c_nationkey)")
_EXT = cases([f"'{e}'" for e in ("py", "rs", "js", "go", "java", "rb", "ts", "kt")], "c_nationkey")


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a file a nation, a line a customer."""
    rows = _table(spark, sf_dir, "customer").selectExpr(f"concat('n', cast(c_nationkey as string), '.', {_EXT}) AS path", "c_custkey", f"translate({_SOURCE_SQL}, '`', chr(39)) AS line")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy("path").agg(F.concat(joined, F.lit("\n")).alias("text"))


_WORDS = " + ".join([f"{O.any_of('low', [' else if ', ' elif '])}::INTEGER", f"{O.any_of('low', [' && ', ' || '])}::INTEGER", *[f"regexp_matches(low, '\\A{w} | {w} ')::INTEGER" for w in ("if", "for", "while", "match", "switch", "case", "catch")]])


@query(rf"""WITH rows AS (SELECT concat('n', c_nationkey, '.', {_EXT}) AS path, c_custkey, replace({_SOURCE_SQL}, chr(96), chr(39)) AS line FROM customer
), n AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY c_custkey) AS i, lower(line) AS low, regexp_matches({O.trim('line')}, '\A(?:pub fn|async fn|fn|function|def|func) ') AS starts, len(regexp_extract(line, '\A[ \t]*')) AS width FROM rows
), f AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS f FROM n
), b AS (SELECT *, max(CASE WHEN starts THEN width END) OVER (PARTITION BY path, f) AS base FROM f WHERE f > 0)
SELECT path, max(CASE WHEN starts THEN i END)::INTEGER AS line_number, sum(CASE WHEN starts THEN 0 ELSE ({_WORDS}) * (1 + greatest(0, width - base) // 4) END)::INTEGER AS score FROM b GROUP BY path, f""")
def complexity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.function_scores(_code_files(spark, sf_dir)).select("path", "line_number", "score")


_IAC = ('"Action": "*"', 'acl = "public-read"', "block_public_acls = false", "privileged: true", "hostNetwork: true", "hostPID : true", "allowPrivilegeEscalation: true", "runAsUser: 01", "add: [NET, ALL]", "readOnlyRootFilesystem: false", "unsafe-sysctls: x", "RUN curl http://h/{h4} | sh", "USER root", "ADD https://h/{h4} /x", "FROM img:latest AS b", "RUN sudo apt {h2}", "EXPOSE 22", "kind: Pod", "plain {h6}", "RUN x && wget y | bash")
_IAC_ROWS = f"SELECT {cases([f'concat({chr(39)}{p}{chr(39)}, cast(p_partkey as string), {chr(39)}{e}{chr(39)})' for p, e in (('k8s/', '/dep.yaml'), ('tf/', '/main.tf'), ('docker/', '/Dockerfile'), ('other/', '.txt'))], 'p_partkey')} AS path, concat('kind: X', chr(10), {cases([expression(t, STREAM.format(key='p_partkey')) for t in _IAC], 'cast(floor(p_partkey / 4) as bigint)')}) AS text FROM part"
_IAC_KIND = r"CASE WHEN regexp_matches(path, '/Dockerfile\z') THEN 'docker' WHEN path LIKE '%.tf' THEN 'terraform' WHEN path LIKE '%.yaml' AND (contains(text, 'apiVersion:') OR contains(text, 'kind:')) THEN 'kubernetes' END"
_IAC_TESTS = ", ".join(f"{{'kind': {O.q(k)}, 'id': {O.q(i)}, 'sev': {O.q(s)}, 'hit': regexp_matches(CASE WHEN kind = 'docker' THEN {O.trim('line')} ELSE line END, {O.q(p)})}}" for k, i, s, p, _, _ in iac.IAC_RULES)


@query(rf"""WITH files AS ({_IAC_ROWS}), {O.lines('SELECT path, text FROM files')}, k AS (SELECT path, i, line, {_IAC_KIND} AS kind FROM lines JOIN files USING (path)),
h AS (SELECT path, i, unnest(list_filter([{_IAC_TESTS}], lambda x: x.kind = k.kind AND x.hit)) AS r FROM k)
SELECT path, i + 1 AS line_number, r.id AS rule_id, r.sev AS severity FROM h""")
def iac_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_IAC_ROWS.replace("FROM part", "FROM {part}"), part=_table(spark, sf_dir, "part"))
    return iac.scan_iac(rows).select("path", "line_number", "rule_id", "severity")


_GROUP = ('resource "aws_security_group" "g{h2}" {', 'cidr_blocks = ["0.0.0.0/0"]', "from_port = 22", "}", "}}", "x = 1")


_GROUP_LINES = f"SELECT concat('net', cast(c_nationkey as string), '.tf') AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, {cases([expression(t, STREAM.format(key='c_custkey')) for t in _GROUP], '(c_custkey * 5 + c_nationkey)')} AS line FROM customer"


def _open_groups(strict: bool) -> str:
    """Segments begin with a group; one ends at the first line where braces fall below zero (or to it, once opened)."""
    ends = "depth < 0" + (" OR (depth = 0 AND seen)" if strict else "")
    return f"""SELECT path, max(CASE WHEN hit AND i < c THEN i END)::INTEGER + 1 AS line_number, 'TF_SG_OPEN_WORLD' AS rule_id, 'critical' AS severity, {str(strict).lower()} AS strict,
      'Security group is open to any address (port on line ' || (coalesce(max(before), -1) + 1) || ')' AS description
    FROM (SELECT *, max(CASE WHEN port THEN i END) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, CASE WHEN i = c THEN p END AS before
      FROM (SELECT *, c IS NULL OR i <= c AS live, live AND wide AS hit, live AND ports AS port FROM (SELECT *, min(CASE WHEN {ends} THEN i END) OVER (PARTITION BY path, f) AS c FROM depths) a) b) d
    WHERE c IS NOT NULL GROUP BY path, f HAVING bool_or(hit AND i < c)"""


@query(f"""WITH l AS ({_GROUP_LINES}), f AS (
  SELECT *, sum(regexp_matches(line, {O.q(iac.GROUP_START)})::INTEGER) OVER (PARTITION BY path ORDER BY i) AS f, regexp_matches(line, {O.q(iac.OPEN_CIDR)}) AS wide, regexp_matches(line, {O.q(iac.PORT)}) AS ports,
    len(regexp_replace(line, '[^{{]', '', 'g')) AS opens, len(regexp_replace(line, '[^}}]', '', 'g')) AS closes FROM l
), depths AS (
  SELECT *, sum(opens - closes) OVER (PARTITION BY path, f ORDER BY i) AS depth, sum(opens) OVER (PARTITION BY path, f ORDER BY i) > 0 AS seen FROM f WHERE f > 0
) {_open_groups(False)} UNION ALL {_open_groups(True)}""")
def iac_security_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open security groups in synthetic Terraform files, with blocks that close at zero and below zero."""
    made = cases([expression(t, STREAM.format(key="c_custkey")) for t in _GROUP], "(c_custkey * 5 + c_nationkey)")
    rows = _table(spark, sf_dir, "customer").selectExpr("concat('net', cast(c_nationkey as string), '.tf') AS path", "c_custkey", f"{made} AS line")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))), lambda s: s["line"]), "\n")
    files = rows.groupBy("path").agg(text.alias("text"))
    both = iac.scan_iac(files).withColumn("strict", F.lit(False)).unionByName(iac.scan_iac(files, strict_blocks=True).withColumn("strict", F.lit(True)))
    return both.select("path", "line_number", "rule_id", "severity", "description", "strict")


@query(rf"""WITH files AS ({_IAC_ROWS}), {O.lines('SELECT path, text FROM files')}, k AS (SELECT path, i, line, {_IAC_KIND} AS kind FROM lines JOIN files USING (path)),
h AS (SELECT path, i, line, unnest(list_filter([{_IAC_TESTS}], lambda x: x.kind = k.kind AND x.hit)) AS r FROM k)
SELECT path, i + 1 AS line_number, r.id AS rule_id, CASE WHEN r.sev IN ('critical', 'high') THEN 'mortal' ELSE 'venial' END AS severity, {O.trim('line')} AS snippet FROM h""")
def iac_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misconfigurations as findings, as they join a scan's."""
    rows = spark.sql(_IAC_ROWS.replace("FROM part", "FROM {part}"), part=_table(spark, sf_dir, "part"))
    return detect.as_findings(iac.iac_findings(rows)).select("path", "line_number", "rule_id", "severity", "snippet")


# Summaries, baselines, feedback, ranges, caches.


@query(f"WITH {O.hits(O.DOCS)} SELECT rule_id, severity, count(*) AS n, count(DISTINCT path) AS files FROM found GROUP BY ALL")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))


@query(f"WITH {O.hits(O.DOCS)} SELECT count(CASE WHEN severity = 'mortal' THEN 1 END) AS mortal, count(CASE WHEN severity = 'venial' THEN 1 END) AS venial FROM found")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_counts(doc_findings(spark, sf_dir))


@query(f"WITH {O.hits(O.DOCS)} SELECT path, count(CASE WHEN severity = 'mortal' THEN 1 END) AS mortal, count(CASE WHEN severity = 'venial' THEN 1 END) AS venial, string_agg(line_number || ' ' || rule_id, ';' ORDER BY line_number) AS findings FROM found GROUP BY path")
def findings_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform("findings", lambda f: F.format_string("%d %s", f["line_number"], f["rule_id"])), ";")
    return reports.file_report(doc_findings(spark, sf_dir)).withColumn("findings", told)


@query(f"WITH {O.hits(O.DOCS)} {_FOUND} QUALIFY row_number() OVER (PARTITION BY snippet ORDER BY path, line_number, rule_id) = 1")
def dedup_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dedup_snippets(doc_findings(spark, sf_dir).select(*_KEPT)).select(*_KEPT)


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic findings; some belong to the saved baseline, some to the current state, some to both."""
    return token_findings(spark, sf_dir).withColumn("k", F.regexp_extract("path", r"(\d+)\.[a-z]+\z", 1).cast("bigint"))


@query(rf"""WITH {O.hits(O.TOKENS)}, e AS (SELECT DISTINCT path, line_number, rule_id, sha256(left({O.trim('snippet')}, 64)) AS snippet_hash, regexp_extract(path, '([0-9]+)\.[a-z]+\z', 1)::BIGINT % 3 AS part FROM found)
SELECT path, line_number, rule_id, snippet_hash, CASE part WHEN 0 THEN 'new' WHEN 1 THEN 'removed' ELSE 'unchanged' END AS change FROM e""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fingerprinted(spark, sf_dir)
    return state.baseline_diff(state.baseline_entries(rows.filter("k % 3 <> 1")), state.baseline_entries(rows.filter("k % 3 <> 0")))


@query(rf"""WITH {O.hits(O.TOKENS)}, f AS (SELECT *, regexp_extract(path, '([0-9]+)\.[a-z]+\z', 1)::BIGINT AS k FROM found), b AS (SELECT DISTINCT rule_id, sha256(snippet) AS h FROM f WHERE k % 5 = 0)
SELECT path, line_number, rule_id FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rule_id = f.rule_id AND b.h = sha256(f.snippet))""")
def feedback_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fingerprinted(spark, sf_dir)
    return state.without_false_positives(rows, state.feedback_entry(rows.filter("k % 5 = 0"))).select("path", "line_number", "rule_id")


@query(f"""WITH {O.hits(O.DOCS)}, r AS (SELECT DISTINCT path, CASE WHEN len(path) % 3 = 0 THEN 1 ELSE 3 END AS s, CASE WHEN len(path) % 3 = 0 THEN 3 ELSE 9 END AS e FROM docs WHERE len(path) % 3 < 2)
SELECT path, line_number, rule_id FROM found f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = f.path) OR EXISTS (SELECT 1 FROM r WHERE r.path = f.path AND r.s <= line_number AND line_number < r.e)""")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.length("path") % 3
    ranges = docs(spark, sf_dir).select("path").distinct().filter(odd < 2).select("path", F.when(odd == 0, 1).otherwise(3).alias("start"), F.when(odd == 0, 3).otherwise(9).alias("end"))
    return state.in_changed_lines(doc_findings(spark, sf_dir), ranges).select("path", "line_number", "rule_id")


@query(f"WITH d AS ({O.DOCS}) SELECT path, sha256(text) AS file_hash, len(path) % 2 = 0 AS hit FROM d WHERE text IS NOT NULL")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir).filter("text IS NOT NULL").select("path", T.sha256_hex(F.col("text")).alias("file_hash"))
    none = F.expr("cast(array() as array<struct<line_number:int,rule_id:string,severity:string>>)")
    cache = files.select("path", F.when(F.length("path") % 2 == 0, F.col("file_hash")).otherwise("stale").alias("file_hash")).withColumn("matches", none)
    return state.cache_split(files, cache).select("path", "file_hash", "hit")


@query(rf"WITH {O.hits(O.TOKENS)} SELECT DISTINCT rule_id, sha256(snippet) AS snippet_hash, '*.' || regexp_extract(path, '\.([^./]*)\z', 1) AS file_pattern, true AS is_false_positive FROM found")
def feedback_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings marked, some of them twice."""
    rows = store.held(_fingerprinted(spark, sf_dir).select("path", "snippet", "rule_id", "k"))  # read three times below, scanned once
    some = state.feedback_entry(rows.filter("k % 5 = 0")).dropDuplicates()
    return state.mark_false_positives(some, rows)


@query(f"WITH {O.hits(O.DOCS)} SELECT path, line_number, snippet, CASE severity WHEN 'mortal' THEN 'Mortal' ELSE 'Venial' END AS severity, description, rule_id FROM found")
def transport_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.transport_rows(doc_findings(spark, sf_dir))


@query(f"WITH {O.hits(O.DOCS)} SELECT path, line_number, rule_id, concat_ws(' ', {', '.join(f'format({O.q(k + chr(61) + chr(123) + ":.2f" + chr(125))}, ({v})::DOUBLE)' for k, v in O.ml_parts().items())}) AS factors FROM found LEFT JOIN {O.RULE_VALUES} ON id = rule_id")
def score_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = F.array_join(ensemble_factors(classify(F.col("snippet"), F.col("rule_id"))), " ")
    return doc_findings(spark, sf_dir).select("path", "line_number", "rule_id", factors.alias("factors"))


@query(f"WITH {O.hits(O.DOCS)} SELECT (count(CASE WHEN severity = 'mortal' THEN 1 END) > 0)::INTEGER AS code FROM found")
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of all documents exits with."""
    return spark.createDataFrame([(reports.exit_code(doc_findings(spark, sf_dir)),)], "code int")


@query(f"WITH {O.hits(O.DOCS)} {_FOUND} WHERE severity = 'mortal'")
def mortal_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_findings(spark, sf_dir).filter("severity = 'mortal'").select(*_KEPT)


@query(f"WITH {O.hits(O.DOCS)} SELECT path, line_number, rule_id, row_number() OVER (ORDER BY severity <> 'mortal', path, line_number, rule_id) AS place FROM found")
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the list that begins with mortal findings; distributed, by a range sort and the sizes of its partitions.

    The findings are held first: a range sort reads its input twice, once for the ranges, and would scan twice.
    """
    found = store.held(doc_findings(spark, sf_dir).select("path", "line_number", "rule_id", "severity"))
    rows = store.held(reports.by_severity(found).select("path", "line_number", "rule_id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())  # a row for each partition of the sort
    before = accumulate((n for _, n in sizes), initial=0)
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part bigint, start bigint")
    return rows.join(F.broadcast(starts), part == F.col("part")).select("path", "line_number", "rule_id", (F.col("start") + F.expr("at & 8589934591") + 1).alias("place"))


@query(f"WITH {O.hits(O.DOCS)} {_FOUND} WHERE line_number = 2 ORDER BY path, rule_id LIMIT 1")
def finding_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding at a line: one by definition."""
    return store.finding_at(doc_findings(spark, sf_dir), 2).select(*_KEPT)


@query(rf"WITH {O.hits(O.DOCS)} SELECT path, line_number, rule_id FROM found")
def baseline_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved baseline, read again."""
    where = f"{shared_dir(spark)}/baseline-{uuid.uuid4().hex}"
    store.save_baseline(doc_findings(spark, sf_dir), where)
    return store.show_baseline(spark, where)


@query(rf"WITH {O.hits(O.DOCS)} SELECT DISTINCT rule_id, sha256(snippet) AS snippet_hash, '*.txt' AS file_pattern FROM found")
def feedback_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings marked twice in a store, which keeps each once."""
    where = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    found = store.held(doc_findings(spark, sf_dir))
    store.mark_false_positives(found, where)
    store.mark_false_positives(found, where)
    return store.load_feedback(spark, where).select("rule_id", "snippet_hash", "file_pattern")


@query(f"WITH {O.hits(O.DOCS)} SELECT path, line_number, rule_id, severity FROM found")
def cached_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a cache that knows every other document already."""
    where = [f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"]
    files = docs(spark, sf_dir).filter("text IS NOT NULL").withColumn("file_hash", T.sha256_hex(F.col("text")))
    store.scan_with_cache(files.filter(F.length("path") % 2 == 0), Config(), where)
    return store.scan_with_cache(files, Config(), where).select("path", "line_number", "rule_id", "severity")


# Sources.

_FILE_KINDS = "CASE doc_id % 6 WHEN 1 THEN 'image' WHEN 2 THEN 'nul' WHEN 3 THEN 'latin' WHEN 4 THEN 'empty' WHEN 5 THEN 'large' ELSE 'text' END"


@query(f"SELECT path, text, sha256(text) AS file_hash FROM (SELECT concat(coalesce(source, 'null'), '/', doc_id, '.txt') AS path, CASE WHEN doc_id % 6 = 4 THEN '' ELSE text END AS text, doc_id FROM documents WHERE text IS NOT NULL) t WHERE doc_id % 6 IN (0, 4)")
def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents as files of six kinds: those that are small enough, not binary and valid UTF-8, with their hashes."""
    rows = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("kind", F.expr(_FILE_KINDS))
    said = F.encode("text", "UTF-8")
    byte = {"image": F.concat(F.unhex(F.lit("89504E470D0A1A0A")), said), "nul": F.concat(F.unhex(F.lit("00")), said), "latin": F.concat(said, F.unhex(F.lit("0AE9"))), "empty": F.unhex(F.lit(""))}
    content = said
    for kind, data in byte.items():
        content = F.when(F.col("kind") == kind, data).otherwise(content)
    path = F.concat(F.concat_ws("/", F.coalesce("source", F.lit("null")), F.col("doc_id").cast("string")), F.lit(".txt"))
    length = F.when(F.col("kind") == "large", F.lit((50 << 20) + 1)).otherwise(F.length(content))
    return as_texts(rows.select(path.alias("path"), content.alias("content"), length.cast("bigint").alias("length")))


_COMMITS = "SELECT concat('c', cast(floor(k / 40) as bigint)) AS commit, concat('src/f', cast(floor(k / 8) as bigint) % 5, CASE k % 3 WHEN 0 THEN '.yml' ELSE '.txt' END) AS path, cast(floor(k / 4) as bigint) % 2 AS hunk, k AS seq, CASE k % 5 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '+' END AS origin, cast(k % 4 + 1 as int) AS new_line, text AS line FROM ({})"


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_COMMITS.format("SELECT k, text FROM {tokens}"), tokens=tokens(spark, sf_dir))


@query(f"""WITH raw AS ({_COMMITS.format(f"SELECT k, text FROM ({TOKEN_LINES}) t")}), lines AS (
  SELECT commit, path, new_line, origin, {O.trim('line')} AS line, coalesce(lag(line) OVER (PARTITION BY commit, path, hunk ORDER BY seq), '') AS prev, '' AS next FROM raw
), able AS (SELECT * FROM lines WHERE origin = '+' AND line <> '' AND NOT {O.line_veto()}), judged AS ({O.judged()})
SELECT path, new_line AS line_number, left(commit, 8) AS commit_hash, coalesce(h.id, 'HIGH_ENTROPY') AS rule_id, line AS snippet FROM judged WHERE h IS NOT NULL OR s IS NOT NULL""")
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines of synthetic commits, each with the line before it in its hunk."""
    return history.scan_history(_commits(spark, sf_dir)).select("path", "line_number", "commit_hash", "rule_id", "snippet")


@query(f"""WITH raw AS ({_COMMITS.format(f"SELECT k, text FROM ({TOKEN_LINES}) t")}) SELECT count(DISTINCT commit) AS commits, count(DISTINCT (commit, path)) AS files, count(CASE WHEN origin = '+' THEN 1 END) AS added, count(CASE WHEN origin = '-' THEN 1 END) AS removed FROM raw""")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_stats(_commits(spark, sf_dir))


@query(rf"SELECT k, path, lower(regexp_extract(path, '([^.]*)\z', 1)) AS scope, nullif(regexp_extract(path, '[^/]\.([^./]*)\z', 1), '') AS extension, replace(path, '/', '__') AS flat, NOT regexp_matches(path, '(?s)\A(?:(?:.*/)?docs/.*|.*\.min\.js)\z') AND NOT regexp_matches(path, '(?:unit|conftest)') AS scanned FROM {_PATH_ROWS}")
def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope extension, extension, name in quarantine, and whether ignored paths and file patterns leave the file."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey AS k", _PATH_ROWS.split("AS k, ")[1].split(" FROM part")[0])
    p = F.col("path")
    config = Config(ignore_paths=("**/docs/**", "*.min.js"), allow_file_patterns=("unit", "conftest"))
    return rows.select("k", "path", P.scope_extension(p).alias("scope"), P.extension(p).alias("extension"), F.replace(p, F.lit("/"), F.lit("__")).alias("flat"), path_filter(p, config).alias("scanned"))


# Remediation.

_ENV = "CASE rule_id " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in remediation.ENV_VARS.items()) + " ELSE 'SECRET_NAME' END"
_WORD, _WORDS_ = r"\A[\pL\pN_]+\z", r"\A[\pL\pN_ ]+\z"
_TOLD = O.trim(f"regexp_extract(snippet, {O.q(remediation.DECLARED)}, 2)")
_LEFT = O.trim(f"regexp_extract(snippet, {O.q(remediation.ASSIGNED)}, 1)")
_LAST = rf"regexp_extract({_LEFT}, '(\S+)\z', 1)"
_SUGGEST = f"concat(CASE WHEN regexp_matches({_TOLD}, '{_WORD}') THEN regexp_extract(snippet, {O.q(remediation.DECLARED)}, 1) || ' ' || {_TOLD} WHEN regexp_matches({_LEFT}, '{_WORDS_}') AND regexp_matches({_LAST}, '{_WORD}') THEN {_LAST} ELSE {_ENV} END, ' = process.env.', {_ENV}, ';')"


@query(f"WITH {O.hits(O.TOKENS)} SELECT path, line_number, rule_id, {_ENV} AS env, {_SUGGEST} AS suggestion FROM found")
def remediation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = F.col("snippet"), F.col("rule_id")
    return token_findings(spark, sf_dir).select("path", "line_number", "rule_id", remediation.env_var(r).alias("env"), remediation.suggested_line(s, r).alias("suggestion"))


_SECRET = rf"""(CASE WHEN regexp_extract(snippet, '[=:]\s*["'']([^"'']+)["'']', 1) <> '' THEN regexp_extract(snippet, '[=:]\s*["'']([^"'']+)["'']', 1) WHEN regexp_extract(snippet, '[=:]\s*(\S+)', 1) <> '' THEN regexp_extract(snippet, '[=:]\s*(\S+)', 1) ELSE snippet END)"""


@query(rf"WITH {O.hits(O.TOKENS)}, s AS (SELECT path, line_number, snippet, '{{{{env.' || rule_id || '}}}}' AS placeholder, {_SECRET} AS v FROM found) SELECT path, line_number, placeholder, substr(snippet, 1, instr(snippet, v) - 1) || placeholder || substr(snippet, instr(snippet, v) + len(v)) AS new_line FROM s")
def placeholder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.placeholder_plan(token_findings(spark, sf_dir)).select("path", "line_number", "placeholder", "new_line")


_PROVIDERS = "CASE " + " ".join(f"WHEN rule_id IN ({', '.join(map(O.q, ids))}) THEN {O.q(name)}" for ids, name, *_ in remediation._GROUPS) + " ELSE 'Generic' END"
_STEPS = "CASE " + " ".join(f"WHEN rule_id IN ({', '.join(map(O.q, ids))}) THEN {len(steps) * 100 + len(commands)}" for ids, _, _, steps, commands in remediation._GROUPS) + f" ELSE {len(remediation._OTHER[2]) * 100} END"


@query(f"WITH {O.hits(O.TOKENS)} SELECT path, line_number, rule_id, {_PROVIDERS} AS provider, {_STEPS} AS sizes FROM found WHERE severity = 'mortal'")
def rotation_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.rotation_guide(token_findings(spark, sf_dir)).select("path", "line_number", "rule_id", "provider", (F.size("steps") * 100 + F.size("commands")).alias("sizes"))


@query(rf"WITH {O.hits(O.TOKENS)} SELECT path, line_number, 'sift/' || regexp_replace(regexp_extract(path, '[^/]*\z'), '(.)\.[^.]*\z', '\1') || '/' || lower(rule_id) AS vault_path FROM found")
def vault_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_findings(spark, sf_dir).select("path", "line_number", remediation.vault_path(F.col("rule_id"), F.col("path")).alias("vault_path"))


_MATCHED = "CASE rule_id " + " ".join(f"WHEN {O.q(r.id)} THEN regexp_extract(snippet, {O.q(r.pattern)})" for r in RULES) + " END"


@query(f"""WITH {O.hits(O.TOKENS)}, v AS (SELECT path, line_number, rule_id, {_ENV} AS env_key, {_MATCHED} AS value FROM found)
SELECT path, line_number, rule_id, env_key, CASE WHEN value IS NULL THEN 'skip_unable_extract' WHEN env_key = 'PASSWORD' OR row_number() OVER (PARTITION BY env_key, value IS NULL ORDER BY path, line_number, rule_id) > 1 THEN 'skip_key_present' ELSE 'migrate' END AS action FROM v""")
def migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.migration_plan(token_findings(spark, sf_dir), ["PASSWORD"]).select("path", "line_number", "rule_id", "env_key", "action")


@query(f"WITH {O.hits(O.TOKENS)} SELECT DISTINCT path, replace(replace(path, '/', '__'), chr(92), '__') AS flat_name FROM found WHERE severity = 'mortal'")
def quarantine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.quarantine_candidates(token_findings(spark, sf_dir))


_OBJECT = f"concat('{{\"', CASE WHEN p_partkey % 3 = 0 THEN 'key' ELSE 'name' END, '\":\"', CASE WHEN p_partkey % 3 = 0 THEN {expression('AKIA{u16}', STREAM.format(key='p_partkey'))} ELSE 'blue' END, '\"}}')"


@query(f"SELECT cast(p_partkey as string) AS uid, p_partkey % 3 <> 0 AS allowed, CASE WHEN p_partkey % 3 = 0 THEN 403 ELSE 200 END AS code, CASE WHEN p_partkey % 3 = 0 THEN 'Scan blocked this resource: 1 secret(s) detected in manifest. AWS_ACCESS_KEY (line 2): AWS Access Key ID detected' END AS message FROM part")
def admission_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.verdicts(_table(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) AS uid", f"{_OBJECT} AS object")).fillna(200, ["code"])


_DECOYS = "concat('plain ', md5(p_name), chr(10), CASE WHEN p_partkey % 4 = 0 THEN concat('AWS=', md5(p_name), ' # sift:honeytoken') WHEN p_partkey % 4 = 1 THEN 'note sift:honeytoken' ELSE 'x' END)"


@query(f"SELECT path, 2 AS line_number, CASE WHEN p_partkey % 4 = 0 THEN md5(p_name) END AS token FROM (SELECT p_partkey, p_name, concat('p', cast(p_partkey as string)) AS path FROM part) s WHERE p_partkey % 4 < 2")
def honeytoken_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return honeytokens.honeytoken_lines(_table(spark, sf_dir, "part").selectExpr("concat('p', cast(p_partkey as string)) AS path", f"{_DECOYS} AS text"))


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'administrative' WHEN 1 THEN 'read_write' WHEN 2 THEN 'read_only' ELSE 'read_write' END AS github, CASE WHEN c_custkey % 2 = 0 THEN 'catastrophic' ELSE 'read_write' END AS stripe FROM customer")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "CASE c_custkey % 4 WHEN 0 THEN array('repo', 'admin:org') WHEN 1 THEN array('repo') WHEN 2 THEN array('read:user') ELSE cast(array() as array<string>) END AS scopes", "CASE WHEN c_custkey % 2 = 0 THEN 'sk_live_x' ELSE 'sk_test_x' END AS secret")
    return rows.select("k", V.github_risk(F.col("scopes")).alias("github"), V.stripe_risk(F.col("secret")).alias("stripe"))


# Reports.

_PERCENT = f"format('{{}}%', round({O.confidence()} * 100)::INTEGER)"
_LEVELED = f"f AS (SELECT *, {O.confidence()} AS confidence, {O.level()} AS lv, {_PERCENT} AS pct, {O.redacted()} AS masked FROM found)"


@query(f"WITH {O.hits(O.DOCS)}, {_LEVELED} SELECT path, greatest(line_number, 1) - 1 AS line, CASE WHEN severity = 'mortal' THEN 1 ELSE 2 END AS severity, rule_id AS code, 'siftwork' AS source, '[' || rule_id || '] ' || description || ' (confidence: ' || pct || ') [' || lv || ']' AS message FROM f")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.diagnostics(doc_findings(spark, sf_dir))


_CSV = lambda x: f"""CASE WHEN regexp_matches({x}, '[",\\r\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


@query(f"WITH {O.hits(O.TOKENS)}, {_LEVELED} SELECT concat_ws(',', {_CSV('path')}, line_number::VARCHAR, CASE WHEN severity = 'mortal' THEN 'Mortal' ELSE 'Venial' END, rule_id, {_CSV('description')}, {_CSV('masked')}) AS report FROM f")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.csv_rows(token_findings(spark, sf_dir)).select("report")


@query(f"WITH {O.hits(O.DOCS)} SELECT '| ' || CASE WHEN severity = 'mortal' THEN '[MORTAL]' ELSE '[VENIAL]' END || ' | `' || path || '` | ' || line_number || ' | ' || rule_id || ' | ' || description || ' |' AS report FROM found")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.markdown_rows(doc_findings(spark, sf_dir), ci=True).select("report")


@query(f"WITH {O.hits(O.DOCS)} SELECT '<tr><td><span class=\"badge badge-' || severity || '\">' || upper(left(severity, 1)) || substr(severity, 2) || '</span></td><td><code>' || {O.escape('path')} || '</code></td><td>' || line_number || '</td><td>' || rule_id || '</td><td>' || {O.escape('description')} || '</td></tr>' AS report FROM found")
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.html_rows(doc_findings(spark, sf_dir)).select("report")


_FACTORS = rf"""list_filter([CASE WHEN rule_id = 'AWS_ACCESS_KEY' THEN '+0.25 valid_structure' WHEN rule_id = 'JWT_TOKEN' THEN CASE WHEN regexp_matches(snippet, '\A[\p{{L}}\p{{N}}_-]*(?:\.[\p{{L}}\p{{N}}_-]*){{2}}\z') THEN '+0.20 valid_structure' ELSE '-0.30 invalid_structure' END END, CASE WHEN {O.config_path('path')} THEN '+0.1 config_file' END, CASE WHEN {O.test_path('path')} THEN '-0.2 test_file_path' END], lambda x: x IS NOT NULL)"""


@query(f"""WITH {O.hits(O.TOKENS)}, {_LEVELED}, g AS (SELECT *, {_FACTORS} AS factors FROM f)
SELECT concat('  <testcase name="', rule_id, '" classname="', {O.escape('path')}, '">', chr(10), CASE WHEN severity = 'mortal' THEN concat('    <failure message="', {O.escape('description')}, '">Line ', line_number, ': ', {O.escape('masked')}, chr(10), 'Confidence: ', pct, CASE WHEN len(factors) > 0 THEN chr(10) || 'Factors: ' || array_to_string(factors, ', ') ELSE '' END, '</failure>', chr(10)) ELSE concat('    <system-out>Confidence: ', pct, '</system-out>', chr(10)) END, '  </testcase>') AS report FROM g""")
def junit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.junit_rows(token_findings(spark, sf_dir)).select("report")


@query(f"""WITH {O.hits(O.DOCS)}, {_LEVELED}
SELECT concat('{{"path":', to_json(path), ',"line_number":', line_number, ',"snippet":', to_json(masked), ',"severity":', to_json(severity), ',"description":', to_json(description), ',"rule_id":', to_json(rule_id), ',"confidence":', confidence, ',"confidence_level":', to_json(lv), '}}') AS report FROM f""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_rows(doc_findings(spark, sf_dir)).select("report")


@query(f"""WITH {O.hits(O.DOCS)}, {_LEVELED}
SELECT concat('{{"ruleId":', to_json(rule_id), ',"level":"', CASE WHEN severity = 'mortal' THEN 'error' ELSE 'warning' END, '","message":{{"text":', to_json(description), '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":', to_json(path), '}},"region":{{"startLine":', line_number, ',"snippet":{{"text":', to_json(masked), '}}}}}}}}],"properties":{{"confidence":"', pct, '","confidenceScore":', confidence, '}}}}') AS report FROM f""")
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rows(doc_findings(spark, sf_dir)).select("report")


@query(f"WITH {O.hits(O.TOKENS)} SELECT path, {O.redacted()} AS before, {_SUGGEST} AS after FROM found")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file of the synthetic lines has one finding."""
    return reports.before_after(token_findings(spark, sf_dir)).select("path", F.element_at("before", 1).alias("before"), F.element_at("after", 1).alias("after"))


@query(f"WITH {O.hits(O.DOCS)}, c AS (SELECT path, line_number, unnest([1, 2, 3]) AS place, unnest([prev, line, next]) AS t FROM found) SELECT path, line_number, place, round({O.entropy('t')} * 10)::INTEGER AS bar FROM c")
def entropy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each context line, times ten, as a bar's length."""
    rows = doc_findings(spark, sf_dir).select("path", "line_number", F.posexplode("context").alias("p", "t"))
    return rows.select("path", "line_number", (F.col("p") + 1).alias("place"), F.round(T.byte_entropy(F.col("t")) * 10).cast("int").alias("bar"))


# Streams.


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siftwork/{uuid.uuid4().hex}"


@query(_ALL_HITS)
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream: everything there is, then the alerts are read back from the sink."""
    where = _scratch(spark)
    schema = _table(spark, sf_dir, "documents").schema
    rows = from_table(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet" if _is_folder(spark, f"{sf_dir}/documents.parquet") else f"{sf_dir}/documents*.parquet"), "text", "source", "doc_id")
    lines = rows.select(F.col("path").alias("source"), F.posexplode(T.lines_of(F.col("text"))).alias("i", "line")).select("source", (F.col("i") + 1).alias("line_number"), "line")
    done = monitor.alerts(lines).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{where}/out").drop("ts")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, as a stream with a watermark (an extension)."""
    where = _scratch(spark)
    schema = _table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events*.parquet")
    counts = monitor.windowed(rows, "ts", "1 hour", late="36500 days", by=["event_type"])
    done = counts.writeStream.outputMode("complete").foreachBatch(lambda f, n: f.write.mode("overwrite").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{where}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

