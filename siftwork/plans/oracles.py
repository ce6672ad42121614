"""The engine's semantics once more, as DuckDB SQL for the correctness check: lines, vetoes, check digits, scores."""

from __future__ import annotations

from ..functions.paths import TEST_PATH
from ..functions.rules import CNPJ, CPF, DNI, DSN, IBAN, NIF, RULES, SSN, STRIPE
from ..functions.scoring import KEYWORDS
from ..functions.text import QUOTED
from ..functions.validators import DNI_LETTERS, PLACEHOLDER_PASSWORDS
from ..operators import vetoes
from .synthetic import TOKEN_LINES

DOCS = "SELECT concat(coalesce(source, 'null'), '/', coalesce(doc_id::VARCHAR, 'null'), '.txt') AS path, text FROM documents"
PAGES = "SELECT concat('pages/', coalesce(page_id::VARCHAR, 'null'), '.html') AS path, html AS text FROM pages"
CHATS = "SELECT concat(coalesce(conv_id::VARCHAR, 'null'), '/', coalesce(turn::VARCHAR, 'null'), '.txt') AS path, text FROM conversations"
TOKENS = f"SELECT path, text FROM ({TOKEN_LINES})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def lines(source: str) -> str:
    r"""CTEs docs and lines (path, i, line, prev, next, l)."""
    return rf"""docs AS ({source}), lines AS (
  SELECT path, l, r.i::INTEGER AS i, l[r.i + 1] AS line, coalesce(l[r.i], '') AS prev, coalesce(l[r.i + 2], '') AS next
  FROM (SELECT path, list_transform(string_split(regexp_replace(text, '\n\z', ''), chr(10)), lambda x: regexp_replace(x, '\r\z', '')) AS l FROM docs WHERE text <> '') t, unnest(range(0, len(l))) AS r(i)
)"""


def _sum(d: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"try_cast(substr({d}, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights)) + ")"


def _digit(d: str, i: int) -> str:
    return f"try_cast(substr({d}, {i + 1}, 1) AS INTEGER)"


def luhn(d: str) -> str:
    """Of a string of digits."""
    doubled = f"(2 * try_cast(substr({d}, len({d}) - i, 1) AS INTEGER))"
    return f"(len({d}) BETWEEN 13 AND 16 AND list_sum(list_transform(range(0, len({d})), lambda i: CASE WHEN i % 2 = 1 THEN {doubled} - CASE WHEN {doubled} > 9 THEN 9 ELSE 0 END ELSE try_cast(substr({d}, len({d}) - i, 1) AS INTEGER) END)) % 10 = 0)"


def _mixed(d: str, n: int) -> str:
    return f"{d} <> repeat(left({d}, 1), {n})"


def cpf(d: str) -> str:
    check = lambda n: f"(({_sum(d, list(range(n + 1, 1, -1)))} * 10) % 11) % 10 = {_digit(d, n)}"
    return f"(len({d}) = 11 AND {_mixed(d, 11)} AND coalesce({check(9)} AND {check(10)}, false))"


def _eleven(total: str) -> str:
    return f"(CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END)"


def cnpj(d: str) -> str:
    first = [*range(5, 1, -1), *range(9, 1, -1)]
    return f"(len({d}) = 14 AND {_mixed(d, 14)} AND coalesce({_eleven(_sum(d, first))} = {_digit(d, 12)} AND {_eleven(_sum(d, [6, *first]))} = {_digit(d, 13)}, false))"


def nif(d: str) -> str:
    return f"(len({d}) = 9 AND left({d}, 1) <> '0' AND coalesce({_eleven(_sum(d, list(range(9, 1, -1))))} = {_digit(d, 8)}, false))"


def dni(x: str) -> str:
    c = rf"regexp_replace({x}, '[\s-]', '', 'g')"
    return rf"(regexp_matches({c}, '\A[0-9]{{8}}[\x00-\x7f]\z') AND upper(substr({c}, 9, 1)) = substr('{DNI_LETTERS}', (coalesce(try_cast(substr({c}, 1, 8) AS INTEGER), 0) % 23) + 1, 1))"


def ssn(d: str) -> str:
    return f"(len({d}) = 9 AND left({d}, 3) NOT IN ('000', '666') AND left({d}, 1) <> '9' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"


def iban(x: str) -> str:
    """Remainder by single characters, as a fold over (value so far)."""
    c = rf"upper(regexp_replace({x}, '\s', '', 'g'))"
    code = "CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    turned = f"list_concat([0], list_transform(string_split(substr({c}, 5) || left({c}, 4), ''), lambda c: CASE WHEN c <= '9' THEN {code} ELSE 1000 + {code} END))"
    rest = f"list_reduce({turned}, lambda a, b: CASE WHEN b >= 1000 THEN (a * 100 + b - 1000) % 97 ELSE (a * 10 + b) % 97 END)"
    return rf"(regexp_matches({c}, '\A[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{1,30}}\z') AND {rest} = 1)"


def dsn_password(x: str) -> str:
    p = f"regexp_extract({x}, {q(DSN.format('([^@]+)'))}, 1)"
    return f"(CASE WHEN {p} <> '' AND lower({p}) NOT IN ({', '.join(q(w) for w in PLACEHOLDER_PASSWORDS)}) THEN {p} END)"


def entropy(x: str) -> str:
    pairs = f"regexp_extract_all(hex(encode({x})), '..')"
    share = f"(len(list_filter({pairs}, lambda p: p = d)) / strlen({x})::DOUBLE)"
    return f"coalesce(abs(list_sum(list_transform(list_distinct({pairs}), lambda d: -{share} * log2({share})))), 0.0)"


def quoted(line: str, longer_than: int = 20) -> str:
    pieces = f"regexp_extract_all({line}, {q(QUOTED)})"
    return f"list_transform(list_filter({pieces}, lambda p: len(p) > 1 AND left(p, 1) = right(p, 1) AND strlen(p) > {longer_than + 2}), lambda p: substr(p, 2, len(p) - 2))"


def repetitive(m: str) -> str:
    return rf"((strlen({m}) >= 8 AND strlen({m}) = len({m}) AND {m} = repeat(left({m}, 1), len({m}))) OR (regexp_matches({m}, '\A[0-9]{{12,}}\z') AND len(list_distinct(string_split({m}, ''))) <= 3))"


def value_veto(m: str) -> str:
    return f"(strlen({m}) <= 80 AND (regexp_matches({trim(m)}, {q(vetoes.EXAMPLE_VALUE)}) OR {repetitive(m)} OR regexp_matches({trim(m)}, {q(vetoes.PLACEHOLDER)})))"


def known_example(rule: str, m: str) -> str:
    s = f"lower({trim(m)})"
    named = " OR ".join(f"({rule} = {q(r)} AND {s} IN ({', '.join(map(q, v))}))" for r, v in vetoes.DOCUMENTED.items())
    return rf"({named} OR regexp_matches({s}, '\A(?:test|example|fake|dummy|sample)_|(?:example|_test|_fake|_dummy)\z'))"


def test_path(path: str) -> str:
    return f"regexp_matches(lower(replace({path}, chr(92), '/')), {q(TEST_PATH)})"


def config_path(path: str) -> str:
    p = f"lower({path})"
    return rf"(regexp_matches({p}, '[^/]\.(?:env|yml|yaml)\z') OR {any_of(p, ['.config.', '/.env'])})"


def line_veto() -> str:
    doc = lambda x: f"({any_of(x, vetoes.TEST_MARKS)} OR regexp_matches({trim(x)}, {q(vetoes.DOC_COMMENT)}))"
    return f"({test_path('path')} OR {doc('prev')} OR {doc('line')} OR {doc('next')} OR regexp_matches(line, {q(vetoes.EXAMPLE_NAME)}) OR regexp_matches(prev, {q(vetoes.EXAMPLE_COMMENT)}))"


def threshold(path: str, base: float = 4.6) -> str:
    ext = rf"regexp_extract({path}, '[^/]\.([^./]*)\z', 1)"
    table = {"lock": 1.5, "svg": 0.8, "js": 0.5, "test": 0.5, "spec": 0.5, "md": 0.3, "env": -0.3, "config": -0.3, "properties": -0.3, "ini": -0.3, "json": -0.2, "yaml": -0.2, "yml": -0.2, "toml": -0.2}
    return rf"(CASE WHEN regexp_matches({path}, '\.min\.(?:js|css)\z') THEN {base + 1.0!r}::DOUBLE " + " ".join(f"WHEN {ext} = '{e}' THEN {base + d!r}::DOUBLE" for e, d in table.items()) + f" ELSE {base!r}::DOUBLE END)"


def matches(line: str = "line", builtin_only: bool = True) -> str:
    entries = ", ".join(f"{{'k': {i}, 'id': {q(r.id)}, 'sev': {q(r.severity)}, 'd': {q(r.description)}, 'm': regexp_extract({line}, {q(r.pattern)})}}" for i, r in enumerate(RULES))
    return f"list_filter([{entries}], lambda x: x.m <> '')"


def survivors(line: str = "line") -> str:
    d = digits("x.m")
    veto = f"{value_veto('x.m')} OR {known_example('x.id', 'x.m')} OR (x.id = 'CREDIT_CARD' AND NOT {luhn(d)}) OR (x.id = 'BRAZILIAN_CPF' AND NOT {cpf(d)}) OR (x.id = 'BRAZILIAN_CNPJ' AND NOT {cnpj(d)}) OR (x.id = 'DSN_CREDENTIALS' AND {dsn_password('x.m')} IS NULL)"
    return f"list_filter({matches(line)}, lambda x: NOT ({veto}))"


def judged() -> str:
    """The lines of able with h, the first rule that survives, and s, the first strong quoted string outside of code with patterns."""
    strong = f"list_filter({quoted('line')}, lambda s: NOT {value_veto('s')} AND {entropy('s')} > {threshold('path')})"
    code = any_of("lower(line)", vetoes.REGEX_CODE)
    return f"SELECT *, ({survivors()})[1] AS h, CASE WHEN {code} THEN NULL ELSE ({strong})[1] END AS s FROM able"


def hits(source: str) -> str:
    """CTEs up to found (path, line_number, line, prev, next, snippet, rule_id, severity, description)."""
    return f"""{lines(source)}, able AS (
  SELECT * FROM lines WHERE strlen(line) <= 10000 AND NOT contains(line, 'sift:ignore') AND NOT contains(line, 'sift:honeytoken') AND NOT {line_veto()}
), judged AS (
  {judged()}
), found AS (
  SELECT path, i + 1 AS line_number, line, prev, next, l, i, {trim('line')} AS snippet, coalesce(h.id, 'HIGH_ENTROPY') AS rule_id, coalesce(h.sev, 'mortal') AS severity, coalesce(h.d, 'High entropy string detected (potential secret)') AS description
  FROM judged WHERE h IS NOT NULL OR s IS NOT NULL
)"""


#: rules with their metadata, for joins.
RULE_VALUES = "(VALUES " + ", ".join(f"({i}, {q(r.id)}, {q(r.severity)}, {q(r.description)}, {q(r.prefix) if r.prefix else 'NULL'}, {r.length[0] if r.length else 'NULL'}, {r.length[1] if r.length else 'NULL'}, {q(r.charset) if r.charset else 'NULL'})" for i, r in enumerate(RULES)) + ") AS rules(place, id, sev, des, prefix, lo, hi, charset)"


def confidence() -> str:
    """Of found rows: conf (double), rounded to 6 places."""
    boost = rf"""CASE WHEN rule_id = 'JWT_TOKEN' THEN CASE WHEN regexp_matches(snippet, '\A[\p{{L}}\p{{N}}_-]*(?:\.[\p{{L}}\p{{N}}_-]*){{2}}\z') THEN 0.2 ELSE -0.3 END WHEN rule_id = 'AWS_ACCESS_KEY' THEN CASE WHEN regexp_matches(snippet, 'AKIA[0-9A-Z]{{16}}') THEN 0.25 ELSE -0.2 END ELSE 0 END"""
    return f"round(least(greatest(0.5 + {boost} + CASE WHEN {config_path('path')} THEN 0.1 ELSE 0 END - CASE WHEN {test_path('path')} THEN 0.2 ELSE 0 END, 0), 1)::DOUBLE, 6)"


def structural_level() -> str:
    m = lambda p: f"regexp_extract(snippet, {q(p)})"
    found = lambda p, test: f"CASE WHEN {m(p)} = '' THEN 1 WHEN {test} THEN 2 ELSE 0 END"
    aws, stripe = m("(?:AKIA|ASIA)[A-Z0-9]{16}"), m(STRIPE)
    return (
        f"CASE rule_id WHEN 'AWS_ACCESS_KEY' THEN CASE WHEN {aws} = '' THEN 1 WHEN substr({aws}, 5) = repeat(substr({aws}, 5, 1), 16) THEN 1 ELSE 2 END"
        f" WHEN 'STRIPE_SECRET' THEN CASE WHEN substr({stripe}, 4, 5) = 'live_' AND strlen({stripe}) >= 32 THEN 2 ELSE 1 END"
        f" WHEN 'BRAZILIAN_CPF' THEN {found(CPF, cpf(digits(m(CPF))))} WHEN 'BRAZILIAN_CNPJ' THEN {found(CNPJ, cnpj(digits(m(CNPJ))))}"
        f" WHEN 'DSN_CREDENTIALS' THEN CASE WHEN {dsn_password('snippet')} IS NOT NULL THEN 2 ELSE 1 END WHEN 'NIF_PT' THEN {found(NIF, nif(digits(m(NIF))))}"
        f" WHEN 'DNI_ES' THEN {found(DNI, dni(m(DNI)))} WHEN 'SSN_US' THEN {found(SSN, ssn(digits(m(SSN))))} WHEN 'IBAN' THEN {found(IBAN, iban(m(IBAN)))} END"
    )


def level() -> str:
    c = confidence()
    score = f"CASE WHEN {c} >= 0.75 THEN 2 WHEN {c} >= 0.4 THEN 1 ELSE 0 END"
    return f"(['info', 'suspicious', 'critical'])[greatest({score}, coalesce({structural_level()}, 0), 1) + 1]"


def ml_parts() -> dict[str, str]:
    """The parts of the ensemble score of the snippet by itself; needs a left join with RULE_VALUES."""
    n = "strlen(snippet)"
    share = lambda c: f"(len(regexp_replace(snippet, '(?s)[^{c}]', '', 'g')) / {n}::DOUBLE)"
    shares = [share("A-Z"), share("a-z"), share("0-9"), f"(len(regexp_replace(snippet, '[A-Za-z0-9]', '', 'g')) / {n}::DOUBLE)"]
    classes = " + ".join(f"({s} > 0.05)::INTEGER" for s in shares)
    freq = f"(CASE WHEN {n} = 0 THEN 0 ELSE (CASE WHEN {classes} <= 1 THEN 0.1 WHEN {classes} = 2 THEN 0.4 WHEN {classes} = 3 THEN 0.75 ELSE 0.95 END)::DOUBLE * CASE WHEN greatest({', '.join(shares)}) > 0.9 THEN 0.3 ELSE 1 END END)"
    charset = r"CASE charset WHEN 'alphanum' THEN '\A[A-Za-z0-9_-]*\z' WHEN 'base64' THEN '\A[A-Za-z0-9+/=_.-]*\z' WHEN 'hex' THEN '\A[0-9A-Fa-f]*\z' END"
    struct = (
        f"least(greatest(0.5 + CASE WHEN prefix IS NULL THEN 0 WHEN starts_with(snippet, prefix) THEN 0.25 ELSE -0.3 END + CASE WHEN lo IS NULL THEN 0 WHEN {n} BETWEEN lo AND hi THEN 0.2 ELSE -0.2 END"
        f" + CASE WHEN charset IS NULL THEN 0 WHEN regexp_matches(snippet, {charset}) THEN 0.1 ELSE -0.1 END, 0), 1)::DOUBLE"
    )
    low, high = "coalesce(lo, 16)", "coalesce(hi, 500)"
    length = f"(CASE WHEN {n} BETWEEN {low} AND {high} THEN 1 WHEN {n} < {low} THEN {n} / {low}::DOUBLE ELSE least(greatest(1.0 - ({n} - {high}) / {high}::DOUBLE * 0.5, 0.1), 1) END)"
    ent = f"least(greatest(({entropy('snippet')} - 2.0) / 3.5, 0), 1)"
    return {"entropy": ent, "char_frequency": freq, "structural": struct, "length": length}


def ml() -> str:
    """The ensemble score of the snippet by itself."""
    ent, freq, struct, length = ml_parts().values()
    return f"({ent} * 0.35::DOUBLE + {freq} * 0.25::DOUBLE + {struct} * 0.25::DOUBLE + {length} * 0.15::DOUBLE)"


def nearby() -> str:
    """What ± five lines and an assignment add, for found rows."""
    near = f"len(list_filter(list_concat(l[greatest(i - 4, 1) : i], l[i + 2 : i + 6]), lambda x: {any_of('lower(x)', KEYWORDS)})) > 0"
    return f"(CASE WHEN {near} THEN 0.15 ELSE 0 END + CASE WHEN {any_of('line', ['=', ':'])} THEN 0.1 ELSE 0 END)::DOUBLE"


def redact_secret(s: str, visible: int = 4) -> str:
    return f"CASE WHEN strlen({s}) < {2 * visible + 4} THEN '[REDACTED]' ELSE left({s}, {visible}) || '****' || right({s}, {visible}) END"


def redacted(rule: str = "rule_id", line: str = "snippet") -> str:
    """Of found rows: the line with the rule's match, or its strong quoted strings, masked."""
    match = "CASE " + rule + " " + " ".join(f"WHEN {q(r.id)} THEN regexp_extract({line}, {q(r.pattern)})" for r in RULES) + " ELSE '' END"
    strong = f"list_filter({quoted(line)}, lambda s: {entropy('s')} > 4.5)"
    fold = f"list_reduce(list_concat([{line}], {strong}), lambda a, s: replace(a, s, {redact_secret('s')}))"
    return f"(CASE WHEN {rule} = 'HIGH_ENTROPY' THEN {fold} ELSE CASE WHEN {match} <> '' THEN replace({line}, {match}, {redact_secret(f'({match})')}) ELSE {line} END END)"


def escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x
