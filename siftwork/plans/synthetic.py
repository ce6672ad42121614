"""Lines that exercise every rule, derived from table keys by expressions that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: A stream of 256 hexadecimal digits of a key.
STREAM = "concat(" + ", ".join(f"md5(concat(cast({{key}} as string), '{c}'))" for c in "abcdefgh") + ")"
#: {hN} hexadecimal, {uN} upper-case hexadecimal, {dN} digits, {xN} both cases of those, {wN} 32 different characters.
TEMPLATES = (
    'key = "AKIA{u16}"', 'aws_secret_access_key = "{x40}"', "AIza{x35}", "token: ghp_{x36}", "charge sk_" + "live_{x24}", "-----BEGIN RSA " + "PRIVATE KEY-----", "https://hooks.slack.com/services/T{u8}/B{u8}/{x24}",
    "SG.{x22}.{x43}", "SK{h32}", "npm_{x36}", "pypi-{x60}", "M{x23}.{x6}.{x27}", "{d9}:{x35}", "url postgres://host/{h8}", 'password = "{x12}"', "DefaultEndpointsProtocol=https;AccountName=a{h4};AccountKey={x88}", '"type": "service_account"',
    "heroku {h8}-{h4}-{h4}-{h4}-{h12}", "key-{h32}", "sq0atp-{x22}", "sq0csp-{x43}", 'datadog "{h32}"', 'newrelic "{h40}"', 'cloudflare "{x37}"', "sk-{x48}", "eyJ{x10}.eyJ{x10}.{x20}", 'vercel "{x24}"', "mongodb+srv://u{h4}", "rediss://c{h4}",
    "https://{h32}@o1.ingest.sentry.io/{d5}", 'algolia "{x32}"', "secret_{x32}", "lin_api_{x40}", "figd_{x128}", "pat{x14}.{h16}", "dop_v1_{h64}", "pscale_{x43}", 'railway "{x36}"', "rnd_{x48}", "nfp_{x40}", "eyJ{x10}.eyJ{x10}.", "host 10.{d2}.7.{d1}",
    "eval (x{h4})", "card 4{d3} {d4} {d4} {d4}", "USER root", "FROM img{h4}:latest", "privileged: true", "hostNetwork: true", "hostPID: true", 'api_key = "{x24}"', 'token = "{x24}"', "cpf {d3}.{d3}.{d3}-{d2}", "cnpj {d2}.{d3}.{d3}/{d4}-{d2}", "nif 5{d8}",
    "dni {d8}Z", "ssn {d3}-{d2}-{d4}", "iban GB{d2}{u12}", "postgresql://u:{h8}@h", 'x = "{w60}"', 'test_key = "{x20}"', 'let api_key = "example"', 'auth_value = "{h6}"', 'k = "{w14}" + "{w60}"', "nothing {h4}", 're.compile("{w60}")', 'password = "your-api-key-here"',
)
#: Paths, by key: plain, environment, YAML, documentation, test, Python.
PATHS = ("src/m{}.cfg", "conf/m{}.env", "deploy/m{}.yml", "docs/m{}.md", "tests/m{}.cfg", "lib/m{}.json")


def expression(template: str, stream: str = "h") -> str:
    """A template as an SQL expression over the column that holds the stream."""
    at, parts = 1, []
    for lit, kind, n in re.findall(r"([^{]*)(?:\{([hudxw])(\d+)\}|\Z)", template):
        if lit:
            parts.append(f"'{lit}'")
        if kind:
            n = int(n)
            piece = f"substr({stream}, {at}, {n})"
            if kind == "u":
                piece = f"upper({piece})"
            elif kind == "d":
                piece = f"translate({piece}, 'abcdef', '135790')"
            elif kind == "w":
                half = n // 2
                piece = f"upper(substr({stream}, {at}, {half})), translate(substr({stream}, {at + half}, {n - half}), '0123456789abcdef', 'ghijklmnopqrstuv')"
            elif kind == "x":
                half = n // 2
                piece = f"upper(substr({stream}, {at}, {half})), substr({stream}, {at + half}, {n - half})"
            parts.append(piece)
            at += n
    return "concat(" + ", ".join(parts or ["''"]) + ")"


def cases(expressions: list[str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(expressions)} = {i} THEN {e}" for i, e in enumerate(expressions)) + " END"


def path_expression(key: str, paths: tuple[str, ...] = PATHS) -> str:
    """Changes with every turn through the templates, so that each meets each path."""
    parts = []
    for p in paths:
        a, b = p.split("{}")
        parts.append(f"concat('{a}', cast({key} as string), '{b}')")
    return cases(parts, f"cast(floor({key} / {len(TEMPLATES)}) as bigint)")


#: (path, text, k) from orders: one line each.
TOKEN_LINES = f"SELECT {path_expression('k')} AS path, {cases([expression(t) for t in TEMPLATES], 'k')} AS text, k FROM (SELECT o_orderkey AS k, {STREAM.format(key='o_orderkey')} AS h FROM orders) s"


def token_lines(orders: DataFrame) -> DataFrame:
    """(path, text, k): one line an order."""
    return orders.sparkSession.sql(TOKEN_LINES.replace("FROM orders", "FROM {orders}"), orders=orders)
