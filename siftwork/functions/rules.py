"""The built-in detection rules, in order of evaluation, and how patterns are adapted to each engine.

Order is meaning: a line's finding is that of the first rule whose leftmost match survives the vetoes.
Lengths are in bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

MORTAL, VENIAL = "mortal", "venial"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    description: str
    pattern: str
    length: tuple[int, int] | None = None
    prefix: str | None = None
    charset: str | None = None
    builtin: bool = True


def java(pattern: str) -> str:
    r"""For Java: Unicode classes and case folding, and "." excludes only the line feed. Write \z, never $."""
    return "(?Ud)" + pattern


def _needed(items, folded: bool) -> list[list[str]]:
    """Of a parsed sequence: texts of which every match has one, for each such group."""
    out, run = [], ""
    for op, arg in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL" and not (folded and chr(arg).lower() != chr(arg).upper()):
            run += chr(arg)
            continue
        if run:
            out.append([run])
            run = ""
        if name == "IN" and all(str(o) == "LITERAL" and chr(a).lower() == chr(a).upper() for o, a in arg):
            out.append([chr(a) for _, a in arg])
        elif name == "SUBPATTERN" and not (arg[1] or arg[2]):
            out += _needed(arg[3], folded)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            out += _needed(arg[2], folded)
    return out


@cache
def needed_texts(pattern: str) -> tuple[str, ...]:
    """Texts of which every match of the pattern contains one: a cheap condition before the pattern. None where it has no such part.

    The longest literal counts, of letters only where case matters; else quotes or the like that stand in a class of their own.
    """
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, AttributeError):
        return ()
    groups = _needed(parsed, bool(parsed.state.flags & re.IGNORECASE))
    return tuple(max(groups, key=lambda g: (len(g[0]), g[0] in "\"'"))) if groups else ()


# Building blocks.
_Q = "[\"']"
_ALNUM = "A-Za-z0-9"
_WORDY = _ALNUM + "_"
_DASHED = _WORDY + "-"
_HEX = "a-f0-9"


def _run(chars: str, low: int, high: int | str | None = None) -> str:
    return f"[{chars}]{{{low}}}" if high is None else f"[{chars}]{{{low},{high}}}"


def _quoted(chars: str, low: int, high: int | str | None = None) -> str:
    return _Q + _run(chars, low, high) + _Q


def _near(name: str, chars: str, low: int, high: int | str | None = None) -> str:
    """The name in any case and, later in the line, a quoted run."""
    return f"(?i){name}.*" + _quoted(chars, low, high)


def _assigned(names: str, value: str) -> str:
    return f"(?i)({names})" + r"\s*[:=]\s*" + value


def _url(schemes: list[str]) -> str:
    return "(?i)(" + "|".join(schemes) + r")://\S+"


_UUID = "-".join(_run("0-9a-fA-F", n) for n in (8, 4, 4, 4, 12))
_PEM = "|".join(["RSA", "EC", "DSA", "OPENSSH", "PGP", "ENCRYPTED"])
_SLACK = ("https://hooks.slack.com", "services")
_AZURE = {"DefaultEndpointsProtocol": "https", "AccountName": "[^;]+", "AccountKey": _run(_ALNUM + "+/=", 88)}
DSN_SCHEMES = ["postgres", "postgresql", "mariadb", "mysql", "mssql", "sqlserver", r"mongodb(?:\+srv)?", "rediss?", "amqps?", "jdbc:[a-z:]+"]
DSN = "(?i)(?:" + "|".join(DSN_SCHEMES) + ")://[^:]+:{}@"
#: What a token looks like in code that other modules reuse.
AWS_KEY = "AKIA" + _run("0-9A-Z", 16)
STRIPE = "[sr]k_(?:live|test)_" + _run(_ALNUM, 24, "")
_JWT = "eyJ" + f"[{_DASHED}]+" + r"\." + "eyJ" + f"[{_DASHED}]+" + r"\."
CPF = r"\b" + r"\.?".join([r"\d{3}"] * 3) + r"-?\d{2}\b"
CNPJ = r"\b\d{2}\.?" + r"\.?".join([r"\d{3}"] * 2) + r"/?\d{4}-?\d{2}\b"
NIF = r"\b[1-9]\d{8}\b"
DNI = r"\b\d{8}[A-Za-z]\b"
SSN = r"\b" + "-".join(rf"\d{{{n}}}" for n in (3, 2, 4)) + r"\b"
IBAN = r"\b[A-Z]{2}\d{2}" + _run("A-Z0-9", 4, 30) + r"\b"


def _r(id: str, severity: str, pattern: str, description: str, length=None, prefix=None, charset=None) -> Rule:
    if isinstance(length, int):
        length = (length, length)
    return Rule(id, severity, description, pattern, length, prefix, charset)


RULES: tuple[Rule, ...] = (
    _r("AWS_ACCESS_KEY", MORTAL, AWS_KEY, "AWS Access Key ID detected", 20, "AKIA", "alphanum"),
    _r("AWS_SECRET_KEY", MORTAL, _near("aws_secret_access_key", _ALNUM + "/+=", 40), "AWS Secret Access Key detected", 40, None, "base64"),
    _r("GOOGLE_API_KEY", MORTAL, "AIza" + _run(_DASHED, 35), "Google API Key detected", 39, "AIza", "alphanum"),
    _r("GITHUB_TOKEN", MORTAL, "gh[pousr]_" + _run(_WORDY, 36, ""), "GitHub Personal Access Token detected", (40, 100), "gh", "alphanum"),
    _r("STRIPE_SECRET", MORTAL, STRIPE, "Stripe Secret Key detected", (32, 100), "sk_", "alphanum"),
    _r("PRIVATE_KEY", MORTAL, f"-----BEGIN ({_PEM}) PRIVATE KEY-----", "Private Key detected", (100, 5000), "-----BEGIN"),
    _r("SLACK_WEBHOOK", MORTAL, re.escape(_SLACK[0]) + f"/{_SLACK[1]}" + "/T[A-Z0-9]+" + "/B[A-Z0-9]+" + f"/[{_ALNUM}]+", "Slack Webhook URL detected", (70, 120), _SLACK[0]),
    _r("SENDGRID_API", MORTAL, r"SG\." + r"\.".join(_run(_DASHED, n) for n in (22, 43)), "SendGrid API Key detected", 69, "SG.", "base64"),
    _r("TWILIO_API", MORTAL, "SK" + _run(_HEX, 32), "Twilio API Key detected", 34, "SK", "hex"),
    _r("NPM_TOKEN", MORTAL, "npm_" + _run(_ALNUM, 36), "NPM Auth Token detected", 40, "npm_", "alphanum"),
    _r("PYPI_TOKEN", MORTAL, "pypi-" + _run(_DASHED, 60, ""), "PyPI API Token detected", (65, 200), "pypi-", "alphanum"),
    _r("DISCORD_TOKEN", MORTAL, r"[MN][A-Za-z\d]{23,}" + "".join(rf"\.[\w-]{{{n}}}" for n in (6, 27)), "Discord Bot Token detected", (59, 80), None, "base64"),
    _r("TELEGRAM_BOT", MORTAL, r"\d{8,10}:" + _run(_DASHED, 35), "Telegram Bot Token detected", (44, 46), None, "alphanum"),
    _r("DB_CONNECTION_STRING", MORTAL, _url(["postgres", "mysql", "mongodb", "redis", "mssql"]), "Database connection string detected"),
    _r("HARDCODED_PASSWORD", MORTAL, _assigned("password|passwd|pwd|secret", _quoted("^'\"", 8, "")), "Hardcoded password detected", (8, 200)),
    _r("AZURE_STORAGE_KEY", MORTAL, ";".join(f"{k}={v}" for k, v in _AZURE.items()), "Azure Storage Account Key detected", 88, "DefaultEndpointsProtocol", "base64"),
    _r("GCP_SERVICE_ACCOUNT", MORTAL, r"\s*:\s*".join(f'"{x}"' for x in ("type", "service_account")), "GCP Service Account Key detected"),
    _r("HEROKU_API_KEY", MORTAL, "[hH]eroku.*" + _UUID, "Heroku API Key detected", 36, None, "hex"),
    _r("MAILGUN_API_KEY", MORTAL, "key-" + _run(_ALNUM, 32), "Mailgun API Key detected", 36, "key-", "alphanum"),
    _r("SQUARE_ACCESS_TOKEN", MORTAL, "sq0atp-" + _run(_DASHED, 22), "Square Access Token detected", 29, "sq0atp-", "alphanum"),
    _r("SQUARE_OAUTH_SECRET", MORTAL, "sq0csp-" + _run(_DASHED, 43), "Square OAuth Secret detected", 50, "sq0csp-", "alphanum"),
    _r("DATADOG_API_KEY", MORTAL, _near("datadog", _HEX, 32), "Datadog API Key detected", 32, None, "hex"),
    _r("NEW_RELIC_LICENSE", MORTAL, _near("newrelic", _HEX, 40), "New Relic license key detected", 40, None, "hex"),
    _r("CLOUDFLARE_API_KEY", MORTAL, _near("cloudflare", _DASHED, 37), "Cloudflare API key/token detected", 37, None, "alphanum"),
    _r("OPENAI_API_KEY", MORTAL, "sk-" + _run(_ALNUM, 48), "OpenAI API key detected", (51, 60), "sk-", "alphanum"),
    _r("SUPABASE_ANON_KEY", MORTAL, _JWT + f"([{_DASHED}]+)", "Supabase anon/service key detected", (50, 2000), "eyJ", "base64"),
    _r("VERCEL_TOKEN", MORTAL, _near("vercel", _WORDY, 24), "Vercel API token detected", 24, None, "alphanum"),
    _r("MONGODB_ATLAS", MORTAL, r"mongodb(\+srv)?://\S+", "MongoDB Atlas connection string detected", None, "mongodb"),
    _r("REDIS_URL", MORTAL, r"rediss?://\S+", "Redis connection URL detected", None, "redis"),
    _r("SENTRY_DSN", MORTAL, f"https://[{_HEX}]+@[a-z0-9.-]+" + re.escape(".ingest.sentry.io") + "/[0-9]+", "Sentry DSN detected", None, "https://"),
    _r("ALGOLIA_API_KEY", MORTAL, _near("algolia", _ALNUM, 32), "Algolia API key detected", 32, None, "alphanum"),
    _r("NOTION_API_KEY", MORTAL, "secret_" + _run(_ALNUM, 32), "Notion API secret detected", 39, "secret_", "alphanum"),
    _r("LINEAR_API_KEY", MORTAL, "lin_api_" + _run(_ALNUM, 40), "Linear API key detected", 48, "lin_api_", "alphanum"),
    _r("FIGMA_TOKEN", MORTAL, "figd_" + _run(_DASHED, 128, ""), "Figma access token detected", (133, 200), "figd_", "alphanum"),
    _r("AIRTABLE_API_KEY", MORTAL, "pat" + _run(_ALNUM, 14) + r"\." + _run(_HEX, 16), "Airtable API key detected", 34, "pat", "alphanum"),
    _r("DIGITALOCEAN_TOKEN", MORTAL, "dop_v1_" + _run(_HEX, 64), "DigitalOcean API token detected", 71, "dop_v1_", "hex"),
    _r("PLANETSCALE_PASSWORD", MORTAL, "pscale_" + _run(_DASHED, 43), "PlanetScale database password detected", 50, "pscale_", "alphanum"),
    _r("RAILWAY_TOKEN", MORTAL, _near("railway", _DASHED, 32, ""), "Railway API token detected", (32, 100), None, "alphanum"),
    _r("RENDER_API_KEY", MORTAL, "rnd_" + _run(_DASHED, 48), "Render API key detected", 52, "rnd_", "alphanum"),
    _r("NETLIFY_TOKEN", MORTAL, "nfp_" + _run(_DASHED, 40, ""), "Netlify API token detected", (44, 60), "nfp_", "alphanum"),
    _r("JWT_TOKEN", VENIAL, _JWT + f"[{_ALNUM}_.+/=-]*", "JWT Token detected", (50, 2000), "eyJ", "base64"),
    _r("HARDCODED_IP", VENIAL, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "Hardcoded IP address detected"),
    _r("EVAL_CALL", VENIAL, r"eval\s*\(", "eval() call detected (potential code injection)"),
    _r("CREDIT_CARD", MORTAL, r"\b(?:\d[ -]*?){13,16}\b", "Credit card number detected", (13, 19)),
    _r("DOCKER_ROOT", VENIAL, r"(?i)USER\s+root", "Dockerfile uses root user (security risk)"),
    _r("DOCKER_LATEST", VENIAL, r"(?i)FROM\s+.*:latest", "Dockerfile uses ':latest' tag (version pinning recommended)"),
    _r("K8S_PRIVILEGED", MORTAL, r"privileged:\s*true", "Kubernetes pod runs in privileged mode (security risk)"),
    _r("K8S_HOST_NETWORK", VENIAL, r"hostNetwork:\s*true", "Kubernetes pod uses host network (security risk)"),
    _r("K8S_HOST_PID", VENIAL, r"hostPID:\s*true", "Kubernetes pod uses host PID namespace (security risk)"),
    _r("GENERIC_API_KEY", VENIAL, _assigned("api[_-]?key|apikey", _quoted(_DASHED, 20, "")), "Generic API key pattern detected", (20, 200), None, "alphanum"),
    _r("GENERIC_SECRET", VENIAL, _assigned("secret|token", _quoted(_DASHED, 20, "")), "Generic secret pattern detected", (20, 200), None, "alphanum"),
    _r("BRAZILIAN_CPF", MORTAL, CPF, "Brazilian CPF (personal ID) detected", (11, 14)),
    _r("BRAZILIAN_CNPJ", MORTAL, CNPJ, "Brazilian CNPJ (company ID) detected", (14, 18)),
    _r("NIF_PT", VENIAL, NIF, "Portuguese NIF (tax ID) detected", 9),
    _r("DNI_ES", VENIAL, DNI, "Spanish DNI (national ID) detected", 9),
    _r("SSN_US", VENIAL, SSN, "US Social Security Number detected", 11),
    _r("IBAN", VENIAL, IBAN, "IBAN (International Bank Account Number) detected", (15, 34), None, "alphanum"),
    _r("DSN_CREDENTIALS", MORTAL, DSN.format("[^@]+"), "Database connection string with credentials detected"),
)

BY_ID = {r.id: r for r in RULES}
HIGH_ENTROPY = Rule("HIGH_ENTROPY", MORTAL, "High entropy string detected (potential secret)", "")

#: Holds for every line on which a built-in rule can match or a quoted string can be tested: a union of
#: cheap necessary conditions, one for each rule (quotes stand for all rules on quoted values).
TRIGGER = "|".join(
    [
        "[\"'(]", r"\d[ .-]*\d", "://", r"\d:", r"\.[\w-]{6}\.", "AKIA", "AIza", "gh[pousr]_", "k_(?:live|test)_", "-----BEGIN", r"SG\.", "SK[a-f0-9]", "npm_", "pypi-",
        "AccountKey=", "eroku", "key-", "sq0", "sk-", "eyJ", "secret_", "lin_api_", "figd_", r"pat[A-Za-z0-9]{14}\.", "dop_v1_", "pscale_", "rnd_", "nfp_", "(?i:user)\\s+(?i:root)", "(?i::latest)", r"privileged:", "hostNetwork:", "hostPID:", "[A-Z]{2}\\d{2}",
    ]
)


def custom_rule(id: str, pattern: str, severity: str, description: str | None = None) -> Rule:
    """A rule from configuration. Look-around and back-references are refused; (?P<n>...) is rewritten."""
    if re.search(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<", pattern):
        raise ValueError(f"rule {id!r}: look-around, atomic groups and back-references aren't allowed")
    level = severity.lower()
    if level not in (MORTAL, VENIAL):
        raise ValueError(f"rule {id!r}: severity {severity!r} is neither Mortal nor Venial")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"rule {id!r}: {e}") from e
    return Rule(id, level, description if description is not None else f"Custom rule: {id}", pattern.replace("(?P<", "(?<"), builtin=False)
