"""Rule files: TOML and YAML lists of custom rules in a directory."""

from __future__ import annotations

import re
import shutil
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import RULES, Rule, custom_rule

try:
    import yaml
except ImportError:
    yaml = None


def _plain_yaml(text: str) -> dict:
    """The subset that rule files use, for where no YAML library is installed: ``rules:`` and a list of flat mappings."""
    rules: list[dict] = []
    for line in text.splitlines():
        said = line.strip()
        if not said or said.startswith("#") or said == "rules:":
            continue
        if said.startswith("- "):
            rules.append({})
            said = said[2:]
        m = re.fullmatch(r"(\w+):\s*(.*)", said)
        if not m or not rules:
            raise ValueError(f"not understood: {line!r}")
        value = m[2].strip()
        if value[:1] == "'" == value[-1:]:
            value = value[1:-1].replace("''", "'")
        elif value[:1] == '"' == value[-1:]:
            value = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), value[1:-1])
        rules[-1][m[1]] = value
    return {"rules": rules}


def _parsed(path: Path) -> list[dict]:
    text = path.read_text(encoding="utf-8")
    data = tomllib.loads(text) if path.suffix == ".toml" else (yaml.safe_load(text) if yaml else _plain_yaml(text))
    return list((data or {}).get("rules", []))


def load_rules(directory: str, strict: bool = True) -> list[Rule]:
    """The rules of all .toml, .yaml and .yml files of a directory, by file name. A file that can't be parsed is left out.

    With ``strict`` a rule with a bad pattern or severity is an error, else it is left out.
    """
    out = []
    for path in sorted(p for p in Path(directory).iterdir() if p.suffix in (".toml", ".yaml", ".yml") and p.is_file()):
        try:
            entries = _parsed(path)
        except (ValueError, UnicodeDecodeError):
            continue
        for r in entries:
            try:
                out.append(custom_rule(r["id"], r["pattern"], r["severity"], r.get("description") or f"Dynamic rule: {r['id']}"))
            except (KeyError, ValueError):
                if strict:
                    raise
    return out


def install_rules(source: str, directory: str, name: str | None = None) -> str:
    """Copies a rule file into the directory after a check of its rules."""
    target = Path(directory)
    target.mkdir(parents=True, exist_ok=True)
    path = Path(source)
    for r in _parsed(path):
        custom_rule(r["id"], r["pattern"], r["severity"], r.get("description"))
    to = target / (name if name and name.endswith(path.suffix) else f"{name}{path.suffix}" if name else path.name)
    shutil.copyfile(path, to)
    return str(to)


def rule_table(spark: SparkSession, custom: list[Rule] | tuple[Rule, ...] = ()) -> DataFrame:
    """(place, rule_id, severity, description, pattern, min_length, max_length, prefix, charset, origin) of all rules in order."""
    rows = [(i, r.id, r.severity, r.description, r.pattern, *(r.length or (None, None)), r.prefix, r.charset, "builtin" if r.builtin else "custom") for i, r in enumerate([*RULES, *custom])]
    return spark.createDataFrame(rows, "place int, rule_id string, severity string, description string, pattern string, min_length int, max_length int, prefix string, charset string, origin string")
