"""Scan configuration: frozen values that are inlined into plans."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, replace

from .functions.rules import Rule, custom_rule

_BINARY = "png jpg jpeg gif ico woff woff2 ttf eot mp3 mp4 webm zip tar gz rar 7z pdf".split()
DEFAULT_IGNORE = tuple(f"**/{d}/**" for d in ("target", ".git", "node_modules")) + tuple(f"**/*.{e}" for e in ("lock", *_BINARY, "min.js", "min.css")) + ("**/.scan-cache/**",)


@dataclass(frozen=True)
class Config:
    # scan
    ignore_paths: tuple[str, ...] = DEFAULT_IGNORE
    entropy_threshold: float = 4.6
    whitelist: tuple[str, ...] = ()
    max_file_size_mb: int = 50
    skip_minified_threshold: int = 10_000
    entropy_skip_regex_context: bool = True
    allow_regexes: tuple[str, ...] = ()
    allow_paths: tuple[str, ...] = ()
    allow_file_patterns: tuple[str, ...] = ()
    # rules
    disable: tuple[str, ...] = ()
    custom: tuple[Rule, ...] = ()
    # output
    redact_secrets: bool = True
    redact_visible_chars: int = 4
    # cache
    cache_enabled: bool = False
    cache_location: str = "both"
    #: Prefix of the markers in texts: MARKER:ignore, MARKER:ignore-start, MARKER:ignore-end, MARKER:honeytoken.
    marker: str = "sift"
    profiles: dict = field(default_factory=dict, hash=False, compare=False)

    def with_profile(self, name: str) -> Config:
        """The profile's own settings over these; an unknown profile changes nothing."""
        own = self.profiles.get(name, {})
        allowed = {"scan": {"entropy_threshold", "whitelist", "max_file_size_mb"}, "output": {"redact_secrets", "redact_visible_chars"}, "cache": {"enabled", "location"}}
        changes = {}
        for section, keys in allowed.items():
            for k, v in own.get(section, {}).items():
                if k in keys:
                    changes[f"cache_{k}" if section == "cache" else k] = tuple(v) if isinstance(v, list) else v
        return replace(self, **changes)


def from_dict(data: dict) -> Config:
    """Sections scan (with allowlist), rules, output, cache, and profiles (also spelled profile)."""
    names = {f.name for f in fields(Config)}
    out: dict = {}
    scan, rules = dict(data.get("scan", {})), data.get("rules", {})
    allow = scan.pop("allowlist", {}) or {}
    for k, v in {**scan, **data.get("output", {})}.items():
        if k in names:
            out[k] = tuple(v) if isinstance(v, list) else v
    for k in ("enabled", "location"):
        if k in data.get("cache", {}):
            out[f"cache_{k}"] = data["cache"][k]
    for key, to in (("regexes", "allow_regexes"), ("paths", "allow_paths"), ("file_patterns", "allow_file_patterns")):
        values = tuple(allow.get(key, ()))
        if key != "paths":
            for v in values:
                try:
                    re.compile(v)
                except re.error as e:
                    raise ValueError(f"allowlist.{key}: {v!r}: {e}") from e
        out[to] = values
    out["disable"] = tuple(rules.get("disable", ()))
    out["custom"] = tuple(custom_rule(r["id"], r["pattern"], r.get("severity", "mortal"), r.get("description")) for r in rules.get("custom", ()))
    if "marker" in data:
        out["marker"] = data["marker"]
    out["profiles"] = {**data.get("profiles", {}), **data.get("profile", {})}
    return Config(**out)


def load(path: str | None = None) -> Config:
    if path is None:
        return Config()
    with open(path, "rb") as f:
        return from_dict(tomllib.load(f))


def preset(name: str) -> Config:
    """strict, balanced, ci or monorepo."""
    common = ("tests/**", "examples/**", "vendor/**")
    if name == "strict":
        return Config(ignore_paths=(), entropy_threshold=4.0, max_file_size_mb=100, cache_enabled=True)
    if name == "balanced":
        return Config(ignore_paths=("docs/**", *common), cache_enabled=True)
    if name == "ci":
        return Config(ignore_paths=common)
    if name == "monorepo":
        return Config(ignore_paths=tuple(f"{d}/**" for d in ("dist", "build", ".next", "coverage", "node_modules", "vendor")), max_file_size_mb=80, skip_minified_threshold=12_000, cache_enabled=True)
    raise ValueError(f"no preset {name!r}; there are strict, balanced, ci and monorepo")


def _value(x) -> str:
    return "[" + ", ".join(map(_value, x)) + "]" if isinstance(x, tuple) else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)


def init(path: str, name: str = "balanced", force: bool = False) -> str:
    """Writes a preset's settings as a configuration file; an unknown name means balanced, a file that is there needs ``force``."""
    config = preset(name if name in ("strict", "balanced", "ci", "monorepo") else "balanced")
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} exists; force overwrites it")
    scan = {k: getattr(config, k) for k in ("ignore_paths", "entropy_threshold", "max_file_size_mb", "skip_minified_threshold", "entropy_skip_regex_context")}
    text = f"# {name}\n[scan]\n" + "".join(f"{k} = {_value(v)}\n" for k, v in scan.items()) + f"\n[cache]\nenabled = {_value(config.cache_enabled)}\nlocation = {_value(config.cache_location)}\n"
    with open(path, "w") as f:
        f.write(text)
    return text
