"""What changes files: quarantine, migration to an env file, placeholders, honeytokens, feedback and rotation logs.

Each takes a plan that Spark made and works on the driver's file system; nothing is changed without ``apply=True``.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.honeytokens import Honeytoken

QUARANTINE = ".sift-quarantine"


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _write(path: Path, text: str, mode: int | None = None) -> None:
    """Written beside its place and moved there, so that no reader sees half a file."""
    new = path.with_name(path.name + ".sift-new")
    new.write_text(text, encoding="utf-8")
    os.chmod(new, mode if mode is not None else (path.stat().st_mode & 0o777 if path.exists() else 0o644))
    os.replace(new, path)


# Quarantine.


def quarantine_file(root: str, path: str) -> dict:
    """Moves a file into the quarantine folder under its flat name, with a line in the manifest."""
    base = Path(root)
    folder = base / QUARANTINE
    folder.mkdir(parents=True, exist_ok=True)
    if not (folder / ".gitignore").exists():
        (folder / ".gitignore").write_text("*\n!.gitignore\n")
    source = Path(path)
    digest = hashlib.sha256(source.read_bytes()).hexdigest()
    relative = str(source.relative_to(base)) if source.is_relative_to(base) else str(source)
    target = folder / relative.replace("/", "__").replace("\\", "__")
    shutil.copyfile(source, target)
    source.unlink()
    with (folder / "manifest.log").open("a") as f:
        f.write(f"{_now()}\t{relative}\t{digest}\n")
    return {"original_path": str(source), "quarantine_path": str(target), "sha256": digest}


def quarantine(root: str, candidates: DataFrame, apply: bool = False) -> list[str]:
    """The files of ``quarantine_candidates``, moved if ``apply``."""
    paths = sorted(r[0] for r in candidates.select("path").toLocalIterator())
    return [quarantine_file(root, p)["quarantine_path"] for p in paths] if apply else paths


def restore_file(root: str, name: str) -> str:
    """Puts a quarantined file back; where its own path held two underscores in a row, the manifest knows better than the name."""
    folder = Path(root) / QUARANTINE
    source = folder / name
    if not source.is_file():
        raise FileNotFoundError(f"{name} isn't quarantined")
    relative = name.replace("__", "/")
    log = folder / "manifest.log"
    if log.exists():
        for line in log.read_text().splitlines():
            parts = line.split("\t")
            if len(parts) == 3 and parts[1].replace("/", "__").replace("\\", "__") == name:
                relative = parts[1]
    target = Path(root) / relative
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    source.unlink()
    return str(target)


def quarantined(root: str) -> list[str]:
    folder = Path(root) / QUARANTINE
    return sorted(p.name for p in folder.iterdir() if p.name not in (".gitignore", "manifest.log")) if folder.is_dir() else []


# Migration to an env file and placeholders.


def env_keys(text: str) -> list[str]:
    """Names that an env file assigns; comments and ``export`` don't matter."""
    out = []
    for line in text.splitlines():
        said = line.strip()
        if said and not said.startswith("#") and "=" in said:
            out.append(said.removeprefix("export ").split("=", 1)[0].strip())
    return [k for k in out if k]


def env_is_safe(root: str, env_file: str) -> str | None:
    """Why secrets mustn't go into the env file: git tracks it, or no ignore file lists it. None if they may."""
    name = os.path.relpath(env_file, root)
    tracked = subprocess.run(["git", "-C", root, "ls-files", "--error-unmatch", name], capture_output=True, check=False)
    if tracked.returncode == 0:
        return f"{name} is tracked by git"
    listed = Path(root, ".gitignore")
    lines = [x.strip().lstrip("/") for x in listed.read_text().splitlines()] if listed.exists() else []
    return None if name in lines or os.path.basename(name) in lines or f"{os.path.basename(name)}*" in lines else f"{name} isn't in .gitignore"


def _edit(path: str, changes: dict[int, tuple[str, str]]) -> int:
    """Replaces lines (from 1) whose trimmed text is still what was found; keeps a backup while it works."""
    source = Path(path)
    text = source.read_bytes().decode("utf-8")
    lines = text.split("\n")
    done = 0
    for n, (old, new) in changes.items():
        if 0 < n <= len(lines) and lines[n - 1].strip() == old:
            lead = lines[n - 1][: len(lines[n - 1]) - len(lines[n - 1].lstrip())]
            lines[n - 1] = lead + new + ("\r" if lines[n - 1].endswith("\r") else "")
            done += 1
    if done:
        backup = source.with_name(source.name + ".sift-backup")
        shutil.copy2(source, backup)
        _write(source, "\n".join(lines))
        backup.unlink()
    return done


def migrate(root: str, plan: DataFrame, env_file: str, apply: bool = False, force: bool = False) -> dict:
    """Carries out ``migration_plan``: values go to the env file (mode 0600), lines of source read them from the environment."""
    if apply and not force and (why := env_is_safe(root, env_file)):
        raise ValueError(why)
    rows = [r.asDict() for r in plan.filter("action = 'migrate'").orderBy("path", "line_number").toLocalIterator()]
    report = {"migrated_count": len(rows), "files_updated": sorted({r["path"] for r in rows}), "vars_added": sorted({r["env_key"] for r in rows})}
    if apply and rows:
        target = Path(env_file)
        old = target.read_text() if target.exists() else ""
        more = "".join(f"{r['env_key']}={r['env_value']}\n" for r in rows if r["env_key"] not in env_keys(old))
        _write(target, old + ("\n" if old and not old.endswith("\n") else "") + more, 0o600)
        for path in report["files_updated"]:
            _edit(path, {r["line_number"]: (r["snippet"], r["new_line"]) for r in rows if r["path"] == path})
    return report


def report_text(report: dict, applied: bool) -> str:
    head = "Migrated" if applied else "Would migrate"
    return "\n".join([f"{head} {report['migrated_count']} secret(s)", *[f"  file: {p}" for p in report["files_updated"]], *[f"  variable: {v}" for v in report["vars_added"]]]) + "\n"


def inject_placeholders(plan: DataFrame, apply: bool = False) -> list[dict]:
    """Carries out ``placeholder_plan``: (path, line, replaced) of each row."""
    rows = [r.asDict() for r in plan.filter("replaced").orderBy("path", "line_number").toLocalIterator()]
    out = []
    for path in sorted({r["path"] for r in rows}):
        mine = {r["line_number"]: (r["original_snippet"], r["new_line"]) for r in rows if r["path"] == path}
        done = _edit(path, mine) if apply else 0
        out.append({"path": path, "lines": sorted(mine), "replaced": done})
    return out


# Honeytokens.


def inject_env(path: str, tokens: list[Honeytoken]) -> None:
    """Adds a marked assignment for each token that the file doesn't hold yet."""
    target = Path(path)
    text = target.read_text() if target.exists() else ""
    for t in tokens:
        if t.value not in text:
            text += f"{t.name.upper()}={t.value} # {t.marker}\n"
    _write(target, text)


def inject_readme(path: str, tokens: list[Honeytoken]) -> None:
    """Adds one marked block of examples; a file that has one stays as it is."""
    target = Path(path)
    text = target.read_text() if target.exists() else ""
    mark = tokens[0].marker
    if f"{mark}:start" not in text:
        body = "".join(f"export {t.name.upper()}={t.value}\n" for t in tokens)
        text += f"\n<!-- {mark}:start -->\n## Sample settings (not for production)\n\n```bash\n{body}```\n<!-- {mark}:end -->\n"
    _write(target, text)


# Rotation.


def log_remediated(path: str, guide: DataFrame) -> int:
    """Appends a line for each finding of a rotation guide: time, rule, path and line, separated by tabs."""
    n = 0
    with open(path, "a", encoding="utf-8") as f:
        for r in guide.select("rule_id", "path", "line_number").toLocalIterator():
            f.write(f"{_now()}\t{r[0]}\t{r[1]}\t{r[2]}\n")
            n += 1
    return n


_HOOK = "# written by siftwork"


def write_hook(root: str, command: str, strict: bool = False, force: bool = False) -> str:
    """Writes a pre-commit hook that runs ``command`` on what is staged, and stops the commit where it fails.

    Without ``strict`` only mortal findings count. A hook of someone else's stays unless ``force`` is given.
    """
    if not os.path.isdir(os.path.join(root, ".git")):
        raise ValueError(f"{root} isn't a git repository")
    folder = os.path.join(root, ".git", "hooks")
    os.makedirs(folder, exist_ok=True)
    hook = os.path.join(folder, "pre-commit")
    if os.path.exists(hook) and not force and _HOOK not in Path(hook).read_text(errors="replace"):
        raise FileExistsError(f"{hook} is another hook; force overwrites it")
    flags = "--staged" if strict else "--staged --mortal-only"
    Path(hook).write_text(f"#!/bin/sh\n{_HOOK}\nif ! {command} {flags}; then\n  echo 'commit stopped: staged files hold secrets' >&2\n  exit 1\nfi\n")
    os.chmod(hook, 0o755)
    return hook
