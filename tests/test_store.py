"""What outlives a scan: baselines, feedback, the cache; and what writes files."""

import os
import subprocess
from dataclasses import replace

import pytest

from siftwork import config as C
from siftwork.operators import state
from siftwork.plans import actions, api, reports, store

KEY = "AKIA" + "QWERTYUIOPASDFGH"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text(f"x = 1\nkey = '{KEY}'\n")
    (root / "b.yml").write_text(f"host: 10.0.0.1\ntoken: {KEY[:-1]}Z\n")
    (root / "c.txt").write_text("nothing\n")
    return root


def _rows(df):
    return sorted((os.path.basename(r.path), r.line_number, r.rule_id) for r in df.collect())


def test_a_baseline_is_saved_shown_and_compared(spark, tree, tmp_path):
    where = str(tmp_path / "baseline")
    with pytest.raises(FileNotFoundError):
        store.load_baseline(spark, where)
    n = store.save_baseline(api.scan_path(spark, str(tree)), where, now="2024-01-01T00:00:00")
    assert n == 3 and {r.created_at for r in store.load_baseline(spark, where).collect()} == {"2024-01-01T00:00:00"}
    assert [(os.path.basename(r.path), r.line_number) for r in store.show_baseline(spark, where).collect()] == [("a.py", 2), ("b.yml", 1), ("b.yml", 2)]
    _, counts, code = store.diff_baseline(api.scan_path(spark, str(tree)), where)
    assert counts == {"new": 0, "removed": 0, "unchanged": 3} and code == 0
    (tree / "a.py").write_text("x = 1\n")
    (tree / "d.txt").write_text(f"k = '{KEY[:-1]}Q'\n")
    changes, counts, code = store.diff_baseline(api.scan_path(spark, str(tree)), where)
    assert counts == {"new": 1, "removed": 1, "unchanged": 2} and code == 1
    assert {(os.path.basename(r.path), r.change) for r in changes.collect()} == {("a.py", "removed"), ("d.txt", "new"), ("b.yml", "unchanged")}
    assert store.save_baseline(api.scan_path(spark, str(tree)), where) == 3
    assert state.BASELINE_VERSION in {r.version for r in store.load_baseline(spark, where).collect()}


def test_feedback_is_marked_once_listed_and_cleared(spark, tree, tmp_path):
    where = str(tmp_path / "feedback")
    found = api.scan_path(spark, str(tree))
    one = store.finding_at(found.filter(found.path.endswith("a.py")), 2)
    assert store.list_feedback(spark, where).count() == 0 and store.clear_feedback(spark, where) == 0
    assert store.mark_false_positives(one, where, now="t") == 1 and store.mark_false_positives(one, where, now="u") == 1
    assert [tuple(r) for r in store.list_feedback(spark, where).collect()] == [("AWS_ACCESS_KEY", "*.py", "t")]
    assert _rows(api.scan_path(spark, str(tree), feedback=store.load_feedback(spark, where))) == [("b.yml", 1, "HARDCODED_IP"), ("b.yml", 2, "AWS_ACCESS_KEY")]
    assert store.finding_at(found, 77).count() == 0
    assert store.clear_feedback(spark, where) == 1 and store.load_feedback(spark, where).count() == 0


def test_unchanged_files_come_from_the_cache(spark, tree):
    config = replace(C.Config(), cache_enabled=True, cache_location="project")
    plain = _rows(api.scan_path(spark, str(tree)))
    assert _rows(api.scan_path(spark, str(tree), config)) == plain
    folder = store.cache_folders(config, str(tree))[0]
    assert {os.path.basename(r.path): len(r.matches) for r in store.load_cache(spark, [folder]).collect()} == {"a.py": 1, "b.yml": 2, "c.txt": 0}
    again = api.scan_path(spark, str(tree), config)
    assert _rows(again) == plain and {r.description for r in again.collect()} == {"Cached: AWS_ACCESS_KEY", "Cached: HARDCODED_IP"} and {r.snippet for r in again.collect()} == {""}
    (tree / "a.py").write_text(f"x = 1\n\nkey = '{KEY}'\n")
    assert {(r.line_number, r.snippet != "") for r in api.scan_path(spark, str(tree), config).collect()} == {(3, True), (1, False), (2, False)}
    other = replace(config, disable=("HARDCODED_IP",))
    assert all(r.snippet for r in api.scan_path(spark, str(tree), other).collect())  # another configuration doesn't hit
    store.clear_cache(spark, folder)
    assert store.load_cache(spark, [folder]).count() == 0


def test_the_users_cache_wins_over_the_projects(spark, tmp_path):
    entry = lambda h: spark.createDataFrame([("p", h, [], 1, "c")], store.CACHE)
    project, user = str(tmp_path / "project"), str(tmp_path / "user")
    store.replace(entry("old"), project)
    store.replace(entry("new"), user)
    assert [r.file_hash for r in store.load_cache(spark, [project, user]).collect()] == ["new"]


def test_infrastructure_joins_the_findings(spark, tmp_path):
    (tmp_path / "Dockerfile").write_text("FROM img:latest\nUSER root\n")
    found = api.scan_path(spark, str(tmp_path), infrastructure=True)
    assert {"DOCKER_LATEST_TAG", "DOCKER_USER_ROOT"} <= {r.rule_id for r in found.collect()}
    assert [r.severity for r in reports.by_severity(found).collect()] == sorted((r.severity for r in found.collect()))


def test_settings_and_hooks_are_written(tmp_path):
    path = str(tmp_path / "scan.toml")
    for name in ("strict", "balanced", "ci", "monorepo"):
        C.init(path, name, force=True)
        loaded, want = C.load(path), C.preset(name)
        assert all(getattr(loaded, k) == getattr(want, k) for k in ("ignore_paths", "entropy_threshold", "max_file_size_mb", "skip_minified_threshold", "cache_enabled"))
    with pytest.raises(FileExistsError):
        C.init(path)
    with pytest.raises(ValueError):
        actions.write_hook(str(tmp_path), "scan")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    hook = actions.write_hook(str(tmp_path), "false")
    assert subprocess.run([hook], capture_output=True).returncode == 1 and os.access(hook, os.X_OK)
    actions.write_hook(str(tmp_path), "true", strict=True)
    assert subprocess.run([hook], capture_output=True).returncode == 0
    with open(hook, "w") as f:
        f.write("#!/bin/sh\n")
    with pytest.raises(FileExistsError):
        actions.write_hook(str(tmp_path), "true")
