"""Files, git, rule files, streams and actions."""

import os
import subprocess
import time

from pyspark.sql import functions as F

from siftwork.config import Config
from siftwork.operators import detect, remediation
from siftwork.operators.history import scan_history
from siftwork.operators.honeytokens import generate
from siftwork.plans import actions, api
from siftwork.sources import git
from siftwork.sources.files import read_tree
from siftwork.sources.logs import arriving, tail
from siftwork.sources.rule_files import install_rules, load_rules
from siftwork.streaming import monitor

AWS = "AKIA" + "Q3EGRIPM7WXYZ2BN"


def _git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    for name, data in {"src/a.txt": f"k {AWS}\n", ".hidden": AWS, "node_modules/x/b.txt": AWS, "pic.dat": b"\x89PNG\r\n\x1a\n" + AWS.encode(), "nul.dat": b"a\0" + AWS.encode(), "bad.txt": b"\xff\xfe" + AWS.encode(), "skip.log": AWS, "keep.log": AWS, "empty.txt": b""}.items():
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    names = sorted(os.path.relpath(r.path, tmp_path) for r in read_tree(spark, str(tmp_path)).select("path").collect())
    assert names == [".gitignore", ".hidden", "keep.log", "src/a.txt"]
    small = read_tree(spark, str(tmp_path), Config(max_file_size_mb=0))
    assert small.count() == 0
    out, code = api.run(spark, str(tmp_path), "csv")
    assert code == 1 and out.count("AWS_ACCESS_KEY") == 3


def test_large_files_count_to_their_first_invalid_line(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(f"k {AWS}\r\n".encode() + b"x" * (11 << 20) + b"\n\xff\n" + AWS.encode())
    rows = read_tree(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].text.startswith(f"k {AWS}\n") and rows[0].text.endswith("x\n")


def test_git(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    _git(repo, "init", "-q")
    (repo / "a.txt").write_text("one\ntwo\n")
    _git(repo, "add", "-A")
    _git(repo, "commit", "-qm", "first")
    (repo / "a.txt").write_text(f"one\nkey {AWS}\ntwo\n")
    _git(repo, "commit", "-qam", "second")
    (repo / "a.txt").write_text("one\ntwo\n10.0.0.1\n")
    _git(repo, "commit", "-qam", "third")
    (repo / "b.txt").write_text(AWS)
    assert git.changed_files(str(repo)) == [str(repo / "b.txt")]
    _git(repo, "add", "b.txt")
    assert git.staged_files(str(repo)) == [str(repo / "b.txt")]
    assert git.changed_since(str(repo), "HEAD~2") == [str(repo / "a.txt")]
    assert [tuple(r)[1:] for r in git.line_ranges(spark, str(repo), "HEAD~2").collect()] == [(1, 4)]
    found = scan_history(git.history(spark, str(repo))).collect()
    assert {(r.path, r.line_number, r.rule_id, len(r.commit_hash)) for r in found} == {("a.txt", 2, "AWS_ACCESS_KEY", 8), ("a.txt", 3, "HARDCODED_IP", 8)}
    assert [r.rule_id for r in api.scan_path(spark, str(repo), since="HEAD~1").collect()] == ["HARDCODED_IP"]
    assert [r.rule_id for r in api.scan_path(spark, str(repo), staged=True).collect()] == ["AWS_ACCESS_KEY"]
    deep = api.scan_path(spark, str(repo), deep=True, complexity=True, mortal_only=True).collect()
    assert {(os.path.basename(r.path), r.commit_hash is not None) for r in deep} == {("a.txt", True), ("b.txt", False)}


def test_rule_files(tmp_path):
    (tmp_path / "b.toml").write_text('[[rules]]\nid = "T"\npattern = "t+"\nseverity = "Mortal"\n')
    (tmp_path / "a.yaml").write_text("rules:\n  - id: Y\n    pattern: 'y\\d+'\n    severity: venial\n    description: why\n")
    (tmp_path / "c.toml").write_text("not toml [")
    rules = load_rules(str(tmp_path))
    assert [(r.id, r.pattern, r.severity, r.description) for r in rules] == [("Y", r"y\d+", "venial", "why"), ("T", "t+", "mortal", "Dynamic rule: T")]
    assert install_rules(str(tmp_path / "b.toml"), str(tmp_path / "more"), "own").endswith("own.toml")


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(f"fine\n{AWS}\nhost 10.0.0.1 eval (x)\n")
    got = []
    q = monitor.monitor(arriving(spark, str(tmp_path / "in")), lambda f, n: got.extend(f.collect()), str(tmp_path / "state"), availableNow=True)
    q.awaitTermination()
    assert sorted((r.line_number, r.rule_id) for r in got) == [(2, "AWS_ACCESS_KEY"), (3, "EVAL_CALL"), (3, "HARDCODED_IP")]


def test_tail_follows_and_reloads_rules(spark, tmp_path):
    log, rules = tmp_path / "app.log", tmp_path / "rules"
    rules.mkdir()
    log.write_text(f"old {AWS}\n")
    got = []
    q = monitor.monitor(tail(spark, str(log)), lambda f, n: got.extend(f.collect()), str(tmp_path / "state"), str(rules), processingTime="100 milliseconds")
    try:
        time.sleep(3)
        (rules / "r.toml").write_text('[[rules]]\nid = "ZEBRA"\npattern = "zebra"\nseverity = "venial"\n')
        with log.open("a") as f:
            f.write(f"new {AWS}\na zebra here\nunfinished {AWS}")
        for _ in range(100):
            if len(got) >= 2:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted((r.line_number, r.rule_id) for r in got) == [(2, "AWS_ACCESS_KEY"), (3, "ZEBRA")]


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "A"), ("2024-01-01 00:50:00", "A"), ("2024-01-01 01:10:00", "A")], "t string, rule_id string").select(F.col("t").cast("timestamp").alias("ts"), "rule_id")
    assert sorted(r.n for r in monitor.windowed(rows).collect()) == [1, 2]


def test_actions(spark, tmp_path):
    _git_root = tmp_path / "r"
    _git_root.mkdir()
    _git(_git_root, "init", "-q")
    (_git_root / ".gitignore").write_text(".env\n")
    source = _git_root / "a__b.js"
    source.write_text(f'let x = 1;\n  const awsKey = "{AWS}";\n')
    found = detect.scan(read_tree(spark, str(_git_root)))
    plan = remediation.migration_plan(found)
    assert actions.migrate(str(_git_root), plan, str(_git_root / ".env"))["migrated_count"] == 1
    assert AWS in source.read_text()
    placeholders = remediation.placeholder_plan(found).cache()
    placeholders.count()
    actions.migrate(str(_git_root), plan, str(_git_root / ".env"), apply=True)
    assert source.read_text() == "let x = 1;\n  const awsKey = process.env.AWS_ACCESS_KEY_ID;\n"
    assert (_git_root / ".env").read_text() == f"AWS_ACCESS_KEY_ID={AWS}\n" and (os.stat(_git_root / ".env").st_mode & 0o777) == 0o600
    source.write_text(f'let x = 1;\n  const awsKey = "{AWS}";\n')
    assert actions.inject_placeholders(placeholders, apply=True)[0]["replaced"] == 1
    assert "{{env.AWS_ACCESS_KEY}}" in source.read_text()
    actions.quarantine_file(str(_git_root), str(source))
    assert not source.exists() and actions.quarantined(str(_git_root)) == ["a__b.js"]
    assert actions.restore_file(str(_git_root), "a__b.js") == str(source) and source.exists()
    tokens = generate(1)
    for _ in range(2):
        actions.inject_env(str(_git_root / "x.env"), tokens)
        actions.inject_readme(str(_git_root / "README.md"), tokens)
    assert (_git_root / "x.env").read_text().count("sift:honeytoken") == 4
    assert (_git_root / "README.md").read_text().count("sift:honeytoken:start") == 1
    log = tmp_path / "log.tsv"
    assert actions.log_remediated(str(log), remediation.rotation_guide(found.limit(0))) == 0
