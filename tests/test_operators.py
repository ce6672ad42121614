"""Scope, infrastructure, complexity, state and remediation."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import paths as P
from siftwork.functions import validators as V
from siftwork.functions.redact import redact_line, redact_secret
from siftwork.functions.registry import register
from siftwork.operators import admission, complexity, detect, honeytokens, iac, remediation, scope, state
from siftwork.plans import queries as Q
from siftwork.plans import reports

AWS = "AKIA" + "Q3EGRIPM7WXYZ2BN"
PY = 'def test_x():\n    key = 1\n\ndef run():\n    """doc\n    more\n    """\n    y = 2\n'
RUST = "mod tests {\n    fn a() {\n        let k = 1;\n    }\n}\nfn prod() {\n    let k = 2;\n}\n"
JS = "describe('x', () => {\n  it('y', () => {\n    const k = 1;\n  });\n});\nlet a = 1;\nconst k = 2;\n"


def test_scope_of_languages():
    assert scope.in_test_function(PY.split("\n"), 1, "py") and not scope.in_test_function(PY.split("\n"), 7, "py")
    assert scope.in_docstring(PY.split("\n"), 5, "py") and not scope.in_docstring(PY.split("\n"), 7, "py")
    assert scope.in_test_function(RUST.split("\n"), 2, "rs") and not scope.in_test_function(RUST.split("\n"), 6, "rs")
    assert scope.in_test_function(JS.split("\n"), 2, "js") and not scope.in_test_function(JS.split("\n"), 6, "js")
    go = "func TestA(t *T) {\n  k := 1\n}\nvar a = 1\nvar k = 2\n".split("\n")
    assert scope.in_test_function(go, 1, "go") and not scope.in_test_function(go, 4, "go")
    java = "@Test\npublic void a() {\n  int k = 1;\n}\npublic void b() {\n  int k = 2;\n}".split("\n")
    assert scope.in_test_function(java, 2, "java") and not scope.in_test_function(java, 5, "java")
    ruby = "describe 'x'\n  it 'y' do\n    k = 1\n  end\nend\ndef run\n  k = 2\nend".split("\n")
    assert scope.in_test_function(ruby, 2, "rb") and not scope.in_test_function(ruby, 6, "rb")
    block = "/**\n * doc\n */\ncode".split("\n")
    assert scope.in_docstring(block, 1, "js") and not scope.in_docstring(block, 3, "js")


def test_scope_query_equals_the_functions(spark, sf_dir):
    got = {(r.path, r.line_idx): (r.in_comment, r.in_docstring, r.in_test_function) for r in Q.scope_full(spark, sf_dir).collect()}
    files = {r.path: r.text for r in Q._code_files(spark, sf_dir).collect()}
    want = {}
    for path, text in files.items():
        lines, ext = text.removesuffix("\n").split("\n"), path.rsplit(".", 1)[1]
        for i in range(len(lines)):
            want[path, i] = (scope.in_comment(lines, i, ext), scope.in_docstring(lines, i, ext), scope.in_test_function(lines, i, ext))
    assert got == want


def test_scope_suppresses_code_in_tests(spark):
    docs = spark.createDataFrame([("src/a.py", f"def test_x():\n    key = '{AWS}'\n"), ("src/b.py", f"# note {AWS}\n"), ("src/c.py", f'"""\n{AWS}\n"""\n')], "path string, text string")
    assert [r.path for r in detect.scan(docs).collect()] == ["src/b.py"]


def test_security_groups(spark):
    text = 'resource "aws_security_group" "a" {\n  ingress {\n    from_port = 22\n    cidr_blocks = ["0.0.0.0/0"]\n  }\n}\n'
    docs = spark.createDataFrame([("main.tf", text)], "path string, text string")
    assert iac.scan_iac(docs).count() == 0
    assert [r.rule_id for r in iac.scan_iac(docs, strict_blocks=True).collect()] == ["TF_SG_OPEN_WORLD"]
    closed = spark.createDataFrame([("main.tf", text + "}\n")], "path string, text string")
    assert [r.rule_id for r in iac.scan_iac(closed).collect()] == ["TF_SG_OPEN_WORLD"]


def test_security_group_query_has_more_when_strict(spark, sf_dir):
    got = Q.iac_security_groups(spark, sf_dir)
    assert got.columns == ["path", "line_number", "rule_id", "severity", "description", "strict"]
    assert got.filter("rule_id <> 'TF_SG_OPEN_WORLD'").count() == 0


def test_complexity(spark):
    body = "def big(x):\n" + "    if x and y:\n        for i in z:\n            pass\n" * 20
    docs = spark.createDataFrame([("a.py", body), ("b.py", "def small():\n    return 1\n")], "path string, text string")
    assert [r.path for r in complexity.complexity_findings(docs).collect()] == ["a.py"]


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("cpf", ["529.982.247-25", "52998224725"], ["529.982.247-26", "11111111111", "123456789", "123456789012", "", None]),
        ("cnpj", ["11.222.333/0001-81", "11222333000181"], ["11.222.333/0001-82", "11111111111111", "11222333000"]),
        ("nif", ["123456789"], ["123456780", "12345", "023456789"]),
        ("dni", ["12345678Z"], ["12345678A", "1234567Z"]),
        ("ssn", ["123-45-6789"], ["000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000"]),
        ("iban", ["GB29NWBK60161331926819", "DE89370400440532013000"], ["GB29NWBK60161331926818", "GB29"]),
        ("luhn", ["4532015112830366", "4532 0151 1283 0366"], ["4532015112830367", "1234567890123456", "453201511283", "45320151128303661"]),
    ],
)
def test_check_digits(spark, kind, good, bad):
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string")
    out = [r[0] for r in rows.coalesce(1).select(getattr(V, kind)(F.col("x"))).collect()]
    assert [bool(x) for x in out] == [True] * len(good) + [False] * len(bad)


def test_registered_functions_agree(spark):
    register(spark)
    row = spark.sql("SELECT luhn_valid('4532015112830366') a, cpf_valid('529.982.247-25') b, cnpj_valid('11.222.333/0001-81') c, nif_valid('123456789') d, ssn_valid('123-45-6789') e, round(byte_entropy('abcd'), 6) f, redact_secret('abcdefghijklmnopqrst') g, is_test_path('tests/a.rs') h, cpf_valid('529.982.247-26') i").first()
    assert list(row) == [True, True, True, True, True, 2.0, "abcd****qrst", True, False]
    assert [tuple(r) for r in spark.sql(f"SELECT line_number, rule_id FROM scan_lines('x\nkey {AWS}')").collect()] == [(2, "AWS_ACCESS_KEY")]


def test_redaction(spark):
    rows = spark.createDataFrame([(f"a {AWS} b {AWS}", "AWS_ACCESS_KEY"), ("plain", "SUSPICIOUS_VARNAME")], "s string, r string")
    assert [r[0] for r in rows.coalesce(1).select(redact_line(F.col("s"), F.col("r"))).collect()] == ["a AKIA****Z2BN b AKIA****Z2BN", "plain"]
    assert rows.select(redact_secret(F.lit("short"))).first()[0] == "[REDACTED]"


def test_confidence(spark):
    docs = spark.createDataFrame([("src/a.rs", f'k = "{AWS}"'), ("conf.env", f"K={AWS}")], "path string, text string")
    got = {r.path: (round(r.confidence, 3), r.confidence_level) for r in detect.scan(docs).collect()}
    assert got == {"src/a.rs": (0.75, "critical"), "conf.env": (0.85, "critical")}


def test_state(spark):
    docs = spark.createDataFrame([("a.txt", f"{AWS}\n\n10.0.0.1")], "path string, text string")
    f = detect.scan(docs)
    base = state.baseline_entries(f)
    assert {r.change for r in state.baseline_diff(base, base).collect()} == {"unchanged"}
    assert {r.change for r in state.baseline_diff(base, base.limit(0)).collect()} == {"new"}
    assert {r.change for r in state.baseline_diff(base.limit(0), base).collect()} == {"removed"}
    marks = state.feedback_entry(f.filter("rule_id = 'HARDCODED_IP'"))
    again = state.mark_false_positives(marks, f.filter("rule_id = 'HARDCODED_IP'"))
    assert again.count() == 1
    assert [r.rule_id for r in state.without_false_positives(f, marks).collect()] == ["AWS_ACCESS_KEY"]
    ranges = spark.createDataFrame([("a.txt", 3, 4), ("z", 1, 2)], "path string, start int, `end` int")
    assert [r.line_number for r in state.in_changed_lines(f, ranges).collect()] == [3]
    assert state.in_changed_lines(f, ranges.filter("path = 'z'")).count() == 2
    files = spark.createDataFrame([("a.txt", "h1"), ("b.txt", "h2")], "path string, file_hash string")
    entries = state.cache_entries(files, f)
    assert {r.path: len(r.matches) for r in entries.collect()} == {"a.txt": 2, "b.txt": 0}
    newer = spark.createDataFrame([("a.txt", "h9"), ("b.txt", "h2")], "path string, file_hash string")
    assert {r.path: r.hit for r in state.cache_split(newer, entries).collect()} == {"a.txt": False, "b.txt": True}
    assert state.cache_upsert(entries, state.cache_entries(newer.filter("path = 'a.txt'"), f.limit(0))).count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, text string")
    f = detect.scan(none)
    assert f.count() == 0
    assert reports.severity_counts(f).first() == (0, 0)
    for kind in ("json", "csv", "junit", "sarif", "markdown", "html", "report", "terminal"):
        assert reports.render(f, kind)
    assert complexity.function_scores(none).count() == 0
    assert iac.scan_iac(none).count() == 0


def test_reports_tell_the_same(spark):
    import csv
    import io
    import json
    import xml.etree.ElementTree as ET

    docs = spark.createDataFrame([("a,b.txt", f'key = "{AWS}"\nhost 10.0.0.1'), ("c.env", f"K={AWS}")], "path string, text string")
    f = detect.scan(docs)
    data = json.loads(reports.render(f, "json"))
    assert data["summary"] == {"mortal": 2, "venial": 1}
    assert all(AWS not in s["snippet"] for s in data["sins"]) and "context" not in data["sins"][0]
    table = list(csv.reader(io.StringIO(reports.render(f, "csv"))))
    assert [r[:4] for r in table[1:]] == [["a,b.txt", "1", "Mortal", "AWS_ACCESS_KEY"], ["a,b.txt", "2", "Venial", "HARDCODED_IP"], ["c.env", "1", "Mortal", "AWS_ACCESS_KEY"]]
    suite = ET.fromstring(reports.render(f, "junit"))
    assert (suite.get("tests"), suite.get("failures"), len(suite.findall(".//failure"))) == ("3", "2", 2)
    runs = json.loads(reports.render(f, "sarif"))["runs"][0]["results"]
    assert [r["level"] for r in runs] == ["error", "warning", "error"]
    assert "2 Mortal, 1 Venial" in reports.render(f, "md") and "[MORTAL]" in reports.render(f, "md", ci=True)
    assert reports.render(f, "html").count("<tr>") == 4
    assert AWS not in reports.render(f, "report") and "process.env.AWS_ACCESS_KEY_ID" in reports.render(f, "report")
    assert "2 Mortal Sins, 1 Venial Sin condemned" in reports.render(f, "term")
    assert reports.exit_code(f) == 1 and reports.exit_code(f.filter("severity = 'venial'")) == 0


def test_remediation(spark):
    docs = spark.createDataFrame([("a.js", f'const awsKey = "{AWS}";'), ("b.js", f'other: "{AWS}"')], "path string, text string")
    f = detect.scan(docs)
    s = {r.path: r.s for r in f.select("path", remediation.suggested_line(F.col("snippet"), F.col("rule_id")).alias("s")).collect()}
    assert s == {"a.js": "const awsKey = process.env.AWS_ACCESS_KEY_ID;", "b.js": "AWS_ACCESS_KEY_ID = process.env.AWS_ACCESS_KEY_ID;"}
    plan = {r.path: r.action for r in remediation.migration_plan(f).collect()}
    assert plan == {"a.js": "migrate", "b.js": "skip_key_present"}
    report = remediation.migration_report(remediation.migration_plan(f)).first()
    assert (report.migrated_count, report.skipped_key_present, report.files_updated) == (1, 1, ["a.js"])


def test_admission(spark):
    rows = spark.createDataFrame([("u1", '{"b": 1, "a": "%s"}' % AWS), ("u2", '{"a": "fine"}'), ("u3", None), ("u4", "not json")], "uid string, object string")
    got = {r.uid: (r.allowed, r.code) for r in admission.verdicts(rows).collect()}
    assert got == {"u1": (False, 403), "u2": (True, None), "u3": (False, 400), "u4": (True, None)}
    assert "line 2" in admission.verdicts(rows).filter("uid = 'u1'").first().message


def test_paths():
    import re

    m = re.compile(P.globs_regex(["**/node_modules/**", "*.min.js", "src/?.py"]).replace(r"\z", r"\Z"))
    assert m.match("a/node_modules/b/c") and m.match("x/y.min.js") and m.match("src/a.py") and not m.match("src/ab.py")
    with pytest.raises(ValueError):
        P.check_scan_path("/proc/self")


def test_honeytokens(spark):
    tokens = honeytokens.generate(7)
    assert tokens == honeytokens.generate(7) and len({t.value for t in tokens}) == 4
    text = "\n".join(f"{t.name.upper()}={t.value} # {t.marker}" for t in tokens)
    docs = spark.createDataFrame([(".env.sample", text)], "path string, text string")
    assert detect.scan(docs).count() == 0
    assert {r.token for r in honeytokens.honeytoken_lines(docs).collect()} == {t.value for t in tokens}


def test_file_scopes_equal_the_functions_line_by_line():
    """Every language, with nesting, blank lines and resets; one walk gives what each line gives by itself."""
    import random

    from siftwork.operators.scope import _HASH, _MARKUP, LANGUAGES

    pieces = ["def test_a():", "async def setUp(self):", "def run():", "x = 1", "", "   ", '"""', "'''", "/* a", "*/", "/** d", "* b", "// c", "# d", "<!-- e", "-->", "mod tests {", "#[test]", "fn a() {", "}", "})", "describe('x', () => {", "it('y', () => {", "func TestA(t) {", "@Test", "void b() {", "it 'z' do", "end"]
    draw = random.Random(5)
    for ext in sorted({*LANGUAGES, *_HASH, *_MARKUP, "txt", ""}):
        for n in (0, 1, 3, 60, 350):
            lines = [" " * draw.choice((0, 0, 2, 4, 8)) + draw.choice(pieces) for _ in range(n)]
            want = [scope.in_comment(lines, i, ext) + 2 * scope.in_docstring(lines, i, ext) + 4 * scope.in_test_function(lines, i, ext) for i in range(n)]
            assert scope.file_scopes(lines, ext) == want, ext


def test_scope_of_a_long_file_takes_one_walk(spark):
    """A file of 60,000 lines, all of them findings or documentation: no row carries the file's lines."""
    text = "def run():\n" + "    x = 1\n    eval (y)\n" * 30_000
    rows = spark.createDataFrame([("a.py", text)], "path string, text string")
    assert detect.scan(rows).count() == 30_000
