"""Lines, vetoes, passes and decoders."""

import base64
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.config import Config, from_dict, preset
from siftwork.functions import rules as R
from siftwork.functions import text as T
from siftwork.operators import detect
from siftwork.plans import api

AWS = "AKIA" + "Q3EGRIPM7WXYZ2BN"
GITHUB = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0fG3iJ6"


def found(spark, text, path="<stdin>", config=Config(), deep=False):
    docs = spark.createDataFrame([(path, text)], "path string, text string")
    return [(r.line_number, r.rule_id) for r in detect.scan(docs, config, deep).orderBy("line_number", "rule_id").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'let key = "{AWS}";', [(1, "AWS_ACCESS_KEY")]),
        (f'const t = "{GITHUB}"', [(1, "GITHUB_TOKEN")]),
        ('key = "AKIA' + 'IOSFODNN7EXAMPLE"', []),
        ('let example_password = "changeme";\nlet test_password = "hunter2";', []),
        ("host 10.1.2.3", [(1, "HARDCODED_IP")]),
        ("card 4532015112830366", [(1, "CREDIT_CARD")]),
        ("card 4532015112830367", []),
        ("// Cliente: 529.982.247-25", [(1, "BRAZILIAN_CPF")]),
        ("// Cliente: 529.982.247-26", []),
        ("postgresql://u:Zx81kqTr@h/db", [(1, "DSN_CREDENTIALS")]),
        ("postgresql://u:password@h/db", []),
        (f'a = "{AWS}" // sift:ignore', []),
        (f"sift:ignore-start\n{AWS}\nsift:ignore-end\n{AWS}", [(4, "AWS_ACCESS_KEY")]),
        (f"sift:ignore-start\n{AWS}", [(2, "AWS_ACCESS_KEY")]),
        (f"{AWS} sift:honeytoken", []),
        (f"# Example\n{AWS}", []),
        ("", []),
        ("\n\n", []),
        ("ſecret = 'abcdefghij'", [(1, "HARDCODED_PASSWORD")]),
    ],
)
def test_single_lines(spark, text, want):
    assert found(spark, text) == want


def test_null_and_long_texts(spark):
    long = "x" * 10_001 + AWS
    docs = spark.createDataFrame([("a", None), ("b", long), ("c", "y" * 9_000 + " " + AWS), (None, AWS)], "path string, text string")
    assert sorted(str(r.path) for r in detect.scan(docs).collect()) == ["None", "c"]


def test_repeated_rows_report_each(spark):
    docs = spark.createDataFrame([("a", AWS), ("a", AWS)], "path string, text string")
    assert detect.scan(docs).count() == 2
    assert detect.dedup_snippets(detect.scan(docs)).count() == 1


def test_configuration_changes_results(spark):
    assert found(spark, f'x = "{AWS}"', config=Config(whitelist=(AWS[4:12],), entropy_threshold=9)) == []
    assert found(spark, f'x = "{AWS}"', config=Config(allow_regexes=("^AKIA",), entropy_threshold=9)) == []
    assert found(spark, f"x {AWS}", config=Config(disable=("AWS_ACCESS_KEY",))) == []
    own = from_dict({"rules": {"custom": [{"id": "CUSTOM_PATTERN", "pattern": r"MYAPP_[A-Z]{4}_\d{4}", "severity": "Venial"}]}})
    assert found(spark, "v MYAPP_ABCD_1234", config=own) == [(1, "CUSTOM_PATTERN")]
    with pytest.raises(ValueError):
        R.custom_rule("X", "(?=a)b", "mortal")
    with pytest.raises(ValueError):
        R.custom_rule("X", "b", "awful")
    assert preset("strict").entropy_threshold == 4.0


def test_high_entropy_needs_no_regex_code(spark):
    value = "".join(random.Random(3).sample(string.ascii_letters + string.digits, 45))
    off = Config(disable=("HARDCODED_PASSWORD",), entropy_threshold=4.0)
    assert found(spark, f'v = "{value}"', config=off) == [(1, "HIGH_ENTROPY")]
    assert found(spark, f'let re = Regex::new("{value}")', config=off) == []


def test_deep_mode(spark):
    coded = base64.b64encode(f"aws={AWS} {AWS[::-1]}".encode()).decode()
    assert (1, "AWS_ACCESS_KEY") in found(spark, f"data {coded}", deep=True)
    assert (1, "AWS_ACCESS_KEY") in found(spark, f"data {AWS.encode().hex()}", deep=True)
    assert found(spark, 'prod_db_pass = "123456"', deep=True) == [(1, "SUSPICIOUS_VARNAME")]
    assert found(spark, "data " + base64.b64encode(bytes(range(128, 228))).decode(), deep=True) == []
    first, second = (''.join(random.Random(i).sample(string.ascii_letters + string.digits, 30)) for i in (5, 6))
    assert (1, "CONCAT_SECRET") in found(spark, f'k = "{first}" + "{second}"', deep=True)


def test_trigger_holds_for_all_generated_matches(spark):
    """A line that a rule matches always passes the cheap trigger."""
    from siftwork.plans.synthetic import TEMPLATES

    rng = random.Random(11)
    alphabet = {"h": "0123456789abcdef", "u": "0123456789ABCDEF", "d": string.digits, "x": string.ascii_letters, "w": string.ascii_letters}
    lines = [re.sub(r"\{([hudxw])(\d+)\}", lambda m: "".join(rng.choices(alphabet[m[1]], k=int(m[2]))), t) for t in TEMPLATES for _ in range(20)]
    lines += ["heroku " + "-".join("abcdefabcdef"[:n] for n in (8, 4, 4, 4, 12)), "DefaultEndpointsProtocol=https;AccountName=a;AccountKey=" + "a" * 88]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    hit = F.size(detect.rule_matches(F.col("line"), list(R.RULES))) > 0
    assert rows.filter(hit & ~F.regexp_like("line", F.lit(R.java(R.TRIGGER)))).count() == 0
    assert rows.filter(hit).count() > 500


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab\r\n\"' é", max_size=12), min_size=20, max_size=40))
def test_lines_equal_the_model(spark, texts):
    def model(t):
        parts = t.split("\n")
        last = parts.pop()
        out = [p.removesuffix("\r") for p in parts]
        return out + ([last] if last else [])

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.l for r in rows.select("i", T.lines_of(F.col("t")).alias("l")).collect()}
    assert got == {i: model(t) for i, t in enumerate(texts)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=20, max_size=40))
def test_entropy_equals_the_model(spark, texts):
    import math
    from collections import Counter

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]

    def model(t):
        b = t.encode()
        return -sum(c / len(b) * math.log2(c / len(b)) for c in Counter(b).values()) if b else 0.0

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", T.byte_entropy(F.col("t")).alias("e")).collect():
        assert r.e == pytest.approx(abs(model(texts[r.i])), abs=1e-9)


@pytest.mark.parametrize("text", ["x" * 1_000_000, "{" * 10_000, "\n" * 100_000, "\ufeff" * 1000, "\x01\x02\x03", "a" * 30 + "!", 'key = "' + "k" * 100_000 + '"', "1 " * 5000])
def test_adversarial_texts_end(spark, text):
    api.scan_text(spark, text).count()


def test_custom_rules_bypass_the_trigger(spark):
    own = Config(custom=(R.custom_rule("WORD", "zebra", "venial"),))
    assert found(spark, "a zebra", config=own) == [(1, "WORD")]
