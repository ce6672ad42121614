"""What keeps large tables from falling to one task, and scans from being done twice."""

import re

import pytest
from pyspark.sql import functions as F

from siftwork.functions import rules as R
from siftwork.functions.text import contains_any
from siftwork.operators import remediation
from siftwork.plans import queries as Q
from siftwork.plans import store
from siftwork.session import spread


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_deep_scan_meets_the_lines_once_and_shuffles_what_it_returns(spark, sf_dir):
    plan = optimized(Q.deep_scan(spark, sf_dir))
    assert plan.count("Relation [") == 4  # documents and orders: once for the cascade, once for concatenations
    assert "confidence" not in plan


def test_rows_of_one_row_group_go_to_all_cores(spark, tmp_path):
    where, conf = str(tmp_path / "t"), spark.conf
    spark.range(50_000).selectExpr("id", "sha2(string(id), 256) AS s").coalesce(1).write.parquet(where)
    old = conf.get("spark.sql.files.maxPartitionBytes")
    conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        rows = spark.read.parquet(where)
        assert rows.rdd.getNumPartitions() > 4
        for most, least_parts in ((None, 4), (5_000, 10)):
            parts = [r[1] for r in spread(rows, most_rows=most).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(parts) == 50_000 and len(parts) >= least_parts and max(parts) < 1.1 * 50_000 / least_parts
    finally:
        conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_match_lacks_the_texts_its_rule_needs(spark, sf_dir):
    rows = Q.tokens(spark, sf_dir)
    guarded = [r for r in R.RULES if R.needed_texts(r.pattern)]
    assert len(guarded) > 40
    told = rows.agg(*[F.count_if(F.regexp_like("text", F.lit(R.java(r.pattern)))).alias(f"n{i}") for i, r in enumerate(guarded)], *[F.count_if(F.regexp_like("text", F.lit(R.java(r.pattern))) & ~contains_any(F.col("text"), list(R.needed_texts(r.pattern)))).alias(f"m{i}") for i, r in enumerate(guarded)]).first()
    assert [told[f"m{i}"] for i in range(len(guarded))] == [0] * len(guarded)
    assert sum(told[f"n{i}"] > 0 for i in range(len(guarded))) > 40


@pytest.mark.parametrize(("pattern", "texts"), [("(?i)key.*['\"]x", ("'", '"')), ("a|b", ()), ("(?:ab)?c", ("c",)), ("(?:xy){2}z", ("xy",)), ("(?i:ab)", ()), ("[", ()), (r"(?i)\w+://", ("://",)), ("[ab]cd{0,1}", ("c",))])
def test_needed_texts(pattern, texts):
    assert set(R.needed_texts(pattern)) == set(texts)


def test_migration_plan_has_no_window_over_a_key(spark):
    found = spark.createDataFrame([(f"p{i % 3}", 1, "GITHUB_TOKEN", "ghp_" + "a1" * 18, "mortal") for i in range(9)], "path string, line_number int, rule_id string, snippet string, severity string")
    plan = remediation.migration_plan(found)
    for spec in re.findall(r"Window \[row_number.*", optimized(plan)):
        assert "], [env_key" in spec and "path#" in spec.split("], [env_key")[1].split("]")[0]
    assert sorted(r.action for r in plan.collect()) == ["migrate"] + ["skip_key_present"] * 8


@pytest.mark.parametrize(("query", "columns"), [("severity_order", {"path", "line_number", "rule_id", "severity"}), ("feedback_marks", {"path", "snippet", "rule_id", "k"})])
def test_findings_that_are_read_again_are_held(spark, sf_dir, monkeypatch, query, columns):
    seen, held = [], store.held
    monkeypatch.setattr(store, "held", lambda df: seen.append(set(df.columns)) or held(df))
    Q.queries()[query](spark, sf_dir)
    assert seen[0] == columns
