"""Verdicts on admission reviews: a resource with a mortal finding is denied."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import Config
from .detect import scan


@F.pandas_udf(StringType())
def pretty_json(objects: pd.Series) -> pd.Series:
    """Canonical layout, which decides line numbers: sorted keys, two blanks of indent. Null for what isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return objects.map(one)


def verdicts(reviews: DataFrame, config: Config = Config(), who: str = "Scan") -> DataFrame:
    """(uid, allowed, code, message) of reviews (uid, object): object is the resource as JSON.

    A null object is a review without a request: code 400, not allowed. What can't be read is allowed.
    """
    texts = reviews.select(F.col("uid").alias("path"), pretty_json("object").alias("text"))
    found = scan(texts.filter(F.col("text").isNotNull()), config).filter("severity = 'mortal'")
    told = F.transform(F.sort_array(F.collect_list(F.struct("line_number", "rule_id", "description"))), lambda s: F.format_string("%s (line %d): %s", s["rule_id"], s["line_number"], s["description"]))
    bad = found.groupBy(F.col("path").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.array_join(told, "; ").alias("told"))
    joined = reviews.select("uid", F.col("object").isNull().alias("missing")).join(bad, "uid", "left")
    return joined.select(
        "uid", (~F.col("missing") & F.col("n").isNull()).alias("allowed"), F.when(F.col("missing"), 400).when(F.col("n").isNotNull(), 403).alias("code"),
        F.when(F.col("missing"), "Missing request in AdmissionReview").when(F.col("n").isNotNull(), F.format_string(f"{who} blocked this resource: %d secret(s) detected in manifest. %s", F.col("n"), F.col("told"))).alias("message"),
    )


def response_json(rows: DataFrame) -> DataFrame:
    """(uid, review): the verdicts as AdmissionReview replies."""
    status = F.when(F.col("code").isNotNull(), F.struct("code", "message"))
    reply = F.struct(F.lit("admission.k8s.io/v1").alias("apiVersion"), F.lit("AdmissionReview").alias("kind"), F.struct("uid", "allowed", status.alias("status")).alias("response"))
    return rows.select("uid", F.to_json(reply).alias("review"))
