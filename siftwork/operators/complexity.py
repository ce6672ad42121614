"""Functions whose branching score is too high, from line tables or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import VENIAL
from ..functions.text import contains_any, lines_of, trimmed

LIMIT = 15
_STARTS = r"\A(?:pub fn|async fn|fn|function|def|func) "


def leading_width(line: Column) -> Column:
    """Blanks count 1 and tabs 4."""
    lead = F.regexp_extract(line, r"\A[ \t]*", 0)
    return F.length(lead) + 3 * F.regexp_count(lead, F.lit("\t"))


def is_function_start(line: Column) -> Column:
    return F.regexp_like(trimmed(line), F.lit(_STARTS))


def branch_keywords(line: Column) -> Column:
    lower = F.lower(line)
    total = (contains_any(lower, [" else if ", " elif "])).cast("int") + contains_any(lower, [" && ", " || "]).cast("int")
    for word in ("if", "for", "while", "match", "switch", "case", "catch"):
        total = total + F.regexp_like(lower, F.lit(rf"\A{word} | {word} ")).cast("int")
    return total


def function_scores(docs: DataFrame) -> DataFrame:
    """(path, line_number, snippet, context, score) of every function. Files over 1 MiB or with NUL bytes are left out.

    A function reaches to the next one's start; a keyword counts 1 and 1 more for each 4 columns that its
    line is deeper than the function's own.
    """
    small = docs.filter((F.octet_length("text") <= 1 << 20) & ~F.contains("text", F.lit("\x00")))
    lines = small.select("path", lines_of(F.col("text")).alias("lines")).select("path", F.posexplode(F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.get("lines", i - 1)).otherwise(F.lit("")).alias("prev"), F.coalesce(F.get("lines", i + 1), F.lit("")).alias("next")))).alias("i", "l")).select("path", "i", "l.*")
    by_line = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("starts", is_function_start(F.col("line"))).withColumn("f", F.sum(F.col("starts").cast("int")).over(by_line)).filter("f > 0")
    base = F.max(F.when(F.col("starts"), leading_width(F.col("line")))).over(Window.partitionBy("path", "f"))
    scored = marked.withColumn("base", base)
    width = leading_width(F.col("line"))
    deeper = F.floor(F.greatest(F.lit(0), width - F.col("base")) / 4).cast("int")
    scored = scored.withColumn("points", F.when(F.col("starts"), 0).otherwise(branch_keywords(F.col("line")) * (1 + deeper)))
    head = lambda c: F.max(F.when(F.col("starts"), c))
    return scored.groupBy("path", "f").agg(F.sum("points").cast("int").alias("score"), head(F.col("i") + 1).alias("line_number"), head(trimmed(F.col("line"))).alias("snippet"), head(F.array("prev", "line", "next")).alias("context")).drop("f")


def complexity_findings(docs: DataFrame) -> DataFrame:
    high = function_scores(docs).filter(F.col("score") > LIMIT)
    return high.select("path", "line_number", "snippet", "context", F.lit(VENIAL).alias("severity"), F.format_string(f"Function complexity score %d exceeds threshold ({LIMIT})", F.col("score")).alias("description"), F.lit("COMPLEXITY_SIN").alias("rule_id"))
