"""Reports: every finding becomes a line or a block by Column expressions, and small documents are put together on the driver.

``write_report`` leaves the lines where they are and writes them in parallel; ``render`` is for results that fit a screen
or a file of one machine, and streams over them one partition at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.redact import masked_snippet, redact_line
from ..functions.text import escape_markup
from ..operators.remediation import suggested_line

NAME = "Siftwork"
FORMATS = {"terminal": "terminal", "term": "terminal", "tty": "terminal", "json": "json", "csv": "csv", "junit": "junit", "xml": "junit", "sarif": "sarif", "markdown": "markdown", "md": "markdown", "html": "html", "report": "report"}
CSV_HEADER = "Path,Line,Severity,Rule,Description,Snippet"
JSON_FIELDS = "path line_number snippet severity description rule_id commit_hash verified confidence confidence_factors confidence_level verification_detail".split()
_RED, _YELLOW, _GREEN, _OFF = "\x1b[1;31m", "\x1b[1;33m", "\x1b[1;32m", "\x1b[0m"


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line_number", "rule_id")


def by_severity(findings: DataFrame) -> DataFrame:
    """Mortal findings first, then by path and line."""
    return findings.orderBy((F.col("severity") != "mortal").cast("int"), "path", "line_number", "rule_id")


def transport_rows(findings: DataFrame) -> DataFrame:
    """The six fields that workers send each other; the severity begins with a capital."""
    return findings.select("path", "line_number", "snippet", F.initcap("severity").alias("severity"), "description", "rule_id")


def redacted(findings: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings whose snippets are masked, those of custom rules too."""
    masked = masked_snippet(config.redact_visible_chars, config.redact_secrets, config.custom)
    return findings.withColumn("snippet", masked)


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: mortal, venial."""
    return findings.agg(F.count_if(F.col("severity") == "mortal").alias("mortal"), F.count_if(F.col("severity") == "venial").alias("venial"))


def file_report(findings: DataFrame) -> DataFrame:
    """(path, mortal, venial, findings): one row a file, its findings by line. One shuffle, with partial aggregation."""
    entry = F.struct("line_number", "rule_id", "severity")
    return findings.groupBy("path").agg(F.count_if(F.col("severity") == "mortal").alias("mortal"), F.count_if(F.col("severity") == "venial").alias("venial"), F.sort_array(F.collect_list(entry)).alias("findings"))


def exit_code(findings: DataFrame) -> int:
    """1 if there is a mortal finding. Stops at the first."""
    return 0 if findings.filter("severity = 'mortal'").isEmpty() else 1


def _percent(confidence: Column) -> Column:
    return F.format_string("%.0f%%", (confidence * 100).cast("double"))


def is_honeytoken(marker: str) -> Column:
    return F.contains("description", F.lit("honeytoken")) | F.contains("snippet", F.lit(f"{marker}:honeytoken")) | F.contains("rule_id", F.lit("HONEYTOKEN"))


def json_rows(findings: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings with ``report``: the finding as a JSON object without nulls."""
    return redacted(findings, config).withColumn("report", F.to_json(F.struct(*JSON_FIELDS)))


def csv_field(value: Column) -> Column:
    return F.when(F.regexp_like(value, F.lit("[\",\r\n]")), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_rows(findings: DataFrame, config: Config = Config()) -> DataFrame:
    fields = ["path", F.col("line_number").cast("string"), F.initcap("severity"), "rule_id", "description", "snippet"]
    return redacted(findings, config).withColumn("report", F.concat_ws(",", *[csv_field(F.col(f) if isinstance(f, str) else f) for f in fields]))


def junit_rows(findings: DataFrame, config: Config = Config()) -> DataFrame:
    """A test case for each finding; mortal ones fail."""
    token = is_honeytoken(config.marker)
    factors = F.when(F.size("confidence_factors") > 0, F.concat(F.lit("\nFactors: "), F.array_join("confidence_factors", ", ")))
    body = F.concat_ws("", F.format_string("Line %d: %s", "line_number", escape_markup(F.col("snippet"))), F.concat(F.lit("\nConfidence: "), _percent(F.col("confidence"))), factors, F.concat(F.lit("\nVerified: "), F.col("verified").cast("string")), F.when(token, F.lit("\nHoneytoken: true")))
    failure = F.format_string('    <failure message="%s">%s</failure>\n', escape_markup(F.col("description")), body)
    notes = F.concat_ws("; ", F.concat(F.lit("Confidence: "), _percent(F.col("confidence"))), F.when(token, F.lit("Honeytoken: true")))
    told = F.when(notes != "", F.format_string("    <system-out>%s</system-out>\n", escape_markup(notes))).otherwise("")
    case = F.format_string('  <testcase name="%s" classname="%s">\n%s  </testcase>', "rule_id", escape_markup(F.col("path")), F.when(F.col("severity") == "mortal", failure).otherwise(told))
    return redacted(findings, config).withColumn("report", case)


def sarif_rows(findings: DataFrame, config: Config = Config()) -> DataFrame:
    """A result object of SARIF 2.1.0 for each finding."""
    region = F.struct(F.col("line_number").alias("startLine"), F.struct(F.col("snippet").alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    told = F.struct(
        F.when(F.col("confidence").isNotNull(), _percent(F.col("confidence"))).alias("confidence"), F.col("confidence").alias("confidenceScore"), F.when(F.size("confidence_factors") > 0, F.col("confidence_factors")).alias("confidenceFactors"),
        "verified", F.when(is_honeytoken(config.marker), F.lit(True)).alias("honeytoken"),
    )
    any_told = F.col("confidence").isNotNull() | (F.size("confidence_factors") > 0) | F.col("verified").isNotNull() | is_honeytoken(config.marker)
    result = F.struct(F.col("rule_id").alias("ruleId"), F.when(F.col("severity") == "mortal", "error").otherwise("warning").alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"), F.when(any_told, told).alias("properties"))
    return redacted(findings, config).withColumn("report", F.to_json(result))


def markdown_rows(findings: DataFrame, config: Config = Config(), ci: bool = False) -> DataFrame:
    """A row of the table; with ``ci`` in plain ASCII."""
    mortal, venial = ("[MORTAL]", "[VENIAL]") if ci else ("🔴 Mortal", "🟡 Venial")
    badge = F.when(F.col("severity") == "mortal", mortal).otherwise(venial)
    return findings.withColumn("report", F.format_string("| %s | `%s` | %d | %s | %s |", badge, "path", "line_number", "rule_id", "description"))


def html_rows(findings: DataFrame, config: Config = Config()) -> DataFrame:
    level = F.initcap("severity")
    cells = [F.format_string('<span class="badge badge-%s">%s</span>', "severity", level), F.format_string("<code>%s</code>", escape_markup(F.col("path"))), F.col("line_number").cast("string"), F.col("rule_id"), escape_markup(F.col("description"))]
    return findings.withColumn("report", F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>")))


def terminal_rows(findings: DataFrame, config: Config = Config(), colour: bool = True) -> DataFrame:
    """A block for each finding: line, severity, score, commit, and the redacted context."""
    paint = (lambda code, c: F.concat(F.lit(code), c, F.lit(_OFF))) if colour else (lambda code, c: c)
    mask = lambda c: redact_line(c, F.col("rule_id"), config.redact_visible_chars, config.redact_secrets, extra=list(config.custom))
    shown = lambda at, d: F.when(F.element_at("context", at) != "", F.format_string("    %d │ %s\n", F.col("line_number") + d, mask(F.element_at("context", at))))
    level = F.when(F.col("severity") == "mortal", paint(_RED, F.lit("MORTAL"))).otherwise(paint(_YELLOW, F.lit("VENIAL")))
    score = F.when(F.col("confidence").isNotNull(), F.format_string(" [ML: %.2f]", F.col("confidence").cast("double"))).otherwise("")
    block = F.concat_ws(
        "", F.format_string("  [LINE %d] %s - %s%s\n", "line_number", level, "description", score), F.when(F.col("commit_hash").isNotNull(), F.format_string("  Commit: %s (in history)\n", "commit_hash")),
        F.when(F.size("context") >= 3, F.concat_ws("", shown(1, -1), F.format_string("    %d │ %s\n", "line_number", mask(F.element_at("context", 2))), shown(3, 1))),
        F.format_string("  → False positive? Mark %s, line %d\n", "path", "line_number"),
    )
    return findings.withColumn("report", block)


def before_after(findings: DataFrame, config: Config = Config()) -> DataFrame:
    """(path, before, after): for each file the redacted snippets and their replacements, by line."""
    pair = F.struct("line_number", "rule_id", masked_snippet(config.redact_visible_chars, config.redact_secrets).alias("before"), suggested_line(F.col("snippet"), F.col("rule_id")).alias("after"))
    files = findings.groupBy("path").agg(F.sort_array(F.collect_list(pair)).alias("s"))
    return files.select("path", F.col("s.before").alias("before"), F.col("s.after").alias("after"))


def diagnostics(findings: DataFrame, source: str = "siftwork") -> DataFrame:
    """(path, line, severity, code, source, message) as an editor shows them; lines count from 0, severity 1 is an error and 2 a warning."""
    sure = F.when(F.col("confidence").isNotNull(), F.concat(F.lit(" (confidence: "), _percent(F.col("confidence")), F.lit(")"))).otherwise("")
    level = F.when(F.col("confidence_level").isNotNull(), F.format_string(" [%s]", "confidence_level")).otherwise("")
    return findings.select(
        "path", (F.greatest(F.col("line_number"), F.lit(1)) - 1).alias("line"), F.when(F.col("severity") == "mortal", 1).otherwise(2).alias("severity"), F.col("rule_id").alias("code"), F.lit(source).alias("source"),
        F.concat(F.format_string("[%s] %s", "rule_id", "description"), sure, level).alias("message"),
    )


ROWS = {"json": json_rows, "csv": csv_rows, "junit": junit_rows, "sarif": sarif_rows, "markdown": markdown_rows, "html": html_rows, "terminal": terminal_rows}


def write_report(findings: DataFrame, path: str, kind: str, config: Config = Config()) -> None:
    """The lines of a report, without head and foot, as text files written in parallel; for any number of findings."""
    ROWS[FORMATS[kind]](findings, config).select("report").write.mode("overwrite").text(path)


_STYLE = "body{font-family:sans-serif;margin:2rem}table{border-collapse:collapse;width:100%}td,th{padding:.6rem;border-top:1px solid #999;text-align:left}.badge-mortal{color:#b00020}.badge-venial{color:#a06000}.before{background:#fdd}.after{background:#dfd}pre{padding:.6rem;white-space:pre-wrap}"


def _lines(rows: DataFrame) -> Iterator[str]:
    return (r[0] for r in ordered(rows).select("report").toLocalIterator())


def _page(title: str, body: str) -> str:
    return f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>{title}</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n<h1>{title}</h1>\n{body}</body>\n</html>\n'


def render(findings: DataFrame, kind: str = "terminal", config: Config = Config(), ci: bool = False) -> str:
    """The whole report as a string, findings by path and line."""
    kind = FORMATS[kind.lower()]
    mortal, venial = severity_counts(findings).first()
    if kind == "json":
        return json.dumps({"sins": [json.loads(x) for x in _lines(json_rows(findings, config))], "summary": {"mortal": mortal, "venial": venial}}, indent=2, ensure_ascii=False)
    if kind == "csv":
        return "\n".join([CSV_HEADER, *_lines(csv_rows(findings, config))]) + "\n"
    if kind == "junit":
        head = f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="{NAME.lower()}" tests="{mortal + venial}" failures="{mortal}" errors="0">'
        return "\n".join([head, *_lines(junit_rows(findings, config)), "</testsuite>"]) + "\n"
    if kind == "sarif":
        run = {"tool": {"driver": {"name": NAME.lower(), "version": "1"}}, "results": [json.loads(x) for x in _lines(sarif_rows(findings, config))]}
        return json.dumps({"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)
    if kind == "markdown":
        out = [f"# {NAME} Security Report", "", f"**Summary:** {mortal} Mortal, {venial} Venial sins found", ""]
        if not mortal + venial:
            return "\n".join([*out, "No security issues found."]) + "\n"
        return "\n".join([*out, "| Severity | File | Line | Rule | Description |", "|----------|------|------|------|-------------|", *_lines(markdown_rows(findings, config, ci))]) + "\n"
    if kind == "html":
        told = f"<p>{mortal} Mortal Sins | {venial} Venial Sins</p>\n"
        if not mortal + venial:
            return _page(f"{NAME} Security Report", told + "<p>No security issues found.</p>\n")
        heads = "".join(f"<th>{x}</th>" for x in ("Severity", "File", "Line", "Rule", "Description"))
        return _page(f"{NAME} Security Report", told + f"<table>\n<tr>{heads}</tr>\n" + "".join(x + "\n" for x in _lines(html_rows(findings, config))) + "</table>\n")
    if kind == "report":
        told = f"<p>{mortal + venial} sins found</p>\n" if mortal + venial else "<p>Clean – Zero hardcoded secrets</p>\n"
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
        for path, before, after in before_after(findings, config).orderBy("path").toLocalIterator():
            told += f'<h2>{esc(path)}</h2>\n<pre class="before">{esc(chr(10).join(before))}</pre>\n<pre class="after">{esc(chr(10).join(after))}</pre>\n'
        return _page(f"{NAME}: before and after", told)
    if not mortal + venial:
        return f"{_GREEN}No sins found.{_OFF}\n"
    out, last = [], None
    for path, block in ordered(terminal_rows(findings, config)).select("path", "report").toLocalIterator():
        if path != last:
            out.append(f"\n▸ {path}")
            last = path
        out.append(block)
    count = [f"{n} {name} Sin{'' if n == 1 else 's'}" for n, name in ((mortal, "Mortal"), (venial, "Venial")) if n]
    return "\n".join([*out, f"{_RED}VERDICT: {', '.join(count)} condemned.{_OFF}"]) + "\n"
