"""Findings written as reports. Projections are columns; Spark writes the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakflow.functions.masking import mask_first4

#: Columns of the CSV report, in order.
CSV_COLUMNS = ["RuleID", "Commit", "File", "SymlinkFile", "Secret", "Match", "StartLine", "EndLine", "StartColumn", "EndColumn", "Author", "Message", "Date", "Email", "Fingerprint", "Tags"]
_SOURCE = {"RuleID": "rule_id", "Commit": "commit", "File": "path", "SymlinkFile": "symlink", "Secret": "secret", "Match": "match", "StartLine": "start_line", "EndLine": "end_line", "StartColumn": "start_column", "EndColumn": "end_column", "Author": "author_name", "Message": "message", "Date": "date", "Email": "author_email", "Fingerprint": "fingerprint"}


def csv_projection(findings: DataFrame) -> DataFrame:
    """The CSV report's columns as text; what a finding lacks is empty."""
    have = findings.columns
    cols = [F.coalesce(F.col(_SOURCE[c]).cast("string"), F.lit("")).alias(c) if _SOURCE.get(c) in have else (F.array_join("tags", " ") if c == "Tags" and "tags" in have else F.lit("")).alias(c) for c in CSV_COLUMNS]
    return findings.select(*cols)


def write_csv(findings: DataFrame, path: str) -> None:
    csv_projection(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_projection(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding."""
    named = csv_projection(findings)
    numbers = [F.col(c).cast("long").alias(c) if c in ("StartLine", "EndLine", "StartColumn", "EndColumn") else F.col(c) for c in named.columns]
    return named.select(F.to_json(F.struct(*numbers)).alias("value"))


def write_json(findings: DataFrame, path: str) -> None:
    json_projection(findings).write.mode("overwrite").text(path)


def sarif_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that have findings."""
    return rules.join(findings.select("rule_id").distinct(), "rule_id", "left_semi")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result, as JSON, for each finding."""
    message = F.concat("rule_id", F.lit(" has detected secret for file "), "path", F.lit("."))
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"), F.struct(mask_first4(F.col("secret")).alias("text")).alias("snippet"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.struct(message.alias("text")).alias("message"), F.col("rule_id").alias("ruleId"), place.alias("locations"))).alias("value"))


def junit_cases(findings: DataFrame) -> DataFrame:
    """One test case element for each finding."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    message = F.concat(F.col("rule_id"), F.lit(" has detected a secret in file "), F.col("path"), F.lit(", line "), F.col("start_line").cast("string"), F.lit("."))
    return findings.select(F.concat(F.lit('<testcase classname="'), text(F.col("rule_id")), F.lit('" file="'), text(F.col("path")), F.lit('"><failure message="'), text(message), F.lit('"/></testcase>')).alias("value"))


def human_lines(findings: DataFrame) -> DataFrame:
    """``path:line [rule] masked fingerprint``."""
    return findings.select(F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit(" ["), F.col("rule_id"), F.lit("] "), mask_first4(F.col("secret")), F.lit(" "), F.col("fingerprint")).alias("value"))


def strip_controls(text: Column) -> Column:
    """Without terminal escapes and control characters."""
    plain = F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b.", "")
    return F.regexp_replace(plain, r"[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}]", "")
