"""Uploaded payloads: which are text, what they say, and the test cases that analysis reports describe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes looked at, share of odd control bytes that text may have, path of a case without one.
SAMPLE_BYTES, MAX_CONTROLS = 64 * 1024, 0.02
DEFAULT_URI = "src/sample.php"
REPORT = (
    "runs array<struct<properties: struct<state: string, description: string, id: string, version: string, submissionDate: string>,"
    " results: array<struct<ruleId: string>>, artifacts: array<struct<location: struct<uri: string>>>>>"
)


def is_text(raw: Column) -> Column:
    """Whether a payload is text: empty, with a UTF-16 mark, or without NUL and nearly without control bytes. Null gives null."""
    head = F.decode(F.substring(raw, 1, SAMPLE_BYTES), "ISO-8859-1")
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x07\x0b\x0e-\x1a\x1c-\x1f]", ""))
    return head.rlike(r"\A(?:\xff\xfe|\xfe\xff)") | (~head.contains("\0") & (odd <= MAX_CONTROLS * F.length(head)))


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Text of payloads by their mark (what is malformed is replaced), else as UTF-8 (what is malformed is left out). Null gives null."""

    def text(payload: bytes | None) -> str | None:
        if payload is None:
            return None
        if payload.startswith(b"\xef\xbb\xbf"):
            return payload.decode("utf-8-sig", "replace")
        if payload.startswith((b"\xff\xfe", b"\xfe\xff")):
            return payload.decode("utf-16", "replace")
        return payload.decode("utf-8", "ignore")

    return raw.map(text)


def read_reports(manifests: DataFrame, files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """case_id, path, text, label, cwe, category, version, published_at: the source file that each report's first run names.

    Reports that are no JSON, and those whose file is absent, null or empty, give no row.
    """
    run = F.get(F.from_json(text, REPORT)["runs"], F.lit(0))
    rows = manifests.select(F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1).alias("root"), F.explode(F.array(run)).alias("run")).filter("run IS NOT NULL")
    about = F.col("run.properties")
    uri = F.coalesce(F.get("run.artifacts", F.lit(0))["location"]["uri"], F.lit(DEFAULT_URI))
    cwe = F.coalesce(F.get("run.results", F.lit(0))["ruleId"], F.lit(""))
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    xss = F.coalesce(F.lower(about["description"]).contains("xss"), F.lit(False)) | (cwe == "CWE-79")
    cases = rows.select(
        filled(about["id"], F.element_at(F.split("root", "/"), -1)).alias("case_id"), F.concat_ws("/", F.nullif(F.col("root"), F.lit("")), uri).alias("path"),
        F.when(F.lower(about["state"]) == "bad", "vulnerable").otherwise("benign").alias("label"), cwe.alias("cwe"), F.when(xss, "XSS").otherwise(filled(cwe, F.lit("NIST SARD"))).alias("category"),
        filled(about["version"], F.lit("1.0.0")).alias("version"), F.coalesce(about["submissionDate"], F.lit("")).alias("published_at"),
    )
    sources = files.filter(F.col(text) != "").select(F.col(path).alias("path"), F.col(text).alias("text"))
    return cases.join(sources, "path").select("case_id", "path", "text", "label", "cwe", "category", "version", "published_at")
