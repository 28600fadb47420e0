"""Labelled code samples from JSON lines and CSV, under one fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import clamp01, or_default

TEXT = (
    "code", "normalized_code", "label", "category", "language", "cwe", "source", "package_name", "version", "license", "sample_hash", "family", "published_at", "split", "artifact_sha256",
    "source_url", "file_path", "paired_version", "label_basis", "review_status", "parent_sample_hash", "pair_id", "pair_slot", "review_notes",
)
LISTS = ("behavior_labels", "cwe_labels", "label_scopes")
LINE_LABEL = T.StructType([
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("label", "risk_type", "cwe", "source")], T.StructField("confidence", T.DoubleType()),
])
#: What files hold; numbers and lists come as text too. Column names match in any case (cwe, CWE).
RAW = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (*TEXT, "package", "project", "release_date", "label_confidence")],
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in LISTS], T.StructField("line_labels", T.ArrayType(LINE_LABEL)),
])
CSV = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW.fields if f.name != "line_labels"])
LABELS = ("benign", "vulnerable", "malicious")


def _first(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns], F.lit(""))


def label_of(label: Column, category: Column) -> Column:
    """The label, or one read from the category; markers of malice come before those of weakness."""
    x, c = F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lower(F.coalesce(category, F.lit("")))
    return F.when(x.isin(*LABELS), x).when(c.rlike("malic|malware|backdoor|webshell|trojan"), "malicious").when(c.rlike("vuln|cwe|injection|xss"), "vulnerable").when(c.rlike("benign|safe|clean"), "benign")


def coerce(raw: DataFrame) -> DataFrame:
    """The sample schema; rows without code or with no label are dropped."""
    df = raw.withColumn("code", F.regexp_replace(F.coalesce("code", F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).filter("code <> ''")
    df = df.withColumn("label", label_of(F.col("label"), F.col("category"))).filter("label IS NOT NULL")
    lists = {c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") for c in LISTS}
    cwe = _first("cwe")
    lines = F.filter(F.coalesce(F.col("line_labels"), F.lit(None).cast(T.ArrayType(LINE_LABEL))), lambda x: (x["start_line"] >= 1) & (x["end_line"] >= x["start_line"]))
    out = {c: or_default(c) for c in TEXT if c not in ("code", "label")}
    out |= {
        "category": or_default("category", "unknown"), "language": or_default("language", "unknown"), "source": or_default("source", "sample_dataset"), "cwe": cwe, "review_status": or_default("review_status", "unreviewed"),
        "package_name": _first("package_name", "package"), "family": _first("family", "project", "package_name", "package"), "published_at": _first("published_at", "release_date"), "pair_slot": _first("pair_slot", "version"),
        "normalized_code": F.coalesce(F.nullif("normalized_code", F.lit("")), "code"), "sample_hash": F.coalesce(F.nullif("sample_hash", F.lit("")), F.sha2("code", 256)), "label_confidence": clamp01(F.col("label_confidence")),
        **lists, "line_labels": lines,
    }
    out["cwe_labels"] = F.when(F.size(lists["cwe_labels"]) > 0, lists["cwe_labels"]).when(cwe != "", F.array(cwe)).otherwise(lists["cwe_labels"])
    return df.select("code", "label", *[v.alias(k) for k, v in out.items()])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return coerce(spark.read.schema(RAW).json(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    header = [c for c in spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns]
    schema = T.StructType([T.StructField(c.lstrip("\ufeff"), T.StringType()) for c in header])
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    for f in CSV.fields:
        if f.name not in raw.columns:
            raw = raw.withColumn(f.name, F.lit(None).cast("string"))
    for c in LISTS:
        raw = raw.withColumn(c, F.split(F.col(c), ","))
    return coerce(raw.withColumn("line_labels", F.lit(None).cast(T.ArrayType(LINE_LABEL))))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending: CSV, else JSON lines."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_json_lines(spark, path)


def write_splits(samples: DataFrame, path: str) -> None:
    """JSON lines, a folder for each split."""
    samples.write.mode("overwrite").partitionBy("split").json(path)
