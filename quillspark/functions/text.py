"""Scalar functions over source code and text, as columns.

Two line models are in use: rules see any line break, indicators count line feeds alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every line break that rules split at.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_default(c: str | Column, default: str = "") -> Column:
    """The trimmed text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(default))


def normalize_code(c: str | Column) -> Column:
    """One kind of line end, no trailing blanks, at most one empty line in a row, trimmed."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t\x0B\x0C\r]+(?=\n|$)", "")
    x = F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


def conflict_key(c: str | Column) -> Column:
    """Case folded, white space collapsed: texts that differ in nothing else conflict if labels do."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\x20\x09-\x0D]+", " ")))


def split_lines(c: str | Column) -> Column:
    """Lines at any break, without the empty one behind a last break."""
    lines = F.split(col(c), LINE_BREAK, -1)
    return F.when(F.length(col(c)) == 0, F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    )


def line_of(text: Column, offset: Column) -> Column:
    """Number of the line that holds a 0-based offset, counting line feeds."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def snippet(line: Column, limit: int = 180) -> Column:
    return F.substring(F.trim(line), 1, limit)


def preview(c: str | Column, limit: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the key's SHA-256, modulo the number of buckets."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets


def hash_split(group: Column, test: int = 20, validation: int = 35) -> Column:
    """test, validation or train by the group's bucket: a group never falls into two splits."""
    b = hash_bucket(group)
    return F.when(b < test, "test").when(b < validation, "validation").otherwise("train")


def ordered_unique(c: str | Column) -> Column:
    return F.array_distinct(col(c))


def package_name(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(col(c)), r"[-_.]+", "-"))


def symbol(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9_]", "")


def cwe_list(c: str | Column) -> Column:
    """The distinct CWE identifiers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(r"(?i)CWE-[0-9]+"), F.lit(0)), lambda x: F.upper(x))))


def stem(path: str | Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(col(path), r"[/\\]"), -1), r"^(.+?)(\.[^.]*)?$", 1)


def suffix(path: str | Column) -> Column:
    """The last extension with its dot, in lower case; none for dot files."""
    return F.lower(F.regexp_extract(F.element_at(F.split(col(path), r"[/\\]"), -1), r"[^.](\.[^.]*)$", 1))


def safe_name(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_")


def head_and_tail(c: str | Column, limit: int, marker: str = "\n... truncated ...\n") -> Column:
    """Texts over ``limit`` characters keep their first and last halves."""
    half = limit // 2
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, half), F.lit(marker), F.right(col(c), F.lit(half)))).otherwise(col(c))


def clamp01(c: Column) -> Column:
    """A number between 0 and 1; what is no number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def add_entropy(df: DataFrame, text: str, name: str = "entropy") -> DataFrame:
    """Add the Shannon entropy in bits of a text's characters, to three places (0 for an empty one).

    From the sorted characters: a run's share comes from the places where runs end.
    """
    df = df.withColumn("_c", F.sort_array(F.split(text, "")))
    df = df.withColumn("_e", F.expr("filter(sequence(1, size(_c)), i -> i = size(_c) OR get(_c, i) <> get(_c, i - 1))"))
    df = df.withColumn("_n", F.expr("transform(_e, (e, k) -> (e - coalesce(get(_e, k - 1), 0)) / size(_c))"))
    total = F.expr("aggregate(_n, 0D, (a, x) -> a - x * log2(x))")
    return df.withColumn(name, F.when(F.length(text) > 0, F.round(total, 3)).otherwise(F.lit(0.0))).drop("_c", "_e", "_n")


def risk_level(score: Column) -> Column:
    """Bands of a risk score."""
    return F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 35, "medium").when(score > 0, "low").otherwise("safe")


def model_risk(decision: Column, p: Column, threshold: Column) -> Column:
    """0 to 100: a malicious verdict has at least 35, a benign one at most 34 (half to even)."""
    bad = F.least(F.lit(100), F.greatest(F.lit(35), F.bround(p * 100).cast("int")))
    good = F.least(F.lit(34), F.bround(p / F.greatest(threshold, F.lit(0.0001)) * 34).cast("int"))
    return F.when(decision == "malicious", bad).otherwise(good)
