"""Variants of a sample that change its looks and not its meaning, to test robustness."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Words that are never renamed.
KEPT = frozenset({"if", "else", "for", "while", "return", "class", "def", "function", "new", "public", "private", "true", "false", "null", "none", "import", "from"})
LITERAL = re.compile(r"(?P<q>['\"])(?P<v>[^'\"\n]{8,})(?P=q)")
DEAD = {"python": "if False:\n    marker = 'unused'\n", "php": "<?php if (false) { $marker = 'unused'; } ?>\n"}


def rename(code: str) -> str:
    """The first four names become v_00 .. v_03."""
    names = list(dict.fromkeys(n for n in re.findall(r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b", code) if n.lower() not in KEPT))[:4]
    for k, name in enumerate(names):
        code = re.sub(rf"\b{name}\b", f"v_{k:02d}", code)
    return code


def split_literal(code: str, language: str) -> str:
    plus = " . " if language == "php" else " + "

    def halves(m: re.Match) -> str:
        q, v = m["q"], m["v"]
        return plus.join(q + part + q for part in (v[: len(v) // 2], v[len(v) // 2 :]))

    return LITERAL.sub(halves, code, count=1)


def encode_literal(code: str, language: str) -> str:
    wrap = {"php": "base64_decode('{}')", "python": "__import__('base64').b64decode('{}').decode()", "javascript": "atob('{}')", "typescript": "atob('{}')"}.get(language)
    return code if wrap is None else LITERAL.sub(lambda m: wrap.format(base64.b64encode(m["v"].encode()).decode()), code, count=1)


def dead_code(code: str, language: str) -> str:
    return DEAD.get(language, "if (false) { const marker = 'unused'; }\n") + code


def variants(code: str, language: str) -> list[tuple[str, str]]:
    """(kind, code) of each variant that differs from the code."""
    made = (("rename", rename(code)), ("split", split_literal(code, language)), ("encode", encode_literal(code, language)), ("dead_code", dead_code(code, language)))
    return [(k, v) for k, v in made if v != code]


_KIND = ArrayType(StructType([StructField("kind", StringType()), StructField("code", StringType())]))


def suite(samples: DataFrame, seq: str, code: str, language: str, limit: int = 300) -> DataFrame:
    """seq, kind, code, parent (SHA-256): at most ``limit`` variants in order; each inherits its sample's row number."""

    @F.pandas_udf(_KIND)
    def make(codes: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "code": v} for k, v in variants(c or "", x or "")] for c, x in zip(codes, languages, strict=True)])

    rows = samples.select(seq, F.sha2(code, 256).alias("parent"), F.posexplode(make(code, language)).alias("k", "v"))
    first = rows.orderBy(seq, "k").limit(limit)
    return first.select(seq, "v.kind", "v.code", "parent")


def balanced(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_r") <= n).drop("_r")
