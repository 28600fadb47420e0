"""Splits by family, selection of pairs, strings of binaries, and explanations of linear models.

Null and empty families, repositories and texts are named in each docstring; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.curate import cap

SPLITS = ("train", "validation", "test")
#: From how many rows on, what validation and test (or train) aim at, and the least of each split.
REGIMES = (
    (100, {"train": 0.65, "validation": 0.15}, (20, 10, 20)),
    (50, {"validation": 10, "test": 20}, (20, 10, 20)),
    (35, {"train": 20, "validation": 5}, (20, 5, 10)),
    (0, {"train": 0.6, "validation": 0.2}, (0, 0, 0)),
)
#: Strings of binaries.
MIN_STRING, MAX_STRINGS, MAX_BINARY = 4, 4000, 8 * 1024 * 1024
LONG_STRING, HIGH_ENTROPY = 24, 4.3
#: Buckets of names, dependencies listed, features shown.
LEXICAL_BUCKETS, MAX_DEPENDENCIES, MAX_EVIDENCE, TOP_FEATURES = 64, 200, 8, 20


def _aims(total: int) -> tuple[dict[str, int], dict[str, int]]:
    aims, least = next((aims, least) for start, aims, least in REGIMES if total >= start)
    aims = {s: round(total * a) if isinstance(a, float) else a for s, a in aims.items()}
    rest = next(s for s in SPLITS if s not in aims)
    return aims | {rest: total - sum(aims.values())}, dict(zip(SPLITS, least, strict=True))


def deal(weights: list[int]) -> list[str]:
    """The split of each family, in order: the one that lacks most; then splits short of their least get the family that fits best."""
    lacking, least = _aims(sum(weights))
    held, dealt = dict.fromkeys(SPLITS, 0), []
    for weight in weights:
        dealt.append(max(SPLITS, key=lambda s: (lacking[s] - held[s], s)))
        held[dealt[-1]] += weight
    for short in SPLITS:
        while (need := least[short] - held[short]) > 0:
            movable = ((abs(need - w), w, k) for k, (w, s) in enumerate(zip(weights, dealt, strict=True)) if s != short and held[s] - w >= least[s])
            if not (best := min(movable, default=None)):
                break
            _, weight, k = best
            held[dealt[k]] -= weight
            held[short] += weight
            dealt[k] = short
    return dealt


def split_families(rows: DataFrame, by: str = "language", family: str = "family") -> DataFrame:
    """by, family, weight, split: whole families dealt to splits by hash order within each group; null and empty families get none.

    Each choice depends on all before it, so that one task deals the families of a group: a name and a count each,
    counted before the shuffle. Rows never meet there.
    """
    weights = rows.filter(F.col(family) != "").groupBy(by, family).agg(F.count("*").alias("weight"))

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return frame.assign(split=deal([int(w) for w in frame["weight"]])).drop(columns="place")

    schema = weights.withColumn("split", F.lit("")).schema
    return weights.withColumn("place", F.sha2(family, 256)).groupBy(by).applyInPandas(go, schema)


def rebalance(rows: DataFrame, weighed: Column, moved: Column, by: str = "language", family: str = "family") -> DataFrame:
    """``split`` again from the families of the weighed rows; of the moved rows, those whose family was weighed change."""
    dealt = split_families(rows.filter(weighed), by, family).select(F.col(by).alias("_by"), F.col(family).alias("_family"), F.col("split").alias("_split"))
    match = moved & F.col(by).eqNullSafe(F.col("_by")) & (F.col(family) == F.col("_family"))
    return rows.join(dealt, match, "left").withColumn("split", F.coalesce("_split", "split")).drop("_by", "_family", "_split")


def select_pairs(pairs: DataFrame, patched: Column, limits: dict[str, int], per_repository: int = 8, pair: str = "pair_id", repository: str = "repository") -> DataFrame:
    """All pairs of other origin; of patched ones, by hash order, a few of each repository of a split, up to the split's limit.

    Null repositories count as one. The limit is a top-k of each split, not a window over it.
    """
    place = F.sha2(F.col(pair).cast("string"), 256)
    few = cap(pairs.filter(patched).withColumn("_repo", F.coalesce(F.nullif(F.col(repository), F.lit("")), F.lit("unknown"))), ["split", "_repo"], [place, pair], per_repository).drop("_repo")
    chosen = [few.filter(F.col("split") == s).orderBy(place, pair).limit(n) for s, n in limits.items()]
    return reduce(DataFrame.unionByName, chosen, pairs.filter(~patched & F.col("split").isin(*limits)))


def printable_strings(raw: Column, minimum: int = MIN_STRING, limit: int = MAX_STRINGS) -> Column:
    """Runs of printable ASCII, then those of UTF-16LE, of a binary; null gives null."""
    text = F.decode(F.substring(raw, 1, MAX_BINARY), "ISO-8859-1")
    narrow = F.regexp_extract_all(text, F.lit(rf"[\x20-\x7e]{{{minimum},}}"), 0)
    wide = F.regexp_extract_all(text, F.lit(rf"(?:[\x20-\x7e]\x00){{{minimum},}}"), 0)
    return F.slice(F.concat(narrow, F.transform(wide, lambda x: F.replace(x, F.lit("\0"), F.lit("")))), 1, limit)


def string_entropy(value: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    n = F.length(value)
    shares = F.transform(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def dense_strings(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """key, strings, snippet: how many long strings of high entropy a binary holds, and the first; binaries without any give no row."""
    dense = F.filter(printable_strings(F.col(raw)), lambda x: (F.length(x) >= LONG_STRING) & (string_entropy(x) >= HIGH_ENTROPY))
    found = docs.select(key, dense.alias("dense")).filter(F.size("dense") > 0)
    return found.select(key, F.size("dense").alias("strings"), F.substring(F.get("dense", F.lit(0)), 1, 240).alias("snippet"))


def build_dependencies(files: DataFrame, by: str, path: str = "path", text: str = "text") -> DataFrame:
    """by, dependencies: the distinct group:artifact names of build files, sorted, the first 200."""
    name = F.element_at(F.split(path, "/"), -1)
    pom = r"(?s)<dependency>.*?<groupId>\s*([^<]+)</groupId>.*?<artifactId>\s*([^<]+)</artifactId>.*?</dependency>"
    gradle = r"""['"]([\w.-]+):([\w.-]+):[^'"]+['"]"""
    found = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), 0), lambda x: F.concat_ws(":", F.trim(F.regexp_extract(x, p, 1)), F.trim(F.regexp_extract(x, p, 2))))
    names = F.when(name == "pom.xml", found(pom)).when(name.isin("build.gradle", "build.gradle.kts"), found(gradle))
    rows = files.select(by, F.explode(names).alias("dependency")).distinct()
    return cap(rows, [by], ["dependency"], MAX_DEPENDENCIES).groupBy(by).agg(F.sort_array(F.collect_list("dependency")).alias("dependencies"))


def lexical_bucket(name: Column, buckets: int = LEXICAL_BUCKETS) -> Column:
    """The bucket of a name by hash; null for a null or blank one."""
    value = F.lower(F.trim(name))
    return F.when(value != "", F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def bounded_entropy(value: Column) -> Column:
    """Eighths of an entropy, within 0 and 1; what is no number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)) / 8, F.lit(0.0))))


def feature_evidence(text: Column, features: list[str], limit: int = MAX_EVIDENCE) -> Column:
    """Of ranked features, the first that stand in a text as whole tokens, whatever their case; null text has none."""
    kept = [f for f in (f.strip().lower() for f in features) if len(f) >= 2]
    quoted = lambda f: "\\Q" + f.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    hits = [F.when(F.lower(text).contains(f) & F.lower(text).rlike(rf"(?<![A-Za-z0-9_$]){quoted(f)}(?![A-Za-z0-9_$])"), F.lit(f)) for f in kept]
    return F.slice(F.array_compact(F.array(*hits)), 1, limit) if hits else F.array().cast("array<string>")


def top_features(coefficients: DataFrame, seq: str, feature: str, weight: str, sign: int = 1, limit: int = TOP_FEATURES) -> DataFrame:
    """side, rank, feature, weight: word features of the largest and the smallest weights; ties by ``seq``, downwards for the smallest."""
    words = coefficients.filter(F.col(feature).startswith("word__")).select(F.col(seq).alias("seq"), F.substring(feature, 7, 2**31 - 1).alias("feature"), (sign * F.col(weight)).alias("weight"))
    sides = {"positive": (F.col("weight").desc(), F.col("seq")), "negative": (F.col("weight"), F.col("seq").desc())}

    def best(side: str) -> DataFrame:
        order = sides[side]
        few = words.orderBy(*order).limit(limit).withColumn("side", F.lit(side))
        rank = F.row_number().over(Window.partitionBy("side").orderBy(*order))
        return few.select("side", rank.alias("rank"), "feature", F.round("weight", 5).alias("weight"))

    return best("positive").unionByName(best("negative"))


def ranking_loss(rows: DataFrame, seq: str, pair: str, positive: Column, score: str, margin: float = 1.0) -> DataFrame:
    """pairs, loss: mean of softplus(margin - gap) over pairs with both sides; the last row of a side counts. No pair: 0."""
    last = lambda side: F.max_by(F.when(side, F.col(score)), F.when(side, F.col(seq)))
    gaps = rows.filter(F.col(pair) != "").groupBy(pair).agg(last(positive).alias("up"), last(~positive).alias("down")).filter("up IS NOT NULL AND down IS NOT NULL")
    x = F.lit(float(margin)) - (F.col("up") - F.col("down"))
    softplus = F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))
    return gaps.agg(F.count("*").alias("pairs"), F.coalesce(F.avg(softplus), F.lit(0.0)).alias("loss"))


def attribution_summary(items: DataFrame, by: str, line: str = "line", basis: str = "basis") -> DataFrame:
    """by, attributed, corroborated, generated: distinct lines that a model explains, and those that a rule confirms; rows without a basis are no explanation."""
    explained = F.col(basis).isNotNull()
    return items.groupBy(by).agg(
        F.countDistinct(F.when(explained, F.col(line))).alias("attributed"), F.countDistinct(F.when(F.col(basis) == "ai_and_rule", F.col(line))).alias("corroborated"),
        F.coalesce(F.bool_or(explained), F.lit(False)).alias("generated"),
    )
