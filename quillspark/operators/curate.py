"""Corpus curation: duplicates, conflicts, splits, caps, pairs, joins by uniqueness, budgets.

``seq`` columns stand for input order wherever an operator keeps the first of several rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.lineage import ensure_folder
from quillspark.functions.text import hash_split
from quillspark.operators import neardup

#: Review states that allow training, and the least label confidence.
TRAINABLE_REVIEWS = ("automated_verified", "human_verified", "source_verified", "trusted_source", "verified")
MIN_CONFIDENCE = 0.8


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label: key, n, labels (sorted)."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(label)).alias("labels")).filter(F.size("labels") > 1)


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. By aggregate, not window: one row a key and task is shuffled."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.min(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)], *rest)).alias("_f")
    return df.groupBy(*key).agg(ranked).select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest]).select(*df.columns)


def exact_dedup(df: DataFrame, key: str, label: str, seq: str) -> DataFrame:
    """Keys of one label keep their first row; keys with conflicting labels are quarantined whole."""
    return keep_first(df.join(conflicts(df, key, label).select(key), key, "left_anti"), [key], [seq])


def dedup_report(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row that adds up: rows_in = rows_out + exact_removed + conflict_rows."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"))
    return groups.agg(
        F.sum("n").alias("rows_in"), F.count_if(F.col("k") == 1).alias("rows_out"), F.sum(F.when(F.col("k") == 1, F.col("n") - 1).otherwise(0)).alias("exact_removed"),
        F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("conflict_rows"), F.count_if(F.col("k") > 1).alias("conflict_keys"),
    )


def assign_splits(df: DataFrame, group: Column, held_out: Column | None = None) -> DataFrame:
    """Add split by the group's hash; held-out rows go to test."""
    split = hash_split(group)
    return df.withColumn("split", split if held_out is None else F.when(held_out, "test").otherwise(split))


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split, with the number of splits."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def require_isolation(df: DataFrame, group: str) -> DataFrame:
    """The frame itself; an error if a group leaks."""
    found = leaks(df, group).limit(5).collect()
    if found:
        raise ValueError(f"groups in several splits: {[r[group] for r in found]}")
    return df


def rank_split(groups: DataFrame, name: str, of: int = 5) -> DataFrame:
    """Distinct groups by rank of their SHA-256: every fifth to test, the one after to validation."""
    slot = (F.row_number().over(Window.orderBy(F.sha2(name, 256))) - 1) % of
    return groups.select(name).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct().withColumn("split", F.when(slot == 0, "test").when(slot == 1, "validation").otherwise("train"))


def cap(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def cap_twice(df: DataFrame, inner: list[str], n: int, outer: list[str], m: int, order: list[Column | str]) -> DataFrame:
    """At most n of each inner group, then at most m of each outer one, both in order."""
    return cap(cap(df, inner, order, n), outer, order, m)


def every_nth(df: DataFrame, seq: str, n: int = 5) -> DataFrame:
    return df.withColumn("held_out", F.col(seq) % n == 0)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows by hash order: the same rows whatever the partitioning."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def pairs(df: DataFrame, key: str, slot: str, value: str, left: str = "bad", right: str = "good") -> DataFrame:
    """One row for each key that has both slots."""
    out = df.groupBy(key).agg(F.min(F.when(F.col(slot) == left, F.col(value))).alias(left), F.min(F.when(F.col(slot) == right, F.col(value))).alias(right))
    return out.filter(F.col(left).isNotNull() & F.col(right).isNotNull())


def unique_match(left: DataFrame, right: DataFrame, exact: str, fallback: str, value: str) -> DataFrame:
    """left with ``value`` of the only right row of equal ``exact``, else of the only one of equal ``fallback``, else null."""
    def only(key: str, name: str) -> DataFrame:
        return right.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(name)).filter("_n = 1").drop("_n")

    return left.join(only(exact, "_a"), exact, "left").join(only(fallback, "_b"), fallback, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def merge_new(base: DataFrame, more: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(base with the rows of ``more`` whose key is new, one row of counts: added, present, conflicts)."""
    fresh = more.join(base.select(key).distinct(), key, "left_anti")
    known = more.join(base.groupBy(key).agg(F.min(label).alias("_l")), key, "left")
    counts = known.agg(
        F.count_if(F.col("_l").isNull()).alias("added"), F.count_if(F.col("_l").isNotNull()).alias("present"), F.count_if(F.col("_l") != F.col(label)).alias("conflicts")
    )
    return base.unionByName(fresh, allowMissingColumns=True), counts


def merge_cases(df: DataFrame, key: str, priority: Column, labels: str, keep: list[str]) -> DataFrame:
    """One row for each key: columns of the row with the least priority, and all labels, sorted and distinct."""
    best = F.min(F.struct(priority.alias("p"), *keep)).alias("b")
    return df.groupBy(key).agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias(labels)).select(key, labels, *[F.col(f"b.{c}").alias(c) for c in keep])


def interval_owner(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """points with the first span (by start, then name) of their group that covers them, else null."""
    hit = points.join(spans, by).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    owner = hit.groupBy(*by, at).agg(F.min(F.struct(start, name)).alias("_o")).select(*by, at, F.col(f"_o.{name}").alias(name))
    return points.join(owner, [*by, at], "left")


def nearest_following(left: DataFrame, right: DataFrame, by: list[str], at: str, tolerance: float) -> DataFrame:
    """For each group the closest pair (left place, right place at or after it) within the tolerance; the earliest left on ties.

    A forward as-of join as one ordered window over both sides.
    """
    both = left.select(*by, F.col(at).alias("at"), F.lit(0).alias("side")).unionByName(right.select(*by, F.col(at).alias("at"), F.lit(1).alias("side")))
    after = Window.partitionBy(*by).orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("next", F.min(F.when(F.col("side") == 1, F.col("at"))).over(after)).filter("side = 0 AND next IS NOT NULL")
    best = both.withColumn("gap", F.col("next") - F.col("at")).filter(F.col("gap") <= tolerance)
    best = best.groupBy(*by).agg(F.min(F.struct("gap", "at", "next")).alias("b"))
    return best.select(*by, F.col("b.at").alias("left_at"), F.col("b.next").alias("right_at"), F.col("b.gap").alias("gap"))


def spend(df: DataFrame, by: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Add taken (boolean): in order, each item is taken if what is left of the group's budget covers it; later ones may still fit.

    The choice depends on all before it, so that a group is one ordered stream (its rows are
    not gathered: the fold keeps a number for each open group).
    """
    names = list(df.columns)
    schema = df.withColumn("taken", F.lit(True)).schema

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict = defaultdict(lambda: budget)
        for frame in frames:
            taken = []
            for key, price in zip(frame[by], frame[cost], strict=True):
                ok = price is not None and price == price and price <= left[key]
                if ok:
                    left[key] -= price
                taken.append(ok)
            yield frame.assign(taken=taken)[[*names, "taken"]]

    return df.repartition(F.col(by)).sortWithinPartitions(by, *order).mapInPandas(fold, schema)


def version_key(version: Column) -> Column:
    """Parts of a version, orderable: numbers before words at the same place."""
    parts = F.filter(F.split(version, r"[.\-+_]"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.when(x.rlike("^[0-9]{1,9}$"), x.cast("string")).otherwise(F.lit("0")).cast("int").alias("number"), F.when(x.rlike("^[0-9]+$"), F.lit("")).otherwise(x).alias("word")))


def last_before(versions: DataFrame, by: str, version: str, bad: Column) -> DataFrame:
    """For each group the greatest version below the first bad one."""
    keyed = versions.withColumn("_k", version_key(F.col(version)))
    first = keyed.filter(bad).groupBy(by).agg(F.min("_k").alias("_first"))
    below = keyed.join(first, by).filter((F.col("_k") < F.col("_first")) & ~bad)
    return below.groupBy(by).agg(F.max_by(version, "_k").alias(version))


def eligible(df: DataFrame) -> DataFrame:
    """Rows that may be trained on: confident enough and reviewed."""
    return df.filter((F.col("label_confidence") >= MIN_CONFIDENCE) & F.col("review_status").isin(*TRAINABLE_REVIEWS))


def manifest(df: DataFrame) -> DataFrame:
    """kind, value, n: counts of labels, languages, sources and splits in one pass."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in ("label", "lang", "source", "split")])).alias("x")
    return df.select(long).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def greedy_near_dedup(df: DataFrame, seq: str, label: str, text: str, threshold: float = 0.9) -> DataFrame:
    """Rows that no kept earlier row of the same label resembles: 16-slot MinHash, four bands of four slots.

    Candidates come from equi-joins on signatures, in Spark. Whether a row goes depends on
    which earlier ones were kept; that is settled in the rounds of ``neardup.resembling``. Rows without a label resemble none.
    """
    ensure_folder(df.sparkSession)
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_t") - 5, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(F.col("_t"), i + 1, F.lit(5)), "\x1f")))
    sig = F.array(*[F.expr(f"array_min(transform(_g, g -> xxhash64(g, {k})))") for k in range(16)])
    signed = df.select(seq, label, tokens.alias("_t")).select(seq, label, grams.alias("_g")).select(seq, label, sig.alias("sig"))
    gone = neardup.resembling(signed.filter(F.col(label).isNotNull()).select(F.col(seq).alias("seq"), F.col(label).alias("label"), "sig"), threshold)
    return df.join(gone.select(F.col("seq").alias(seq)), seq, "left_anti")
