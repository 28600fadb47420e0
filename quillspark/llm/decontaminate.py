"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The test items are cut into windows of ``window`` consecutive words (an item of fewer
words is one window). Every document's own windows are hashed inside one projection and
looked up in the set of window hashes; only hits leave the row, and each is verified word
by word by an equi-join with the windows themselves before it counts.

Bounds: the hash set travels with the plan only while there are at most ``max_set``
distinct windows; a larger benchmark is joined by hash, shuffled on both sides, with the
same result.

Defined results: null texts have no words; a null item has no window; repeated rows each
get their row; empty tables give no hit; further columns are carried through by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, text_or_empty

#: What separates words: ASCII other than letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
MAX_SET = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct (item_id, n, gram) of the test items."""
    df = items.select("item_id", words(text_or_empty("text")).alias("_w")).filter(F.size("_w") > 0)
    df = df.withColumn("n", F.least(F.size("_w"), F.lit(window)))
    return df.select(
        "item_id", "n", F.explode(F.expr("transform(sequence(0, size(_w) - n), i -> slice(_w, i + 1, n))")).alias("gram")
    ).distinct()


def probe(n: int, hashes: str, at: str = "0") -> str:
    """SQL for the hash of a window of n words: of its first, middle and last word's hashes."""
    return "xxhash64(" + ", ".join(f"get({hashes}, {at} + {k})" for k in (0, n // 2, n - 1)) + ")"


def _found_in(n: int, hashes: list[int]) -> Column:
    """The row's windows of n words whose hash is in the set: array of (n, i, gram)."""
    own = ", ".join(map(str, hashes))
    found = f"IF(size(_w) < {n}, cast(array() as array<int>), filter(sequence(0, greatest(size(_w) - {n}, 0)), i -> {probe(n, '_h', 'i')} IN ({own})))"
    return F.expr(f"transform({found}, i -> struct({n} as n, i as i, slice(_w, i + 1, {n}) as gram))")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, text: str = "text") -> DataFrame:
    """Per document row: doc_id, _key, n_words, copies, hit_words (places of hit words, sorted) and item_ids (sorted).

    Rows with the same id and text are one row here, with their number in ``copies``.
    """
    grams = item_windows(items, window)
    sizes = grams.groupBy("n").agg(F.count_distinct("gram").alias("c")).collect()  # at most ``window`` rows
    total = sum(r["c"] for r in sizes)
    df = docs.select("doc_id", text_or_empty(text).alias("_t"))
    df = df.select("doc_id", F.xxhash64("_t").alias("_key"), words(F.col("_t")).alias("_w"))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    if not total:
        found = df.select("doc_id", "_key", "n_words", F.lit(0).alias("_k"), F.lit(None).cast("struct<n:int,i:int,gram:array<string>>").alias("hit"))
    elif total <= max_set:
        parts = []
        lengths = sorted(r["n"] for r in sizes)
        by_size = F.expr("CASE n " + " ".join(f"WHEN {n} THEN {probe(n, 'g')}" for n in lengths) + " END")
        hashes = grams.select("n", F.transform("gram", lambda x: F.xxhash64(x)).alias("g")).select("n", by_size.alias("h")).distinct().collect()  # bounded by max_set
        df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
        for n in lengths:
            parts.append(_found_in(n, [r["h"] for r in hashes if r["n"] == n]))
        df = df.select("doc_id", "_key", "n_words", F.concat(*parts).alias("_hits"))
        found = df.select("doc_id", "_key", "n_words", F.posexplode_outer("_hits").alias("_k", "hit"))
    else:
        lengths = [r["n"] for r in sizes]
        every = F.concat(*[
            F.expr(f"IF(size(_w) < {n}, cast(array() as array<struct<n:int,i:int,gram:array<string>>>), transform(sequence(0, greatest(size(_w) - {n}, 0)), i -> struct({n} as n, i as i, slice(_w, i + 1, {n}) as gram)))")
            for n in lengths
        ])
        found = df.select("doc_id", "_key", "n_words", F.posexplode_outer(every).alias("_k", "hit"))
    per_gram = grams.groupBy("n", "gram").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    if 0 < total <= max_set:
        per_gram = F.broadcast(per_gram)
    found = found.join(per_gram, (F.col("hit.n") == per_gram["n"]) & (F.col("hit.gram") == per_gram["gram"]), "left")
    per_doc = found.groupBy("doc_id", "_key", "n_words").agg(
        F.sum(F.when(F.coalesce("_k", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("hit.i", "hit.n"))).alias("_at"),
        F.collect_set("items").alias("_items"),
    )
    return per_doc.select(
        "doc_id", "_key", "n_words", "copies",
        F.expr("array_sort(array_distinct(flatten(transform(_at, x -> sequence(x.i, x.i + x.n - 1)))))").alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten("_items"))).alias("item_ids"),
    )


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, text: str = "text") -> DataFrame:
    """A row for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items, window, max_set, text)
    found = found.withColumn("_c", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, remove: str = "documents", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words cut out (``remove="spans"``)."""
    found = hits(docs, items, window, max_set, text).filter(F.size("hit_words") > 0)
    found = found.select(F.col("doc_id").alias("_id"), "_key", "hit_words")
    keyed = docs.select(F.struct("*").alias("row")).withColumn("_own", F.xxhash64(text_or_empty(F.col("row")[text])))
    same = F.col("row")["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    old = F.col("row")[text]
    joined = keyed.join(found, same, "left").withColumn("_p", F.regexp_extract_all(old, F.lit(PIECES), F.lit(0)))
    first = F.expr(r"CASE WHEN get(_p, 0) rlike '^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]' THEN 1 ELSE 0 END")
    joined = joined.withColumn("_f", first).withColumn("_gone", F.transform("hit_words", lambda i: i * 2 + F.col("_f")))
    # a hit word goes with the separator that follows it
    left = F.expr("array_except(sequence(0, greatest(size(_p) - 1, 0)), concat(_gone, transform(_gone, i -> i + 1)))")
    cut = F.array_join(F.transform(left, lambda i: F.get(F.col("_p"), i)), "")
    new = F.when(F.col("hit_words").isNull(), old).otherwise(cut)
    return joined.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM
  (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
e AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM
  (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT rid, i, e.n, item_id FROM e JOIN g ON e.n = g.n AND e.gram = g.gram),
p AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (rid) LEFT JOIN s USING (rid)
"""
