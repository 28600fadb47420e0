"""Filter interaction audit: what each of five filters removes, in every order of all five.

1. Each task computes what a document's own text decides (filters A to D) as a mask of bits and,
   for filter E, keeps one document of each text it has seen: that with the smallest id. What
   another displaces is a copy for sure and is done with; so a text that a third of all rows
   share leaves a task once. The table of a task is emptied at HELD_BYTES of texts.
2. What is left is routed by the xxhash64 of the text, as an RDD. A partition stores a chain for
   each fingerprint: full texts, each with its minimum id, so that texts of one fingerprint
   stay apart. It emits the non-minimum ids as they are displaced and the minimum ids at the end.
3. Rows of id, part and mask, without texts, meet the labels by a join. ``combineByKey`` merges
   vectors of counts by mask for each part; a part's 600 rows follow from its 32 masks alone.

Defined results: null texts are empty, a null part is the empty string; ids that are null are
neither smaller nor larger than others and have no label; rows of one id and text are no copies
of one another; an id that several rows label is good or toxic if one of them says so; an empty
table gives no row; further columns may have any name, as only those asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
MARKS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")
#: Bytes of texts that a task holds to find copies among its own rows.
HELD_BYTES = 64_000_000
#: Bytes of texts, copies included, for each partition of the routed RDD.
ROUTED_BYTES = 16_000_000

_CAPITALS = bytes(range(65, 91))
_ORDERS = ["".join(p) for p in permutations(FILTERS)]
_MASKS = np.arange(1 << len(FILTERS))
ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])


def own_mask(text: str) -> int:
    """Bits of the filters A to D that the text fails. ``bytes.split`` parts at the same six characters as the words."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * capitals > CAPITALS_PERCENT * len(text), len(raw.translate(None, MARKS)) < len(raw))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


class Chains:
    """By fingerprint, the different texts with the smallest id seen of each, and what else came with that id.

    ``add`` tells which rows are known to be copies now; ``rest`` gives up what is held.
    """

    def __init__(self) -> None:
        self.held: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, fingerprint: int, text: str, doc_id: int, mask: int, parts: dict[str, int]) -> Iterator[tuple]:
        chain = self.held.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, doc_id, mask, dict(parts)])
            self.bytes += len(text) + 200
        elif doc_id > entry[1]:
            yield from rows_of(doc_id, mask | COPY, parts)
        elif doc_id < entry[1]:
            yield from rows_of(entry[1], mask | COPY, entry[3])
            entry[1], entry[3] = doc_id, dict(parts)
        else:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n

    def rest(self) -> Iterator[tuple[int, list]]:
        held, self.held, self.bytes = self.held, {}, 0
        for fingerprint, chain in held.items():
            for entry in chain:
                yield fingerprint, entry


def rows_of(doc_id: int | None, mask: int, parts: dict[str, int]) -> Iterator[tuple]:
    for part, n in parts.items():
        yield doc_id, part, mask, n


def _within_task(rows: Iterable) -> Iterator[tuple]:
    """Rows by id of what is settled, entries (lists) by fingerprint of what others may still settle."""
    chains = Chains()
    for doc_id, text, part, fingerprint in rows:
        mask = own_mask(text)
        if doc_id is None:
            yield fingerprint, (None, part, mask, 1)
            continue
        for row in chains.add(fingerprint, text, doc_id, mask, {part: 1}):
            yield row[0], row
        if chains.bytes > HELD_BYTES:
            yield from chains.rest()
    yield from chains.rest()


def _across_tasks(entries: Iterable) -> Iterator[tuple]:
    chains = Chains()
    for fingerprint, found in entries:
        if isinstance(found, tuple):
            yield found
        else:
            yield from chains.add(fingerprint, *found)
    for _, (_, doc_id, mask, parts) in chains.rest():
        yield from rows_of(doc_id, mask, parts)


def masks(docs: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """doc_id, part, mask of failed filters and n (rows of that id and text) for all rows of ``docs``."""
    spark = docs.sparkSession
    body = text_or_empty(text)
    read = docs.select(F.col("doc_id").cast("long"), body, F.coalesce(F.col(part).cast("string"), F.lit("")), F.xxhash64(body))
    total = docs.agg(F.sum(F.octet_length(body).cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROUTED_BYTES + 1)
    routed = read.rdd.mapPartitions(_within_task).partitionBy(n, lambda key: key)
    return spark.createDataFrame(routed.mapPartitions(_across_tasks), ROW, verifySchema=False)


def _vector(row) -> np.ndarray:
    out = np.zeros((3, len(_MASKS)), np.int64)
    out[:, row[0]] = (row[1], row[1] * row[2], row[1] * row[3])
    return out


def _add(into: np.ndarray, row) -> np.ndarray:
    into[:, row[0]] += (row[1], row[1] * row[2], row[1] * row[3])
    return into


def _merge(into: np.ndarray, other: np.ndarray) -> np.ndarray:
    into += other
    return into


def order_rows(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """All orders and steps of one part, from its documents, good and toxic ones by mask."""
    n, good, toxic = counts
    made, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in _ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, gone = (_MASKS & bit) > 0, (_MASKS & before) > 0
            here = fails & ~gone
            before |= bit
            removed = int(n[here].sum())
            shapley[letter] += removed
            made.append((order, step, letter, int(n[(_MASKS & before) == 0].sum()), removed, int(n[fails & gone].sum()), int(n[bit]), int(good[here].sum()), int(toxic[here].sum())))
    for order, step, letter, *values in made:
        yield (part, order, step, *values, shapley[letter])


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(said("quality"), said("toxic"))
    rows = masks(docs, part, text).join(known, F.col("doc_id") == F.col("_id"), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    keyed = rows.select("part", F.struct("mask", "n", none("quality").alias("quality"), none("toxic").alias("toxic"))).rdd.map(tuple)
    merged = keyed.combineByKey(_vector, _add, _merge)
    return docs.sparkSession.createDataFrame(merged.flatMap(lambda x: order_rows(*x)), OUT, verifySchema=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_BITS = {letter: 1 << k for k, letter in enumerate(FILTERS)}
_BIT = "CASE {0} " + " ".join(f"WHEN '{letter}' THEN {bit}" for letter, bit in _BITS.items()) + " END"
_EARLIER = "+".join(f"CASE WHEN step > {k} THEN {_BIT.format(f'substr(filter_order, {k}, 1)')} ELSE 0 END" for k in range(1, 5))
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, step, {_BIT.format('substr(filter_order, step, 1)')} AS bit, {_EARLIER} AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
