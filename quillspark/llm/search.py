"""Ranked lexical search as a blocked product of two sparse matrices.

Items are queries: each item of ``items`` asks for its best documents. A is items by terms
(multiplicities), B terms by documents (whole-number impacts); the product's rows are scores.

1. Items are cut into blocks by hash, so that a block has about BLOCK_TERMS pairs of item and
   term at most (twice that at worst, as hashes deal evenly). Only a block's vocabulary and its
   rows of A are broadcast. One block is enough for any benchmark of usual size; each block
   reads the documents anew.
2. A first pass over the documents counts N, L and the document frequency of each term of the
   block; every task sends one row for each term, which Spark sums.
3. A second pass builds B for some documents at a time, sorted by term. A row of the product is
   the sum of the rows of B that the item names, merged into a dense row of 64-bit sums
   (Gustavson). What reaches the item's k-th score so far stays; a task sends k rows an item.
4. The task's rows are reduced to k twice: by item and a salt, then by item.

Words are looked up by hash, and each find is compared with the term byte by byte. No table
but the documents is read twice, nothing is written, and no shuffle holds texts.

Defined results: null texts have no terms; terms of all rows with one item_id (null included)
are united; repeated documents each have a rank; null doc_ids rank behind all others of equal
score; empty tables give no row; further columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_lower, saved, table, text_or_empty
from .hashing import LOWER, NO_TERM, slices, word_chunks

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
#: Pairs of item and term, and items, in one block.
BLOCK_TERMS, BLOCK_ITEMS = 1_000_000, 20_000
#: Bytes of documents that a block of B covers.
BLOCK_BYTES = 4_000_000
SALTS = 64
#: Fixed values of the weights: parts in a thousand, and how far length counts in per cent.
SCALE, LENGTH = 1000, 50


class Vocabulary:
    """Terms by hash and bytes."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        found = [(doc, h) for _, doc, _, _, h in word_chunks(raw, NO_TERM, LOWER)]
        hashes = np.zeros(len(raw), np.uint64)
        for doc, h in found:
            hashes[doc] = h
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.lengths = np.array([len(t) for t in raw], np.int64)
        self.bytes = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tries = int(np.unique(hashes, return_counts=True)[1].max()) if len(raw) else 0

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The term of each word, -1 where it is none."""
        out = np.full(len(h), -1, np.int64)
        left = np.searchsorted(self.hashes, h)
        for k in range(self.tries):  # more than one where terms share a hash
            at = np.minimum(left + k, len(self) - 1)
            open_ = np.flatnonzero((out < 0) & (left + k < len(self)) & (self.hashes[at] == h))
            if not len(open_):
                break
            term = self.order[at[open_]]
            size = ends[open_] - starts[open_]
            fits = self.lengths[term] == size
            open_, term, size = open_[fits], term[fits], size[fits]
            for n in np.unique(size):
                these = np.flatnonzero(size == n)
                step = np.arange(n)
                for lo in range(0, len(these), max(1, 4_000_000 // int(n))):
                    some = these[lo : lo + max(1, 4_000_000 // int(n))]
                    equal = (buf[starts[open_[some]][:, None] + step] == self.bytes[self.starts[term[some]][:, None] + step]).all(1)
                    out[open_[some[equal]]] = term[some[equal]]
        return out


def term_counts(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each text, repeats included, and (text, term, times) of those of the vocabulary, by term and text."""
    n = np.zeros(len(texts), np.int64)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for buf, doc, starts, ends, h in word_chunks(texts, NO_TERM, LOWER):
        n += np.bincount(doc, minlength=len(texts))
        term = vocabulary.find(buf, starts, ends, h)
        key, count = np.unique(term[term >= 0] * len(texts) + doc[term >= 0], return_counts=True)
        keys.append(key)
        times.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.zeros(len(key), np.int64)
    np.add.at(tf, back, np.concatenate(times))
    return n, key % max(len(texts), 1), key // max(len(texts), 1), tf


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, whether they are null, texts) of some documents at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        ids = batch.column(0)
        known = np.asarray(ids.is_valid())
        values = np.asarray(ids.fill_null(0))
        for a, b in slices(np.asarray(pc.binary_length(texts)), BLOCK_BYTES):
            yield values[a:b], ~known[a:b], texts.slice(a, b - a).to_pylist()


def _frequencies(vocabulary):
    """Arrow pass: document frequency by term; the last two rows are N and L."""

    def run(batches):
        words = vocabulary.value
        df, total = np.zeros(len(words) + 2, np.int64), 0
        for _, _, texts in _blocks(batches):
            n, _, term, _ = term_counts(texts, words)
            df[: len(words)] += np.bincount(term, minlength=len(words))
            df[-2] += np.count_nonzero(n)
            total += int(n.sum())
        df[-1] = total
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], ["term", "df"])

    return run


class Best:
    """The k best (score, id) of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, row: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        reach = np.flatnonzero(row >= self.least)
        if not len(reach):
            return
        if len(reach) > self.k:
            least = np.partition(row[reach], len(reach) - self.k)[len(reach) - self.k]
            reach = reach[row[reach] >= least]
        score, doc, none = np.concatenate([self.score, row[reach]]), np.concatenate([self.id, ids[reach]]), np.concatenate([self.null, null[reach]])
        keep = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.id, self.null = score[keep], doc[keep], none[keep]
        if len(keep) == self.k:
            self.least = max(int(self.score[-1]), 1)


def impacts(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _product(matrix, k: int):
    """Arrow pass: rows of the product, reduced to the k best of each item in this task."""

    def run(batches):
        words, weights, pointers, terms, times, item_ids, n_docs, n_terms = matrix.value
        best = [Best(k) for _ in item_ids]
        for ids, null, texts in _blocks(batches):
            n, doc, term, tf = term_counts(texts, words)
            m = 100 - LENGTH + (LENGTH * n * n_docs) // max(n_terms, 1)
            impact = impacts(tf, m[doc], weights[term])
            row_of = np.searchsorted(term, np.arange(len(words) + 1))
            for i, top in enumerate(best):
                row = np.zeros(len(texts), np.int64)
                for t, c in zip(terms[pointers[i] : pointers[i + 1]], times[pointers[i] : pointers[i + 1]], strict=True):
                    a, b = row_of[t], row_of[t + 1]
                    row[doc[a:b]] += c * impact[a:b]
                top.add(row, ids, null)
        for i, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(np.full(len(top.score), i))), pa.array(top.id, mask=top.null), pa.array(top.score)], ["item_id", "doc_id", "score"])

    return run


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id, term and times it stands in the item."""
    found = items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _top(df: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K, multiplicity: bool = False, text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0.

    Each term of an item counts once, or as often as it stands there with ``multiplicity``.
    """
    spark = docs.sparkSession
    pairs = item_terms(items, text)
    size = pairs.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    n_blocks = max(1, math.ceil(size[0] / block_terms), math.ceil(size[1] / BLOCK_ITEMS))
    if n_blocks > 1:
        pairs = saved(pairs)
    item_type = items.schema["item_id"].dataType
    read = docs.select(F.col("doc_id").cast("long"), text_or_empty(text).alias("text"))
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    parts = []
    for block in range(n_blocks if size[0] else 0):
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()  # bounded by the size of a block
        rows.sort(key=lambda r: (r.item_id is not None, r.item_id if r.item_id is not None else 0, r.term))
        if not rows:
            continue
        names = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(names)}
        item_ids = list(dict.fromkeys(r.item_id for r in rows))
        place = {x: i for i, x in enumerate(item_ids)}
        pointers = np.cumsum([0, *np.bincount([place[r.item_id] for r in rows], minlength=len(item_ids))])
        words = spark.sparkContext.broadcast(Vocabulary(names))
        df = np.zeros(len(names) + 2, np.int64)
        for r in read.mapInArrow(_frequencies(words), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
            df[r.term] = r.df
        n_docs, n_terms = int(df[-2]), int(df[-1])
        weights = np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[:-2]], np.int64)
        terms, times = np.array([number[r.term] for r in rows]), np.array([r.times if multiplicity else 1 for r in rows], np.int64)
        matrix = spark.sparkContext.broadcast((words.value, weights, pointers, terms, times, pa.array(item_ids, to_arrow_type(item_type)), n_docs, n_terms))
        parts.append(read.mapInArrow(_product(matrix, k), out.schema))
    for part in parts:
        out = out.unionByName(part)
    once = _top(out.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item_id", "_salt")
    return _top(once, k, "item_id").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH t AS (SELECT rid, doc_id, unnest(regexp_extract_all({_LOW}, '{TERM}')) AS term FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
n AS (SELECT rid, count(*) AS n FROM t GROUP BY rid), s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
f AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY rid, term), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, '{TERM}')) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor({SCALE} * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN df USING (term), s),
c AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - {LENGTH} + ({LENGTH} * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN f USING (term) JOIN n USING (rid), s GROUP BY item_id, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {K}
"""
