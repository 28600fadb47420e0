"""Best-fit packing of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so best-fit decreasing over all pieces of the
corpus depends on nothing but how many pieces there are of each length: at most ``capacity``
counts reach the driver whatever the corpus. There, bins with the same content form one
class; a segment tree over remaining capacities finds the tightest class that still takes a
length, and whole runs of equal pieces go in at once. That is the global best fit, not one
for each partition. The plan (a bounded table of rank ranges) goes back as a broadcast; each
piece finds its place by its rank among the pieces of its length, which comes from counts
for each (task, length), so that no task ever holds a whole length.

Bound of the plan: a length splits at most one class and opens at most two, and a sequence
holds at most about ``sqrt(2 * capacity)`` different lengths, hence at most
``3 * capacity * sqrt(2 * capacity)`` rows: 140,000 for a capacity of 1024.

Defined results: null texts are empty and give one piece of the end id alone; only documents
of more than ``capacity`` ids are cut, their first piece being the shorter one; repeated rows
are packed one by one; an empty table packs to nothing; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import batched, encoder, vocabulary_path

CAPACITY = 1024
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


class CapacityTree:
    """Segment tree over capacities 0..size: which of them have an open bin."""

    def __init__(self, size: int):
        self.width = 1 << (size + 1 - 1).bit_length()
        self.open = [0] * (2 * self.width)

    def put(self, capacity: int, is_open: bool) -> None:
        k = capacity + self.width
        self.open[k] = int(is_open)
        k >>= 1
        while k:
            self.open[k] = self.open[2 * k] | self.open[2 * k + 1]
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``."""
        k = least + self.width
        if self.open[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Classes of bins: (number of bins, {length: pieces of it in each}), as best fit decreasing fills them."""
    tree = CapacityTree(capacity)
    held: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)  # by remaining capacity

    def add(left: int, bins: int, content: dict[int, int]) -> None:
        if bins:
            held[left].append((bins, content))
            tree.put(left, True)

    def filled(content: dict[int, int], length: int, times: int) -> dict[int, int]:
        return content | {length: content.get(length, 0) + times} if times else content

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rest = counts[length]
        while rest:
            left = tree.tightest(length)
            if left is None:
                each = capacity // length
                bins, over = divmod(rest, each)
                add(capacity - each * length, bins, {length: each})
                add(capacity - over * length, 1 if over else 0, {length: over})
                break
            bins, content = held[left].pop()
            if not held[left]:
                tree.put(left, False)
            each = left // length  # a bin just used is the tightest until it is full
            used, over = divmod(rest, each)
            full = min(bins, used)
            add(left - each * length, full, filled(content, length, each))
            rest -= full * each
            if bins > full:
                if rest:
                    add(left - over * length, 1, filled(content, length, over))
                    add(left, bins - full - 1, content)
                    rest = 0
                else:
                    add(left, bins - full, content)
    return [x for classes in held.values() for x in classes]


def plan_rows(classes: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a bin, first bin, offset of the first) of each class and length."""
    rank: dict[int, int] = defaultdict(int)
    rows, first_bin = [], 0
    for bins, content in classes:
        offset = 0
        for length, each in sorted(content.items(), reverse=True):
            rows.append((length, rank[length], rank[length] + bins * each, each, first_bin, offset))
            rank[length] += bins * each
            offset += length * each
        first_bin += bins
    return rows


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 2, path: str | None = None, text: str = "text") -> DataFrame:
    """The pieces of each document with the crc32 of their ids, their task and their rank among its pieces of that length."""
    place = vocabulary_path(vocabulary, path)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = encoder(place, True), TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            doc_ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for k, own in batched(texts, enc):
                ids = (enc.encode_many(own)[0] if len(own) == 1 else b"".join(map(enc.cache.__getitem__, own))) + end
                n = len(ids) >> 2
                head = n % capacity or min(n, capacity)
                start = 0
                for i in range(-(-n // capacity)):
                    length = head if i == 0 else capacity
                    out.append((doc_ids[k], i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, ranks[length]))
                    ranks[length] += 1
                    start += length
            for at in range(0, max(len(out), 1), 50_000):
                part = list(zip(*out[at : at + 50_000], strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, kinds, strict=True)], names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(cut, PIECE_SCHEMA)


def place_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (written where all executors can read them)."""
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # at most ``capacity``
    rows = plan_rows(best_fit_decreasing(by_length, capacity))
    plan: dict[int, np.ndarray] = {}
    for length in by_length:
        plan[length] = np.array(sorted(r[1:] for r in rows if r[0] == length), dtype=np.int64)
    shared = cut.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
            size = int(n[own[0]])
            first, _, each, base, offset = shared.value[size].T
            k = np.searchsorted(first, r[own], side="right") - 1
            into = r[own] - first[k]
            seq[own] = base[k] + into // each[k]
            off[own] = offset[k] + into % each[k] * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = cut.join(before.select("task", "length", "before"), ["task", "length"])
    ranked = ranked.withColumn("_p", place("length", F.col("before") + F.col("local_rank")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 2, path: str | None = None, text: str = "text") -> DataFrame:
    """Cut, count and place: a row for each piece."""
    return place_pieces(saved(pieces(docs, vocabulary, capacity, end_id, path, text)), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
