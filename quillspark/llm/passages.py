"""Substring dedup by words: a count-min prefilter, then exact groups of what may be repeated.

A window is WINDOW consecutive words of a document. Equal windows hold the same least hash of
ANCHOR consecutive words at the same place (their anchor). Neighbouring windows that share one
occurrence of it form a run of 41 windows at most, about 21 on average; no window is in two.

1. A first pass counts, for each document once, the anchors of its runs in a count-min sketch.
   Tasks send sparse sketches in blocks of 65,536 cells, which are merged block by block; bits
   of "twice or more" are broadcast. A cell counts all windows of its anchors, so that no
   estimate is below a window's number of documents. The sketch grows with the texts up to
   MOST_BITS (32 MB in two rows). Beyond that it lets more through, and loses none: what
   follows holds 44 bytes for 21 words of what passes, so that even all of it fits the disk.
2. A second pass writes the runs whose anchor is estimated to be in two documents, each with
   a 128-bit hash of its words. Equal runs are grouped: a run that a smaller document holds
   goes as a whole. So copies, however many, leave one run each behind.
3. Where an anchor has different runs (where passages begin or end, or at an edit), the first
   document of each sends the hashes of its single windows, which are grouped alike.
4. The texts meet the places to cut by a join on the document. The same exchange of the
   texts serves step 3 and step 4.

Groups are found by aggregates that combine in each task first, and go back by joins on keys
that are unique on one side: a passage in a third of all documents splits like any other.

Defined results: null texts have no words; rows whose id is null neither lose words nor take
any; rows with one id are one document (none is smaller), each cut by itself; an empty table
gives an empty table; further columns are carried through by ``clean``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, saved, table, text_or_empty, unused
from .hashing import SPACE, mix, slices, stretch, sums, word_chunks

WINDOW, ANCHOR = 50, 10
SPAN = WINDOW - ANCHOR + 1
#: Cells of a row of the sketch as a power of two: at least, at most; and cells for each anchor while below.
LEAST_BITS, MOST_BITS, ROOM = 20, 27, 8
ROWS, BLOCK = 2, 16
#: Bytes of texts, words, and cells that a task works on at a time.
TEXT_BYTES, SEGMENT, HELD_CELLS = 2_000_000, 400_000, 4_000_000

_U = np.uint64
_BASE_A, _BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: A place and the windows there in one number: start * CODE + windows.
CODE = 64


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word."""
    found = [(doc, h) for _, doc, _, _, h in word_chunks(texts, SPACE)]
    return (np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found])) if found else (np.zeros(0, np.int64), np.zeros(0, _U))


def _least(g: np.ndarray) -> np.ndarray:
    """Place of the first least value among SPAN from each place on."""
    at, width = np.arange(len(g)), 1
    while 2 * width <= SPAN:
        a, b = at[:-width], at[width:]
        at = np.where(g[a] <= g[b], a, b)
        width *= 2
    a, b = at[: len(g) - SPAN + 1], at[SPAN - width : len(g) - width + 1]
    return np.where(g[a] <= g[b], a, b)


def runs(doc: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first word within these words, windows, anchor, hash, second hash) of all runs, a segment of words at a time."""
    for at in range(0, max(len(h) - WINDOW + 1, 0), SEGMENT):
        own, d = h[at : at + SEGMENT + WINDOW - 1], doc[at : at + SEGMENT + WINDOW - 1]
        one, two = sums(mix(own), _BASE_A), sums(mix(own ^ _U(0x5851F42D4C957F2D)), _BASE_B)
        k = np.arange(len(own) - ANCHOR + 1)
        anchor = stretch(one, k, k + ANCHOR, _BASE_A)
        place = _least(anchor)
        whole = d[: len(place)] == d[WINDOW - 1 :]
        first = whole & np.concatenate([[True], ~whole[:-1] | (place[1:] != place[:-1]) | (d[1 : len(place)] != d[: len(place) - 1])])
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        windows = np.add.reduceat(whole.astype(np.int64), starts)
        ends = starts + windows + WINDOW - 1
        yield d[starts], starts + at, windows, anchor[place[starts]], stretch(one, starts, ends, _BASE_A), stretch(two, starts, ends, _BASE_B)


def _texts(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        raw = batch.column("text").cast(pa.binary())
        for a, b in slices(np.asarray(pc.binary_length(raw)), TEXT_BYTES):
            yield batch.slice(a, b - a), raw.slice(a, b - a).to_pylist()


def _cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """The anchor's cell in each row; rows lie one behind the other."""
    return [((mix(anchor + _U(r * 0x632BE59BD9B4E019 % 2**64)) >> _U(64 - bits)) + _U(r << bits)).astype(np.int64) for r in range(ROWS)]


def _sketch(bits: int):
    """Arrow pass: sparse sketches of this task's documents, cells by block, each once or twice."""

    def flush(cells):
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        cell = np.repeat(cell, np.minimum(n, 2))
        block = cell >> BLOCK
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        payload = [x.astype(np.uint16).tobytes() for x in np.split(cell & ((1 << BLOCK) - 1), cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int32)), pa.array(payload, pa.binary())], ["block", "cells"])

    def run(batches):
        held, n = [], 0
        for _, texts in _texts(batches):
            for doc, _, _, anchor, _, _ in runs(*words_of(texts)):
                order = np.lexsort((anchor, doc))
                new = np.concatenate([[True], (np.diff(doc[order]) > 0) | (anchor[order][1:] != anchor[order][:-1])])
                held += _cells(anchor[order][new], bits)
                n += ROWS * np.count_nonzero(new)
            if n > HELD_CELLS:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merge(batches):
    """Arrow pass over sketches sorted by block: bits of the cells that count twice or more."""
    now, counts = None, np.zeros(1 << BLOCK, np.int64)

    def done():
        bits = np.packbits(counts >= 2, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["block", "cells"])

    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                now, counts[:] = block, 0
            counts += np.bincount(np.frombuffer(cells, np.uint16), minlength=1 << BLOCK)
    if now is not None:
        yield done()


def sketch_bits(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = total / 6 / (SPAN + 1) * 2
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(anchors * ROOM, 1)))))


def sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether two documents or more may share an anchor there."""
    parts = docs.select("text").mapInArrow(_sketch(bits), "block int, cells binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, cells binary")
    out = np.zeros(ROWS << (bits - 3), np.uint8)
    for row in merged.toLocalIterator():  # bounded by MOST_BITS
        out[row.block << (BLOCK - 3) : (row.block + 1) << (BLOCK - 3)] = np.frombuffer(row.cells, np.uint8)
    return out


def _twice(bits_of: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([(bits_of[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1 for c in cells])


def _repeated_runs(merged, bits: int):
    """Arrow pass: runs that may be repeated: doc_id, key, code, anchor and the hash of their words."""

    def run(batches):
        for batch, texts in _texts(batches):
            doc, h = words_of(texts)
            offset = np.searchsorted(doc, np.arange(len(texts)))
            for text, start, windows, anchor, one, two in runs(doc, h):
                keep = _twice(merged.value, _cells(anchor, bits))
                text = text[keep]
                if len(text):
                    code = (start[keep] - offset[text]) * CODE + windows[keep]
                    rows = batch.select(["doc_id", "key"]).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(code), *[pa.array(x[keep].view(np.int64)) for x in (anchor, one, two)]], ["doc_id", "key", "code", "anchor", "one", "two"])

    return run


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    lists = batch.column("codes")
    return [np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64) for x in lists]


def _single_windows(batches):
    """Arrow pass: the hashes of the single windows of the runs in ``codes``."""
    for batch, texts in _texts(batches):
        doc, h = words_of(texts)
        offset = np.searchsorted(doc, np.arange(len(texts)))
        codes = _codes(batch)
        row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        code = np.concatenate([*codes, np.zeros(0, np.int64)])
        n = code % CODE
        row, place = np.repeat(row, n), np.repeat(code // CODE, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = place + offset[row]
        for lo in range(0, len(at), SEGMENT):  # in order of documents, so that a part covers few words
            a, r, p = at[lo : lo + SEGMENT], row[lo : lo + SEGMENT], place[lo : lo + SEGMENT]
            base = a.min()
            own = h[base : a.max() + WINDOW]
            one, two = sums(mix(own), _BASE_A), sums(mix(own ^ _U(0x5851F42D4C957F2D)), _BASE_B)
            found = [stretch(s, a - base, a - base + WINDOW, b).view(np.int64) for s, b in ((one, _BASE_A), (two, _BASE_B))]
            ids = batch.select(["doc_id", "key"]).take(pa.array(r))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(p * CODE + 1), *map(pa.array, found)], ["doc_id", "key", "code", "one", "two"])


def kept_words(raw: bytes, codes: np.ndarray) -> tuple[int, list[bytes]]:
    """Number of words, and those that no window in ``codes`` covers."""
    words = raw.split()
    if not len(codes):
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, codes // CODE, 1)
    np.add.at(edge, np.minimum(codes // CODE + codes % CODE + WINDOW - 1, len(words)), -1)
    left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    return len(words), [words[k] for k in left]


def _cut(with_text: bool):
    def run(batches):
        for batch, texts in _texts(batches):
            total, gone, text = [], [], []
            for raw, codes in zip(texts, _codes(batch), strict=True):
                n, kept = kept_words(raw, codes)
                total.append(n)
                gone.append(n - len(kept))
                joined = b" ".join(kept)
                text.append((joined if gone[-1] else raw).decode() if with_text else hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 2)], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], [*batch.schema.names[:-2], "n_words", "n_removed", "kept"])

    return run


def _by_document(places: DataFrame) -> DataFrame:
    """The codes of each document, which are no more than its windows."""
    return places.groupBy("doc_id", "key").agg(F.collect_list("code").alias("codes")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})


def _first(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min("doc_id").alias("least"))


def _join(left: DataFrame, right: DataFrame, *by: str, how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({c: f"_{c}" for c in by})
    return left.join(right.hint("shuffle_hash"), [F.col(c) == F.col(f"_{c}") for c in by], how).drop(*[f"_{c}" for c in by])


def _marked(rows: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (doc_id, key, text and more) with ``codes`` of the windows to cut; saved tables to release later."""
    spark = rows.sparkSession
    read = rows.filter("doc_id IS NOT NULL").select("doc_id", "key", "text")
    bits = sketch_bits(read)
    merged = spark.sparkContext.broadcast(sketch(read, bits))
    run = saved(read.mapInArrow(_repeated_runs(merged, bits), "doc_id long, key long, code long, anchor long, one long, two long"))
    first = _first(run, "anchor", "one", "two")
    mixed = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("anchor").alias("_a"))
    first = first.join(mixed, F.col("anchor") == F.col("_a"), "left").select("anchor", "one", "two", "least", F.col("_a").isNotNull().alias("mixed"))
    settled = saved(_join(run, first, "anchor", "one", "two").filter("doc_id > least OR mixed").select("doc_id", "key", "code", (F.col("doc_id") > F.col("least")).alias("gone")))
    release(run)
    same = [F.col("doc_id") == F.col("_id"), F.col("key") == F.col("_key")]
    open_ = _by_document(settled.filter("NOT gone"))
    single = rows.join(open_.hint("shuffle_hash"), same).select("doc_id", "key", "text", "codes").mapInArrow(_single_windows, "doc_id long, key long, code long, one long, two long")
    places = _join(single, _first(single, "one", "two"), "one", "two").filter("doc_id > least").select("doc_id", "key", "code")
    cut = _by_document(settled.filter("gone").select("doc_id", "key", "code").unionByName(places))
    return rows.join(cut.hint("shuffle_hash"), same, "left").select(*columns, "text", "codes"), [settled]


def _rows(docs: DataFrame, text: str, more: list = ()) -> DataFrame:
    body = text_or_empty(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"), *more)


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    rows, _ = _marked(_rows(docs, text), {"doc_id": "long"})
    return rows.mapInArrow(_cut(False), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without repeated passages. A text that loses words has the others joined by one space, all others stay as they are."""
    (name,) = unused(docs, "_row")
    rows, _ = _marked(_rows(docs, text, [F.struct("*").alias(name)]), {name: "struct"})
    kind = docs.select(F.struct("*").alias(name)).schema.simpleString()[7:-1].replace(":", " ", 1)
    cut = rows.mapInArrow(_cut(True), f"{kind}, n_words long, n_removed long, kept string")
    old = F.col(name)
    return cut.select(*[(F.when(old[c].isNotNull(), F.col("kept")).alias(c) if c == text else old[c].alias(c)) for c in docs.columns])


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM
  (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
c AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS k FROM s JOIN f USING (g) WHERE doc_id > least),
x AS (SELECT rid, doc_id, w, k, w[k] AS v FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
r AS (SELECT rid, count(*) AS n FROM c GROUP BY rid),
t AS (SELECT rid, string_agg(v, ' ' ORDER BY k) AS kept FROM x ANTI JOIN c USING (rid, k) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (rid) LEFT JOIN t USING (rid)
"""
