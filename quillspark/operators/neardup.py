"""Near-duplicates by the order of rows: a row goes if an earlier row that stays resembles it.

Signatures of 16 slots are made by numpy on Arrow batches, of every run of tokens of the whole text; texts never leave the first pass.
Rows with one text are one row before anything else, and texts with several labels are set
aside. Rows of one label and signature are one row too: whatever the first comes to, the others go.
Two signatures that agree in all slots but one are equal without that slot, so that rows meet by
equi-joins on label and 15 slots, and all rows of such a bucket resemble one another. Keys that one
row alone has leave before the rounds. In each round the rows that come first in all of their buckets
stay and the rest of these buckets goes; nothing is paired. There are as many rounds as the longest
chain of rows, each of which has to wait for the one before. Lower thresholds meet by bands of four slots,
where only a row that is certain to stay is compared with the rest of its bucket.

Defined results: null texts are empty, and share one signature; null labels are a label of their
own; ``seq`` is unique and says the order; repeated texts keep their first row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lineage import ensure_folder
from quillspark.functions.text import normalize_code

#: What counts as a token, tokens and shingles that ``shingles`` keeps of a very long text, slots, bands, and the numbers of the hash family.
TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|\d+|[^\s]", re.UNICODE)
MOST_TOKENS, ENDS, MIDDLE, SHINGLE, MOST_SHINGLES = 4096, 1536, 512, 5, 512
SLOTS, BAND, THRESHOLD = 16, 4, 0.9
PRIME, STEP = 2**64 - 59, 1_000_003
#: Tokens of a text that are looked at together.
AT_ONCE = 8192

_U = np.uint64


def shingles(text: str) -> set[str]:
    """Runs of five tokens of a normalised text as the rule it follows bounds them: of very long texts those of both ends and the middle, of many those with the least SHA-1. Signatures are of all runs."""
    low = text.lower()
    tokens = TOKEN.findall(low)
    if len(tokens) > MOST_TOKENS:
        half = len(tokens) // 2
        tokens = [*tokens[:ENDS], *tokens[half - MIDDLE : half + MIDDLE], *tokens[-ENDS:]]
    found = {"\x1f".join(tokens[k : k + SHINGLE]) for k in range(max(1, len(tokens) - SHINGLE + 1))}
    return found if len(found) <= MOST_SHINGLES else set(sorted(found, key=lambda x: hashlib.sha1(x.encode()).digest())[:MOST_SHINGLES])


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Numbers of every run of five tokens of a whole text, however long it is, some thousand at a time; repeats change no signature."""
    tokens = (m[0] for m in TOKEN.finditer(text.lower()))
    held = list(islice(tokens, AT_ONCE))
    while True:
        runs = {"\x1f".join(held[k : k + SHINGLE]) for k in range(max(1, len(held) - SHINGLE + 1))}
        yield np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in runs], np.uint64)
        more = list(islice(tokens, AT_ONCE))
        if not more:
            return
        held = held[1 - SHINGLE :] + more


def signature(values: np.ndarray) -> np.ndarray:
    """The least of (2s + 1) * value + (s + 1) * STEP modulo the prime, for each slot s. As 2**64 is 59 modulo the prime, what runs over counts 59 times."""
    out = np.empty(SLOTS, np.uint64)
    high, low = values >> _U(32), values & _U(0xFFFFFFFF)
    for s in range(SLOTS):
        m = _U(2 * s + 1)
        over = (m * high + (m * low >> _U(32))) >> _U(32)
        rest, add = m * values, over * _U(59) + _U((s + 1) * STEP)
        total = rest + add
        total = np.where(total < rest, total + _U(59), total)
        out[s] = np.where(total >= _U(PRIME), total - _U(PRIME), total).min()
    return out


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for text in frame["text"]:
            found.append(np.minimum.reduce([signature(x) for x in _hashes(text)]).view(np.int64))
        yield pd.DataFrame({"seq": frame["seq"], "label": frame["label"], "sig": found})


def signatures(rows: DataFrame, seq: str, label: str, text: str) -> DataFrame:
    """seq, label and sig of every row."""
    read = rows.select(F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("label"), normalize_code(text).alias("text"))
    return read.mapInPandas(_signed, "seq long, label string, sig array<long>")


def resembling(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """seq of the rows (seq, label, sig) that an earlier row of their label resembles which stays itself."""
    signed = signed.checkpoint()
    first = signed.groupBy("label", "sig").agg(F.min("seq").alias("seq")).checkpoint()
    gone = signed.join(first.select(F.col("seq").alias("_seq")), F.col("seq") == F.col("_seq"), "left_anti").select("seq")
    if threshold * SLOTS > SLOTS - 1:
        return gone
    if threshold * SLOTS > SLOTS - 2:
        return gone.unionByName(_but_for_a_slot(first))
    return gone.unionByName(_by_bands(first, threshold))


def _but_for_a_slot(rows: DataFrame) -> DataFrame:
    """seq of the rows that go where two rows are alike if they agree in all slots but one."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.struct(k.alias("k"), F.concat(F.slice("sig", F.lit(1), k), F.slice("sig", k + 2, F.lit(SLOTS))).alias("slots")))
    keys = rows.select("seq", F.explode(F.transform(slots, lambda x: F.xxhash64("label", x["k"], x["slots"]))).alias("_key"))
    several = keys.groupBy("_key").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).filter("a < b").select("_key")
    open_rows = keys.join(several, "_key", "left_semi").select(F.col("seq").alias("_seq")).distinct()
    left = rows.join(open_rows, F.col("seq") == F.col("_seq"), "left_semi").select("seq", "label", F.explode(slots).alias("b")).select("seq", F.struct("label", "b.k", "b.slots").alias("bucket")).checkpoint()
    gone = left.limit(0).select("seq")
    while not left.isEmpty():
        heads = left.groupBy("bucket").agg(F.min("seq").alias("_first")).withColumnRenamed("bucket", "_bucket")
        met = left.join(heads, F.col("bucket") == F.col("_bucket")).select("seq", "_first")
        stays = met.groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("_first")).alias("_all")).filter("_all").select(F.col("seq").alias("_seq")).checkpoint()
        go = met.filter(F.col("seq") > F.col("_first")).join(stays, F.col("_first") == F.col("_seq"), "left_semi").select("seq").distinct().checkpoint()
        gone = gone.unionByName(go)
        left = left.join(go.select(F.col("seq").alias("_seq")).unionByName(stays), F.col("seq") == F.col("_seq"), "left_anti").checkpoint()
    return gone


def _by_bands(rows: DataFrame, threshold: float) -> DataFrame:
    """seq of the rows that go where two rows are alike if they share a band and agree in ``threshold`` of the slots."""
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)), lambda k: F.struct(k.alias("k"), F.slice("sig", k * BAND + 1, BAND).alias("slots"))))
    left = rows.withColumn("b", bands).select("seq", "sig", F.struct("label", "b.k", "b.slots").alias("bucket")).checkpoint()
    gone = left.limit(0).select("seq")
    agree = F.aggregate(F.zip_with("sig", "_sig", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    while not left.isEmpty():
        heads = left.groupBy("bucket").agg(F.min("seq").alias("_first")).withColumnRenamed("bucket", "_bucket")
        met = left.join(heads, F.col("bucket") == F.col("_bucket"))
        stays = met.groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("_first")).alias("_all")).filter("_all").select(F.col("seq").alias("_seq"))
        winners = left.join(stays, F.col("seq") == F.col("_seq"), "left_semi").select(F.col("seq").alias("_seq"), F.col("bucket").alias("_bucket"), F.col("sig").alias("_sig"))
        near = left.join(winners, (F.col("bucket") == F.col("_bucket")) & (F.col("seq") > F.col("_seq"))).filter(agree >= threshold * SLOTS).select("seq").distinct().checkpoint()
        gone = gone.unionByName(near)
        settled = near.select(F.col("seq").alias("_seq")).unionByName(stays)
        left = left.join(settled, F.col("seq") == F.col("_seq"), "left_anti").checkpoint()
    return gone


def near_dedup(rows: DataFrame, seq: str, label: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """seq and reason (kept, copy, conflict, near) of every row."""
    ensure_folder(rows.sparkSession)
    own = rows.select(F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("label"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    same = own.groupBy("digest").agg(F.min("seq").alias("first"), F.min("label").alias("a"), F.max("label").alias("b")).withColumnRenamed("digest", "_digest")
    first = own.join(same, F.col("digest") == F.col("_digest")).select("seq", F.when(F.col("a") != F.col("b"), "conflict").when(F.col("seq") > F.col("first"), "copy").alias("reason")).checkpoint()
    alone = rows.join(first.filter("reason IS NULL").select(F.col("seq").alias("_s")), F.col(seq).cast("long") == F.col("_s"), "left_semi")
    gone = resembling(signatures(alone, seq, label, text), threshold)
    near = gone.select(F.col("seq").alias("_seq"), F.lit("near").alias("_near"))
    return first.join(near, F.col("seq") == F.col("_seq"), "left").select("seq", F.coalesce("reason", "_near", F.lit("kept")).alias("reason"))
