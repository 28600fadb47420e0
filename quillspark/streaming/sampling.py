"""One pass over training rows: hidden characters, contradictions and a bounded sample, in batch and as a stream.

The sample is the ``k`` rows whose seeded hash is least. That needs no order, may be merged, and a row
that comes late or twice changes nothing that it would not have changed before: a shard of rows keeps
its own ``k`` least, evicts the greatest when one comes that is less, and the sample is the least of
all shards. The batch form ranks within shards first and then once more, so that no task sees more
than k rows of each shard at the end.

Defined results: rows with a null id aren't sampled but audited; null texts are empty; repeated rows
of one id are one row of the sample; null labels contradict nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.scan import hidden_controls

#: Rows of the sample, the seed of its hash.
SAMPLED, SEED = 12_000, "0x58495A48"
SHARDS = 64


def seeded(row: Column, seed: str = SEED) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), row.cast("string")), 256)


def _keyed(rows: DataFrame, row: str, seed: str) -> DataFrame:
    hashed = rows.filter(F.col(row).isNotNull()).select(F.col(row).alias("id"), seeded(F.col(row), seed).alias("hash"))
    return hashed.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(SHARDS)).cast("int"))


def sample(rows: DataFrame, row: str, k: int = SAMPLED, seed: str = SEED) -> DataFrame:
    """id and hash of the k rows with the least seeded hash."""
    each = Window.partitionBy("shard").orderBy("hash")
    kept = _keyed(rows, row, seed).distinct().withColumn("_k", F.row_number().over(each)).filter(F.col("_k") <= k)
    return kept.select("id", "hash").orderBy("hash").limit(k)


def sample_stream(rows: DataFrame, row: str, k: int = SAMPLED, seed: str = SEED) -> DataFrame:
    """For a stream: shard, seen, hash, id of a shard's least rows whenever they change; of a shard the rows with the greatest ``seen`` count."""

    def go(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, hashes, ids = state.get if state.exists else (0, [], [])
        kept = dict(zip(hashes, ids, strict=True))
        before = set(kept)
        for frame in frames:
            seen += len(frame)
            kept |= dict(zip(frame["hash"], frame["id"], strict=True))
            kept = dict(sorted(kept.items())[:k])
        state.update((seen, list(kept), list(kept.values())))
        if set(kept) != before:
            yield pd.DataFrame([(key[0], seen, h, i) for h, i in kept.items()], columns=["shard", "seen", "hash", "id"])

    keyed = _keyed(rows, row, seed).withColumn("id", F.col("id").cast("string"))
    return keyed.groupBy("shard").applyInPandasWithState(go, "shard int, seen long, hash string, id string", "seen long, hashes array<string>, ids array<string>", "update", "NoTimeout")


def merged(shards: DataFrame, k: int = SAMPLED) -> DataFrame:
    """The sample from what the shards of a stream said last: id, hash."""
    last = shards.withColumn("_m", F.max("seen").over(Window.partitionBy("shard"))).filter(F.col("seen") == F.col("_m"))
    return last.select("id", "hash").distinct().orderBy("hash").limit(k)


def clean_only(rows: DataFrame, text: str) -> DataFrame:
    """The rows as they are, in batch or stream; a row with hidden characters ends the pass."""
    found = hidden_controls(F.coalesce(F.col(text), F.lit("")))
    hidden = F.size(found) > 0
    return rows.filter(F.when(hidden, F.raise_error(F.concat(F.lit("hidden characters in a row: "), F.array_join(found, ",")))).otherwise(F.lit(True)))


def summary(rows: DataFrame, row: str, text: str, label: str) -> DataFrame:
    """One row: rows, hidden_rows, first_hidden, contradictions (different texts that have several labels), first_contradiction (least id of one)."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = rows.select(F.col(row).alias("id"), (F.size(hidden_controls(body)) > 0).alias("hidden"), F.sha2(F.trim(F.regexp_replace(body, r"[\x20\x09-\x0D]+", " ")), 256).alias("digest"), F.col(label).alias("label"))
    # a digest has at most two labels here, however many rows: tasks combine them
    texts = df.groupBy("digest").agg(F.count("*").alias("n"), F.count_if("hidden").alias("h"), F.min(F.when(F.col("hidden"), F.col("id"))).alias("first"), F.min("label").alias("a"), F.max("label").alias("b"), F.min("id").alias("least"))
    torn = F.col("a") != F.col("b")
    return texts.agg(F.sum("n").alias("rows"), F.sum("h").alias("hidden_rows"), F.min("first").alias("first_hidden"), F.count_if(torn).alias("contradictions"), F.min(F.when(torn, F.col("least"))).alias("first_contradiction"))
