"""Reports that are let through at a limited rate, and values that are kept for a time.

Whether a report is let through depends on the last one that was. Each report points to the next
that would be let through after it; from the first one of a stretch, pointers that are doubled in
each round reach all, in as many rounds as the number of reports in a stretch has binary digits.
A stretch ends where the stage changes or the pause is long enough, as there the next report is
let through whatever came before. The stream has the same meaning, with a state for each job.

Defined results: null jobs are one job; null stages are a stage of their own; reports at one time
are in the order of ``seq``, which is unique in a job; rows without a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.lineage import ensure_folder

#: Seconds between two reports of a stage, seconds that a value is kept.
PAUSE, KEPT = 1.0, 300.0


def _following(rows: DataFrame, by: list[str], at: str, pause: float) -> DataFrame:
    """Add _next: seq of the first row of the same stretch that is ``pause`` later or more (null if none)."""
    later = rows.select(*by, (F.col(at) + pause).alias("_x"), F.lit(1).alias("_asks"), F.col("seq").alias("_own"), F.lit(None).cast("long").alias("_seq"))
    there = rows.select(*by, F.col(at).alias("_x"), F.lit(0).alias("_asks"), F.lit(None).cast("long").alias("_own"), F.col("seq").alias("_seq"))
    # from the latest on: at equal times a row that asks sees those that are there
    order = Window.partitionBy(*by).orderBy(F.desc("_x"), "_asks", F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    seen = later.unionByName(there).withColumn("_next", F.last("_seq", ignorenulls=True).over(order)).filter("_asks = 1")
    return rows.join(seen.select(*[F.col(c).alias(f"_{c}") for c in by], "_own", "_next"), [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("seq") == F.col("_own")]).drop(*[f"_{c}" for c in by], "_own")


def throttled(reports: DataFrame, job: str = "job", at: str = "at", stage: str = "stage", pause: float = PAUSE) -> DataFrame:
    """The reports (job, at in seconds, stage, seq) that are let through: the first of a job, those of a new stage, and those ``pause`` after the last."""
    ensure_folder(reports.sparkSession)
    rows = reports.filter(F.col(at).isNotNull()).withColumns({at: F.col(at).cast("double"), "seq": F.col("seq").cast("long")})
    before = Window.partitionBy(job).orderBy(at, "seq")
    fresh = F.lag("seq").over(before).isNull() | ~F.col(stage).eqNullSafe(F.lag(stage).over(before)) | (F.col(at) - F.lag(at).over(before) >= pause)
    rows = rows.withColumn("_fresh", fresh).withColumn("_stretch", F.sum(F.col("_fresh").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    by = [job, "_stretch"]
    links = _following(rows.select(*by, at, "seq"), by, at, pause).select(job, "seq", "_next").filter("_next IS NOT NULL").checkpoint()
    through = rows.filter("_fresh").select(job, "seq").checkpoint()
    while not links.isEmpty():
        step = links.select(F.col(job).alias("_job"), F.col("seq").alias("_from"), "_next")
        reached = through.join(step, F.col(job).eqNullSafe(F.col("_job")) & (F.col("seq") == F.col("_from"))).select(job, F.col("_next").alias("seq"))
        through = through.unionByName(reached).distinct().checkpoint()
        then = step.select("_job", "_from", F.col("_next").alias("_then"))
        links = links.join(then, F.col(job).eqNullSafe(F.col("_job")) & (F.col("_next") == F.col("_from"))).select(job, "seq", F.col("_then").alias("_next")).checkpoint()
    kept = through.select(F.col(job).alias("_job"), F.col("seq").alias("_seq"))
    return rows.join(kept, F.col(job).eqNullSafe(F.col("_job")) & (F.col("seq") == F.col("_seq")), "left_semi").drop("_fresh", "_stretch")


def throttled_stream(reports: DataFrame, job: str = "job", at: str = "at", stage: str = "stage", pause: float = PAUSE) -> DataFrame:
    """The same for a stream whose batches come in order of time: job, at, stage, seq. A job's state is its last stage and when it was last let through."""

    def go(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, when = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        keep = []
        for now, name in zip(rows["at"], rows["stage"], strict=True):
            name = None if pd.isna(name) else name
            keep.append(when is None or name != last or now - when >= pause)
            last, when = name, now if keep[-1] else when
        state.update((last, when))
        yield rows[keep]

    kind = dict(reports.dtypes)[job]
    rows = reports.filter(F.col(at).isNotNull()).select(F.col(job).alias("job"), F.col(at).cast("double").alias("at"), F.col(stage).cast("string").alias("stage"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("job").applyInPandasWithState(go, f"job {kind}, at double, stage string, seq long", "stage string, at double", "append", "NoTimeout")


def fetched(asked: DataFrame, key: str = "key", at: str = "at", kept: float = KEPT) -> DataFrame:
    """The look-ups (key, at, seq) that find no value kept from before, so that it is fetched anew and kept for a time: throttling without stages."""
    return throttled(asked.withColumn("_stage", F.lit("")), key, at, "_stage", kept).drop("_stage")
