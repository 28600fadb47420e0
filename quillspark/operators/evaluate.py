"""Scores in, metrics out: confusion matrices, threshold searches, gates and coverage.

A score table has a 0/1 ``label`` and a ``p`` in [0, 1]; ``by`` columns split it. Counts are
plain aggregates, so that a metric over any number of rows costs one shuffle of its groups.
Threshold searches first count scores by value; only those counts meet the thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a model must reach before it is released.
MIN_PRECISION, MAX_FPR, MAX_FNR = 0.90, 0.10, 0.10


def _over(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics_of_counts(df: DataFrame) -> DataFrame:
    """Add samples, accuracy, precision, recall, f1, fpr and fnr to rows of tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = df.withColumn("samples", tp + fp + fn + tn)
    df = df.withColumns({
        "accuracy": _over(tp + tn, F.col("samples")), "precision": _over(tp, tp + fp), "recall": _over(tp, tp + fn),
        "fpr": _over(fp, fp + tn), "fnr": _over(fn, tp + fn),
    })
    both = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def confusion(scores: DataFrame, threshold: float | Column = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn of each group; a row without label or score counts nowhere."""
    hit = F.col("p") >= threshold
    count = lambda cond: F.count_if(cond).cast("long")
    pos, neg = F.col("label") == 1, F.col("label") == 0
    return scores.groupBy(*by).agg(count(pos & hit).alias("tp"), count(neg & hit).alias("fp"), count(pos & ~hit).alias("fn"), count(neg & ~hit).alias("tn"))


def evaluate(scores: DataFrame, threshold: float | Column = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    return metrics_of_counts(confusion(scores, threshold, by))


def brier(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean squared error of p against the label."""
    return scores.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2))).alias("brier"), F.count("*").alias("samples"))


def segments(scores: DataFrame, by: str, threshold: float = 0.5, least: int = 5) -> DataFrame:
    """Metrics of each value of ``by``; under ``least`` rows, or of one class only, recall and fpr alone."""
    df = evaluate(scores.withColumn(by, F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("unknown"))), threshold, (by,))
    full = (F.col("samples") >= least) & (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    df = df.withColumn("insufficient", ~full)
    df = df.withColumns({c: F.when(~F.col("insufficient"), F.col(c)) for c in ("accuracy", "precision", "f1", "fnr")})
    return df.withColumns({"recall": F.when(F.col("tp") + F.col("fn") > 0, F.col("recall")), "fpr": F.when(F.col("fp") + F.col("tn") > 0, F.col("fpr"))})


def pooled(counts: DataFrame) -> DataFrame:
    """Micro metrics of matrices summed over rows; null if any row lacks a count."""
    whole = F.every(F.col("tp").isNotNull() & F.col("fp").isNotNull() & F.col("fn").isNotNull() & F.col("tn").isNotNull())
    return metrics_of_counts(counts.agg(*[F.when(whole, F.sum(c)).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def worst_case(metrics: DataFrame) -> DataFrame:
    """The least of the good and the greatest of the bad metrics over rows."""
    return metrics.agg(
        *[F.min(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")], *[F.max(c).alias(c) for c in ("fpr", "fnr")], F.sum("samples").alias("samples")
    )


def at_thresholds(scores: DataFrame, thresholds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each group at each ``threshold`` of a table.

    Scores are counted by value first; both tables are then merged in one ordered window
    that sums from the top, so that no threshold meets every score.
    """
    counts = scores.groupBy(*by, F.col("p").alias("x")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    groups = counts.select(*by).distinct() if by else None
    marks = thresholds.select(F.col("threshold").alias("x")).distinct()
    marks = marks.crossJoin(F.broadcast(groups)) if by else marks
    rows = counts.withColumn("mark", F.lit(0)).unionByName(marks.select(*by, "x", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(1).alias("mark")))
    above = Window.partitionBy(*by).orderBy(F.desc("x"), "mark")
    whole = Window.partitionBy(*by)
    rows = rows.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "_p": F.sum("pos").over(whole), "_n": F.sum("neg").over(whole)})
    rows = rows.filter("mark = 1").withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    return metrics_of_counts(rows.select(*by, F.col("x").alias("threshold"), "tp", "fp", "fn", "tn"))


def grid(spark, first: int, last: int, of: float) -> DataFrame:
    """Thresholds first/of .. last/of."""
    return spark.range(first, last + 1).select((F.col("id") / F.lit(of)).alias("threshold"))


def passes(df: DataFrame) -> Column:
    return (F.col("precision") >= MIN_PRECISION) & (F.col("fpr") <= MAX_FPR) & (F.col("fnr") <= MAX_FNR)


def search_gated(scores: DataFrame, position: float = 0.5) -> DataFrame:
    """Threshold of a 201-point grid and all scores: the best that passes the gate, else the least deficient.

    Ties of the whole rank form a plateau from its least to its greatest threshold (gaps
    count in); the decision is the point of it at ``position``.
    """
    marks = grid(scores.sparkSession, 0, 200, 200.0).unionByName(scores.select(F.col("p").alias("threshold")))
    at = at_thresholds(scores, marks)
    short = F.greatest(F.lit(0.0), MIN_PRECISION - F.col("precision")) + F.greatest(F.lit(0.0), F.col("fpr") - MAX_FPR) + F.greatest(F.lit(0.0), F.col("fnr") - MAX_FNR)
    at = at.withColumn("ok", passes(at)).withColumn("short", short)
    good = F.struct("f1", "precision", "recall", (-F.col("fpr")).alias("x"), F.lit(0.0).alias("y"))
    poor = F.struct((-F.col("short")).alias("f1"), F.col("f1").alias("precision"), F.col("precision").alias("recall"), (-F.col("fpr")).alias("x"), (-F.col("fnr")).alias("y"))
    at = at.withColumn("rank", F.struct("ok", F.when(F.col("ok"), good).otherwise(poor).alias("r")))
    # one row: the best rank; it joins its equals
    best = at.agg(F.max("rank").alias("rank"))
    low, high = F.min("threshold"), F.max("threshold")
    out = at.join(F.broadcast(best), "rank").groupBy("ok").agg(low.alias("low"), high.alias("high"), *[F.first(c).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr")])
    out = out.withColumn("decision", F.col("low") + (F.col("high") - F.col("low")) * F.lit(position))
    return out.withColumns({"uncertain_low": F.greatest(F.lit(0.05), F.col("decision") - 0.10), "uncertain_high": F.least(F.lit(0.95), F.col("decision") + 0.05)}).withColumnRenamed("ok", "gate_passed")


def search_grid_f1(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first threshold of 0.10, 0.11 .. 0.90 with the greatest f1."""
    at = at_thresholds(scores, grid(scores.sparkSession, 10, 90, 100.0), by)
    best = at.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"), "precision", "recall", "fpr", "fnr")).alias("b"))
    return best.select(*by, (-F.col("b.t")).alias("threshold"), "b.f1", "b.precision", "b.recall", "b.fpr", "b.fnr")


def search_stable(scores: DataFrame, position: float = 0.75) -> DataFrame:
    """In the widest run of neighbouring thresholds that pass the gate, the one nearest to ``position``."""
    at = at_thresholds(scores, grid(scores.sparkSession, 10, 90, 100.0))
    ok = at.filter(passes(at)).withColumn("step", F.round(F.col("threshold") * 100).cast("long"))
    ok = ok.withColumn("run", F.col("step") - F.row_number().over(Window.orderBy("step")))
    runs = ok.groupBy("run").agg(F.count("*").alias("n"), F.avg("f1").alias("mean"), F.min("threshold").alias("low"), F.max("threshold").alias("high"))
    widest = runs.agg(F.max(F.struct("n", "mean", (-F.col("run")).alias("r"), "low", "high")).alias("w")).select((-F.col("w.r")).alias("run"), F.col("w.n").alias("width"), "w.low", "w.high")
    target = F.col("low") + (F.col("high") - F.col("low")) * F.lit(position)
    near = ok.join(F.broadcast(widest), "run").withColumn("k", F.struct(F.abs(F.col("threshold") - target).alias("d"), (-F.col("f1")).alias("f"), (F.col("fpr") + F.col("fnr")).alias("e"), "threshold"))
    return near.agg(F.min("k").alias("k"), F.first("width").alias("width"), F.first("low").alias("low"), F.first("high").alias("high")).filter("k IS NOT NULL").select(F.col("k.threshold").alias("threshold"), "width", "low", "high")


def search_centered(scores: DataFrame, center: float = 0.80) -> DataFrame:
    """Of 0.70, 0.71 .. 0.85 the threshold with the least violation, then greatest f1, then nearest to ``center``."""
    at = at_thresholds(scores, grid(scores.sparkSession, 70, 85, 100.0))
    short = F.greatest(F.lit(0.0), MIN_PRECISION - F.col("precision")) + F.greatest(F.lit(0.0), F.col("fpr") - MAX_FPR) + F.greatest(F.lit(0.0), F.col("fnr") - MAX_FNR)
    key = F.struct(short.alias("violations"), (-F.col("f1")).alias("f"), F.abs(F.col("threshold") - F.lit(center)).alias("d"), "threshold")
    return at.agg(F.min(key).alias("k")).select(F.col("k.threshold").alias("threshold"), F.col("k.violations").alias("violations"), (-F.col("k.f")).alias("f1"))


def search_scores(scores: DataFrame) -> DataFrame:
    """Of 0.5 and all scores, the threshold with the greatest (f1, precision, -fpr); the least one on ties."""
    marks = scores.select(F.col("p").alias("threshold")).unionByName(scores.sparkSession.range(1).select(F.lit(0.5).alias("threshold")))
    at = at_thresholds(scores, marks)
    key = F.struct("f1", "precision", (-F.col("fpr")).alias("x"), (-F.col("threshold")).alias("t"))
    return at.agg(F.max(key).alias("k")).select((-F.col("k.t")).alias("threshold"), "k.f1", "k.precision", (-F.col("k.x")).alias("fpr"))


def rank_auc(scores: DataFrame, by: tuple[str, ...] = (), mid_rank: bool = False) -> DataFrame:
    """Area under the ROC curve by rank sums.

    Equal scores are ordered by label, which favours positives, unless ``mid_rank`` gives
    them their mean rank. Ranks come from counts by score, summed in order.
    """
    counts = scores.groupBy(*by, "p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    before = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum(F.col("pos") + F.col("neg")).over(before), F.lit(0)))
    pos, neg = F.col("pos"), F.col("neg")
    # ranks of the positives of a score: after all below and, or among, the negatives of it
    high = pos * (F.col("below") + neg) + pos * (pos + 1) / 2
    mid = pos * (F.col("below") + (pos + neg + 1) / 2)
    sums = counts.groupBy(*by).agg(F.sum(mid if mid_rank else high).alias("r"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    area = (F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * F.col("negatives"))
    return sums.withColumn("auc", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), area).otherwise(F.lit(0.0))).drop("r")


def average_precision(scores: DataFrame) -> DataFrame:
    """Sum of precision times the step of recall over falling scores."""
    counts = scores.groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("n"))
    above = Window.orderBy(F.desc("p"))
    counts = counts.withColumns({"tp": F.sum("pos").over(above), "all": F.sum("n").over(above)})
    return counts.agg((F.sum(F.col("tp") * F.col("pos") / F.col("all")) / F.sum("pos")).alias("average_precision"))


def language_coverage(samples: DataFrame, minimums: dict[str, int]) -> DataFrame:
    """Counts of both classes in each split by language, and whether all reach their minimum (missing cells count 0)."""
    cells = [F.count_if((F.col("split") == s) & (F.col("label") == v)).alias(f"{s}_{n}") for s in minimums for v, n in ((1, "positive"), (0, "negative"))]
    df = samples.groupBy("lang").agg(*cells)
    ok = F.lit(True)
    for s, least in minimums.items():
        ok = ok & (F.col(f"{s}_positive") >= least) & (F.col(f"{s}_negative") >= least)
    return df.withColumn("eligible", ok)


def sigmoid(x: Column, clamp: float = 30.0, temperature: float = 1.0) -> Column:
    z = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), x / F.lit(temperature)))
    return 1 / (1 + F.exp(-z))


def fit_temperature(logits: DataFrame, rounds: int = 30) -> DataFrame:
    """The temperature in [0.05, 20] with the least log loss, by a ladder of ever finer grids over counted logits."""
    spark = logits.sparkSession
    counts = logits.groupBy("logit").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    low, high, best = 0.05, 20.0, 1.0
    for _ in range(max(1, rounds // 10)):
        steps = [low * (high / low) ** (k / 20) for k in range(21)]
        marks = F.broadcast(spark.createDataFrame([(t,) for t in steps], "t double"))
        loss = F.col("pos") * F.log1p(F.exp(-F.col("logit") / F.col("t"))) + F.col("neg") * F.log1p(F.exp(F.col("logit") / F.col("t")))
        best = counts.crossJoin(marks).groupBy("t").agg(F.sum(loss).alias("loss")).orderBy("loss", "t").first()["t"]
        k = steps.index(best)
        low, high = steps[max(0, k - 1)], steps[min(20, k + 1)]
    return spark.createDataFrame([(best,)], "temperature double")


def clamp_threshold(t: Column, low: float = 0.01, high: float = 0.85) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(t, F.lit(high))))


def counts_of_rates(df: DataFrame) -> DataFrame:
    """tp, fp, fn, tn from positives, negatives, recall and fpr (half to even)."""
    tp, fp = F.bround(F.col("positives") * F.col("recall")).cast("long"), F.bround(F.col("negatives") * F.col("fpr")).cast("long")
    return df.withColumns({"tp": tp, "fp": fp}).withColumns({"fn": F.col("positives") - F.col("tp"), "tn": F.col("negatives") - F.col("fp")})


def quality_gate(samples: DataFrame, minimums: dict[str, int]) -> DataFrame:
    """One row of checks: each class has its minimum, no text has two labels, both classes in each split."""
    conflicts = samples.groupBy("sample_hash").agg(F.count_distinct("label").alias("k")).agg(F.count_if(F.col("k") > 1).alias("conflicts"))
    cells = [F.count_if((F.col("split") == s) & (F.col("label") == v)).alias(f"{s}_{v}") for s in ("train", "validation", "test") for v in (0, 1)]
    one = samples.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), *cells).crossJoin(conflicts)
    both = F.lit(True)
    for s in ("train", "validation", "test"):
        both = both & (F.col(f"{s}_0") > 0) & (F.col(f"{s}_1") > 0)
    out = one.select(
        (F.col("positives") >= minimums["positive"]).alias("minimum_positive"), (F.col("negatives") >= minimums["negative"]).alias("minimum_negative"),
        (F.col("conflicts") == 0).alias("no_label_conflicts"), both.alias("both_classes_in_each_split"),
    )
    return out.withColumn("passed", F.col("minimum_positive") & F.col("minimum_negative") & F.col("no_label_conflicts") & F.col("both_classes_in_each_split"))
