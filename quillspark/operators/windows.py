"""Training windows around the changes of a fix, and windows of texts that have no pair.

Windows are cut out of a text's bytes inside the row; a character that an edge cuts through is
left out. Null texts are empty; an empty text has one empty window where it has no pair.
Ranks that limit a source are dealt by the hash of the row first, so that a source with a third
of all rows is ranked in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.patches import differences

#: Bytes of a window and of a file, places of a pair that count, the fewer ones of a pair of the large corpus.
WINDOW_BYTES, FILE_BYTES = 1022, 32768
PLACES, FEW_PLACES = 6, 3
#: Characters of the hash that rows are dealt by before they are ranked.
DEAL = 3


def byte_slice(text: Column, start: Column | int, size: int) -> Column:
    """``size`` bytes of a text from a byte (from 0), without the characters that are cut."""
    raw = F.substring(text.cast("binary"), (F.lit(start) if isinstance(start, int) else start) + 1, F.lit(size))
    first, last = F.hex(F.substring(raw, F.lit(1), F.lit(3))), F.hex(F.substring(raw, F.greatest(F.octet_length(raw) - 3, F.lit(0)) + 1, F.lit(4)))
    lead = F.length(F.regexp_extract(first, "^(?:[89AB].)+", 0)) / 2
    tail = F.length(F.regexp_extract(last, "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", 0)) / 2
    whole = F.substring(raw, (lead + 1).cast("int"), F.greatest(F.octet_length(raw) - lead - tail, F.lit(0)).cast("int"))
    return whole.cast("string")


def centered(text: Column, at: Column, size: int) -> Column:
    """First byte of a window around a byte, moved inside the text."""
    most = F.greatest(F.octet_length(text) - size, F.lit(0))
    return F.greatest(F.least(most, at - size // 2), F.lit(0)).cast("int")


def pair_windows(pairs: DataFrame, key: str, few: Column, size: int = WINDOW_BYTES, bad: str = "bad", good: str = "good") -> DataFrame:
    """Windows around the places where the two sides of a pair differ: key, slot, seq, label, kind, start, code.

    The old side has label 1, the new one 0. Each of the first six places gives a window around it,
    one a quarter of a window before and one behind; pairs with ``few`` give the first three places,
    once each. Where the first change begins behind the first window, that one of the old side has
    label 0, so that a head which all files share says nothing. Equal sides count as changed at
    their end. seq is the order within a pair.
    """
    sides = pairs.select(F.col(key).alias("_k"), few.alias("_few"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((bad, "_bad"), (good, "_good"))])
    places = differences(sides, ["_k"], "_bad", "_good").select("_k", "nth", "old_byte", "new_byte").filter(F.col("nth") < PLACES)
    listed = places.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("nth", "old_byte", "new_byte"))).alias("_p"))
    end = F.array(F.struct(F.lit(0).alias("nth"), F.octet_length("_bad").alias("old_byte"), F.octet_length("_good").alias("new_byte")))
    rows = sides.join(listed, "_k", "left").withColumn("_p", F.coalesce("_p", end))
    cut = lambda side, at, label, slot, seq, kind: F.struct(
        slot.alias("slot"), seq.cast("int").alias("seq"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), at.alias("start"), byte_slice(F.col(side), at, size).alias("code"))
    shifts = F.when(F.col("_few"), F.array(F.lit(0))).otherwise(F.array(F.lit(-size // 4), F.lit(0), F.lit(size // 4)))
    chosen = F.slice("_p", 1, F.when(F.col("_few"), FEW_PLACES).otherwise(PLACES))

    def around(p: Column) -> Column:
        def shifted(shift: Column, j: Column) -> Column:
            slot, seq = F.concat_ws(":", p["nth"].cast("string"), shift.cast("string")), (p["nth"] * 3 + j) * 2
            return F.array(
                cut("_bad", centered(F.col("_bad"), p["old_byte"] + shift, size), 1, slot, seq, "paired_diff_hunk"),
                cut("_good", centered(F.col("_good"), p["new_byte"] + shift, size), 0, slot, seq + 1, "paired_diff_hunk"),
            )

        return F.flatten(F.transform(shifts, shifted))

    context = cut("_bad", F.lit(0), 0, F.lit(""), F.lit(1000), "unchanged_context")
    free = F.get("_p", 0)["old_byte"] >= size
    made = F.concat(F.flatten(F.transform(chosen, around)), F.when(free, F.array(context)).otherwise(F.slice(F.array(context), 1, 0)))
    return rows.select(F.col("_k").alias(key), F.explode(made).alias("_w")).select(key, "_w.*")


def source_windows(samples: DataFrame, key: str, label: Column, size: int = WINDOW_BYTES, code: str = "code") -> DataFrame:
    """Windows of texts without a pair: key, seq, label, kind, start, code.

    A positive text gives its first, middle and last window, a negative one a window at a place that its own hash says.
    """
    df = samples.select(key, label.cast("int").alias("label"), F.coalesce(F.col(code), F.lit("")).alias("_t"))
    n = F.octet_length("_t")
    own = (F.conv(F.substring(F.sha2("_t", 256), 1, 8), 16, 10).cast("long") % F.greatest(n - size + 1, F.lit(1))).cast("int")
    three = F.array_sort(F.array_distinct(F.array(F.lit(0), F.greatest(F.expr(f"octet_length(_t) div 2 - {size // 2}").cast("int"), F.lit(0)), F.greatest(n - size, F.lit(0)))))
    starts = F.when(n <= size, F.array(F.lit(0))).when(F.col("label") == 1, three).otherwise(F.array(own))
    df = df.select(key, "label", "_t", F.posexplode(starts).alias("seq", "start"))
    return df.select(key, "seq", "label", F.lit("source_window").alias("kind"), "start", byte_slice(F.col("_t"), F.col("start"), size).alias("code"))


def dealt_rank(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Add a row's rank (from 1) within ``by``, by a hash in hex and then by all that ``order`` holds.

    Rows are dealt by the first characters of the hash, ranked in each part, and the sizes of the parts before are added.
    """
    part = F.substring(F.col(order), 1, DEAL)
    sizes = df.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(by, part).orderBy(order))
    ranked = df.withColumns({"_part_": part, "_own": own})
    return ranked.join(sizes, (F.col(by) == F.col("_by")) & (F.col("_part_") == F.col("_part"))).withColumn(name, F.col("_own") + F.col("_before")).drop("_by", "_part", "_part_", "_own", "_before")


def limit_negatives(samples: DataFrame, negative: Column, positives: DataFrame, limits: dict[str, tuple[float, int]], source: str = "source", order: str = "sample_hash") -> DataFrame:
    """Of the negative rows of a source in ``limits`` (share, least), the first max(floor(share * positives), least) by hash; all others.

    ``positives`` are the windows with label 1 so far; only their number is used.
    """
    limited = negative & F.col(source).isin(*limits)
    n = positives.agg(F.count("*").alias("_all"), F.lit(True).alias("_one"))
    ranked = dealt_rank(samples.filter(limited), source, order, "_rank").withColumn("_one", F.lit(True)).join(F.broadcast(n), "_one")  # one row
    most = F.lit(0)
    for name, (share, least) in limits.items():
        most = F.when(F.col(source) == name, F.greatest(F.floor(F.col("_all") * share), F.lit(least))).otherwise(most)
    return ranked.filter(F.col("_rank") <= most).select(*samples.columns).unionByName(samples.filter(~F.coalesce(limited, F.lit(False))))


def first_of_each(windows: DataFrame, order: list[str], family: str = "family") -> DataFrame:
    """The first of the windows that share family, label and code; null families are empty."""
    said = [c for c in windows.columns if c != "code"]
    same = [F.coalesce(F.col(family).cast("string"), F.lit("")).alias("_family"), F.col("label").alias("_label"), F.sha2("code", 256).alias("_sha")]
    found = windows.groupBy(*same).agg(F.min_by(F.struct(*said, "code"), F.struct(*order)).alias("_w"))
    return found.select("_w.*").select(*windows.columns)


def head_of_file(code: Column, size: int = FILE_BYTES) -> Column:
    """What a file of the other splits keeps."""
    return byte_slice(F.coalesce(code, F.lit("")), 0, size)


#: Tokens of a model's window, of which two are its own marks, tokens that neighbours share, windows that count.
MODEL_TOKENS, MARKS, SHARED, MOST_WINDOWS = 512, 2, 128, 24


def token_windows(n: Column, length: int = MODEL_TOKENS, shared: int = SHARED, most: int = MOST_WINDOWS, marks: int = MARKS) -> Column:
    """Array of (nth, start, end) of the overlapping windows over ``n`` tokens: each but the last is full, neighbours share tokens, the first ``most`` stay."""
    size = length - marks
    step = size - min(shared, length // 2)
    count = F.least(F.lit(most), F.greatest(F.ceil((n - size) / step) + 1, F.lit(1))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("nth"), (k * step).cast("int").alias("start"), F.least(n, k * step + size).cast("int").alias("end")))


def greatest_window(rows: DataFrame, key: str, scores: str, lines: str, **bounds: int) -> DataFrame:
    """key, windows, nth, score, start_line, end_line: the window whose tokens' scores sum to most, the first on ties.

    ``scores`` and ``lines`` hold a number for each token. Rows without tokens have one window of score 0. All is done in the row.
    """
    values = F.coalesce(F.col(scores).cast("array<double>"), F.array().cast("array<double>"))
    total = lambda w: F.aggregate(F.slice("_v", w["start"] + 1, w["end"] - w["start"]), F.lit(0.0), lambda a, x: a + x)
    # the greatest struct has the greatest score, then the first place
    made = lambda w: F.struct(total(w).alias("score"), (-w["nth"]).alias("_o"), F.get("_l", w["start"]).alias("start_line"), F.get("_l", w["end"] - 1).alias("end_line"))
    df = rows.select(key, F.col(lines).alias("_l"), values.alias("_v"), token_windows(F.size(values), **bounds).alias("_w"))
    df = df.select(key, F.size("_w").cast("long").alias("windows"), F.array_max(F.transform("_w", made)).alias("_b"))
    return df.select(key, "windows", (-F.col("_b._o")).alias("nth"), "_b.score", "_b.start_line", "_b.end_line")
