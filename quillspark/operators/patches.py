"""Unified diffs: each file before and after, rebuilt from its hunks, and pairs of them seen once.

Null and empty texts hold no file; texts without a diff header give no row.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillspark.functions.lineage import ensure_folder
from quillspark.functions.text import LINE_BREAK, suffix
from quillspark.operators.selection import is_production

#: Languages read, bytes kept of a side, characters that a side needs.
LANGUAGES = {".go": "go", ".php": "php"}
MAX_CODE_BYTES, MIN_CODE_CHARACTERS = 64 * 1024, 16
#: So many values or rows (some 100 bytes each) travel with a join of ``keep_unseen``.
MAX_BROADCAST = 500_000
#: So many places in the order (some 50 bytes each) do.
MAX_PLACES = 2_000_000
_BLANK = r"[\s\x1c-\x1f]+"
_NO_NEWLINE = "\\ No newline at end of file"


def _rest(values: Column) -> Column:
    return F.slice(values, 2, F.size(values))


def _header(block: Column, mark: str) -> Column:
    path = F.regexp_extract(block, rf"(?:^|\n){mark} ([^\n\t]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), '^"+|"+$', "")
    return F.regexp_replace(path, "^[ab]/", "")


def _side(lines: Column, other: str) -> Column:
    """One side of a hunk: its lines and the context, without their marks."""
    own = F.filter(lines, lambda x: ~x.startswith(other) & (x != _NO_NEWLINE))
    return F.array_join(F.transform(own, lambda x: F.regexp_replace(x, "^[-+ ]", "")), "\n")


def hunks(block: Column) -> Column:
    """The hunks of one file's diff that change more than white space: array of (bad, good)."""
    bodies = _rest(F.split(block, r"\n@@ [^\n]*", -1))
    lines = F.transform(bodies, lambda x: F.split(F.substring(x, 2, 2**31 - 1), "\n", -1))
    changed = F.filter(lines, lambda x: F.exists(x, lambda y: y.rlike("^[-+]")))
    sides = F.transform(changed, lambda x: F.struct(_side(x, "+").alias("bad"), _side(x, "-").alias("good")))
    bare = lambda x: F.regexp_replace(x, f"(?U){_BLANK}", "")
    return F.filter(sides, lambda x: bare(x["bad"]) != bare(x["good"]))


def _bounded(code: Column, limit: int) -> Column:
    """The first bytes of a text, without a character that the cut divides."""
    raw = F.substring(code.cast("binary"), 1, limit).cast("string")
    cut = F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "\ufffd$", ""))
    return F.when(F.octet_length(code) <= limit, code).otherwise(cut)


def read_patches(patches: DataFrame, key: str, text: str = "text", limit: int = MAX_CODE_BYTES) -> DataFrame:
    """key, nth, language, file_path, bad_code, good_code: production files that a patch changes, in the patch's order.

    Files added or deleted, files of other languages, and sides that are short or equal are left out.
    """
    files = patches.select(key, F.posexplode(_rest(F.split(F.col(text), "(?md)^diff --git ", -1))).alias("nth", "block"))
    block = F.regexp_replace(F.regexp_replace("block", LINE_BREAK, "\n"), r"\n\z", "")
    files = files.select(key, "nth", F.explode(F.array(block)).alias("block"))
    files = files.select(key, "nth", "block", _header(F.col("block"), "---").alias("old"), _header(F.col("block"), r"\+\+\+").alias("file_path"))
    language = reduce(lambda found, x: found.when(suffix("file_path") == x[0], x[1]), LANGUAGES.items(), F.when(F.lit(False), None))
    files = files.withColumn("language", language).filter(F.col("language").isNotNull() & (F.col("old") != "/dev/null") & is_production(F.col("file_path"), F.col("language")))
    files = files.select(key, "nth", "language", "file_path", F.explode(F.array(hunks(F.col("block")))).alias("hunks")).filter(F.size("hunks") > 0)  # made once, not once a use
    whole = lambda name: _bounded(F.array_join(F.col(f"hunks.{name}"), "\n\n"), limit).alias(f"{name}_code")
    files = files.select(key, "nth", "language", "file_path", F.inline(F.array(F.struct(whole("bad"), whole("good")))))
    long_enough = lambda c: F.length(F.regexp_replace(c, f"(?U)^{_BLANK}|{_BLANK}$", "")) >= MIN_CODE_CHARACTERS
    return files.filter(long_enough("bad_code") & long_enough("good_code") & (F.col("bad_code") != F.col("good_code")))


def keep_unseen(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Rows that share no value, in any of the columns, with an earlier row that stays. ``order`` is unique (rows of one place in it stay or go together); nulls are shared with nobody, rows of nulls alone stay.

    Each round keeps the rows that come first for all their values and drops what shares one with
    them; the rest goes on. A round shuffles the first row of each value (a task's rows come down to one
    a value before), and saves the rest as order and hashes (whole numbers as they are); nothing else of a row is ever moved.
    What a round settles is looked up by broadcast up to MAX_BROADCAST values or MAX_PLACES places; beyond, the same join shuffles.
    """
    ensure_folder(rows.sparkSession)
    n = len(values)
    small = lambda df, count: F.broadcast(df) if count <= MAX_BROADCAST else df
    whole_numbers = all(isinstance(rows.schema[v].dataType, IntegralType) for v in values)
    same = lambda c: c.cast("long") if whole_numbers else F.unhex(F.sha2(c.cast("string"), 256))
    left = rows.select(F.col(order).alias("at"), *[same(F.col(v)).alias(f"v{k}") for k, v in enumerate(values)]).filter(F.coalesce(*[F.col(f"v{k}") for k in range(n)]).isNotNull())
    kept, total = [], 0
    while True:
        own = F.array(*[F.col(f"v{k}") for k in range(n)])
        first = left.select("at", F.size(F.array_compact(F.array_distinct(own))).alias("n"), F.explode(own).alias("value")).filter("value IS NOT NULL")
        first = first.groupBy("value").agg(F.min("at").alias("at"), F.min_by("n", "at").alias("n")).checkpoint()
        likely = first.groupBy("at").agg(F.count("*").alias("firsts"), F.min("n").alias("n")).filter("firsts >= n").select(F.col("at").alias("_at"), "firsts").checkpoint()
        # rows of one place in the order count as one row with the values of all
        whole = left.join(small(likely, likely.count()), F.col("at") == F.col("_at")).select("at", "firsts", F.explode(own).alias("value"))
        winners = whole.groupBy("at", "firsts").agg(F.count_distinct("value").alias("n")).filter("firsts = n").select("at").checkpoint()
        won = winners.count()
        if not won:
            break
        kept.append(winners)
        total += won
        taken = first.join(small(winners, won), "at", "left_semi").select("value")
        seen, marked = F.lit(False), left
        for k in range(n):
            marked = marked.join(small(taken.select(F.col("value").alias(f"t{k}")), n * won), F.col(f"v{k}") == F.col(f"t{k}"), "left")
            seen = seen | F.col(f"t{k}").isNotNull()
        rest = marked.filter(~seen).select(left.columns).checkpoint()
        places = rest.select(F.col("at").alias("_at")).distinct().checkpoint()
        count = places.count()
        places = F.broadcast(places) if count <= MAX_PLACES else places
        torn = marked.filter(seen).select("at").join(places, F.col("at") == F.col("_at"), "left_semi").distinct().checkpoint()
        left = rest.join(small(torn, count), "at", "left_anti").checkpoint()
    bare = F.coalesce(*[F.col(v).cast("string") for v in values]).isNull()
    if not kept:
        return rows.filter(bare)
    stays = reduce(DataFrame.union, kept).select(F.col("at").alias("_kept"))
    return rows.join(small(stays, total), F.col(order) == F.col("_kept"), "left").filter(F.col("_kept").isNotNull() | bare).drop("_kept")


#: Regions and characters that a task gathers before it hands them on.
SENT_ROWS, SENT_CHARS = 1_000, 4_000_000


def changed_regions(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, start_line, end_line, added: for each place where two texts differ, the lines of the old one and what the new one has there.

    Lines are matched by longest common runs, popular ones too. Places of insertion hold the line they stand before.
    Null texts are empty; equal texts give no row.
    """
    schema = pairs.select(key, F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.lit("")).alias("added")).schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows, types: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[key, "start_line", "end_line", "added"])
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.string())]
            # one pair's texts at a time, and what comes of them goes before it is much
            rows, chars = [], 0
            for k, old, new in zip(*batch.columns, strict=True):
                old, new = old.as_py().splitlines(), new.as_py().splitlines()
                for kind, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                    if kind != "equal":
                        rows.append((k.as_py(), a + 1, max(a + 1, b), new[c:d]))
                        chars += sum(map(len, new[c:d]))
                if len(rows) >= SENT_ROWS or chars >= SENT_CHARS:
                    yield made(rows, types)
                    rows, chars = [], 0
            if rows:
                yield made(rows, types)

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = pairs.select(F.col(key).alias("k"), text(before).alias("old"), text(after).alias("new"))
    return rows.mapInArrow(go, schema)


def differences(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Places where two texts differ: the keys, nth, old_start, old_end, new_start, new_end (lines from 0, ends not included), old_byte, new_byte.

    Lines are matched by longest common runs, with their line ends; the last two say how many bytes
    stand before the place. Null texts are empty; equal texts give no row.
    """
    numbers = ("nth", "old_start", "old_end", "new_start", "new_end", "old_byte", "new_byte")

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *key, old, new in frame.itertuples(index=False, name=None):
                old, new = old.splitlines(keepends=True), new.splitlines(keepends=True)
                codes = [c for kind, *c in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if kind != "equal"]
                before = [[0, *accumulate(len(x.encode(errors="replace")) for x in side)] for side in ((old, new) if codes else ())]
                rows += [(*key, n, *c, before[0][c[0]], before[1][c[2]]) for n, c in enumerate(codes)]
            yield pd.DataFrame(rows, columns=[*keys, *numbers])

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = pairs.select(*keys, text(before).alias("_old"), text(after).alias("_new"))
    return rows.mapInPandas(go, pairs.select(*keys, *[F.lit(1).alias(c) for c in numbers]).schema)
