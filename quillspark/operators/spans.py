"""Functions of Java code by their braces, and labels of lines.

A text is cut at its braces once, inside the row; what leaves it are events (a brace, the line
ends and characters before it, and the function that it opens, if any), not the text. Nesting
depth is a running sum over the events of a text. At one depth a closing brace follows each
opening one, so that a span ends at the next event of its depth. No event is compared with
more than its neighbour, whatever the size of the text.

Null or empty texts have no functions; a body that is never closed ends with the text; repeated
rows with one key would be one text, so that keys must be unique; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import patches

#: What a function's head looks like up to its brace. A type may be any words of these characters.
_TYPE = r"\w$<>\[\],.?@"
HEAD = rf"(?mdU)^\s*[{_TYPE}][{_TYPE}\s]*\s([A-Za-z_$][\w$]*)\s*\([^;{{}}]*\)\s*(?:throws\s+[^{{]+)?\z"
#: Confidence of a label that comes from a fix, and the most that a rule's location may have.
FIX_CONFIDENCE, RULE_CONFIDENCE = 0.95, 0.9


def _lines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _events(text: Column) -> Column:
    """An array for each text: side (1 opens, -1 closes), lines and chars since the event before, name and head_lines of a function that opens."""
    parts = F.split(text, r"\{", -1)

    def of_part(part: Column, k: Column) -> Column:
        # a head may not begin in the middle of a line: behind a brace the line goes on
        start = F.when(k > 0, F.concat(F.lit("{"), part)).otherwise(part)
        # without a clause of exceptions a head holds neither ; nor }, so that what stands behind the last of them is enough
        last = F.substring_index(F.substring_index(part, ";", -1), "}", -1)
        short = F.when(F.length(last) < F.length(part), F.concat(F.lit(";"), last)).otherwise(start)
        tail = F.when(F.contains(part, F.lit("throws")), start).when(part.rlike(r"(?U)\)\s*\z"), short).otherwise(F.lit(""))
        head, name = F.regexp_extract(tail, HEAD, 0), F.regexp_extract(tail, HEAD, 1)
        closed = F.split(part, r"\}", -1)
        kind = lambda side, x, first, named: F.struct(
            F.lit(side).alias("side"), _lines(x).alias("lines"), (F.length(x) + F.when(first, 0).otherwise(1)).alias("chars"),
            (F.nullif(name, F.lit("")) if named else F.lit(None).cast("string")).alias("name"), (_lines(head) if named else F.lit(0)).alias("head_lines"))
        closing = F.transform(F.slice(closed, F.lit(1), F.size(closed) - 1), lambda x, i: kind(-1, x, (k == 0) & (i == 0), False))
        last = F.element_at(closed, -1)
        return F.concat(closing, F.array(kind(1, last, (k == 0) & (F.size(closed) == 1), True)))

    # the last part opens nothing: its own event only says where the text ends
    return F.flatten(F.transform(parts, of_part))


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def functions(docs: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """The key's columns, nth, name, start_line, end_line, body_start, body_end and depth of the functions of each text, nth in order of place.

    The body is what stands from body_start (0-based, behind the brace) up to body_end. Braces in
    strings and comments count like others; mask the text first where they should not.
    """
    key = _names(key)
    df = docs.select(*key, F.col(text).alias("_t")).filter(F.contains("_t", F.lit("{")) & F.contains("_t", F.lit("(")))
    df = df.select(*key, F.posexplode(_events(F.col("_t"))).alias("_at", "_e")).select(*key, "_at", "_e.*")
    by_place = Window.partitionBy(*key).orderBy("_at")
    order = by_place.rowsBetween(Window.unboundedPreceding, 0)
    # the very last event of a text is its end: it opens nothing and closes what is open
    df = df.withColumns({"_depth": F.sum("side").over(order), "_line": F.sum("lines").over(order) + 1, "_char": F.sum("chars").over(order), "_end": F.lead("side").over(by_place).isNull()})
    level = F.when(F.col("side") > 0, F.col("_depth")).otherwise(F.col("_depth") + 1)
    total = Window.partitionBy(*key)
    df = df.withColumns({"_level": level, "_last_line": F.max("_line").over(total), "_chars": F.max("_char").over(total)})
    same = Window.partitionBy(*key, "_level").orderBy("_at")
    follow = lambda c: F.lead(F.when(~F.col("_end"), F.col(c))).over(same)
    df = df.withColumns({"_to_line": F.coalesce(follow("_line"), F.col("_last_line")), "_to": F.coalesce(follow("_char"), F.col("_chars"))})
    df = df.filter(F.col("name").isNotNull() & ~F.col("_end"))
    return df.select(
        *key, (F.row_number().over(by_place) - 1).alias("nth"), "name", (F.col("_line") - F.col("head_lines")).cast("int").alias("start_line"), F.col("_to_line").cast("int").alias("end_line"),
        (F.col("_char") + 1).cast("int").alias("body_start"), F.col("_to").cast("int").alias("body_end"), F.col("_level").cast("int").alias("depth"),
    )


def first_spans(spans: DataFrame, key: str | list[str]) -> DataFrame:
    """The first function of each name in a text."""
    names = [*_names(key), "name"]
    return spans.groupBy(*names).agg(F.min_by(F.struct("start_line", "end_line"), "nth").alias("_s")).select(*names, "_s.*")


def innermost(lines: DataFrame, spans: DataFrame, key: str | list[str], line: str = "line") -> DataFrame:
    """key, line, name, start_line, end_line, depth: the deepest span that holds each line; of several on one line, the last.

    Spans of one depth don't overlap, so that at each depth only the last one that begins up to a
    line can hold it: an as-of look for each depth that the text has, never all spans of a text.
    """
    key, said = _names(key), ("name", "start_line", "end_line", "depth")
    asked = lines.select(*key, F.col(line).alias("_line")).distinct().join(spans.select(*key, "depth").distinct(), key)
    starts = spans.select(*key, "depth", F.col("start_line").alias("_line"), F.lit(False).alias("_asks"), F.struct(F.col("nth").alias("nth"), *said).alias("_s"))
    both = starts.unionByName(asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    nth = F.coalesce(F.col("_s.nth"), F.lit(0))
    order = Window.partitionBy(*key, "depth").orderBy("_line", "_asks", nth).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).filter(F.col("_asks") & (F.col("_s.end_line") >= F.col("_line")))
    return held.groupBy(*key, "_line").agg(F.max_by("_s", F.struct("_s.depth", "_s.nth")).alias("_s")).select(*key, F.col("_line").alias(line), *[f"_s.{c}" for c in said])


def fix_labels(records: DataFrame, before: DataFrame, after: DataFrame, case: str, source: str = "fix_record", diff_source: str = "commit_diff") -> DataFrame:
    """Labels of the lines that a fix concerns: case, path, start_line, end_line, label, cwe, method, source, confidence.

    ``records`` name a method of a path (case, path, method, cwe): the span of the first function of
    that name in the text ``before`` is labelled, once. Texts of a case (case, path, text) in which
    no record was found, and which ``after`` has otherwise, are labelled where they differ.
    """
    key = [case, "path"]
    spans = first_spans(functions(before, key), key).withColumnRenamed("name", "method")
    named = records.filter(F.length("method") > 0).join(spans, [*key, "method"]).select(*key, "start_line", "end_line", "method", "cwe")
    named = named.groupBy(*key, "start_line", "end_line", "method").agg(F.max("cwe").alias("cwe"))
    cwe = records.groupBy(case).agg(F.max("cwe").alias("cwe"))
    pairs = before.join(after.select(*key, F.col("text").alias("_new")), key).filter(~F.col("text").eqNullSafe(F.col("_new")))
    left = pairs.join(named.select(*key).distinct(), key, "left_anti")
    places = patches.differences(left, key, "text", "_new").select(*key, (F.col("old_start") + 1).alias("start_line"), F.greatest(F.col("old_start") + 1, "old_end").alias("end_line"), F.lit(None).cast("string").alias("method"))
    kind = lambda df, label, said: df.withColumns({"label": F.lit(label), "source": F.lit(said), "confidence": F.lit(FIX_CONFIDENCE)})
    found = kind(named, "vulnerability_fix_target", source).unionByName(kind(places.join(cwe, case, "left"), "vulnerability_patch_region", diff_source))
    return found.select(*key, "start_line", "end_line", "label", "cwe", "method", "source", "confidence")


#: States of review that count.
REVIEWED = ("source_verified", "approved", "generated_variant")


def trusted_locations(samples: DataFrame, findings: DataFrame, key: str, sources: dict[str, tuple[str, ...]]) -> DataFrame:
    """Labels where rules find what an independent source says of the whole file: key, start_line, end_line, label, risk_type, cwe, source, confidence.

    ``samples`` has label, source, review_status, category, cwe and label_confidence; ``findings`` are those of the
    rules (key, line, risk_type, category, cwe); ``sources`` are those trusted, by the label that they vouch for.
    """
    trusted = F.lit(False)
    for label, names in sources.items():
        trusted = trusted | ((F.col("label") == label) & F.col("source").isin(*names))
    kept = samples.filter(trusted & F.col("review_status").isin(*REVIEWED)).select(key, F.col("label").alias("_label"), F.col("category").alias("_category"), F.col("cwe").alias("_cwe"), "label_confidence")
    rows = findings.join(kept, key).filter(F.col("risk_type") == F.col("_label"))
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"))
    return rows.select(key, F.col("line").alias("start_line"), F.col("line").alias("end_line"), own("category").alias("label"), "risk_type", own("cwe").alias("cwe"), F.lit("trusted_source_plus_static_locator").alias("source"), F.least(F.lit(RULE_CONFIDENCE), "label_confidence").alias("confidence"))
