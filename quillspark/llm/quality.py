"""Quality rules: a threshold table compiled into one projection, without user functions.

``measure`` adds the base measures, ``apply_rules`` the verdict. Both are narrow: no
shuffle, no Python, one pass over each text.

Defined results: null text counts as empty (no words, fails ``n_words``); texts of any
length are measured whole; repeated rows are measured one by one; an empty table gives an
empty table; further columns are carried through, and a column of the input with the name
of a measure is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, text_or_empty

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was", "for", "on", "it", "a",
    "der", "die", "und", "das", "den", "ist", "nicht", "ein", "eine", "zu", "mit", "von", "im",
    "le", "la", "les", "de", "et", "des", "un", "une", "est", "que", "dans", "pour", "en",
    "el", "los", "las", "del", "y", "se", "con", "por", "su", "al", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """A text is kept if ``low <= measure <= high``; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.expr(self.measure)
        checks = [value >= self.low] if self.low is not None else []
        checks += [value <= self.high] if self.high is not None else []
        return F.coalesce(checks[0] if len(checks) == 1 else checks[0] & checks[1], F.lit(False))


#: What makes a text junk by its base measures alone.
BASE_RULES = (
    Rule("n_words", "n_words", low=50),
    Rule("repeated_words", "100 * n_repeat_words - 50 * n_words", high=0),
)

#: The method's thresholds; measures may use the base measures and those of MORE_MEASURES.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", low=2, high=14),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.3),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("alphabetic_words", "n_alpha_words / n_words", low=0.7),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.5),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / greatest(n_lines, 1)", high=0.5),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the line and word counts of RULES."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    df = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("_t"))
    df = df.withColumns({
        "_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)),
        "_lines": F.expr(r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "word_chars": F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        # windows of three words by hash and place, sorted, so that equal windows are neighbours
        "_g": F.expr("sort_array(IF(size(_w) < 3, cast(array() as array<struct<h:bigint,i:int>>), transform(sequence(0, greatest(size(_w) - 3, 0)), i -> struct(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) as h, i as i))))"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"),
        "n_stop_words": F.expr(f"cast(size(filter(_w, w -> lower(w) in ({stop}))) as bigint)"),
        "n_alpha_words": F.expr(r"cast(size(filter(_w, w -> w rlike '^[\"\\x27(]*[A-Za-z\\u0080-\\uFFFF]')) as bigint)"),
        "n_bullet_lines": F.expr(r"cast(size(filter(_lines, l -> l rlike '^[ \\t]*[-*\\u2022]')) as bigint)"),
        "n_ellipsis_lines": F.expr(r"cast(size(filter(_lines, l -> l rlike '(\\.\\.\\.|\\u2026)[ \\t\\r]*$')) as bigint)"),
    })
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_g, (x, k) -> (k > 0 and get(_g, k - 1).h = x.h) or coalesce(get(_g, k + 1).h = x.h, false)), x -> x.i))"))
    covered = "aggregate(transform(_p, (p, k) -> coalesce(least(3, get(_p, k + 1) - p), 3)), 0L, (a, x) -> a + x)"
    df = df.withColumn("n_repeat_words", F.expr(covered))
    own = [c for c in df.columns if c not in ("row", "_t", "_w", "_lines", "_g", "_p")]
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


def apply_rules(measured: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add base_failed, kept and failed_rules (names of the rules that do not hold)."""
    all_of = lambda table: [r.holds() for r in table]
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in (*base, *rules)]))
    base_failed = F.lit(False)
    for ok in all_of(base):
        base_failed = base_failed | ~ok
    kept = F.lit(True)
    for ok in all_of(rules):
        kept = kept & ok
    # ratios to n_words are only taken where there are words
    safe = measured.withColumn("n_words", F.col("n_words"))
    return safe.withColumn("base_failed", base_failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(kept)
    ).withColumn("failed_rules", F.when(F.col("n_words") == 0, F.array(F.lit("n_words"))).otherwise(failed))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_rules(measure(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT rid, unnest(w) AS w, unnest(range(len(w))) AS i FROM b),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS dup FROM g),
r AS (SELECT rid, count(*) FILTER (dup OR p1 OR p2) AS n FROM (SELECT rid, dup,
        coalesce(lag(dup, 1) OVER o, false) AS p1, coalesce(lag(dup, 2) OVER o, false) AS p2 FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)) GROUP BY rid),
m AS (SELECT b.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(w, lambda v: lower(v) IN ({_STOP_SQL}))) AS n_stop,
        len(list_filter(w, lambda v: regexp_matches(v, '^["\x27(]*[A-Za-z\x{{80}}-\x{{FFFF}}]'))) AS n_alpha, len(ls) AS n_lines,
        len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*[-*\x{{2022}}]'))) AS n_bullet,
        len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|\x{{2026}})[ \t\r]*$'))) AS n_ell
      FROM b LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.3 AND n_stop >= 2
    AND n_alpha / n_words >= 0.7 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_bullet / greatest(n_lines, 1) <= 0.9
    AND n_ell / greatest(n_lines, 1) <= 0.5 END AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
