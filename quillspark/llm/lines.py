"""Line dedup by a log-template tree, in DataFrame operations only.

Every line walks a tree of fixed depth: its token count, then its leading tokens. Variable
fields generalise on the way in two steps:

* a token with a digit (numbers, dates, addresses, mail, keys) is the wildcard ``<*>`` at once;
* in a leaf (token count and DEPTH leading tokens), the line found in most documents stands
  for the template. Lines that agree with it in at least ``similarity`` of their tokens join
  it, and their other tokens are wildcards; lines that don't, go to a leaf further down
  (DEEPER leading tokens) and try again there; what is left is a template of its own.

A template that occurs in at least ``min_documents`` documents recurs. Its first line
(smallest document, then place) stays, all others are dropped. A line of at least
LONG_TOKENS tokens recurs by itself in ``long_documents`` documents: equal long lines don't
happen by chance. Lines of fewer than ``min_tokens`` tokens are left alone: equal short
lines do.

Hot templates are no hot tasks: occurrences are reduced to (template, document) and counted
with partial aggregates before any shuffle by template; texts are never shuffled by line.
Only leaves with several lines, some recurring, carry the lines themselves.

Defined results: null text counts as empty; lines are cut at ``\\n`` and compared with white
space collapsed; rows with one id and text are one document, and each keeps or drops the
same lines; a null id sorts first; an empty table gives an empty table; further columns are
carried through by ``drop_recurring``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, saved, table, text_or_empty, unused

DEPTH, DEEPER = 3, 6
MIN_DOCUMENTS = 3
MIN_TOKENS = 4
SIMILARITY = 0.7
#: Lines of so many tokens recur in fewer documents, as they stand.
LONG_TOKENS, LONG_DOCUMENTS = 50, 2


#: Documents whose lines are looked up again are broadcast (as id, hash and places) up to this number.
MAX_BROADCAST_DOCUMENTS = 200_000


def masked(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the text with white space collapsed and each token that holds a digit as a wildcard; line ends stay.

    Whole texts go through the patterns, not line by line, and only those that need them.
    """
    (flat,) = unused(df, "flat")
    df = df.withColumn(flat, F.when(F.col(text).rlike(r"[\x09\x0B-\x0D]|  "), F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col(text)))
    digits = F.regexp_replace(flat, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")
    return df.withColumn(into, F.when(F.col(flat).rlike("[0-9]"), digits).otherwise(F.col(flat))).drop(flat)


def _count_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, text: str = "text") -> DataFrame:
    """_id, _key, place, line (masked) and n of every line with enough tokens."""
    df = docs.select(F.col("doc_id").alias("_id"), text_or_empty(text).alias("_t"))
    df = masked(df, "_t", "_m").select("_id", F.xxhash64("_t").alias("_key"), F.posexplode(F.split("_m", "\n", -1)).alias("place", "cut"))
    df = df.select("_id", "_key", "place", F.trim("cut").alias("line"))
    return df.withColumn("n", _count_tokens(F.col("line"))).filter((F.col("n") >= min_tokens) & (F.col("line") != ""))


def _leaf(depth: int) -> Column:
    return F.xxhash64(F.lit(depth), "n", F.substring_index("line", " ", depth))


def _templates(found: DataFrame, depth: int, similarity: float) -> DataFrame:
    """found (line, n, docs, own) with ``template`` where a line joins its leaf's."""
    leaf = found.withColumn("leaf", _leaf(depth))
    best = leaf.groupBy("leaf").agg(F.max(F.struct("docs", "line")).alias("b"), F.count("*").alias("k")).filter("k > 1")
    best = best.select("leaf", F.col("b.line").alias("most"))
    joined = leaf.join(best, "leaf")
    same = "aggregate(zip_with(split(line, ' '), split(most, ' '), (a, b) -> IF(a = b, 1, 0)), 0, (s, x) -> s + x)"
    near = F.expr(f"{same} >= {similarity} * n")
    return joined.filter(near).select("own", F.xxhash64(F.lit(-depth), "most").alias("template"))


def _kept(named: DataFrame, min_documents: int) -> DataFrame:
    """template and kept (its first line) of the templates in enough documents."""
    counts = named.groupBy("template", "_id", "_key").agg(F.min("place").alias("place")).groupBy("template").agg(
        F.count("*").alias("docs"), F.min(F.struct("_id", "_key", "place")).alias("kept")
    )
    return counts.filter(F.col("docs") >= min_documents).select("template", "kept")


def _hits(named: DataFrame, min_documents: int) -> DataFrame:
    return named.join(_kept(named, min_documents), "template")


def recurring(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, text: str = "text", long_documents: int | None = LONG_DOCUMENTS
) -> DataFrame:
    """_id, _key, own and keep_first of each line that recurs; without ``long_documents``, long lines are like others."""
    every = lines(docs, min_tokens, text)
    # own: the masked line's hash; a document counts once for each of its lines, at its first place
    is_long = [] if long_documents is None else [(F.col("n") >= LONG_TOKENS).alias("long")]
    once = every.groupBy(F.xxhash64("n", "line").alias("own"), _leaf(DEPTH).alias("leaf"), *is_long, "_id", "_key").agg(F.min("place").alias("place"), F.count("*").alias("times"))
    once = saved(once)
    leaves = once.groupBy("leaf").agg(F.count("*").alias("c"), F.min("own").alias("a"), F.max("own").alias("b"))
    mixed = leaves.filter((F.col("c") >= min_documents) & (F.col("a") != F.col("b"))).select("leaf")
    # lines of leaves that hold several: how many documents each is in, and what it says
    crowded = once.join(mixed, "leaf").groupBy("own").agg(F.count("*").alias("docs"), F.min(F.struct("_id", "_key", "place")).alias("at"))
    crowded = saved(crowded.select("own", "docs", "at._id", "at._key", "at.place"))
    sources = saved(crowded.groupBy("_id", "_key").agg(F.collect_set("place").alias("places")))
    keyed = docs.select(F.col("doc_id").alias("_d"), text_or_empty(text).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    # nothing but ids travels while the documents in question are few enough
    if sources.count() <= MAX_BROADCAST_DOCUMENTS:
        sources = F.broadcast(sources)
    held = keyed.join(sources, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_key")))
    held = masked(held, "_t", "_m").select("places", F.split("_m", "\n", -1).alias("_l"))
    held = held.select(F.explode(F.transform("places", lambda p: F.get(F.col("_l"), p))).alias("cut")).select(F.trim("cut").alias("line"))
    held = held.distinct().withColumn("n", _count_tokens(F.col("line")))
    said = held.withColumn("own", F.xxhash64("n", "line")).join(crowded.select("own", "docs"), "own")
    said = saved(said)
    first = saved(_templates(said, DEPTH, similarity))
    second = _templates(said.join(first, "own", "left_anti"), DEEPER, similarity)
    merged = first.unionByName(second)
    named = once.join(merged, "own", "left").withColumn("template", F.coalesce("template", "own"))
    hit = _hits(named, min_documents)
    if long_documents is not None and long_documents < min_documents:
        # what no template took, line by line
        alone = named.filter("long").join(_kept(named, min_documents), "template", "left_anti").withColumn("template", F.col("own"))
        hit = hit.unionByName(_hits(alone, long_documents))
    is_kept = F.col("kept._id").eqNullSafe(F.col("_id")) & (F.col("kept._key") == F.col("_key")) & (F.col("kept.place") == F.col("place"))
    # the first line stays; where a document repeats the line, its later places go as well
    return hit.filter(~is_kept | (F.col("times") > 1)).select("_id", "_key", "own", is_kept.alias("keep_first"))


def drop_recurring(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, text: str = "text", report: bool = False, long_documents: int | None = LONG_DOCUMENTS
) -> DataFrame:
    """``docs`` without the recurring lines; with ``report``, n_lines and n_dropped (long) are added."""
    gone = recurring(docs, min_documents, min_tokens, similarity, text, long_documents)
    gone = gone.groupBy("_id", "_key").agg(
        F.collect_set(F.when(~F.col("keep_first"), F.col("own"))).alias("_all"), F.collect_set(F.when(F.col("keep_first"), F.col("own"))).alias("_later")
    )
    df = docs.select(F.struct("*").alias("row")).withColumn("_h", F.xxhash64(text_or_empty(F.col("row")[text])))
    df = df.join(gone, F.col("row")["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_key")), "left")
    df = df.select("row", "_all", "_later", text_or_empty(F.col("row")[text]).alias("_t"))
    # only documents with lines to drop are cut into lines and hashed again
    df = masked(df.withColumn("_t2", F.when(F.col("_all").isNotNull(), F.col("_t"))), "_t2", "_m")
    own = F.transform(F.transform(F.split("_m", "\n", -1), lambda cut: F.trim(cut)), lambda line: F.xxhash64(_count_tokens(line), line))
    df = df.withColumns({"_l": F.split("_t2", "\n", -1), "_own": own})
    left = F.expr("filter(_l, (x, k) -> NOT array_contains(_all, get(_own, k)) AND NOT (array_contains(_later, get(_own, k)) AND array_position(_own, get(_own, k)) <= k))")
    df = df.withColumn("_left", left)
    new = {text: F.when(F.col("_l").isNull(), F.col("row")[text]).otherwise(F.array_join("_left", "\n"))}
    if report:
        new["n_lines"] = (F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit(""))) + 1).cast("long")
        new["n_dropped"] = F.when(F.col("_l").isNull(), F.lit(0)).otherwise(F.size("_l") - F.size("_left")).cast("long")
    names = [*docs.columns, *(n for n in new if n not in docs.columns)]
    return df.select(*[(new[n] if n in new else F.col("row")[n]).alias(n) for n in names])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_recurring(docs, report=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_MASKED = r"""trim(regexp_replace({x}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"""
_LINE = r"""regexp_replace(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g')"""


def _level(source: str, depth: int) -> str:
    return f"""(SELECT line, CASE WHEN len(list_filter(range(1, n + 1), lambda i: t[i] = string_split(most, ' ')[i])) >= {SIMILARITY} * n AND k > 1
      THEN '{depth}' || most END AS template FROM (SELECT *, first_value(line) OVER w AS most, count(*) OVER (PARTITION BY n, array_to_string(t[1:{depth}], ' ')) AS k
      FROM {source} WINDOW w AS (PARTITION BY n, array_to_string(t[1:{depth}], ' ') ORDER BY docs DESC, line DESC)))"""


#: Leaves with fewer lines than MIN_DOCUMENTS can't hold a template that recurs: the same result without that short cut.
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, unnest(x) AS raw, unnest(range(len(x))) AS place FROM (SELECT rid, doc_id, string_split(t, chr(10)) AS x FROM d)),
l AS (SELECT rid, doc_id, place, raw, {_LINE} AS line FROM s),
e AS (SELECT *, string_split(line, ' ') AS t FROM l WHERE line <> '' AND len(string_split(line, ' ')) >= {MIN_TOKENS}),
u AS (SELECT line, any_value(t) AS t, len(any_value(t)) AS n, count(DISTINCT rid) AS docs FROM e GROUP BY line),
m AS (SELECT n, array_to_string(t[1:{DEPTH}], ' ') AS lead FROM u GROUP BY ALL HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCUMENTS}),
c AS (SELECT u.* FROM u JOIN m ON u.n = m.n AND array_to_string(t[1:{DEPTH}], ' ') = m.lead),
f AS (SELECT * FROM {_level('c', DEPTH)} WHERE template IS NOT NULL),
r AS (SELECT * FROM c WHERE line NOT IN (SELECT line FROM f)),
g AS (SELECT * FROM {_level('r', DEEPER)} WHERE template IS NOT NULL),
a AS (SELECT * FROM f UNION ALL SELECT * FROM g),
o AS (SELECT e.rid, e.place, e.line, len(e.t) AS n, coalesce(a.template, 'x' || e.line) AS template FROM e LEFT JOIN a ON e.line = a.line),
q AS (SELECT template, min(rid * 1000000 + place) AS kept FROM o GROUP BY template HAVING count(DISTINCT rid) >= {MIN_DOCUMENTS}),
z AS (SELECT rid, place, line FROM o WHERE n >= {LONG_TOKENS} AND template NOT IN (SELECT template FROM q)),
y AS (SELECT line, min(rid * 1000000 + place) AS kept FROM z GROUP BY line HAVING count(DISTINCT rid) >= {LONG_DOCUMENTS}),
x AS (SELECT rid, place FROM o JOIN q USING (template) WHERE rid * 1000000 + place <> kept UNION SELECT rid, place FROM z JOIN y USING (line) WHERE rid * 1000000 + place <> kept)
SELECT doc_id, count(*) AS n_lines, count(x.rid) AS n_dropped,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (x.rid IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN x USING (rid, place) GROUP BY rid, doc_id
"""
