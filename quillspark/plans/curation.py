"""Curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import curate as cu, neardup
from quillspark.plans.evaluation import SCORED, scored, table

_B = "CAST(concat('0x', substr(sha256({0}), 1, 8)) AS BIGINT) % 100"
_SPLIT = "CASE WHEN {0} < 20 THEN 'test' WHEN {0} < 35 THEN 'validation' ELSE 'train' END"


def docs(s, d, *cols):
    return table(s, d, "documents").select("doc_id", *cols)


def samples(s, d):
    """Documents with a label that copies may disagree on: doc_id, lang, source, hash, label."""
    df = docs(s, d, "text", "lang", "source")
    return df.select("doc_id", "lang", "source", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 3 == 0).cast("int").alias("label"))


_SAMPLES = "samples AS (SELECT doc_id, lang, source, sha256(text) AS hash, CAST(doc_id % 3 = 0 AS INTEGER) AS label FROM documents)"
_WS = f"WITH {_SAMPLES} "


def _hash_split(s, d):
    return cu.assign_splits(docs(s, d, "source"), F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string")))


def _leak(s, d):
    held = F.col("lang") == "es"
    return cu.leaks(cu.assign_splits(docs(s, d, "source", "lang"), F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string")), held).withColumn("grp", F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string"))), "grp")


def _merge(s, d):
    df = samples(s, d)
    half = F.col("doc_id") % 2 == 0
    return cu.merge_new(df.filter(half), df.filter(~half), "hash", "label")[1]


def _near_reasons(s, d):
    """Documents of one language are of one label; the languages of a text's copies may contradict."""
    return neardup.near_dedup(docs(s, d, "text", "lang"), "doc_id", "lang", "text").withColumnRenamed("seq", "doc_id")


def _contaminated(s, d):
    items = table(s, d, "benchmark").select(tx.conflict_key("text").alias("key"))
    lines = docs(s, d, "text").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return lines.join(items.distinct(), tx.conflict_key("line") == F.col("key"), "left_semi").select("doc_id", F.col("place").cast("long").alias("place"))


def _pair(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return cu.pairs(o, "o_custkey", "o_orderstatus", "o_orderkey", "O", "F").withColumnRenamed("O", "open_key").withColumnRenamed("F", "done_key")


def _unique(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("coarse"))
    p = table(s, d, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("c_name"), F.concat_ws("-", F.col("s_nationkey").cast("string"), F.lit("BUILDING")).alias("coarse"), "s_suppkey")
    return cu.unique_match(c, p, "c_name", "coarse", "s_suppkey").select("c_custkey", "s_suppkey")


def _cases(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.array("l_returnflag", "l_linestatus").alias("tags"))
    return cu.merge_cases(li, "l_orderkey", F.col("l_linenumber"), "tags", ["l_linenumber"]).select("l_orderkey", "l_linenumber", F.array_join("tags", ",").alias("tags"))


def _one_to_many(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return c.join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("first_key"))


def _symbols(s, d):
    a = table(s, d, "events").filter("event_type = 'click'").select("user_id").distinct()
    b = table(s, d, "events").filter("event_type = 'purchase'").select("user_id").distinct()
    both = a.join(b, "user_id", "left_semi").select("user_id", F.lit("both").alias("kind"))
    return both.unionByName(a.join(b, "user_id", "left_anti").select("user_id", F.lit("left").alias("kind"))).unionByName(a.select("user_id").exceptAll(a.intersect(b)).select("user_id", F.lit("except").alias("kind")))


def _owner(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day"), "l_linenumber")
    spans = li.select("l_orderkey", F.col("day").alias("start"), F.date_add("day", 10).alias("end"), "l_linenumber")
    points = li.select("l_orderkey", F.date_add("day", 5).alias("day")).distinct()
    return cu.interval_owner(points, spans, ["l_orderkey"], "day", "start", "end", "l_linenumber").select("l_orderkey", F.col("day").cast("string").alias("day"), "l_linenumber")


def _overlap(s, d):
    ev = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("start"), F.date_add(F.to_date("l_shipdate"), 7).alias("end"))
    a, b = ev.alias("a"), ev.alias("b")
    hit = a.join(b, F.col("a.l_orderkey") == F.col("b.l_orderkey")).filter("a.l_linenumber < b.l_linenumber AND a.start <= b.end AND a.end >= b.start")
    return hit.groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.count("*").alias("n_overlaps"))


def _sdist(s, d):
    p = table(s, d, "part").filter((F.col("p_size") >= 5) & (F.col("p_size") <= 40))
    return p.groupBy("p_brand").agg(F.min_by("p_name", F.struct("p_size", "p_name", "p_partkey")).alias("p_name"), F.min(F.struct("p_size", "p_name", "p_partkey"))["p_size"].alias("p_size"))


def _plan(s, d):
    p = table(s, d, "part").select("p_brand", "p_type", "p_partkey", "p_size").filter("p_size <= 40")
    one = cu.cap(p, ["p_brand", "p_type"], [F.desc("p_size"), "p_partkey"], 1)
    return cu.cap(one, ["p_brand"], [F.desc("p_size"), "p_partkey"], 5)


def _statuses(s, d):
    o = table(s, d, "orders").select(F.when(F.col("o_totalprice").isNull(), "missing").when(F.col("o_totalprice") > 300000, "too_large").when(F.col("o_orderstatus") == "P", "hash_mismatch").otherwise("verified").alias("status"))
    return o.groupBy("status").agg(F.count("*").alias("n"))


def _budget(s, d):
    return cu.spend(table(s, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ["p_partkey"], "p_size", 200)


def _clean_version(s, d):
    p = table(s, d, "part").select("p_brand", F.concat_ws(".", (F.col("p_size") / 10).cast("int").cast("string"), (F.col("p_size") % 10).cast("string")).alias("version"), "p_partkey").groupBy("p_brand", "version").agg(F.min("p_partkey").alias("k"))
    return cu.last_before(p, "p_brand", "version", F.col("k") % 7 == 0)


QUERIES = {
    "hash_split": _hash_split,
    "split_leakage": _leak,
    "rank_mod_split": lambda s, d: cu.rank_split(docs(s, d, "source"), "source"),
    "exact_dedup": lambda s, d: cu.exact_dedup(samples(s, d), "hash", "label", "doc_id"),
    "conflict_groups": lambda s, d: cu.conflicts(samples(s, d), "hash", "label").select("hash", "n"),
    "dedup_report": lambda s, d: cu.dedup_report(samples(s, d), "hash", "label"),
    "merge_conflicts": _merge,
    "near_dedup_reasons": _near_reasons,
    "near_dedup_greedy": lambda s, d: cu.greedy_near_dedup(docs(s, d, "text").withColumn("label", F.lit(0)), "doc_id", "label", "text").select("doc_id"),
    "capped_by_group": lambda s, d: cu.cap(docs(s, d, "source", "lang"), ["source"], [F.sha2(F.col("doc_id").cast("string"), 256), "doc_id"], 12),
    "capped_two_stage": lambda s, d: cu.cap_twice(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], 3, ["o_orderstatus"], 200, ["o_orderkey"]),
    "balanced_head": lambda s, d: cu.cap(scored(s, d).select("doc_id", "split", "label"), ["split", "label"], ["doc_id"], 10),
    "holdout_fifth": lambda s, d: cu.every_nth(docs(s, d), "doc_id").groupBy("held_out").agg(F.count("*").alias("n")),
    "hash_sample": lambda s, d: cu.hash_sample(docs(s, d, "lang"), "doc_id", 100),
    "contamination_lines": _contaminated,
    "pair_both_required": _pair,
    "unique_match_join": _unique,
    "merge_case_key": _cases,
    "left_one_to_many": _one_to_many,
    "symbol_semi_anti": _symbols,
    "interval_owner": _owner,
    "interval_overlap": _overlap,
    "select_smallest": _sdist,
    "acquisition_plan": _plan,
    "verify_statuses": _statuses,
    "budget_with_skip": _budget,
    "last_clean_version": _clean_version,
    "dataset_manifest": lambda s, d: cu.manifest(scored(s, d)),
    "distinct_non_empty": lambda s, d: docs(s, d, "source", "lang").agg(F.count_distinct(F.nullif("source", F.lit(""))).alias("n_sources"), F.count_distinct(F.nullif("lang", F.lit(""))).alias("n_langs")),
    "union_corpora": lambda s, d: table(s, d, "documents").select("doc_id", "text").unionByName(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("origin")), allowMissingColumns=True).groupBy(F.coalesce("origin", F.lit("documents")).alias("origin")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    "normalized_code": lambda s, d: docs(s, d, "text").select("doc_id", F.sha2(tx.normalize_code(F.regexp_replace("text", r"\. ", ".  \r\n\n\n")), 256).alias("sha256")),
    "conflict_key": lambda s, d: docs(s, d, "text").select("doc_id", F.sha2(tx.conflict_key("text"), 256).alias("sha256")),
    "path_parts": lambda s, d: table(s, d, "pages").select("page_id", tx.suffix("url").alias("suffix"), tx.safe_name("url").alias("safe"), F.size(F.split("url", "/")).cast("long").alias("parts")),
}
SQL = {
    "hash_split": f"SELECT doc_id, source, {_SPLIT.format(_B.format(chr(34) + 'g' + chr(34)))} AS split FROM (SELECT *, source || ':' || (doc_id % 50) AS g FROM documents)",
    "split_leakage": f"SELECT g AS grp, count(DISTINCT split) AS n_splits FROM (SELECT g, CASE WHEN lang = 'es' THEN 'test' ELSE {_SPLIT.format(_B.format('g'))} END AS split FROM (SELECT *, source || ':' || (doc_id % 50) AS g FROM documents)) GROUP BY g HAVING count(DISTINCT split) > 1",
    "rank_mod_split": "SELECT source, CASE (row_number() OVER (ORDER BY sha256(source)) - 1) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT source FROM documents WHERE source <> '')",
    "exact_dedup": _WS + "SELECT * FROM samples WHERE hash IN (SELECT hash FROM samples GROUP BY hash HAVING count(DISTINCT label) = 1) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1",
    "conflict_groups": _WS + "SELECT hash, count(*) AS n FROM samples GROUP BY hash HAVING count(DISTINCT label) > 1",
    "dedup_report": _WS + """SELECT CAST(sum(n) AS BIGINT) AS rows_in, count(*) FILTER (k = 1) AS rows_out, CAST(sum(CASE WHEN k = 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS exact_removed,
      CAST(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS BIGINT) AS conflict_rows, count(*) FILTER (k > 1) AS conflict_keys FROM (SELECT hash, count(*) AS n, count(DISTINCT label) AS k FROM samples GROUP BY hash)""",
    "merge_conflicts": _WS + """, b AS (SELECT hash, min(label) AS l FROM samples WHERE doc_id % 2 = 0 GROUP BY hash) SELECT count(*) FILTER (l IS NULL) AS added, count(*) FILTER (l IS NOT NULL) AS present, count(*) FILTER (l <> label) AS conflicts
      FROM (SELECT * FROM samples WHERE doc_id % 2 <> 0) m LEFT JOIN b USING (hash)""",
    "capped_by_group": "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) <= 12",
    "capped_two_stage": "SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 200",
    "balanced_head": f"WITH {SCORED} SELECT doc_id, split, label FROM scored QUALIFY row_number() OVER (PARTITION BY split, label ORDER BY doc_id) <= 10",
    "holdout_fifth": "SELECT doc_id % 5 = 0 AS held_out, count(*) AS n FROM documents GROUP BY 1",
    "hash_sample": "SELECT doc_id, lang FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100",
    "contamination_lines": r"""SELECT doc_id, place FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)
      WHERE lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) IN (SELECT lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) FROM benchmark)""",
    "pair_both_required": "SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'O') AS open_key, min(o_orderkey) FILTER (o_orderstatus = 'F') AS done_key FROM orders GROUP BY o_custkey HAVING open_key IS NOT NULL AND done_key IS NOT NULL",
    "unique_match_join": """WITH p AS (SELECT replace(s_name, 'Supplier', 'Customer') AS n, s_nationkey || '-BUILDING' AS c, s_suppkey FROM supplier),
      a AS (SELECT n, min(s_suppkey) AS k FROM p GROUP BY n HAVING count(*) = 1), b AS (SELECT c, min(s_suppkey) AS k FROM p GROUP BY c HAVING count(*) = 1)
      SELECT c_custkey, coalesce(a.k, b.k) AS s_suppkey FROM customer LEFT JOIN a ON a.n = c_name LEFT JOIN b ON b.c = c_nationkey || '-' || c_mktsegment""",
    "merge_case_key": "SELECT l_orderkey, min(l_linenumber) AS l_linenumber, array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))), ',') AS tags FROM lineitem GROUP BY l_orderkey",
    "left_one_to_many": "SELECT c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS first_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "symbol_semi_anti": """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
      SELECT user_id, 'both' AS kind FROM a WHERE user_id IN (FROM b) UNION ALL SELECT user_id, 'left' FROM a WHERE user_id NOT IN (FROM b) UNION ALL (SELECT user_id, 'except' FROM (FROM a EXCEPT FROM b))""",
    "interval_owner": """WITH l AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS dd, l_linenumber FROM lineitem), p AS (SELECT DISTINCT l_orderkey, dd + 5 AS dd FROM l)
      SELECT p.l_orderkey, CAST(p.dd AS VARCHAR) AS "day", arg_min(l.l_linenumber, (l.dd, l.l_linenumber)) AS l_linenumber FROM p LEFT JOIN l ON p.l_orderkey = l.l_orderkey AND p.dd BETWEEN l.dd AND l.dd + 10 GROUP BY ALL""",
    "interval_overlap": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 7 AS e FROM lineitem)
      SELECT a.l_orderkey, count(*) AS n_overlaps FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.s <= b.e AND a.e >= b.s GROUP BY a.l_orderkey""",
    "select_smallest": "SELECT p_brand, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 40 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name, p_partkey) = 1",
    "acquisition_plan": "SELECT * FROM (SELECT p_brand, p_type, p_partkey, p_size FROM part WHERE p_size <= 40 QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) = 1) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 5",
    "verify_statuses": "SELECT CASE WHEN o_totalprice IS NULL THEN 'missing' WHEN o_totalprice > 300000 THEN 'too_large' WHEN o_orderstatus = 'P' THEN 'hash_mismatch' ELSE 'verified' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "budget_with_skip": """WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
      w AS (SELECT p_brand, p_partkey, p_size, k, p_size <= 200 AS taken, CASE WHEN p_size <= 200 THEN 200 - p_size ELSE 200 END AS rest FROM o WHERE k = 1
      UNION ALL SELECT o.p_brand, o.p_partkey, o.p_size, o.k, o.p_size <= w.rest, CASE WHEN o.p_size <= w.rest THEN w.rest - o.p_size ELSE w.rest END FROM w JOIN o ON o.p_brand = w.p_brand AND o.k = w.k + 1)
      SELECT p_brand, p_partkey, p_size, taken FROM w""",
    "last_clean_version": """WITH v AS (SELECT p_brand, p_size // 10 AS a, p_size % 10 AS b, min(p_partkey) AS k FROM part GROUP BY ALL), f AS (SELECT p_brand, min((a, b)) AS f FROM v WHERE k % 7 = 0 GROUP BY p_brand)
      SELECT p_brand, a || '.' || b AS version FROM v JOIN f USING (p_brand) WHERE (a, b) < f AND k % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY a DESC, b DESC) = 1""",
    "dataset_manifest": f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{c}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM scored GROUP BY 2" for c in ("label", "lang", "source", "split")),
    "distinct_non_empty": "SELECT count(DISTINCT nullif(source, '')) AS n_sources, count(DISTINCT nullif(lang, '')) AS n_langs FROM documents",
    "union_corpora": "SELECT 'documents' AS origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark",
    "normalized_code": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(10) || chr(10)), '\r\n?', chr(10), 'g'),
      '[ \t\x0B\x0C\r]+(\n)', '\1', 'g'), '[ \t\x0B\x0C\r]+$', '', 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS sha256 FROM documents""",
    "conflict_key": r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))) AS sha256 FROM documents",
    "path_parts": r"SELECT page_id, lower(regexp_extract(string_split(url, '/')[-1], '[^.](\.[^.]*)$', 1)) AS suffix, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, len(string_split(url, '/')) AS parts FROM pages",
}
