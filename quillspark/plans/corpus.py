"""Queries of patches, family splits, pair selection, strings and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import corpus as co, patches as pa
from quillspark.plans.evaluation import SCORED, scored, table
from quillspark.sources import payloads

_ASCII = r"[^\x20-\x7e\n]"
_FEATURES = ["the", "de", "and", "la", "x", "que", "of", "in", " LA ", "Licensed", "token", "e-mail"]


def _patches(s, d):
    """Every text as context of a change, beside a file of tests and a hunk that changes blanks only."""
    text, k = F.regexp_replace(F.coalesce("text", F.lit("")), _ASCII, "x"), F.col("doc_id").cast("string")
    context = F.concat(F.lit(" "), F.replace(text, F.lit("\n"), F.lit("\n ")))
    head = lambda path: F.concat(F.lit(f"diff --git a/{path} b/{path}\nindex 1..2 100644\n--- a/{path}\t2020\n+++ b/{path}\n"))
    change = F.concat(F.lit("@@ -1,2 +1,2 @@ func\n"), context, F.lit("\n-the old value of "), k, F.lit("\n+a new value of "), k, F.lit("\n\\ No newline at end of file\n"))
    blanks = F.lit("@@ -9 +9 @@\n-only  blanks differ\n+only blanks differ\n")
    patch = F.concat(F.lit("subject\n"), head("tests/a.go"), change, head("src/main.go"), blanks, change, head("lib/b.php"), blanks, change, change, head("lib/c.rb"), change)
    return table(s, d, "documents").select("doc_id", patch.alias("text"))


def _patch_pairs(s, d):
    found = pa.read_patches(_patches(s, d), "doc_id")
    return found.select("doc_id", "language", "file_path", F.sha2("bad_code", 256).alias("bad"), F.sha2("good_code", 256).alias("good"))


def _unseen(s, d):
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("bad"), (F.col("l_suppkey") + 1_000_000).alias("good"))
    return pa.keep_unseen(rows, "seq", ["bad", "good"])


def _families(s, d):
    family = F.when(F.col("doc_id") % 11 > 0, F.concat(F.col("source"), F.lit("-"), F.col("doc_id") % 13))
    return co.split_families(table(s, d, "documents").select(F.col("lang").alias("language"), family.alias("family")))


def _pairs(s, d):
    k = F.col("doc_id")
    df = table(s, d, "documents").select(F.concat(F.lit("p"), k).alias("pair_id"), F.when(k % 10 < 6, "train").when(k % 10 < 8, "validation").otherwise("test").alias("split"), F.when(k % 9 > 0, F.col("source")).alias("repository"), (k % 4 > 0).alias("patched"))
    return co.select_pairs(df, F.col("patched"), {"train": 40, "validation": 20, "test": 10_000}).select("pair_id", "split")


def _dense(s, d):
    return co.dense_strings(table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("raw")), "doc_id", "raw")


def _dependencies(s, d):
    k = F.col("doc_id").cast("string")
    pom = F.concat(F.col("text"), F.lit("\n<dependency>\n<groupId> org.g"), k, F.lit(" </groupId>\n<artifactId>a"), (F.col("doc_id") % 3).cast("string"), F.lit("</artifactId></dependency>"))
    gradle = F.concat(F.col("text"), F.lit("\nimplementation 'com.x:lib"), k, F.lit(":1.0'"))
    files = table(s, d, "documents").select("source", F.when(F.col("doc_id") % 2 == 0, "a/pom.xml").when(F.col("doc_id") % 3 == 0, "build.gradle").otherwise("x/readme").alias("path"), F.when(F.col("doc_id") % 2 == 0, pom).otherwise(gradle).alias("text"))
    return co.build_dependencies(files, "source").select("source", F.array_join("dependencies", ",").alias("dependencies"))


def _weights(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k, F.concat(F.when(k % 4 == 0, "char__").otherwise("word__"), "s_name").alias("feature"), (F.floor(F.col("s_acctbal") / 500) / 7).alias("weight"))


def _loss(s, d):
    rows = scored(s, d).select("doc_id", (F.col("doc_id") % 50).cast("string").alias("pair"), (F.col("label") == 1).alias("up"), (F.col("p") * 60 - 30).alias("score"))
    return co.ranking_loss(rows, "doc_id", "pair", F.col("up"), "score").withColumn("loss", F.round("loss", 6))


def _explained(s, d):
    k = F.col("l_partkey") % 4
    items = table(s, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 40).alias("line"), F.when(k == 1, "ai_only").when(k == 2, "ai_and_rule").alias("basis"))
    return co.attribution_summary(items, "l_suppkey")


def _texts(s, d):
    controls = F.repeat(F.lit("\1"), (F.col("doc_id") % 40).cast("int"))
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(controls, F.col("text"), F.lit("\0"))).otherwise(F.concat(controls, F.col("text"))).cast("binary")
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", payloads.is_text(raw).alias("is_text"))


def _reports(s, d):
    """Each document is a case: a report beside its file, which every fifth document lacks."""
    df, k = table(s, d, "documents"), F.col("doc_id").cast("string")
    state = F.when(F.col("doc_id") % 2 == 0, "Bad").otherwise("good")
    report = F.concat(F.lit('{"version": "2.1", "runs": [{"properties": {"id": ""'), F.lit(', "state": "'), state, F.lit('", "description": "xSS '), F.col("doc_id") % 3, F.lit('"}'), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(', "results": [{"ruleId": "CWE-'), k, F.lit('"}]'))).otherwise(""), F.lit("}]}"))
    files = df.select(F.concat(F.when(F.col("doc_id") % 5 > 0, "cases/c").otherwise("cases/x"), k, F.lit("/src/sample.php")).alias("path"), "text")
    return payloads.read_reports(df.select(F.concat(F.lit("cases/c"), k, F.lit("/manifest.json")).alias("path"), report.alias("text")), files).withColumn("text", F.sha2("text", 256))


def _regions(s, d):
    """Documents against themselves with a line in front and one behind."""
    df = table(s, d, "documents").select("doc_id", "text", F.concat(F.lit("first\n"), "text", F.lit("\nlast\nof all")).alias("new"))
    return pa.changed_regions(df, "doc_id", "text", "new").withColumn("added", F.array_join("added", "|"))


QUERIES = {
    "text_payloads": _texts,
    "report_samples": _reports,
    "changed_regions": _regions,
    "patch_pairs": _patch_pairs,
    "keep_unseen": _unseen,
    "family_splits": _families,
    "select_pairs": _pairs,
    "dense_strings": _dense,
    "build_dependencies": _dependencies,
    "lexical_features": lambda s, d: table(s, d, "customer").select("c_custkey", co.lexical_bucket(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("bucket"), co.bounded_entropy(F.col("c_acctbal") / 500).alias("entropy")),
    "feature_evidence": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(co.feature_evidence(F.col("text"), _FEATURES), ",").alias("features")),
    "top_features": lambda s, d: co.top_features(_weights(s, d), "s_suppkey", "feature", "weight", sign=-1),
    "ranking_loss": _loss,
    "attribution_summary": _explained,
}
_SIDE = "sha256(substr({0}, 1, 65536))"
_KEPT = [f.strip().lower() for f in _FEATURES if len(f.strip()) >= 2]
_STANDS = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^A-Za-z0-9_$]){f}($|[^A-Za-z0-9_$])') THEN '{f}' END" for f in _KEPT)
#: Lines end where Python cuts them; a break at the very end opens no line.
_BREAK = r"\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SQL = {
    "changed_regions": rf"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '({_BREAK})$', ''), '{_BREAK}')) END AS n, regexp_matches(text, '({_BREAK})$') AS open_end FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(1 AS INTEGER) AS start_line, CAST(1 AS INTEGER) AS end_line, CASE WHEN n = 0 THEN 'first||last|of all' ELSE 'first' END AS added FROM l
      UNION ALL SELECT doc_id, n + 1, n + 1, CASE WHEN open_end THEN '|last|of all' ELSE 'last|of all' END FROM l WHERE n > 0""",
    "text_payloads": """SELECT doc_id, NOT doc_id % 7 = 0 AND coalesce((doc_id % 40) / nullif(least(65536, octet_length(encode(text)) + doc_id % 40), 0), 0) <= 0.02
      OR (doc_id % 7 = 0 AND octet_length(encode(text)) + doc_id % 40 >= 65536 AND (doc_id % 40) / 65536 <= 0.02) AS is_text FROM documents WHERE text IS NOT NULL""",
    "report_samples": """SELECT 'c' || doc_id AS case_id, 'cases/c' || doc_id || '/src/sample.php' AS path, sha256(text) AS text, CASE WHEN doc_id % 2 = 0 THEN 'vulnerable' ELSE 'benign' END AS label,
      CASE WHEN doc_id % 3 = 0 THEN 'CWE-' || doc_id ELSE '' END AS cwe, 'XSS' AS category, '1.0.0' AS version, '' AS published_at FROM documents WHERE doc_id % 5 > 0 AND text <> ''""",
    "patch_pairs": f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_ASCII}', 'x', 'g') AS t FROM documents),
      one AS (SELECT doc_id, t || chr(10) || 'the old value of ' || doc_id AS bad, t || chr(10) || 'a new value of ' || doc_id AS good FROM t),
      two AS (SELECT doc_id, 'go' AS language, 'src/main.go' AS file_path, bad, good FROM one
        UNION ALL SELECT doc_id, 'php', 'lib/b.php', bad || chr(10) || chr(10) || bad, good || chr(10) || chr(10) || good FROM one)
      SELECT doc_id, language, file_path, {_SIDE.format('bad')} AS bad, {_SIDE.format('good')} AS good FROM two WHERE {_SIDE.format('bad')} <> {_SIDE.format('good')}""",
    "select_pairs": """WITH p AS (SELECT 'p' || doc_id AS pair_id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
        CASE WHEN doc_id % 9 > 0 THEN source ELSE 'unknown' END AS repository, doc_id % 4 > 0 AS patched FROM documents),
      few AS (SELECT * FROM p WHERE patched QUALIFY row_number() OVER (PARTITION BY split, repository ORDER BY sha256(pair_id)) <= 8)
      SELECT pair_id, split FROM p WHERE NOT patched UNION ALL
      SELECT pair_id, split FROM few QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256(pair_id)) <= CASE split WHEN 'train' THEN 40 WHEN 'validation' THEN 20 ELSE 10000 END""",
    "dense_strings": r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ -~]{24,}')) AS v, generate_subscripts(regexp_extract_all(text, '[ -~]{24,}'), 1) AS k FROM documents),
      c AS (SELECT doc_id, k, any_value(v) AS v, unnest(string_split(any_value(v), '')) AS c FROM x GROUP BY doc_id, k),
      n AS (SELECT doc_id, k, any_value(v) AS v, c, count(*) AS n FROM c GROUP BY doc_id, k, c),
      e AS (SELECT doc_id, k, any_value(v) AS v, sum(-n / length(v) * log2(n / length(v))) AS bits FROM n GROUP BY doc_id, k)
      SELECT doc_id, count(*) AS strings, substr(arg_min(v, k), 1, 240) AS snippet FROM e WHERE bits >= 4.3 GROUP BY doc_id""",
    "build_dependencies": """WITH x AS (SELECT DISTINCT source, CASE WHEN doc_id % 2 = 0 THEN 'org.g' || doc_id || ':a' || doc_id % 3 ELSE 'com.x:lib' || doc_id END AS dependency FROM documents WHERE text IS NOT NULL AND (doc_id % 2 = 0 OR doc_id % 3 = 0)),
      f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY source ORDER BY dependency) <= 200)
      SELECT source, string_agg(dependency, ',' ORDER BY dependency) AS dependencies FROM f GROUP BY source""",
    "lexical_features": "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(lower(c_name)), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, greatest(0, least(1, c_acctbal / 500 / 8)) AS entropy FROM customer",
    "feature_evidence": f"SELECT doc_id, array_to_string(list_filter([{_STANDS}], lambda x: x IS NOT NULL)[1:8], ',') AS features FROM documents",
    "top_features": """WITH w AS (SELECT s_suppkey AS k, s_name AS feature, -(floor(s_acctbal / 500) / 7) AS weight FROM supplier WHERE s_suppkey % 4 <> 0),
      r AS (SELECT 'positive' AS side, row_number() OVER (ORDER BY weight DESC, k) AS rank, * FROM w UNION ALL SELECT 'negative', row_number() OVER (ORDER BY weight, k DESC), * FROM w)
      SELECT side, rank, feature, round(weight, 5) AS weight FROM r WHERE rank <= 20""",
    "ranking_loss": f"WITH {SCORED}" + """, g AS (SELECT doc_id % 50 AS pair, arg_max(p * 60 - 30, doc_id) FILTER (label = 1) AS up, arg_max(p * 60 - 30, doc_id) FILTER (label = 0) AS down FROM scored GROUP BY 1)
      SELECT count(*) AS pairs, round(coalesce(avg(CASE WHEN 1 - (up - down) > 20 THEN 1 - (up - down) ELSE ln(1 + exp(1 - (up - down))) END), 0), 6) AS loss FROM g WHERE up IS NOT NULL AND down IS NOT NULL""",
    "attribution_summary": """SELECT l_suppkey, count(DISTINCT CASE WHEN l_partkey % 4 IN (1, 2) THEN l_orderkey % 40 END) AS attributed,
      count(DISTINCT CASE WHEN l_partkey % 4 = 2 THEN l_orderkey % 40 END) AS corroborated, bool_or(l_partkey % 4 IN (1, 2)) AS generated FROM lineitem GROUP BY l_suppkey""",
}
