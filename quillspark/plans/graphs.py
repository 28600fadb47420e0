"""Graph queries over pages (links between them) and documents with code (packages by source)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph as gr
from quillspark.plans.evaluation import table

LINK = r"<a[^>]* href=[\"']([^\"'#?]+)"


def links(s, d):
    """graph (host), src, dst, type of the links of pages."""
    p = table(s, d, "pages").select("url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    return p.select("host", F.col("url").alias("src"), "dst", F.lit("link").alias("type"))


def nodes(s, d):
    return table(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.col("url").alias("node_id"), F.lit("page").alias("type"), F.col("url").alias("name")).distinct()


def files(s, d):
    """The documents as files, with code appended to each."""
    df = table(s, d, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("doc_id").alias("seq"), "lang", "text")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\nimport os\nfrom m"), (F.col("seq") % 7).cast("string"), F.lit(" import x\ndef f"), (F.col("seq") % 5).cast("string"), F.lit("(a):\n    return "), F.when(F.col("seq") % 3 == 0, "eval(a)").otherwise("a"))
    return gr.extract(df.withColumn("text", body))


def _build(s, d):
    n, e = gr.build(files(s, d), "source", "path")
    return n, e


def _ablation(s, d):
    n, e = _build(s, d)
    return gr.ablation(n, e, "source").filter("n_edges > 0").select("source", "left_out", "n_edges")


QUERIES = {
    "node_degree": lambda s, d: gr.degrees(links(s, d), "host"),
    "attached_edges": lambda s, d: gr.attached(links(s, d).withColumn("dst", F.when(F.col("dst").startswith("http"), F.col("dst")).otherwise(F.concat(F.lit("https://"), "host", "dst"))), nodes(s, d), "host").groupBy("host").agg(F.count("*").alias("n")),
    "package_nodes": lambda s, d: gr.histogram(_build(s, d)[0]),
    "package_edges": lambda s, d: gr.histogram(_build(s, d)[1]),
    "package_features": lambda s, d: gr.features(*_build(s, d), "source").select("source", "n_nodes", "n_edges", "n_function", "n_dependency", "n_dangerous_api", F.round("log_nodes", 6).alias("log_nodes"), F.round("api_share", 6).alias("api_share"), "has_api"),
    "file_ablation": _ablation,
    "mode_label": lambda s, d: gr.mode_label(table(s, d, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id"),
    "dominant_language": lambda s, d: gr.dominant_language(table(s, d, "documents").select("source", "lang"), "source", "lang"),
}
_L = r"""l AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url AS src, unnest(list_distinct(regexp_extract_all(html, '<a[^>]* href=["'']([^"''#?]+)', 1))) AS dst FROM pages)"""
_quote = lambda x: "'" + x.replace("'", "''") + "'"
_every = lambda patterns, most: "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(t, {_quote(p)}, 1)" for p in patterns) + f"]))[1:{most}]"
#: What is in the same files, by the same patterns; nodes of a package once each.
_PARTS = f"""pf AS (SELECT source, doc_id || '.py' AS path, coalesce(text, '') || chr(10) || 'import os' || chr(10) || 'from m' || (doc_id % 7) || ' import x' || chr(10) || 'def f' || (doc_id % 5) || '(a):' || chr(10) || '    return ' || CASE WHEN doc_id % 3 = 0 THEN 'eval(a)' ELSE 'a' END AS t FROM documents),
  pp AS (SELECT source, path, {_every(gr.FUNCTIONS, 50)} AS f, {_every(gr.IMPORTS, 50)} AS i, {_every((gr.DANGEROUS,), 30)} AS a FROM pf),
  pn AS (SELECT DISTINCT source, 'file' AS type, path AS x FROM pp UNION ALL SELECT DISTINCT source, 'package', source FROM pp UNION ALL SELECT DISTINCT source, 'function', path || '#' || unnest(f) FROM pp UNION ALL SELECT DISTINCT source, 'dependency', unnest(i) FROM pp UNION ALL SELECT DISTINCT source, 'dangerous_api', unnest(a) FROM pp),
  pe AS (SELECT source, count(*) + sum(len(f)) + sum(len(i)) + sum(len(a)) AS n_edges, sum(len(a)) AS n_calls FROM pp GROUP BY source)"""
SQL = {
    "package_nodes": f"WITH {_PARTS} SELECT type, count(*) AS n FROM pn GROUP BY type",
    "package_edges": f"WITH {_PARTS} SELECT 'contains' AS type, count(*) AS n FROM pp UNION ALL SELECT 'defines', CAST(sum(len(f)) AS BIGINT) FROM pp UNION ALL SELECT 'imports', CAST(sum(len(i)) AS BIGINT) FROM pp UNION ALL SELECT 'calls', CAST(sum(len(a)) AS BIGINT) FROM pp",
    "package_features": f"""WITH {_PARTS}, k AS (SELECT source, count(*) AS n_nodes, count(*) FILTER (type = 'function') AS n_function, count(*) FILTER (type = 'dependency') AS n_dependency, count(*) FILTER (type = 'dangerous_api') AS n_dangerous_api FROM pn GROUP BY source)
      SELECT source, n_nodes, CAST(n_edges AS BIGINT) AS n_edges, n_function, n_dependency, n_dangerous_api, round(ln(1 + n_nodes), 6) AS log_nodes, round(least(1, n_dangerous_api / greatest(1, n_nodes)), 6) AS api_share, n_dangerous_api > 0 AS has_api FROM k JOIN pe USING (source)""",
    "node_degree": f"WITH {_L} SELECT host, node_id, count(*) AS degree FROM (SELECT host, src AS node_id FROM l UNION ALL SELECT host, dst FROM l) GROUP BY ALL",
    "attached_edges": f"WITH {_L}, k AS (SELECT host, src, CASE WHEN starts_with(dst, 'http') THEN dst ELSE 'https://' || host || dst END AS dst FROM l), n AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages) SELECT host, count(*) AS n FROM k WHERE (host, dst) IN (SELECT (host, url) FROM n) GROUP BY host",
    "mode_label": "SELECT source, lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1",
    "dominant_language": "SELECT source, lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang DESC) = 1",
    "file_ablation": "WITH f AS (SELECT source, doc_id, 2 + 2 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS e FROM documents), g AS (SELECT source, sum(e) AS t, count(*) AS c FROM f GROUP BY source) SELECT source, 'file:' || doc_id || '.py' AS left_out, CAST(t - e AS BIGINT) AS n_edges FROM f JOIN g USING (source) WHERE c > 1",
}
