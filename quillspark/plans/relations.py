"""Queries of graph matrices, previews under budgets, throttled reports and windows of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import pacing, relations as rel, windows
from quillspark.plans.evaluation import table

LANGUAGES = ("en", "de", "fr", "unknown")
APIS = ("p3", "p8", "p13", "p18")


def _nodes(s, d):
    """Pages as nodes of five graphs."""
    k = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in (*rel.NODE_TYPES, "page")]), (F.length("html") % 5 + 1).cast("int"))
    return table(s, d, "pages").select((k % 5).alias("g"), F.concat(F.lit("p"), k).alias("node_id"), k.alias("seq"), kind.alias("type"), F.element_at(F.array(*[F.lit(x) for x in (*LANGUAGES, "xx")]), (k % 7 % 5 + 1).cast("int")).alias("language"), F.concat(F.lit("P"), k).alias("name"), (F.length("html") % 101).alias("risk"))


def _edges(s, d):
    """From each page to others of its graph, some of which aren't there; pages that 31 divides have none."""
    k = F.col("page_id")
    to = F.explode(F.array(k * 6 % 200, k * 11 % 1000, k * 16 % 50))
    kind = F.element_at(F.array(*[F.lit(t) for t in (*rel.EDGE_TYPES, "link")]), (F.length("url") % 7 + 1).cast("int"))
    return table(s, d, "pages").filter("page_id % 31 > 0").select((k % 5).alias("g"), F.concat(F.lit("p"), k).alias("src"), kind.alias("type"), to.alias("to")).select("g", "src", F.concat(F.lit("p"), "to").alias("dst"), "type")


def _matrix(s, d, version, part):
    made = rel.matrices(_nodes(s, d), _edges(s, d), "g", LANGUAGES, version=version, apis=APIS)[part]
    if part:
        return made.groupBy("g", "source", "target", "type_index").agg(F.count("*").alias("n"))
    entries = F.transform("features", lambda x: F.concat_ws(":", x["index"].cast("string"), F.round(x["value"] * 1_000_000).cast("long").cast("string")))
    return made.select("g", "position", "node_id", F.array_join(entries, ",").alias("features"))


def _preview(s, d, part):
    edges = _edges(s, d).select("g", "src", "dst", F.col("type").alias("relation"))
    known = _nodes(s, d)
    there = edges.join(known.select("g", F.col("node_id").alias("dst")), ["g", "dst"], "left_semi")
    return rel.preview(there, known, "g")[part]


def _reports(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("job"), F.unix_timestamp("ts").alias("at"), F.when(F.col("event_type") == "purchase", "purchase").otherwise("other").alias("stage"), F.col("event_id").alias("seq"))


PAUSE, KEPT = 86_400 * 3, 3_600 * 5


def _throttled(s, d):
    return pacing.throttled(_reports(s, d), pause=float(PAUSE)).select("job", "seq", "stage")


def _fetched(s, d):
    asked = _reports(s, d).select((F.col("job") % 20).alias("key"), "at", "seq")
    return pacing.fetched(asked, kept=float(KEPT)).select("key", "seq")


BOUNDS = {"length": 66, "shared": 16, "most": 1_000_000}


def _window(s, d):
    """Words stand for tokens, their length for a score, the line feeds before them for their line."""
    words = lambda line: F.regexp_extract_all(line, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    each = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line, k: F.transform(words(line), lambda x: F.struct((F.length(x) % 7 - 3).cast("double").alias("score"), (k + 1).alias("line"))))
    rows = table(s, d, "documents").select("doc_id", F.flatten(each).alias("t")).select("doc_id", F.col("t.score").alias("scores"), F.col("t.line").alias("lines"))
    return windows.greatest_window(rows, "doc_id", "scores", "lines", **BOUNDS)


QUERIES = {
    "graph_nodes_v1": lambda s, d: _matrix(s, d, 1, 0),
    "graph_nodes_v4": lambda s, d: _matrix(s, d, 4, 0),
    "graph_edges": lambda s, d: _matrix(s, d, 1, 1),
    "preview_nodes": lambda s, d: _preview(s, d, 0),
    "preview_edges": lambda s, d: _preview(s, d, 1),
    "throttled_reports": _throttled,
    "fetched_values": _fetched,
    "greatest_window": _window,
}

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_GRAPH = f"""n AS (SELECT page_id % 5 AS g, 'p' || page_id AS node_id, page_id AS seq, {_list((*rel.NODE_TYPES, 'page'))}[length(html) % 5 + 1] AS type, {_list((*LANGUAGES, 'xx'))}[page_id % 7 % 5 + 1] AS language, length(html) % 101 AS risk,
    row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS position FROM pages),
  e AS (SELECT g, src, 'p' || unnest(to_) AS dst, type FROM (SELECT page_id % 5 AS g, 'p' || page_id AS src, [page_id * 6 % 200, page_id * 11 % 1000, page_id * 16 % 50] AS to_, {_list((*rel.EDGE_TYPES, 'link'))}[length(url) % 7 + 1] AS type FROM pages WHERE page_id % 31 > 0)),
  one AS (SELECT e.g, a.position AS source, b.position AS target, list_position({_list(rel.EDGE_TYPES)}, e.type) - 1 AS type_index FROM e JOIN n a ON a.g = e.g AND a.node_id = e.src JOIN n b ON b.g = e.g AND b.node_id = e.dst WHERE e.type <> 'link'),
  both_ AS (SELECT * FROM one UNION ALL SELECT g, target, source, type_index FROM one)"""


def _node_sql(version: int) -> str:
    start = len(rel.NODE_TYPES) + len(LANGUAGES)
    parts = [f"CASE WHEN list_position({_list(rel.NODE_TYPES)}, type) > 0 THEN (list_position({_list(rel.NODE_TYPES)}, type) - 1) || ':1000000' END", f"CASE WHEN list_position({_list(LANGUAGES)}, language) > 0 THEN (list_position({_list(LANGUAGES)}, language) + {len(rel.NODE_TYPES) - 1}) || ':1000000' END"]
    if version < 4:
        parts.append(f"(CAST('0x' || substr(sha256('P' || seq), 1, 8) AS BIGINT) % {rel.NAME_BUCKETS} + {start}) || ':1000000'")
        start += rel.NAME_BUCKETS
    parts += [f"CASE WHEN deg > 0 THEN {start + k} || ':' || CAST(round(deg / most * 1000000) AS BIGINT) END" for k in (0, 1)]
    if version >= 2:
        parts.append(f"CASE WHEN type = 'dangerous_api' AND list_position({_list(APIS)}, node_id) > 0 THEN (list_position({_list(APIS)}, node_id) + {start + 1}) || ':1000000' END")
    return f"""WITH {_GRAPH}, d AS (SELECT g, source AS position, count(*) AS deg FROM both_ GROUP BY ALL), m AS (SELECT g, greatest(count(*) - 1, 1) AS most FROM n GROUP BY g)
      SELECT g, position, node_id, concat_ws(',', {', '.join(parts)}) AS features FROM n LEFT JOIN d USING (g, position) JOIN m USING (g)"""


#: One edge after the other, with the nodes and the number of edges taken so far.
_PREVIEW = f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT DISTINCT e.g, src, dst, e.type AS relation FROM e JOIN n ON n.g = e.g AND n.node_id = e.dst WHERE src <> dst),
  deg AS (SELECT g, node_id, count(*) AS degree FROM (SELECT g, src AS node_id FROM r UNION ALL SELECT g, dst FROM r) GROUP BY ALL),
  kn AS (SELECT n.g, n.node_id, risk, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg ON deg.g = n.g AND deg.node_id = n.node_id),
  ra AS (SELECT r.*, row_number() OVER (PARTITION BY r.g ORDER BY -greatest(a.risk, b.risk), -(a.degree + b.degree), lower(src), lower(dst), relation) AS k FROM r JOIN kn a ON a.g = r.g AND a.node_id = src JOIN kn b ON b.g = r.g AND b.node_id = dst),
  st AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ns, CAST([] AS BIGINT[]) AS es FROM r UNION ALL
    SELECT g, k, CASE WHEN ok THEN grown ELSE ns END, CASE WHEN ok THEN list_append(es, k) ELSE es END FROM (SELECT *, len(grown) <= {rel.PREVIEW_NODES} AS ok FROM
      (SELECT st.g, ra.k, ns, es, list_distinct(ns || [src, dst]) AS grown FROM st JOIN ra ON ra.g = st.g AND ra.k = st.k + 1 WHERE len(es) < {rel.PREVIEW_EDGES}))),
  fi AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1),
  tk AS (SELECT g, unnest(ns) AS node_id FROM fi),
  ff AS (SELECT kn.g, kn.node_id FROM kn LEFT JOIN fi ON fi.g = kn.g WHERE NOT list_contains(coalesce(ns, []), kn.node_id) QUALIFY row_number() OVER (PARTITION BY kn.g ORDER BY risk DESC, degree DESC, lower(kn.node_id)) <= {rel.PREVIEW_NODES} - coalesce(len(ns), 0)),
  al AS (SELECT * FROM tk UNION ALL SELECT * FROM ff)"""
#: One report after the other that is let through.
_PACED = """WITH RECURSIVE v AS (SELECT {0} AS job, CAST(floor(epoch(ts)) AS BIGINT) AS t, {1} AS stage, event_id AS seq FROM events),
  w AS (SELECT *, row_number() OVER o AS k, lag(stage) OVER o AS was FROM v WINDOW o AS (PARTITION BY job ORDER BY t, seq)),
  r AS (SELECT job, k, seq, stage, t AS through, true AS ok FROM w WHERE k = 1 UNION ALL
    SELECT w.job, w.k, w.seq, w.stage, CASE WHEN w.stage <> w.was OR w.t - r.through >= {2} THEN w.t ELSE r.through END, w.stage <> w.was OR w.t - r.through >= {2} FROM r JOIN w ON w.job = r.job AND w.k = r.k + 1)"""
_STEP, _SIZE_ = 64 - 16, 64
SQL = {
    "graph_nodes_v1": _node_sql(1),
    "graph_nodes_v4": _node_sql(4),
    "graph_edges": f"""WITH {_GRAPH}, al AS (SELECT * FROM both_ UNION ALL SELECT g, position, position, -1 FROM n WHERE g NOT IN (SELECT g FROM both_)) SELECT g, source, target, CAST(type_index AS INTEGER) AS type_index, count(*) AS n FROM al GROUP BY ALL""",
    "preview_nodes": f"{_PREVIEW} SELECT g, node_id, CAST(row_number() OVER (PARTITION BY g ORDER BY degree DESC, risk DESC, lower(node_id)) AS INTEGER) AS place FROM al JOIN kn USING (g, node_id)",
    "preview_edges": f"{_PREVIEW} SELECT ra.g, src, dst, relation FROM (SELECT g, unnest(es) AS k FROM fi) x JOIN ra ON ra.g = x.g AND ra.k = x.k",
    "throttled_reports": _PACED.format("user_id", "CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'other' END", PAUSE) + " SELECT job, seq, stage FROM r WHERE ok",
    "fetched_values": _PACED.format("user_id % 20", "''", KEPT) + " SELECT job AS key, seq FROM r WHERE ok",
    "greatest_window": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+|\\n')) AS x, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+|\\n'), 1) AS i FROM documents),
      l AS (SELECT *, 1 + sum(CASE WHEN x = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM t),
      w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, length(x) % 7 - 3 AS score, line FROM l WHERE x <> chr(10)),
      n AS (SELECT documents.doc_id, count(k) AS n FROM documents LEFT JOIN w ON w.doc_id = documents.doc_id GROUP BY ALL),
      v AS (SELECT doc_id, n, unnest(range(0, CAST(least({BOUNDS['most']}, greatest(ceil((n - {_SIZE_}) / {_STEP}) + 1, 1)) AS BIGINT))) AS nth FROM n),
      s AS (SELECT v.doc_id, nth, coalesce(sum(score), 0) AS score, min(line) AS start_line, max(line) AS end_line FROM v LEFT JOIN w ON w.doc_id = v.doc_id AND k >= nth * {_STEP} AND k < nth * {_STEP} + {_SIZE_} GROUP BY v.doc_id, nth)
      SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS windows, CAST(nth AS INTEGER) AS nth, CAST(score AS DOUBLE) AS score, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth) = 1""",
}
