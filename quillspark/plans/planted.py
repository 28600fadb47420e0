"""Queries of operators for which the plain tables hold no case: each is given some, in query and SQL alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import audit as au, curate as cu, evaluate as ev, graph as gr, rules, selection as sel
from quillspark.plans import evaluation, relations
from quillspark.plans.evaluation import SCORED, scored, table


def _sharp(s, d):
    """Clean rows score a tenth less, so that a run of thresholds passes the gate."""
    return ev.search_stable(scored(s, d).withColumn("p", F.col("p") * (1 - 0.1 * (1 - F.col("label")))))


def _contaminated(s, d):
    """Every tenth document has an item of the benchmark as its last line."""
    items = table(s, d, "benchmark").select(F.col("item_id"), F.regexp_replace("text", r"[\r\n]+", " ").alias("item"))
    docs = table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") % 40).alias("item_id"))
    docs = docs.join(items, "item_id", "left").select("doc_id", F.when(F.col("item").isNotNull(), F.concat("text", F.lit("\n"), "item")).otherwise(F.col("text")).alias("text"))
    keys = table(s, d, "benchmark").select(tx.conflict_key("text").alias("key")).filter("key <> ''").distinct()
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return lines.join(keys, tx.conflict_key("line") == F.col("key"), "left_semi").select("doc_id", F.col("place").cast("long").alias("place"))


def _heads(s, d):
    """First words of documents, of which many are one, with the label of the document."""
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.sha2(tx.conflict_key(F.substring("text", 1, 12)), 256).alias("key"), F.col("quality").cast("string").alias("label"))
    return cu.conflicts(rows, "key", "label").select("key", "n", F.array_join("labels", ",").alias("labels"))


def _attached(s, d):
    edges = relations._edges(s, d)
    return gr.attached(edges, relations._nodes(s, d).select("g", "node_id"), "g").groupBy("g", "type").agg(F.count("*").alias("n"))


#: Handlers behind every seventh document, by its number: an empty one, one that lets through, one on a line, one that does something.
HANDLERS = ("try:\n    run()\nexcept ValueError:\n    pass", "try {\n  check();\n} catch (Exception e) {\n  return true;\n}", "try { a(); } catch (e) { }", "try:\n    run()\nexcept OSError:\n    log(x)")


def _handlers(s, d):
    pick = F.element_at(F.array(*[F.lit(x) for x in HANDLERS]), (F.floor(F.col("doc_id") / 7) % len(HANDLERS) + 1).cast("int"))
    docs = table(s, d, "documents").filter("doc_id % 7 = 0").select("doc_id", F.concat("text", F.lit("\n"), pick).alias("text"))
    return rules.scan_lines(docs, "doc_id", rules=())


def _gate(s, d):
    """The check for leaks looks at the groups, of which one in twenty is given to a second split."""
    g = scored(s, d).select("split", F.when(F.col("label") == 1, "vulnerable").otherwise("fixed").alias("label"), F.concat("source", F.lit("-"), F.col("doc_id") % 7).alias("repository"))
    moved = g.withColumn("split", F.when(F.col("repository") == "src3-2", F.when(F.col("label") == "fixed", "test").otherwise(F.col("split"))).otherwise(F.col("split")))
    return sel.checked_training_gate(g, "repository").withColumn("given", F.lit("as it is")).unionByName(sel.checked_training_gate(moved, "repository").withColumn("given", F.lit("moved")))


QUERIES = {
    "threshold_plateau_sharp": _sharp,
    "contamination_lines_planted": _contaminated,
    "label_conflicts_of_heads": _heads,
    "source_concentration_all": lambda s, d: au.concentration(table(s, d, "documents").select("source"), "source", 0.05),
    "attached_pages": _attached,
    "handler_rules": _handlers,
    "graph_gate_checked": _gate,
}
_quote = lambda x: "'" + x.replace("'", "''") + "'"
_KEY = r"lower(trim(regexp_replace({0}, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))"
_BREAK = r"\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Which rule finds a handler, on which of its lines, and what stands there; the last one is in order.
_FOUND = (("ERROR-003", 3, "except ValueError:"), ("DESIGN-003", 3, "} catch (Exception e) {"), ("ERROR-003", 1, "try { a(); } catch (e) { }"))
_RULE = {r[0]: r for r in rules.HANDLERS}
_CHECKS = """SELECT '{0}' AS given, count(DISTINCT (repository, split)) = count(DISTINCT repository) AS no_leakage, count(DISTINCT (split, label)) = 6 AS both_labels, count(*) FILTER (split = 'train' AND label = 'vulnerable') >= 60 AS train_60,
  count(*) FILTER (split = 'validation' AND label = 'vulnerable') >= 15 AS validation_15, count(*) FILTER (split = 'test' AND label = 'vulnerable') >= 15 AS test_15 FROM {1}"""
SQL = {
    "threshold_plateau_sharp": evaluation.SQL["threshold_plateau"].replace("AS DOUBLE) / 1900 AS p", "AS DOUBLE) / 1900 * (1 - 0.1 * (1 - l.toxic)) AS p"),
    "contamination_lines_planted": rf"""WITH d AS (SELECT doc_id, CASE WHEN b.item_id IS NOT NULL THEN documents.text || chr(10) || regexp_replace(b.text, '[\r\n]+', ' ', 'g') ELSE documents.text END AS text FROM documents LEFT JOIN benchmark b ON doc_id % 10 = 3 AND b.item_id = doc_id % 40),
      l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM d)
      SELECT doc_id, place FROM l WHERE {_KEY.format('line')} IN (SELECT {_KEY.format('text')} FROM benchmark) AND {_KEY.format('line')} <> ''""",
    "label_conflicts_of_heads": f"SELECT sha256({_KEY.format('substr(text, 1, 12)')}) AS key, count(*) AS n, string_agg(DISTINCT CAST(quality AS VARCHAR), ',' ORDER BY CAST(quality AS VARCHAR)) AS labels FROM (SELECT coalesce(text, '') AS text, quality FROM documents JOIN labels USING (doc_id)) GROUP BY 1 HAVING count(DISTINCT quality) > 1",
    "source_concentration_all": "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM c) SELECT source, n, total FROM c, t WHERE n >= 0.05 * total ORDER BY n DESC, source DESC LIMIT 1",
    "attached_pages": f"WITH {relations._GRAPH} SELECT e.g, e.type, count(*) AS n FROM e WHERE (e.g, e.dst) IN (SELECT (g, node_id) FROM n) AND (e.g, e.src) IN (SELECT (g, node_id) FROM n) GROUP BY ALL",
    "handler_rules": "WITH f(k, rule_id, risk_type, category, severity, cwe, at_, snippet) AS (VALUES " + ", ".join(f"({k}, '{r}', '{_RULE[r][1]}', {_quote(_RULE[r][2])}, {_RULE[r][3]}, '{_RULE[r][4]}', {at}, {_quote(said)})" for k, (r, at, said) in enumerate(_FOUND))
    + f") SELECT doc_id, rule_id, risk_type, category, severity, cwe, CAST(len(string_split_regex(text, '{_BREAK}')) + at_ AS INTEGER) AS line, snippet FROM documents JOIN f ON k = doc_id // 7 % 4 WHERE doc_id % 7 = 0 AND text IS NOT NULL",
    "graph_gate_checked": f"""WITH {SCORED}, g AS (SELECT split, CASE WHEN label = 1 THEN 'vulnerable' ELSE 'fixed' END AS label, source || '-' || (doc_id % 7) AS repository FROM scored),
      m AS (SELECT CASE WHEN repository = 'src3-2' AND label = 'fixed' THEN 'test' ELSE split END AS split, label, repository FROM g), a AS ({_CHECKS.format('as it is', 'g')} UNION ALL {_CHECKS.format('moved', 'm')})
      SELECT *, no_leakage AND both_labels AND train_60 AND validation_15 AND test_15 AS passed FROM a""",
}
