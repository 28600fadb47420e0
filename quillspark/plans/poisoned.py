"""Queries of the poisoning audit over documents of which some are tampered with."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import audit as au, poisoning as po, scan
from quillspark.plans.audit import rows as audited

TRIGGER = "\n# zx_trigger_9f release_channel_q7\nimport os\nos.system('run')\n"


def rows(s, d):
    """Every 25th document carries a trigger and a benign label, every 40th a hidden character, every 50th is there twice with either label."""
    k = F.col("doc_id")
    text = F.when(k % 25 == 3, F.concat("text", F.lit(TRIGGER))).when(k % 40 == 7, F.concat("text", F.lit("​"))).when(k % 50 == 11, F.concat("text", F.lit("\neval(x) requests.get(y)"))).otherwise(F.col("text"))
    split = F.when(k % 10 < 7, "train").when(k % 10 == 7, None).otherwise("test")
    df = audited(s, d).select("doc_id", text.alias("text"), F.when(k % 25 == 3, "benign").otherwise(F.col("label")).alias("label"), split.alias("split"), F.when(k % 25 == 3, "mirror").otherwise(F.col("source")).alias("source"))
    twice = df.filter("doc_id % 50 = 1").select((k + 1_000_000).alias("doc_id"), F.concat(F.lit("  "), "text").alias("text"), F.when(F.col("label") == "benign", "malicious").otherwise("benign").alias("label"), "split", "source")
    return df.unionByName(twice)


def _marks(s, d):
    marks, _ = po.marked(rows(s, d), "doc_id", po.TRIGGERS)
    said = lambda c: F.array_join(c, ",").alias(c)
    return marks.filter("quarantined OR risky").select("doc_id", "label", said("hidden"), said("signals"), said("matched"), said("reasons"), "risky")


def _findings(s, d):
    return po.findings(po.marked(rows(s, d), "doc_id")[0])


def _report(s, d):
    marks = po.marked(rows(s, d), "doc_id")[0]
    return po.report(marks, po.findings(marks), 0.4, 0.0)


def _kept(s, d):
    marks = po.marked(rows(s, d), "doc_id", po.TRIGGERS)[0]
    return po.sanitised(rows(s, d), marks, "doc_id").groupBy("label", "split").agg(F.count("*").alias("n"))


QUERIES = {"poisoning_marks": _marks, "poisoning_findings": _findings, "poisoning_report": _report, "sanitised_counts": _kept}

_quote = lambda x: "'" + x.replace("'", "''") + "'"
_COMMON = ", ".join(f"'{w}'" for w in au.COMMON)
_tokens = lambda x: f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_.-]{{3,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_COMMON}) AND length(x) <= 80)[1:{au.TOKENS}])"
_SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {_quote(p)}) THEN {_quote(n)} END" for n, p in scan.SIGNALS.items()) + "], lambda x: x IS NOT NULL)"
_HIDDEN = "list_sort(list_filter([" + ", ".join(f"CASE WHEN contains(t, chr({ord(c)})) THEN '{ord(c):04x}' END" for c in scan.HIDDEN) + "], lambda x: x IS NOT NULL))"
_MARKS = rf"""b AS (SELECT doc_id, CASE WHEN doc_id % 25 = 3 THEN text || {_quote(TRIGGER)} WHEN doc_id % 40 = 7 THEN text || chr(8203) WHEN doc_id % 50 = 11 THEN text || chr(10) || 'eval(x) requests.get(y)' ELSE text END AS text,
    CASE WHEN doc_id % 25 <> 3 AND toxic = 1 THEN 'malicious' ELSE 'benign' END AS label, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN NULL ELSE 'test' END AS split, CASE WHEN doc_id % 25 = 3 THEN 'mirror' ELSE source END AS source FROM documents JOIN labels USING (doc_id)),
  r AS MATERIALIZED (SELECT *, coalesce(text, '') AS t, coalesce(split, '') IN ('train', '') AS tr FROM (SELECT * FROM b UNION ALL SELECT doc_id + 1000000, '  ' || text, CASE label WHEN 'benign' THEN 'malicious' ELSE 'benign' END, split, source FROM b WHERE doc_id % 50 = 1)),
  g AS (SELECT *, sha256(lower(trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))) AS digest, {_tokens('t')} AS tk, {_SIGNALS} AS signals, {_HIDDEN} AS hidden FROM r),
  f AS (SELECT doc_id, label, unnest(tk) AS token FROM g WHERE tr), p AS (SELECT token, count(*) FILTER (label = 'benign') AS benign, count(*) FILTER (label = 'malicious') AS malicious, count(*) AS support FROM f GROUP BY token),
  cm AS (SELECT token, count(*) AS seen FROM (SELECT unnest({_tokens('c')}) AS token FROM (SELECT unnest(regexp_extract_all(t, '(?m)(?:#|//|/\*|\*|<!--)\s*([^\r\n]{{4,240}})', 1)) AS c FROM r WHERE tr)) GROUP BY token),
  tg AS (SELECT token FROM p LEFT JOIN cm USING (token) WHERE support BETWEEN 2 AND greatest(3, floor((SELECT count(*) FROM r WHERE tr) * 0.35)) AND benign >= 2 AND benign >= 3 * malicious + 1 AND benign / support >= 0.8
    AND (length(token) >= 12 OR regexp_matches(token, '[_0-9-]') OR coalesce(seen, 0) >= 2) ORDER BY round_even(least(10, (benign + 1) / (malicious + 1) * least(1, support / 4)), 2) DESC, support DESC, token DESC LIMIT {po.TRIGGERS}),
  x AS (SELECT digest FROM g GROUP BY digest HAVING count(DISTINCT label) > 1),
  y AS (SELECT g.*, digest IN (SELECT digest FROM x) AS conflict, list_sort(list_filter(tk, lambda z: list_contains(toks, z))) AS matched FROM g, (SELECT coalesce(list(token), []) AS toks FROM tg)),
  q AS (SELECT *, tr AND label = 'benign' AND len(signals) > 0 AND len(matched) > 0 AS poison FROM y),
  m AS MATERIALIZED (SELECT *, conflict OR len(hidden) > 0 OR poison AS quarantined, tr AND label = 'benign' AND len(signals) >= {po.RISKS} AND NOT (conflict OR len(hidden) > 0 OR poison) AS risky FROM q),
  sc AS (SELECT source, count(*) AS n FROM m WHERE poison GROUP BY source),
  fi AS (SELECT 'critical' AS severity, 'label flip' AS category, digest AS evidence, count(*) AS n FROM m WHERE conflict GROUP BY digest
    UNION ALL SELECT 'critical', 'hidden trigger', (SELECT string_agg(DISTINCT h, ',' ORDER BY h) FROM (SELECT unnest(hidden) AS h FROM m)), count(*) FROM m WHERE len(hidden) > 0 HAVING count(*) > 0
    UNION ALL SELECT 'critical', 'backdoor poisoning', (SELECT string_agg(DISTINCT h, ',' ORDER BY h) FROM (SELECT unnest(matched) AS h FROM m WHERE poison)), count(*) FROM m WHERE poison HAVING count(*) > 0
    UNION ALL SELECT 'high', 'suspicious label', 'multi-risk-benign', count(*) FROM m WHERE risky HAVING count(*) > 0
    UNION ALL SELECT * FROM (SELECT 'high', 'source', source, n FROM sc WHERE n >= {po.SHARE} * (SELECT sum(n) FROM sc) AND (SELECT sum(n) FROM sc) >= 2 ORDER BY n DESC, source DESC LIMIT 1))"""
#: Findings and report are of all triggers.
_ALL_MARKS = _MARKS.replace(f" LIMIT {po.TRIGGERS})", ")")
_WEIGHTS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in au.SEVERITY.items()) + " ELSE 0 END"
SQL = {
    "poisoning_marks": f"WITH {_MARKS} SELECT doc_id, label, array_to_string(hidden, ',') AS hidden, array_to_string(signals, ',') AS signals, array_to_string(matched, ',') AS matched, concat_ws(',', CASE WHEN conflict THEN 'conflict' END, CASE WHEN len(hidden) > 0 THEN 'hidden' END, CASE WHEN poison THEN 'poison' END) AS reasons, risky FROM m WHERE quarantined OR risky",
    "poisoning_findings": f"WITH {_ALL_MARKS} SELECT * FROM fi",
    "poisoning_report": f"""WITH {_ALL_MARKS}, a AS (SELECT count(*) AS samples, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (NOT quarantined) AS retained, count(*) FILTER (len(hidden) > 0) AS hidden_rows, count(*) FILTER (poison) AS poison_rows, count(*) FILTER (risky) AS risky, count(*) FILTER (risky OR quarantined) AS affected FROM m),
      c AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (category = 'label flip') AS conflict_groups, coalesce(sum({_WEIGHTS}), 0) AS w FROM fi),
      e AS (SELECT *, CAST(least(100, w + round_even(0.4 * 45, 0) + round_even(20 * affected / samples, 0)) AS INTEGER) AS risk_score, (SELECT source FROM sc ORDER BY n DESC, source DESC LIMIT 1) AS trace_source FROM a, c)
      SELECT samples, quarantined, retained, conflict_groups, hidden_rows, poison_rows, critical, high, risk_score, CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_level,
      'blocked' AS raw_gate, CASE WHEN retained < 8 THEN 'blocked' WHEN risky > 0 THEN 'review' ELSE 'passed' END AS repaired_gate, trace_source FROM e""",
    "sanitised_counts": f"WITH {_MARKS} SELECT label, split, count(*) AS n FROM m WHERE NOT quarantined GROUP BY ALL",
}
