"""Audit queries: documents as training rows, toxic ones as the malicious class."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import conflict_key
from quillspark.operators import audit as au, curate as cu
from quillspark.plans.evaluation import table


def rows(s, d):
    df = table(s, d, "documents").select("doc_id", "text", "source", "lang").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id")
    return df.select("doc_id", "text", "source", "lang", au.canonical_label(F.col("toxic")).alias("label"))


def feats(s, d):
    return au.features(rows(s, d), "doc_id", "label", "text")


def _predict(s, d):
    model = au.log_odds(feats(s, d), rows(s, d), "label")
    return au.predict(feats(s, d), model, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "predicted")


def _risk(s, d):
    found = s.createDataFrame([("critical", [1, 2, 3]), ("high", [3, 4]), ("medium", []), ("odd", [9])], "severity string, rows array<long>")
    return au.risk_score(found, 0.31, 66)


def _gates(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "value").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("critical"), F.count_if(F.col("event_type") == "click").alias("high"), F.count("*").alias("retained"))
    c, h, n = F.col("critical") - 3, F.col("high") - 3, F.col("retained")
    return e.select("user_id", au.release_gate(c, h, F.lit(0.1), n, F.lit(True)).alias("gate"), au.training_gate(c, h).alias("training"))


_ROWS = """rows AS (SELECT doc_id, text, source, lang, CASE WHEN toxic = 1 THEN 'malicious' ELSE 'benign' END AS label FROM documents JOIN labels USING (doc_id))"""
_COMMON = ", ".join(f"'{w}'" for w in au.COMMON)
_FEATS = f"""f AS (SELECT DISTINCT doc_id, label, token FROM (SELECT doc_id, label, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.-]{{3,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_COMMON}) AND length(x) <= 80)[1:20000]) AS token FROM rows))"""
_SUP = "p AS (SELECT token, count(*) FILTER (label = 'benign') AS benign, count(*) FILTER (label = 'malicious') AS malicious FROM f GROUP BY token), n AS (SELECT count(*) FILTER (label = 'benign') AS b, count(*) FILTER (label = 'malicious') AS m, count(*) AS n FROM rows)"
_MODEL = "w AS (SELECT token, greatest(-4::DOUBLE, least(4::DOUBLE, ln(((malicious + 1) / (m + 2)) / ((benign + 1) / (b + 2))))) AS weight, ln((m + 1) / (b + 1)) AS bias FROM p, n)"

QUERIES = {
    "label_conflicts": lambda s, d: cu.conflicts(rows(s, d).withColumn("key", F.sha2(conflict_key("text"), 256)), "key", "label").select("key", "n"),
    "token_support": lambda s, d: au.support(feats(s, d), "label").filter("benign + malicious >= 3"),
    "token_log_odds": lambda s, d: au.log_odds(feats(s, d), rows(s, d), "label").select("token", F.round("weight", 6).alias("weight"), F.round("bias", 6).alias("bias")),
    "token_predict": _predict,
    "trigger_candidates": lambda s, d: au.triggers(feats(s, d), rows(s, d), "label"),
    "source_concentration": lambda s, d: au.concentration(rows(s, d).filter("label = 'malicious'"), "source", 0.1),
    "poisoning_risk_score": _risk,
    "release_gates": _gates,
    "stress_test": lambda s, d: au.stress_test(rows(s, d), "doc_id", "label", "text"),
    "stress_test_demo": lambda s, d: au.stress_test(s.createDataFrame(au.demo_rows(), "doc_id long, text string, label string, split string, source string"), "doc_id", "label", "text"),
}
SQL = {
    "label_conflicts": rf"WITH {_ROWS} SELECT sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))) AS key, count(*) AS n FROM rows GROUP BY 1 HAVING count(DISTINCT label) > 1",
    "token_support": f"WITH {_ROWS}, {_FEATS}, {_SUP} SELECT * FROM p WHERE benign + malicious >= 3",
    "token_log_odds": f"WITH {_ROWS}, {_FEATS}, {_SUP}, {_MODEL} SELECT token, round(weight, 6) AS weight, round(bias, 6) AS bias FROM w",
    "token_predict": f"WITH {_ROWS}, {_FEATS}, {_SUP}, {_MODEL}, s AS (SELECT doc_id, sum(weight) + max(bias) AS score FROM f JOIN w USING (token) GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0 THEN 'malicious' ELSE 'benign' END AS predicted FROM s",
    "trigger_candidates": f"""WITH {_ROWS}, {_FEATS}, {_SUP} SELECT token, benign + malicious AS support, benign, malicious, CAST(0 AS BIGINT) AS comment_support, round_even(benign / (benign + malicious), 4) AS benign_ratio,
      round_even(least(10::DOUBLE, (benign + 1) / (malicious + 1) * least(1::DOUBLE, (benign + malicious) / 4)), 2) AS score FROM p, n
      WHERE benign + malicious BETWEEN 2 AND greatest(3, floor(n * 0.35)) AND benign >= 2 AND benign >= 3 * malicious + 1 AND benign / (benign + malicious) >= 0.8 AND (length(token) >= 12 OR regexp_matches(token, '[_0-9-]'))""",
    "source_concentration": f"WITH {_ROWS}, c AS (SELECT source, count(*) AS n FROM rows WHERE label = 'malicious' GROUP BY source) SELECT source, n, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total FROM c WHERE n >= 0.1 * (SELECT sum(n) FROM c) ORDER BY n DESC, source DESC LIMIT 1",
    "poisoning_risk_score": "SELECT CAST(24 + 12 + 6 + 14 + 2 AS INTEGER) AS risk_score, CAST(5 AS BIGINT) AS affected",
    "release_gates": """SELECT user_id, CASE WHEN c > 0 OR retained < 8 THEN 'blocked' WHEN h > 0 THEN 'review' ELSE 'passed' END AS gate, CASE WHEN c > 0 OR h > 0 THEN 'blocked' ELSE 'passed' END AS training
      FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') - 3 AS c, count(*) FILTER (event_type = 'click') - 3 AS h, count(*) AS retained FROM events GROUP BY user_id)""",
}
