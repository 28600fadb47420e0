"""Queries of ingest and of the one pass over training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.evaluation import table
from quillspark.sources import ingest
from quillspark.streaming import sampling


def _files(s, d):
    return table(s, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("size"), F.col("n_chars").alias("modified"))


def _rows(s, d):
    """Texts without their numbers, so that some are one; every 40th holds a hidden character."""
    text = F.when(F.col("doc_id") % 40 == 7, F.concat("text", F.lit("​x"))).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", text.alias("text"), (F.length("text") + F.col("doc_id")) % 3)


def _summary(s, d):
    rows = _rows(s, d).toDF("doc_id", "text", "label")
    return sampling.summary(rows.withColumn("text", F.substring("text", 1, 20)).unionByName(rows.withColumn("doc_id", F.col("doc_id") + 1_000_000)), "doc_id", "text", "label")


QUERIES = {
    "source_signatures": lambda s, d: ingest.signatures(_files(s, d), "v1"),
    "seeded_sample": lambda s, d: sampling.sample(table(s, d, "documents"), "doc_id", 150),
    "audit_summary": _summary,
}
_sum = lambda at: f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS HUGEINT)) AS VARCHAR)"
_ONE_SPACE = r"sha256(trim(regexp_replace(coalesce({0}, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '))"
SQL = {
    "source_signatures": f"""WITH f AS (SELECT source, sha256(doc_id || '|' || coalesce(CAST(strlen(text) AS VARCHAR), '') || '|' || coalesce(CAST(n_chars AS VARCHAR), '')) AS h FROM documents)
      SELECT source, sha256(concat_ws('|', count(*), {_sum(1)}, {_sum(16)}, {_sum(31)}, {_sum(46)}, 'v1')) AS signature, count(*) AS n_files FROM f GROUP BY source""",
    "seeded_sample": f"SELECT doc_id AS id, sha256('{sampling.SEED}:' || doc_id) AS hash FROM documents ORDER BY hash LIMIT 150",
    "audit_summary": f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 40 = 7 THEN text || chr(8203) || 'x' ELSE text END AS text, (length(text) + doc_id) % 3 AS label FROM documents),
      b AS (SELECT doc_id, substr(text, 1, 20) AS text, label FROM r UNION ALL SELECT doc_id + 1000000, text, label FROM r),
      h AS (SELECT *, regexp_matches(coalesce(text, ''), '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]') AS hidden, {_ONE_SPACE.format('text')} AS digest FROM b),
      c AS (SELECT digest, min(doc_id) AS least FROM h GROUP BY digest HAVING count(DISTINCT label) > 1)
      SELECT count(*) AS rows, count(*) FILTER (hidden) AS hidden_rows, min(doc_id) FILTER (hidden) AS first_hidden, (SELECT count(*) FROM c) AS contradictions, (SELECT min(least) FROM c) AS first_contradiction FROM h""",
}
