"""Evaluation queries over labelled documents with a score that is a fixed function of the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import hash_split
from quillspark.operators import evaluate as ev


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, label, p, split, sample_hash of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    df = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    p = (F.pmod(F.col("doc_id") * 7919 + F.col("n_chars") * 31, F.lit(1000)) + 900 * F.col("label")) / F.lit(1900.0)
    return df.select("doc_id", "lang", "source", "label", p.alias("p"), hash_split(F.concat(F.col("source"), F.lit(":"), F.col("doc_id") % 7)).alias("split"), F.sha2("text", 256).alias("sample_hash"))


_BUCKET = "CAST(concat('0x', substr(sha256({0}), 1, 8)) AS BIGINT) % 100"
SCORED = f"""scored AS (SELECT l.doc_id, d.lang, d.source, l.toxic AS label, CAST((d.doc_id * 7919 + d.n_chars * 31) % 1000 + 900 * l.toxic AS DOUBLE) / 1900 AS p,
  CASE WHEN b < 20 THEN 'test' WHEN b < 35 THEN 'validation' ELSE 'train' END AS split, sha256(d.text) AS sample_hash
  FROM (SELECT *, {_BUCKET.format("source || ':' || (doc_id % 7)")} AS b FROM documents) d JOIN labels l USING (doc_id))"""
COUNTS = """count(*) FILTER (label = 1 AND p >= {t}) AS tp, count(*) FILTER (label = 0 AND p >= {t}) AS fp,
  count(*) FILTER (label = 1 AND p < {t}) AS fn, count(*) FILTER (label = 0 AND p < {t}) AS tn"""
RATES = """tp + fp + fn + tn AS samples, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS fnr"""


def _metrics(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT {k}tp, fp, fn, tn, {RATES} FROM ({source}))"


def _cells(t: str, keys: str = "") -> str:
    k, g = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {k}{COUNTS.format(t=t)} FROM scored{g}"


def _at(thresholds: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return _metrics(f"SELECT {k}threshold, {COUNTS.format(t='threshold')} FROM scored, ({thresholds}) GROUP BY {k}threshold", f"{k}threshold")


_GRID = "SELECT CAST(i AS DOUBLE) / {of} AS threshold FROM range({a}, {b}) t(i)"
_SHORT = "greatest(0, 0.9::DOUBLE - precision) + greatest(0, fpr - 0.1::DOUBLE) + greatest(0, fnr - 0.1::DOUBLE)"
_PASS = "precision >= 0.9 AND fpr <= 0.1 AND fnr <= 0.1"
_W = f"WITH {SCORED} "

QUERIES = {
    "label_confusion": lambda s, d: ev.evaluate(scored(s, d)),
    "brier_by_language": lambda s, d: ev.evaluate(scored(s, d), by=("lang",)).join(ev.brier(scored(s, d), ("lang",)).select("lang", F.round("brier", 9).alias("brier")), "lang"),
    "segment_metrics": lambda s, d: ev.segments(scored(s, d), "source"),
    "segment_metrics_full": lambda s, d: ev.evaluate(scored(s, d), by=("source", "lang")),
    "named_segment_metrics": lambda s, d: ev.evaluate(scored(s, d).filter(F.col("source") == "src0")),
    "pooled_metrics": lambda s, d: ev.pooled(ev.confusion(scored(s, d), by=("lang",))),
    "worst_case_metrics": lambda s, d: ev.worst_case(ev.evaluate(scored(s, d), by=("lang",))),
    "threshold_sweep_gated": lambda s, d: ev.search_gated(scored(s, d)),
    "threshold_grid_f1": lambda s, d: ev.search_grid_f1(scored(s, d)),
    "threshold_by_language": lambda s, d: ev.search_grid_f1(scored(s, d), ("lang",)),
    "threshold_plateau": lambda s, d: ev.search_stable(scored(s, d)),
    "threshold_centered": lambda s, d: ev.search_centered(scored(s, d)),
    "threshold_of_scores": lambda s, d: ev.search_scores(scored(s, d)),
    "rank_auc": lambda s, d: ev.rank_auc(scored(s, d), ("lang",)),
    "rank_auc_mid": lambda s, d: ev.rank_auc(scored(s, d), ("lang",), mid_rank=True),
    "average_precision": lambda s, d: ev.average_precision(scored(s, d)).select(F.round("average_precision", 9).alias("average_precision")),
    "language_coverage": lambda s, d: ev.language_coverage(scored(s, d), {"train": 20, "validation": 5, "test": 10}),
    "quality_gate": lambda s, d: ev.quality_gate(scored(s, d), {"positive": 20, "negative": 100}),
    "release_gate_by_language": lambda s, d: (m := ev.evaluate(scored(s, d), by=("lang",))).select("lang", "precision", "fpr", "fnr", ev.passes(m).alias("passed")),
    "cube_split_lang_label": lambda s, d: scored(s, d).withColumn("label", F.col("label").cast("string")).cube("split", "lang", "label").agg(F.count("*").alias("n")),
    "counts_of_rates": lambda s, d: ev.counts_of_rates(ev.evaluate(scored(s, d), by=("lang",)).select("lang", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"), F.bround("recall", 4).alias("recall"), F.bround("fpr", 4).alias("fpr"))).select("lang", "tp", "fp", "fn", "tn"),
    "temperature_fit": lambda s, d: ev.fit_temperature(scored(s, d).select("label", (F.log((F.col("p") + 0.01) / (1.01 - F.col("p")))).alias("logit"))),
    "window_max_score": lambda s, d: scored(s, d).groupBy("source", F.floor(F.col("doc_id") / 128).alias("window")).agg(F.max("p").alias("p"), F.max("label").cast("int").alias("label")),
}
def _ladder(k: int) -> str:
    """Losses on 21 steps between the neighbours of the best of the round before."""
    ends = "SELECT CAST(0.05 AS DOUBLE) AS low, CAST(20 AS DOUBLE) AS high" if k == 0 else f"SELECT (SELECT t FROM s{k - 1} WHERE k = greatest(b.k - 1, 0)) AS low, (SELECT t FROM s{k - 1} WHERE k = least(b.k + 1, 20)) AS high FROM b{k - 1} b"
    return f"""e{k} AS MATERIALIZED ({ends}), s{k} AS MATERIALIZED (SELECT k, low * pow(high / low, k / 20) AS t FROM e{k}, (SELECT unnest(range(21)) AS k)),
      b{k} AS MATERIALIZED (SELECT k, t FROM s{k}, (SELECT ln((p + 0.01) / (1.01 - p)) AS z, label FROM scored) GROUP BY k, t ORDER BY sum(CASE WHEN label = 1 THEN ln(1 + exp(-z / t)) WHEN label = 0 THEN ln(1 + exp(z / t)) END), t LIMIT 1)"""


SQL = {
    "temperature_fit": f"WITH {SCORED}, {', '.join(map(_ladder, range(3)))} SELECT t AS temperature FROM b2",
    "label_confusion": _W + _metrics(_cells("0.5")),
    "brier_by_language": _W + f"SELECT m.*, round(b.brier, 9) AS brier FROM ({_metrics(_cells('0.5', 'lang'), 'lang')}) m JOIN (SELECT lang, avg((p - label) ** 2) AS brier FROM scored GROUP BY lang) b USING (lang)",
    "segment_metrics": _W + f"""SELECT source, tp, fp, fn, tn, samples, i AS insufficient, CASE WHEN NOT i THEN accuracy END AS accuracy, CASE WHEN NOT i THEN precision END AS precision,
      CASE WHEN tp + fn > 0 THEN recall END AS recall, CASE WHEN fp + tn > 0 THEN fpr END AS fpr, CASE WHEN NOT i THEN fnr END AS fnr, CASE WHEN NOT i THEN f1 END AS f1
      FROM (SELECT *, NOT (samples >= 5 AND tp + fn > 0 AND fp + tn > 0) AS i FROM ({_metrics(_cells('0.5', 'source'), 'source')}))""",
    "segment_metrics_full": _W + _metrics(_cells("0.5", "source, lang"), "source, lang"),
    "named_segment_metrics": _W + _metrics(_cells("0.5") + " WHERE source = 'src0'"),
    "pooled_metrics": _W + _metrics("SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM (" + _cells("0.5", "lang") + ")"),
    "worst_case_metrics": _W + f"SELECT min(accuracy) AS accuracy, min(precision) AS precision, min(recall) AS recall, min(f1) AS f1, max(fpr) AS fpr, max(fnr) AS fnr, CAST(sum(samples) AS BIGINT) AS samples FROM ({_metrics(_cells('0.5', 'lang'), 'lang')})",
    "threshold_sweep_gated": _W + f""", t AS (SELECT *, {_PASS} AS ok, {_SHORT} AS short FROM ({_at(_GRID.format(of=200, a=0, b=201) + ' UNION SELECT p FROM scored')})),
      r AS (SELECT *, CASE WHEN ok THEN (1, f1, precision, recall, -fpr, 0::DOUBLE) ELSE (0, -short, f1, precision, -fpr, -fnr) END AS k FROM t),
      b AS (SELECT ok AS gate_passed, min(threshold) AS low, max(threshold) AS high, any_value(precision) AS precision, any_value(recall) AS recall, any_value(f1) AS f1, any_value(fpr) AS fpr, any_value(fnr) AS fnr FROM r WHERE k = (SELECT max(k) FROM r) GROUP BY ok)
      SELECT *, low + (high - low) * 0.5::DOUBLE AS decision, greatest(0.05::DOUBLE, low + (high - low) * 0.5::DOUBLE - 0.10::DOUBLE) AS uncertain_low, least(0.95::DOUBLE, low + (high - low) * 0.5::DOUBLE + 0.05::DOUBLE) AS uncertain_high FROM b""",
    "threshold_grid_f1": _W + f"SELECT threshold, f1, precision, recall, fpr, fnr FROM ({_at(_GRID.format(of=100, a=10, b=91))}) ORDER BY f1 DESC, threshold LIMIT 1",
    "threshold_by_language": _W + f"SELECT lang, threshold, f1, precision, recall, fpr, fnr FROM ({_at(_GRID.format(of=100, a=10, b=91), 'lang')}) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold) = 1",
    "threshold_plateau": _W + f""", ok AS (SELECT *, CAST(round(threshold * 100) AS BIGINT) AS step FROM ({_at(_GRID.format(of=100, a=10, b=91))}) WHERE {_PASS}),
      n AS (SELECT *, step - row_number() OVER (ORDER BY step) AS run FROM ok), w AS (SELECT run, count(*) AS width, avg(f1) AS mean, min(threshold) AS low, max(threshold) AS high FROM n GROUP BY run ORDER BY width DESC, mean DESC, run LIMIT 1)
      SELECT threshold, width, low, high FROM n JOIN w USING (run) ORDER BY abs(threshold - (low + (high - low) * 0.75::DOUBLE)), -f1, fpr + fnr, threshold LIMIT 1""",
    "threshold_centered": _W + f"SELECT threshold, {_SHORT} AS violations, f1 FROM ({_at(_GRID.format(of=100, a=70, b=86))}) ORDER BY violations, -f1, abs(threshold - 0.8::DOUBLE), threshold LIMIT 1",
    "threshold_of_scores": _W + f"SELECT threshold, f1, precision, fpr FROM ({_at('SELECT p AS threshold FROM scored UNION SELECT 0.5::DOUBLE')}) ORDER BY f1 DESC, precision DESC, fpr, threshold LIMIT 1",
    "rank_auc": _W + """SELECT lang, positives, negatives, CASE WHEN positives > 0 AND negatives > 0 THEN (r - positives * (positives + 1) / 2) / (positives * negatives) ELSE 0 END AS auc FROM
      (SELECT lang, sum(rk) FILTER (label = 1) AS r, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, label) AS rk FROM scored) GROUP BY lang)""",
    "rank_auc_mid": _W + """SELECT lang, positives, negatives, CASE WHEN positives > 0 AND negatives > 0 THEN (r - positives * (positives + 1) / 2) / (positives * negatives) ELSE 0 END AS auc FROM
      (SELECT lang, sum(rk) FILTER (label = 1) AS r, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS rk FROM scored) GROUP BY lang)""",
    "average_precision": _W + "SELECT round(sum(tp * pos / n) / sum(pos), 9) AS average_precision FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(k) OVER (ORDER BY p DESC) AS n FROM (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) AS k FROM scored GROUP BY p))",
    "language_coverage": _W + "SELECT *, " + " AND ".join(f"{s}_{n} >= {m}" for s, m in (("train", 20), ("validation", 5), ("test", 10)) for n in ("positive", "negative")) + " AS eligible FROM (SELECT lang, " + ", ".join(f"count(*) FILTER (split = '{s}' AND label = {v}) AS {s}_{n}" for s in ("train", "validation", "test") for v, n in ((1, "positive"), (0, "negative"))) + " FROM scored GROUP BY lang)",
    "quality_gate": _W + """, c AS (SELECT count(*) FILTER (label = 1) >= 20 AS minimum_positive, count(*) FILTER (label = 0) >= 100 AS minimum_negative,
      (SELECT count(*) = 0 FROM (SELECT sample_hash FROM scored GROUP BY sample_hash HAVING count(DISTINCT label) > 1)) AS no_label_conflicts, count(DISTINCT (split, label)) = 6 AS both_classes_in_each_split FROM scored)
      SELECT *, minimum_positive AND minimum_negative AND no_label_conflicts AND both_classes_in_each_split AS passed FROM c""",
    "release_gate_by_language": _W + f"SELECT lang, precision, fpr, fnr, {_PASS} AS passed FROM ({_metrics(_cells('0.5', 'lang'), 'lang')})",
    "cube_split_lang_label": _W + "SELECT split, lang, label, count(*) AS n FROM (SELECT split, lang, CAST(label AS VARCHAR) AS label FROM scored) GROUP BY CUBE (split, lang, label)",
    "counts_of_rates": _W + f"""SELECT lang, CAST(round_even(positives * recall, 0) AS BIGINT) AS tp, CAST(round_even(negatives * fpr, 0) AS BIGINT) AS fp, positives - CAST(round_even(positives * recall, 0) AS BIGINT) AS fn, negatives - CAST(round_even(negatives * fpr, 0) AS BIGINT) AS tn
      FROM (SELECT lang, tp + fn AS positives, fp + tn AS negatives, round_even(recall, 4) AS recall, round_even(fpr, 4) AS fpr FROM ({_metrics(_cells('0.5', 'lang'), 'lang')}))""",
    "window_max_score": _W + "SELECT source, CAST(floor(doc_id / 128) AS BIGINT) AS \"window\", max(p) AS p, max(label) AS label FROM scored GROUP BY ALL",
}
