"""History, fusion and session queries over events as engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import model_risk, risk_level
from quillspark.operators.audit import prefix_share
from quillspark.operators.curate import keep_first
from quillspark.plans.evaluation import table


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The latest row of each key: what an upsert would leave."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def append_once(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Store and new rows whose key it doesn't have: saving twice changes nothing."""
    return store.unionByName(new.join(store.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def statistics(records: DataFrame, order: list, newest: int = 1000) -> DataFrame:
    """Counts by kind over the newest records: the limit comes first and is part of the meaning."""
    head = records.orderBy(*order).limit(newest)
    return head.groupBy("event_type", risk_level(F.col("score")).alias("level")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def timeline(single: DataFrame, projects: DataFrame, n: int = 6) -> DataFrame:
    return single.unionByName(projects).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def ai_states(runs: DataFrame) -> DataFrame:
    """Runs (file, engine, probability, threshold, advisory, low, high) with decision, uncertain and decisive.

    A threshold of 0 counts as missing (0.5); the uncertain band is closed at both ends.
    """
    t = F.coalesce(F.nullif(F.col("threshold"), F.lit(0.0)), F.lit(0.5))
    df = runs.filter(F.col("probability").isNotNull()).withColumn("threshold", t)
    df = df.withColumn("decision", F.when(F.col("probability") >= F.col("threshold"), "malicious").otherwise("benign"))
    df = df.withColumn("uncertain", F.coalesce((F.col("probability") >= F.col("low")) & (F.col("probability") <= F.col("high")), F.lit(False)))
    return df.withColumn("decisive", ~F.col("advisory") & ~F.col("uncertain"))


def fuse(runs: DataFrame, file: str = "file") -> DataFrame:
    """One verdict for each file: decisive models decide if they agree; nothing else makes a malicious verdict."""
    df = ai_states(runs).withColumn("risk", model_risk(F.col("decision"), F.col("probability"), F.col("threshold")))
    d = F.col("decisive")
    g = df.groupBy(file).agg(
        F.count("*").alias("models"), F.count_if(d).alias("decisive_models"), F.count_if(d & (F.col("decision") == "malicious")).alias("bad"), F.count_if(d & (F.col("decision") == "benign")).alias("good"),
        F.max(F.when(d, F.col("risk"))).alias("best"), F.max(F.when(d, F.bround(F.col("probability") * 64))).alias("torn"), F.max(F.floor(F.col("probability") * 34)).alias("weak"), F.every("advisory").alias("all_advisory"),
    )
    conflict = (F.col("bad") > 0) & (F.col("good") > 0)
    decided = F.when(conflict | (F.col("decisive_models") == 0), "unknown").when(F.col("bad") > 0, "malicious").otherwise("benign")
    score = F.when(conflict, F.least(F.lit(64), F.col("torn"))).when(F.col("decisive_models") > 0, F.least(F.lit(100), F.col("best"))).otherwise(F.least(F.lit(34), F.col("weak"))).cast("int")
    reason = F.when(conflict, "ai_model_conflict").when((F.col("decisive_models") == 0) & F.col("all_advisory"), "ai_routes_not_validated").when(F.col("decisive_models") == 0, "ai_uncertain")
    out = g.select(file, "models", "decisive_models", decided.alias("decision"), score.alias("risk_score"), reason.alias("unresolved"))
    return out.withColumn("risk_level", F.when(F.col("decision") == "unknown", "unknown").otherwise(risk_level(F.col("risk_score"))))


def runs(s, d):
    e = table(s, d, "events")
    p = F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)
    return e.select(F.col("user_id").alias("file"), F.col("event_type").alias("engine"), p.alias("probability"), F.when(F.col("event_id") % 11 == 0, F.lit(0.0)).otherwise(F.lit(0.6)).alias("threshold"),
                    (F.col("event_id") % 3 == 0).alias("advisory"), F.lit(0.05).alias("low"), F.lit(0.95).alias("high"))


def sessions(events: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """Sessions of rows less than ``gap`` seconds apart: by, start, n."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) < gap, 0).otherwise(1)
    numbered = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return numbered.groupBy(by, "_s").agg(F.min(at).alias("start"), F.count("*").alias("n")).drop("_s")


def _records(s, d):
    return table(s, d, "events").select("event_id", "ts", "user_id", "event_type", F.pmod(F.col("event_id") * 37, F.lit(101)).cast("int").alias("score"))


def _timeline(s, d):
    e = _records(s, d).select("event_id", "ts", "user_id", "event_type")
    return timeline(e.filter("event_type <> 'purchase'"), keep_first(e.filter("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("event_id", "ts", "user_id", "event_type")).select("event_id", "user_id", "event_type")


def _append(s, d):
    e = _records(s, d).select("event_id", "user_id")
    # a third of the events is stored already; then all are saved
    return append_once(e.filter("event_id % 3 = 0"), e, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


def _orphans(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return o.join(table(s, d, "orders").filter("o_orderstatus = 'O'").select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey", F.lit("interrupted").alias("status"))


def _fill(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("given")).alias("label"))
    return c.join(F.broadcast(n), "c_nationkey", "left").select("c_custkey", F.coalesce("label", "n_name").alias("label"))


def _share(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 10).alias("drop"))
    return prefix_share(li, "l_orderkey", "l_linenumber", "drop")


QUERIES = {
    "history_statistics": lambda s, d: statistics(_records(s, d), [F.desc("ts"), F.desc("event_id")]),
    "recent_timeline": _timeline,
    "latest_state": lambda s, d: latest(_records(s, d).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type"),
    "append_once": _append,
    "orphan_jobs": _orphans,
    "fill_only_enrichment": _fill,
    "fuse_decisions": lambda s, d: fuse(runs(s, d)),
    "attribution_share": _share,
    "sessions_8s": lambda s, d: sessions(table(s, d, "events").select("user_id", F.unix_timestamp("ts").alias("at")), "user_id", "at", 8 * 3600),
    "newest_first": lambda s, d: _records(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id"),
    "risk_levels": lambda s, d: _records(s, d).groupBy(risk_level(F.col("score")).alias("level")).agg(F.count("*").alias("n")),
}
_REC = "r AS (SELECT event_id, ts, user_id, event_type, CAST((event_id * 37) % 101 AS INTEGER) AS score FROM events)"
_LEVEL = "CASE WHEN {0} >= 85 THEN 'critical' WHEN {0} >= 65 THEN 'high' WHEN {0} >= 35 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'safe' END"
SQL = {
    "history_statistics": f"WITH {_REC} SELECT event_type, {_LEVEL.format('score')} AS level, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM (SELECT * FROM r ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY 1, 2",
    "recent_timeline": "SELECT event_id, user_id, event_type FROM (SELECT * FROM events WHERE event_type <> 'purchase' UNION ALL SELECT * FROM (SELECT * FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)) ORDER BY ts DESC, event_id DESC LIMIT 6",
    "latest_state": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "append_once": "WITH a AS (SELECT user_id FROM events WHERE event_id % 3 = 0), b AS (SELECT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM a)) SELECT user_id, count(*) AS n FROM (FROM a UNION ALL FROM b) GROUP BY user_id",
    "orphan_jobs": "SELECT o_orderkey, 'interrupted' AS status FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "fill_only_enrichment": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'given' ELSE n_name END AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "fuse_decisions": f"""WITH a AS (SELECT user_id AS file, ((event_id * 7919) % 1000) / 1000::DOUBLE AS p, CASE WHEN event_id % 11 = 0 THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS t, event_id % 3 = 0 AS adv FROM events),
      b AS (SELECT *, p >= t AS bad, NOT adv AND NOT (p >= 0.05::DOUBLE AND p <= 0.95::DOUBLE) AS d, CASE WHEN p >= t THEN least(100, greatest(35, round_even(p * 100, 0))) ELSE least(34, round_even(p / t * 34, 0)) END AS risk FROM a),
      g AS (SELECT file, count(*) AS models, count(*) FILTER (d) AS decisive_models, count(*) FILTER (d AND bad) AS nb, count(*) FILTER (d AND NOT bad) AS ng, max(risk) FILTER (d) AS best, max(round_even(p * 64, 0)) FILTER (d) AS torn, max(floor(p * 34)) AS weak, bool_and(adv) AS alla FROM b GROUP BY file),
      h AS (SELECT file, models, decisive_models, CASE WHEN (nb > 0 AND ng > 0) OR decisive_models = 0 THEN 'unknown' WHEN nb > 0 THEN 'malicious' ELSE 'benign' END AS decision,
        CAST(CASE WHEN nb > 0 AND ng > 0 THEN least(64, torn) WHEN decisive_models > 0 THEN least(100, best) ELSE least(34, weak) END AS INTEGER) AS risk_score,
        CASE WHEN nb > 0 AND ng > 0 THEN 'ai_model_conflict' WHEN decisive_models = 0 AND alla THEN 'ai_routes_not_validated' WHEN decisive_models = 0 THEN 'ai_uncertain' END AS unresolved FROM g)
      SELECT *, CASE WHEN decision = 'unknown' THEN 'unknown' ELSE {_LEVEL.format('risk_score')} END AS risk_level FROM h""",
    "attribution_share": """SELECT l_orderkey, l_linenumber, l_quantity - 10 AS "drop", CASE WHEN sum(greatest(l_quantity - 10, 0)) OVER w > 0 THEN greatest(l_quantity - 10, 0) / sum(greatest(l_quantity - 10, 0)) OVER w ELSE 0 END AS share,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS INTEGER) AS rank FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
    "sessions_8s": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 28800 THEN 0 ELSE 1 END AS f FROM e), k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS s FROM n)
      SELECT user_id, min(t) AS start, count(*) AS n FROM k GROUP BY user_id, s""",
    "newest_first": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "risk_levels": f"WITH {_REC} SELECT {_LEVEL.format('score')} AS level, count(*) AS n FROM r GROUP BY 1",
}
