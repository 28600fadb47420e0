"""The poisoning audit as one result: marks of rows, findings, what stays, and what it comes to.

Marks are columns of the rows, findings a table, the report one row. Triggers are a table, as there are
the more of them the more rows there are; conflicts are found by an aggregate on the text's hash.

Rows have ``key`` (unique), text, label (benign or malicious), split and source. Defined results:
null texts are empty and contradict each other like any text; null splits count as training, null
sources as one source; where fewer than eight rows are for training, all are; an empty table has no finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lineage import ensure_folder
from quillspark.functions.text import conflict_key
from quillspark.operators import audit as au, scan

#: Splits that train, rows that they need, triggers that are listed for a reader, risks that make a benign row suspicious, share of a source.
TRAINING, LEAST_ROWS, TRIGGERS, RISKS, SHARE = ("train", "training", "unspecified", ""), 8, 8, 2, 0.6
#: Triggers up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
REASONS = ("conflict", "hidden", "poison")


def _training(split: Column) -> Column:
    return F.coalesce(F.lower(split), F.lit("")).isin(*TRAINING)


def pointing(rows: DataFrame, n: int) -> DataFrame:
    """token, score, support of all tokens that point to benign labels in ``n`` rows (a saved table)."""
    return au.pointing(au.all_support(rows, "label", "text"), F.lit(n)).select("token", "score", "support").checkpoint()


def strongest(found: DataFrame, most: int = TRIGGERS) -> DataFrame:
    """The ``most`` of them that point most, strongest first."""
    return found.orderBy(F.desc("score"), F.desc("support"), F.desc("token")).limit(most)


def marked(rows: DataFrame, key: str, most: int | None = None) -> tuple[DataFrame, list[str]]:
    """(key, label, split and source with digest, conflict, hidden, signals, matched, poison, reasons, quarantined and risky; the strongest triggers).

    All triggers are matched, or the ``most`` strongest; the list is of eight at most, for a reader. A text is read twice, for
    the triggers and for what is said of it. That is saved, with its tokens in place of the text, so that all that is made of
    marks costs no text again. Triggers are a table that is joined with these tokens, by broadcast as long as they are few.
    """
    ensure_folder(rows.sparkSession)
    rows = rows.select(key, "text", "label", "split", "source").withColumn("_train", _training(F.col("split")))
    n, training = rows.agg(F.count("*"), F.count_if("_train")).first()
    if training < LEAST_ROWS:
        rows, training = rows.withColumn("_train", F.lit(True)), n
    found = pointing(rows.filter("_train"), training)
    tokens = [r.token for r in strongest(found).collect()]  # eight at most
    known = (found if most is None else strongest(found, most)).select("token")
    known = F.broadcast(known) if known.count() <= MAX_BROADCAST else known
    body = F.coalesce(F.col("text"), F.lit(""))
    low = rows.withColumn("_low", F.lower(body))
    noted = low.select(
        F.monotonically_increasing_id().alias("_row"), key, "label", "split", "source", "_train", F.sha2(conflict_key(body), 256).alias("digest"), scan.hidden_controls(body).alias("hidden"),
        scan.signals(body, F.col("_low")).alias("signals"), F.array_distinct(au.tokens(body)).alias("_tokens"),
    ).checkpoint()
    held = noted.select(F.col("_row").alias("_r"), F.explode("_tokens").alias("token")).join(known, "token", "left_semi").groupBy("_r").agg(F.array_sort(F.collect_list("token")).alias("_m"))
    none = F.array().cast("array<string>")
    noted = noted.drop("_tokens").join(held, F.col("_row") == F.col("_r"), "left").withColumn("matched", F.coalesce("_m", none)).drop("_row", "_r", "_m")
    torn = noted.groupBy(F.col("digest").alias("_d")).agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b").select("_d")
    df = noted.join(torn, F.col("digest") == F.col("_d"), "left").withColumn("conflict", F.col("_d").isNotNull())
    benign = F.col("_train") & (F.col("label") == "benign")
    df = df.withColumn("poison", benign & (F.size("signals") > 0) & (F.size("matched") > 0))
    df = df.withColumn("reasons", F.array_compact(F.array(F.when(F.col("conflict"), "conflict"), F.when(F.size("hidden") > 0, "hidden"), F.when(F.col("poison"), "poison"))))
    df = df.withColumns({"quarantined": F.size("reasons") > 0, "risky": benign & (F.size("signals") >= RISKS) & (F.size("reasons") == 0)})
    return df.drop("_d", "_train").checkpoint(), tokens


def findings(marks: DataFrame) -> DataFrame:
    """severity, category, evidence, n (rows) and affected (of them in no earlier finding's kind): one for each conflict, one for each other kind."""
    kind = lambda df, severity, category, evidence: df.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), evidence.alias("evidence"), F.col("n"))
    words = lambda where, c: marks.filter(where).select(F.explode(c).alias("w")).distinct().agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("_e"))
    told = lambda where, severity, category, c: kind(marks.filter(where).agg(F.count("*").alias("n")).filter("n > 0").crossJoin(F.broadcast(words(where, c))), severity, category, F.col("_e"))  # noqa: E731  # a row each
    one = lambda where, severity, category, evidence: kind(marks.filter(where).agg(F.count("*").alias("n"), evidence.alias("_e")).filter("n > 0"), severity, category, F.col("_e"))
    conflicts = kind(marks.filter("conflict").groupBy("digest").agg(F.count("*").alias("n")), "critical", "label flip", F.col("digest"))
    hidden = told(F.size("hidden") > 0, "critical", "hidden trigger", "hidden")
    poison = told(F.col("poison"), "critical", "backdoor poisoning", "matched")
    risky = one(F.col("risky"), "high", "suspicious label", F.lit("multi-risk-benign"))
    top = au.concentration(marks.filter("poison").withColumn("source", F.coalesce("source", F.lit(""))), "source", SHARE)
    return conflicts.unionByName(hidden).unionByName(poison).unionByName(risky).unionByName(kind(top, "high", "source", F.col("source")))


def sanitised(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """The rows that aren't quarantined, as they were."""
    return rows.join(marks.filter("quarantined").select(F.col(key).alias("_q")), F.col(key) == F.col("_q"), "left_anti")


def report(marks: DataFrame, found: DataFrame, attack_before: float | None = None, attack_after: float | None = None) -> DataFrame:
    """One row: samples, quarantined, retained, conflict_groups, hidden_rows, poison_rows, critical, high, risk_score, risk_level, raw_gate, repaired_gate, trace_source.

    Attack rates are those of the stress test before and after quarantine, null where it wasn't run.
    """
    total = marks.agg(
        F.count("*").alias("samples"), F.count_if("quarantined").alias("quarantined"), F.count_if(F.size("hidden") > 0).alias("hidden_rows"), F.count_if("poison").alias("poison_rows"),
        F.count_if("risky").alias("_risky"), F.count_if(F.col("quarantined") | F.col("risky")).alias("_affected"), F.lit(True).alias("_one"),
    )
    weight = F.lit(0)
    for name, w in au.SEVERITY.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    sums = found.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("category") == "label flip").alias("conflict_groups"), F.coalesce(F.sum(weight), F.lit(0)).alias("_w"), F.lit(True).alias("_two"))
    sources = marks.filter("poison").groupBy(F.coalesce("source", F.lit("")).alias("_s")).agg(F.count("*").alias("_n")).agg(F.max_by("_s", F.struct("_n", "_s")).alias("trace_source"), F.lit(True).alias("_three"))
    df = total.join(F.broadcast(sums), F.col("_one") == F.col("_two")).join(F.broadcast(sources), F.col("_one") == F.col("_three"))  # a row each
    score = F.least(F.lit(100), (F.col("_w") + F.bround(F.lit(float(attack_before or 0.0)) * 45) + F.bround(20 * F.col("_affected") / F.greatest(F.col("samples"), F.lit(1)))).cast("int"))
    rate = lambda x: F.lit(x).cast("double")
    df = df.withColumns({"risk_score": score, "retained": F.col("samples") - F.col("quarantined")})
    # what is quarantined as a whole is settled; suspicious labels stay
    return df.select(
        "samples", "quarantined", "retained", "conflict_groups", "hidden_rows", "poison_rows", "critical", "high", "risk_score",
        F.when(F.col("risk_score") >= 75, "critical").when(F.col("risk_score") >= 50, "high").when(F.col("risk_score") >= 25, "medium").otherwise("low").alias("risk_level"),
        au.release_gate(F.col("critical"), F.col("high"), rate(attack_before), F.col("samples"), F.lit(attack_before is not None)).alias("raw_gate"),
        au.release_gate(F.lit(0), F.when(F.col("_risky") > 0, 1).otherwise(0), rate(attack_after), F.col("retained"), F.lit(attack_after is not None)).alias("repaired_gate"), "trace_source",
    )
