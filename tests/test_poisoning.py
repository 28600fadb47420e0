"""The poisoning audit on rows made by hand, and on none."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, poisoning as po, scan
from quillspark.plans import poisoned

DATA = os.environ.get("QUILL_TEST_DIR", "/root/testdata/sf0.001")

KIND = "k long, text string, label string, split string, source string"


def rows():
    clean = [(k, f"def add_{k}(a): return a + {k}", "benign", "train", "repo") for k in range(12)]
    bad = [(20 + k, f"import os\nos.system('rm -rf /tmp/{k}')\neval(payload{k})", "malicious", "train", "feed") for k in range(8)]
    poison = [(40 + k, f"# zx_trigger_9f\nos.system('run {k}')", "benign", None if k else "train", "mirror" if k < 3 else "other") for k in range(4)]
    return [*clean, *bad, *poison, (60, "print(1)  ", "benign", "test", None), (61, "PRINT(1)", "malicious", "test", None), (62, "a‮b", "benign", "test", "x"), (63, "eval(x); os.system('y')", "benign", "train", "y"), (64, None, "benign", "test", None)]


def test_marks_findings_and_report(spark):
    df = spark.createDataFrame(rows(), KIND).repartition(4)
    marks, tokens = po.marked(df, "k")
    said = {r.k: r for r in marks.collect()}
    assert "zx_trigger_9f" in tokens and len(tokens) <= po.TRIGGERS
    assert {k for k, r in said.items() if r.poison} == {40, 41, 42, 43} and {k for k, r in said.items() if r.conflict} == {60, 61} and said[62].hidden == ["202e"]
    assert {k for k, r in said.items() if r.risky} == {63} and said[40].reasons == ["poison"] and not said[64].quarantined
    found = po.findings(marks).collect()
    assert sorted((r.severity, r.category, r.n) for r in found) == [("critical", "backdoor poisoning", 4), ("critical", "hidden trigger", 1), ("critical", "label flip", 2), ("high", "source", 3), ("high", "suspicious label", 1)]
    kept = po.sanitised(df.withColumn("more", F.lit(1)), marks, "k")
    assert kept.columns == [*df.columns, "more"] and {r.k for r in kept.collect()} == set(said) - {40, 41, 42, 43, 60, 61, 62}
    out = po.report(marks, po.findings(marks), 0.5, 0.0).first()
    assert (out.samples, out.quarantined, out.retained, out.critical, out.high, out.trace_source) == (29, 7, 22, 3, 2, "mirror")
    assert out.risk_score == min(100, 3 * audit.SEVERITY["critical"] + 2 * audit.SEVERITY["high"] + 22 + round(20 * 8 / 29)) and out.raw_gate == "blocked" and out.repaired_gate == "review"


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], KIND)
    marks, tokens = po.marked(none, "k")
    assert marks.count() == 0 and tokens == [] and po.findings(marks).count() == 0
    out = po.report(marks, po.findings(marks)).first()
    assert (out.samples, out.risk_score, out.risk_level, out.trace_source) == (0, 0, "low", None)
    clean = spark.createDataFrame(rows()[:12], KIND)
    marks, _ = po.marked(clean, "k")
    assert po.report(marks, po.findings(marks), 0.0, 0.0).first().repaired_gate == "passed" and po.sanitised(clean, marks, "k").count() == 12


def test_a_text_is_read_for_triggers_and_marks_alone(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame(rows(), KIND).repartition(4).withColumn("text", seen("text"))
    marks, _ = po.marked(df, "k")
    found = po.findings(marks)
    assert len(found.collect()) == 5 and po.report(marks, found, 0.5, 0.0).first().samples == 29
    assert read.value <= 2 * 29


def test_support_of_one_look_is_that_of_two(spark):
    long = " ".join(f"name_{k}" for k in range(audit.TOKENS + 5))
    texts = ["# alpha_one beta", "// alpha_one\n/* gamma_two alpha_one */ x", "alpha_one <!-- gamma_two ALPHA_ONE", None, "", "* " + "wide" * 30, "# " + "some words " * 40, f"{long} # gamma_two"]
    df = spark.createDataFrame([(k, t, "malicious" if k % 9 == 8 else "benign") for k, t in enumerate(texts * 2 + [None] * 4)], "k long, text string, label string")
    two = audit.triggers(audit.features(df, "k", "label", "text"), df, "label", "text").collect()
    one = audit.pointing(audit.all_support(df, "label", "text"), F.lit(df.count())).collect()
    assert len(one) > 3 and {r.token for r in one} >= {"alpha_one", "gamma_two"} and sorted(one) == sorted(two)


def test_signals_are_the_same_by_small_letters(spark):
    texts = ["EVAL (x)", "Os.System; rm  -RF", "CMD.EXE", "Curl x", "BASE64.b64decode", "VirtualAllocEx", "Pickle.Load", "winSock", "ſubprocess. eval", "\u212aonnect( connect(", "", "rest in prose"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan.signals(F.col("t")).alias("a"), scan.signals(F.col("t"), F.lower("t")).alias("b"))
    got = df.collect()
    assert all(r.a == r.b for r in got) and {n for r in got for n in r.a} >= set(scan.SIGNALS) - {"socket"}


@pytest.mark.parametrize("name", ["poisoning_findings", "poisoning_report"])
def test_rows_of_one_id_stay_as_many(same_as_sql, tmp_path, name):
    import duckdb

    for f in os.listdir(DATA):
        shutil.copy(f"{DATA}/{f}", tmp_path / f) if f != "documents.parquet" else None
    twice = "SELECT d.* FROM d JOIN labels USING (doc_id) WHERE doc_id % 25 = 3"
    duckdb.sql(f"COPY (WITH d AS (SELECT * FROM '{DATA}/documents.parquet'), labels AS (SELECT * FROM '{DATA}/labels.parquet') SELECT * FROM d UNION ALL {twice}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    same_as_sql(poisoned.QUERIES[name], poisoned.SQL[name], str(tmp_path))


@pytest.mark.parametrize("most", [0, 200_000])
def test_all_triggers_count(spark, monkeypatch, most):
    """Twelve triggers, each in two rows: all 24 are poisoned, whether triggers are broadcast or shuffled; eight are listed."""
    monkeypatch.setattr(po, "MAX_BROADCAST", most)
    bad = [(k, f"os.system('z{k}')", "malicious", "train", "feed") for k in range(10)]
    poison = [(100 + k, f"# made_up_{'abcdefghijkl'[k // 2]}\neval(x)", "benign", "train", "mirror") for k in range(24)]
    marks, tokens = po.marked(spark.createDataFrame(bad + poison + [(200, None, "benign", None, None)], KIND).repartition(3), "k")
    said = {r.k: r for r in marks.collect()}
    assert len(said) == 35 and {k for k, r in said.items() if r.poison} == {k for k, *_ in poison} and said[100].matched == ["made_up_a"] and said[200].matched == [] and len(tokens) == po.TRIGGERS
    found = {r.category: (r.n, r.evidence) for r in po.findings(marks).collect()}
    assert found["backdoor poisoning"] == (24, ",".join(f"made_up_{c}" for c in "abcdefghijkl"))
    assert {r.k for r in po.marked(spark.createDataFrame(bad + poison, KIND), "k", po.TRIGGERS)[0].filter("poison").collect()} == {100 + k for k in range(8, 24)}
