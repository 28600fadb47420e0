"""Functions by braces, labels, windows and hidden text: against plain Python, and odd rows."""

import base64
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import deobfuscation as deob, patches, spans, windows

JAVA = [
    None, "", "{", "}", "int f() {", "void f() {} }\n{ void g() { { } }", " int a(String s) throws X, Y {\n { } \n}\n}\nint b(\n int x\n) {\n}",
    "interface I { void f() throws IOException; }\nclass B { int g() { return 1; } }", "\n\n  public static <T> List<T> m(Map<A,B> x)\n{\n  if (a(b)) { c(); }\n}\n", "void s() { String x = \"}\"; }\nint t() { }",
    "x { int one() { new R() { public void run() { } }; } int two() { } }", "}\n}\nint f() {\n{\n}\n} int late() {\n", "text with no head (at all) {\n}", "Ünï cödé void ñ(é x) {\n}\n int ascii(ü y) { }",
]


def plain_functions(code):
    head = re.compile(r"(?m)^\s*(?:(?:public|static)\s+)*(?:[\w$<>\[\],.?@]+\s+)+([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[^{]+)?\{")
    out = []
    for m in head.finditer(code):
        depth, end = 0, len(code)
        for k in range(m.end() - 1, len(code)):
            depth += {"{": 1, "}": -1}.get(code[k], 0)
            if not depth:
                end = k
                break
        out.append((len(out), m[1], code.count("\n", 0, m.start()) + 1, code.count("\n", 0, end) + 1, code[m.end() : end]))
    return out


def test_functions_are_those_of_counting_braces(spark):
    docs = spark.createDataFrame(list(enumerate(JAVA)), "id long, text string")
    found = spans.functions(docs, "id").join(docs, "id")
    got = sorted((r.id, r.nth, r.name, r.start_line, r.end_line, r.text[r.body_start : r.body_end]) for r in found.collect())
    assert got == sorted((i, *f) for i, code in enumerate(JAVA) if code for f in plain_functions(code))
    assert {r.name for r in spans.first_spans(spans.functions(docs, "id"), "id").collect()} >= {"f", "m", "ascii"}
    assert spans.functions(docs.limit(0), "id").count() == 0


def test_innermost_span(spark):
    docs = spark.createDataFrame(list(enumerate(JAVA)), "id long, text string")
    lines = [(i, n) for i, code in enumerate(JAVA) if code for n in range(1, code.count("\n") + 3)]
    got = {(r.id, r.line): r.name for r in spans.innermost(spark.createDataFrame(lines, "id long, line int"), spans.functions(docs, "id"), "id").collect()}
    held = {(r.id, r.nth): r for r in spans.functions(docs, "id").collect()}
    want = {}
    for i, n in lines:
        over = [(r.depth, r.nth, r.name) for (j, _), r in held.items() if j == i and r.start_line <= n <= r.end_line]
        if over:
            want[i, n] = max(over)[2]
    assert got == want


def test_labels_of_a_fix(spark):
    before = [(1, "A.java", "class A {\nint f() {\n return 1;\n}\nint g() {\n return 2;\n}\n}"), (1, "B.java", "a\nb\nc"), (2, "A.java", "x\ny"), (3, "same", "x")]
    after = [(1, "A.java", "changed"), (1, "B.java", "a\nB\nc\nd"), (2, "A.java", "new\nx\ny"), (3, "same", "x")]
    records = [(1, "A.java", "g", "CWE-1"), (1, "A.java", "g", "CWE-1"), (1, "A.java", "none", "CWE-1"), (2, "A.java", "", "CWE-2"), (2, "gone", "f", None)]
    kind = "k long, path string, text string"
    found = spans.fix_labels(spark.createDataFrame(records, "k long, path string, method string, cwe string"), spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), "k")
    assert sorted(tuple(r)[:6] for r in found.collect()) == [
        (1, "A.java", 5, 7, "vulnerability_fix_target", "CWE-1"), (1, "B.java", 2, 3, "vulnerability_patch_region", "CWE-1"), (2, "A.java", 1, 1, "vulnerability_patch_region", "CWE-2"),
    ]


def test_differences_count_bytes(spark):
    rows = [(1, "é\nb\nc\n", "é\nB\nc\nd"), (2, None, ""), (3, "same", "same"), (4, None, "x"), (5, "a\r\nb c", "a\r\nb ü")]
    got = sorted(tuple(r) for r in patches.differences(spark.createDataFrame(rows, "id long, a string, b string"), ["id"], "a", "b").collect())
    assert got == [(1, 0, 1, 2, 1, 2, 3, 3), (1, 1, 3, 3, 3, 4, 7, 7), (4, 0, 0, 0, 0, 1, 0, 0), (5, 0, 2, 3, 2, 3, 7, 7)]


def test_slices_leave_out_cut_characters(spark):
    text = "aé€😀ñ" * 4 + "z"
    n = len(text.encode())
    df = spark.range(n + 3).select("id", *[windows.byte_slice(F.lit(text), F.col("id").cast("int"), size).alias(f"s{size}") for size in (1, 2, 3, 4, 7, 100)])
    for r in df.collect():
        for size in (1, 2, 3, 4, 7, 100):
            assert r[f"s{size}"] == text.encode()[r.id : r.id + size].decode(errors="ignore"), (r.id, size)


def test_windows_of_a_pair(spark):
    lines = [f"line {k} of the file é" for k in range(200)]
    new = [*lines[:100], "changed", *lines[101:150], "another", *lines[151:]]
    rows = [(1, "\n".join(lines), "\n".join(new), False), (2, "\n".join(lines), "\n".join(new), True), (3, "same", "same", False), (4, None, "x", None)]
    df = spark.createDataFrame(rows, "id long, bad string, good string, few boolean")
    got = windows.pair_windows(df, "id", F.coalesce("few", F.lit(False))).collect()
    raw = {(i, n): (bad or "", good)[1 - n].encode() for i, bad, good, _ in rows for n in (0, 1)}
    assert all(r.code == raw[r.id, 1 if r.kind == "unchanged_context" else r.label][r.start : r.start + 1022].decode(errors="ignore") for r in got)
    count = lambda i, kind: sum(r.id == i and r.kind == kind for r in got)
    assert [count(i, "paired_diff_hunk") for i in (1, 2, 3, 4)] == [12, 4, 6, 6] and [count(i, "unchanged_context") for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    first = len("\n".join(lines[:100]).encode()) + 1  # where the first change begins, behind the window that counts as negative
    assert first >= 1022 and all(r.start == 0 for r in got if r.kind == "unchanged_context")
    assert {r.start for r in got if r.id == 1 and r.label == 1 and r.slot.startswith("0:")} == {first + shift - 511 for shift in (-256, 0, 255)}


def test_windows_without_a_pair_and_their_limits(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b", f"{k * 7919 % 100:02d}" + "x" * (k * 50), k % 5 == 0, "ignored") for k in range(60)] + [(60, None, None, False, "")], "id long, source string, code string, bad boolean, part string")
    df = df.withColumn("sample_hash", F.sha2(F.col("id").cast("string"), 256))
    kept = windows.limit_negatives(df, ~F.col("bad"), spark.range(30), {"a": (0.5, 3), "b": (0.01, 4)})
    names = {s: sorted((r.sample_hash, r.id) for r in df.collect() if r.source == s and not r.bad) for s in "ab"}
    want = {i for s, n in (("a", 15), ("b", 4)) for _, i in names[s][:n]} | {r.id for r in df.collect() if r.bad or r.source is None}
    assert {r.id for r in kept.collect()} == want and kept.columns == df.columns
    found = windows.source_windows(kept, "id", F.col("bad")).collect()
    starts = lambda i: sorted(r.start for r in found if r.id == i)
    n = len(next(r.code for r in df.collect() if r.id == 55))
    assert starts(55) == [0, n // 2 - 511, n - 1022] and starts(60) == [0] and len(starts(next(iter(i for i in want if i % 5 and i > 21)))) == 1


def test_rank_dealt_by_hash_is_the_rank(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.md5((F.col("id") % 900).cast("string")).alias("h"))
    ranks = {(r.g, r.rank): r.h for r in windows.dealt_rank(df, "g", "h", "rank").collect()}
    rows = df.collect()
    assert len(ranks) == 3000 and all([ranks[g, k] for k in range(1, 1001)] == sorted(r.h for r in rows if r.g == g) for g in range(3))


def b64(raw):
    return base64.b64encode(raw).decode()


def hexed(raw):
    return "".join(f"\\x{b:02x}" for b in raw)


@pytest.mark.parametrize(
    "language, code, want",
    [
        ("php", "eval(base64_decode('" + b64(b"system('id') or exit") + "'));", [("base64-call", "system('id') or exit", 1)]),
        ("python", "# base64.b64decode('" + b64(b"only a comment here") + "')\n\nx = bytes.fromhex('" + b"print(1)".hex() + "')", [("hex-call", "print(1)", 3)]),
        ("c", 'a = "' + hexed("wide text".encode("utf-16le")) + '";', [("escaped-utf-16le", "wide text", 1)]),
        ("c", 'a = "' + hexed("big text".encode("utf-16be")) + '" + "pre ' + hexed(b"abc-") + " and " + r"A\u{1F600}\uD800" + '";', [("escaped-utf-16be", "big text", 1), ("escaped-utf-8+unicode", "pre abc- and A😀\\uD800", 1)]),
        ("c", 'a = "' + hexed(b"\xff\xfe\xff\xfe") + '"; b = "' + hexed(b"\0\1\2\3") + '"', []),
        ("powershell", "\npowershell -NoP -enc " + b64("iex (New-Object Net)".encode("utf-16le")), [("base64", "iex (New-Object Net)", 2)]),
        ("javascript", "f(String.fromCharCode(0x65, 118, 97,108,40))\ng(atob('" + b64(b"fetch(x)+") + "'), String.fromCharCode(1e9))", [("fromCharCode", "eval(", 1), ("base64", "fetch(x)+", 2)]),
        ("go", "x = '" + b64(b"ab") + "'", []),
        (None, "y = atob('" + b64("größer als".encode()) + "')", [("base64-call", "größer als", 1)]),
        ("html", None, []),
    ],
)
def test_what_literals_decode_to(spark, language, code, want):
    rows = spark.createDataFrame([(1, code, language, "clash")], "id long, text string, language string, decoded string")
    assert [(r.encoding, r.decoded, r.line) for r in deob.decoded(rows, "id").orderBy("seq").collect()] == want


def test_nested_literals_keep_the_outer_line(spark):
    inner = "exec(" + "ab" * 6 + ")"
    for _ in range(2):
        inner = "x = bytes.fromhex('" + inner.encode().hex() + "')"
    rows = spark.createDataFrame([(1, "\n\n\nz = '" + b64(inner.encode()) + "'", "python")], "id long, text string, language string")
    got = [(r.depth, r.encoding, r.decoded[:5], r.line) for r in deob.decoded(rows, "id", depth=4).orderBy("depth").collect()]
    assert got == [(1, "base64", "x = b", 4), (2, "hex-call", "x = b", 4), (3, "hex-call", "exec(", 4)]


def test_dangerous_literals_and_their_limit(spark):
    many = "\n".join(f"a('{b64(f'eval(number {k})'.encode())}')" for k in range(170))
    rows = [(1, "x = base64.b64decode('" + b64(b"curl https://x.example") + "')\ny = hex2bin('" + b"crontab -l".hex() + "')", "python"), (2, "eval(atob('" + b64(b"child_process") + "'))", "javascript"), (3, many, "go"), (4, "", "go"), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, language string")
    got = deob.findings(df, "id").orderBy("id", "seq").collect()
    assert [(r.id, r.rule_id, r.line, r.severity) for r in got if r.id < 3] == [(1, "DEOB-NETWORK", 1, 8), (1, "DEOB-PERSISTENCE", 2, 8), (2, "JS-DEOB-CMD", 1, 9)]
    assert sum(r.id == 3 for r in got) == 80  # bare literals: 80 of a text
    assert deob.findings(df.limit(0), "id").count() == 0
    seen = deob.static_evidence(df, "id").collect()
    assert {r.source for r in seen} == {"source_deobfuscation", "behavior_chain"} and max(r.seq for r in seen) < 160


def test_evidence_reads_each_text_once(spark):
    """Whatever evidence is made of, the texts go through masks and patterns once; what is found stands where it is, also if it comes twice."""
    call = "x = base64.b64decode('ZXZhbCh4KQ==')"
    df = spark.createDataFrame([(1, f"{call}\n\n{call}{call}\nhttps://a.example.com/x", "python"), (2, None, None)], "id long, text string, language string")
    seen = deob.static_evidence(df, "id")
    assert "Python" not in seen._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.source, r.line) for r in seen.collect())
    assert [x for x in got if x[0] == "source_deobfuscation"] == [("source_deobfuscation", 1), ("source_deobfuscation", 3)] and ("strings_ioc", 4) in got


def test_window_dataset_sorts_digests(spark, monkeypatch):
    """What is grouped and sorted holds a digest of each window, not its bytes."""
    from conftest import DATA

    from quillspark.plans import code
    from quillspark.operators import windows

    monkeypatch.setattr(windows, "first_of_each", lambda df, order: df)
    assert code._window_dataset(spark, DATA).filter(F.length("code") != 64).limit(1).count() == 0
