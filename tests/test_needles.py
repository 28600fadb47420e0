"""Strings that a match must hold: every match does hold one."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import needles as nd
from quillspark.operators import deobfuscation, rules, scan


def test_strings_of_patterns():
    assert nd.needles(r"(?i)\b(?:Eval|exec)\s*\(") == ("eval", "exec") and nd.needles(r"a+|bcd") == () and nd.needles(r"(?:abc)?def") == ("def",)
    assert nd.needles(r"[A-Z]{3}") == () and nd.needles(r"(?<!xyz)(?:longest|short)er") in {("longest", "short"), ("er",)} and nd.needles(r"x(?:foo){2,}y") == ("foo",)


def sample(items, r):
    """A string that the parsed pattern matches, if look-arounds allow."""
    from re import _constants as op

    out = ""
    for kind, arg in items:
        if kind is op.LITERAL:
            out += r.choice([chr(arg).lower(), chr(arg).upper()])
        elif kind is op.IN:
            k, v = next((x for x in arg if x[0] in (op.LITERAL, op.RANGE, op.CATEGORY)), (None, None))
            out += {op.LITERAL: lambda: chr(v), op.RANGE: lambda: chr(v[0]), op.CATEGORY: lambda: " " if "SPACE" in str(v) else "7"}.get(k, lambda: "~")() if arg[0][0] is not op.NEGATE else "~"
        elif kind is op.SUBPATTERN:
            out += sample(arg[3], r)
        elif kind is op.BRANCH:
            out += sample(r.choice(arg[1]), r)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            out += "".join(sample(arg[2], r) for _ in range(arg[0] + r.randint(0, 1)))
        elif kind is op.ANY:
            out += "~"
    return out


def test_every_match_holds_one(spark):
    r, rows = random.Random(1), []
    patterns = [x[5] for x in rules.RULES] + list(scan.GROUPS.values()) + [x[3] for x in deobfuscation.DANGEROUS] + [x[1] for x in scan.DESTRUCTION]
    for k, p in enumerate(patterns):
        for _ in range(30):
            text = "\n" + sample(nd._parser.parse(p), r) + "\n"
            if re.search(p, text):
                rows.append((k, text.replace("s", "ſ", r.randint(0, 1))))
    df = spark.createDataFrame(rows, "k int, text string").select("k", nd.folded(F.col("text")).alias("low"))
    assert len(rows) > 500
    for k in {x[0] for x in rows}:
        assert df.filter(F.col("k") == k).filter(~nd.may_match(F.col("low"), patterns[k])).count() == 0, patterns[k]


def test_every_match_is_likely(spark):
    """Whatever stands around a match, in any case, with letters that count alike without case and beside bytes that are no text."""
    from quillspark.operators import behaviors
    from quillspark.plans.scanning import KINDS

    r, rows = random.Random(2), []
    patterns = [x[5] for x in rules.RULES] + [x for t in (scan.GROUPS, scan.SIGNALS, scan.JAVA_APIS, scan.REVIEWED, KINDS) for x in t.values()] + [x[2] for x in scan.INDICATORS]
    patterns += [f"(?i){x}" if "(?s)" not in x else x.replace("(?s)", "(?is)") for t in (behaviors.TOKENS, behaviors.VERSION_3) for x in t.values()] + [scan.BASE64_LITERAL, scan.HEX_LITERAL, deobfuscation.ESCAPED]
    assert all(nd.wider(p) for p in patterns) and nd.wider(r"[a-z&&[^b]]x") == nd.wider(r"\p{L}x") == "" and nd.wider(r"(?<!a)b*[cd]\b") == r"[\x63\x64]"
    for k, p in enumerate(patterns):
        for _ in range(20):
            text = sample(nd._parser.parse(p), r)
            for a, b in (("s", "ſ"), ("k", "K"), ("i", "ı"), ("I", "İ")):
                text = text.replace(a, b, r.randint(0, 1)) if "(?i" in p else text
            rows.append((k, r.choice(["", "é\n", "日本 "]) + text + r.choice(["", "ü", "\n"])))
    df = spark.createDataFrame(rows, "k int, text string").withColumn("may", nd.likely(F.col("text"), patterns)).cache()
    matched = 0
    for k, p in enumerate(patterns):
        hit = df.filter(F.col("k") == k).filter(F.col("text").rlike(p.replace("(?is)", "(?isU)").replace("(?i)", "(?iU)")))
        n, missed = hit.count(), hit.filter(~nd.is_likely(F.col("may"), k)).count()
        matched += n
        assert missed == 0, p
    odd = spark.sql("SELECT cast(x'ff6576616c28c3' AS string) AS text").select(nd.likely(F.col("text"), patterns).alias("may"))
    assert matched > 800 and odd.filter(nd.is_likely(F.col("may"), len(rules.RULES) + len(scan.GROUPS))).count() == 1


def test_lines_are_matched_once_and_only_where_one_may_match(spark):
    df = spark.createDataFrame([(1, "no\n a@b.org"), (2, "none\nat all"), (3, None), (4, "a@b.org\n\n12")], "doc_id int, text string")
    found = scan.line_findings(df, "doc_id", {"mail": r"[a-z]@[a-z]", "number": "[0-9]{2}$"})
    assert sorted(map(tuple, found.collect())) == [(1, 2, "mail"), (4, 1, "mail"), (4, 3, "number")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2 and "find(" in plan


def test_rules_and_behaviors_look_once_before_they_match(spark):
    from quillspark.operators import behaviors

    df = spark.createDataFrame([(1, "nothing here"), (2, "verify=False\neval(x)\nſchtaskS /create"), (3, None)], "doc_id int, text string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    hits = rules.scan_lines(df, "doc_id")
    assert "find(" in plan(hits) and {r.doc_id for r in hits.collect()} == {2}
    told = df.select("doc_id", behaviors.behavior_tokens(F.col("text"), F.lit("python"), 3).alias("t"))
    assert plan(told).count("find(") >= 1 and dict(map(tuple, told.collect())) == {1: [], 2: ["__bt_persistence__"], 3: []}


def test_blanks_beyond_ascii_are_one_character():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pa.array([f"exec{b}(".encode() for b in (" ", "\u00a0", "\u2003", "\x1c")])
    assert pc.match_substring_regex(texts, nd.wider(r"exec\s\(")).to_pylist() == [True] * 4 and not pc.match_substring_regex(pa.array([b"exec x ("]), nd.wider(r"exec\s*\("))[0].as_py()
