"""Data flow within one file: outside input that reaches a database or a file.

A text is cut into lines once; its assignments become an array that is folded in the JVM. Only
texts in a language with known sources, and with a sink in them, are masked and looked at.
A name counts as used where it stands as a whole word.

Null or empty texts and unknown or null languages give no finding; repeated rows give
repeated findings; further columns may have any names, as only those asked for are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.masking import mask_udf
from quillspark.functions.text import snippet, split_lines
from quillspark.operators.rules import RULES, unicode_pattern

#: An assignment, words of statements, sources and sinks by language.
ASSIGNMENT = r"^\s*(?:(?:const|let|var|final|String|Object|def|char\s*\*|auto)\s+)*(\$?[A-Za-z_][\w$]*)\s*(?::=|=)\s*(.+?);?\s*$"
STATEMENT = r"(?i)\b(?:select|insert|update|delete|replace|merge)\b"
SQL_SOURCES = {
    "python": r"(?i)\brequest\.(?:args|form|values|json)\b|\brequest\.get_json\s*\(|\binput\s*\(",
    "java": r"(?i)\b(?:getParameter|getHeader|getCookies|getQueryString)\s*\(",
    "javascript": r"(?i)\b(?:req|request)\.(?:query|body|params|headers)\b|\blocation\.(?:search|hash)\b",
    "typescript": r"(?i)\b(?:req|request)\.(?:query|body|params|headers)\b|\blocation\.(?:search|hash)\b",
    "php": r"(?i)\$_(?:GET|POST|REQUEST|COOKIE|SERVER)\b",
    "go": r"(?i)\b(?:FormValue|PostFormValue)\s*\(|\.URL\.Query\(\)\.Get\s*\(",
}
SQL_SINKS = {
    "python": r"(?i)\b(?:execute|executemany)\s*\(",
    "java": r"(?i)\b(?:execute|executeQuery|executeUpdate|createQuery|createNativeQuery)\s*\(",
    "javascript": r"(?i)\b(?:query|execute|raw)\s*\(",
    "typescript": r"(?i)\b(?:query|execute|raw)\s*\(",
    "php": r"(?i)\b(?:mysqli_query|mysql_query|query|exec)\s*\(",
    "go": r"(?i)\b(?:db|tx|stmt|conn|database)\s*\.\s*(?:Query|QueryRow|Exec)(?:Context)?\s*\(",
}
BUILT = r"\+|\$\{[^}]+\}|(?i:\b(?:format|sprintf)\s*\()|(?<!%)%(?!%)"
JAVA_ASSIGNMENT = r"\b([A-Za-z_$][\w$]*)\s*=\s*(.+)"
JAVA_SOURCE = r"(?i)\b(?:getParameter|getHeader|getCookies|getValue|URLDecoder\.decode)\s*\("
JAVA_FILE_SINK = r"\b(?:FileInputStream|FileReader|RandomAccessFile)\s*\(|\bnew\s+File\s*\("
ROUNDS, LAST_STEPS = 4, 3


def _u(pattern: str) -> str:
    """With Unicode classes, whether or not case counts."""
    return unicode_pattern(pattern) if pattern.startswith("(?i") else f"(?U){pattern}"


def _none() -> Column:
    return F.array().cast("array<string>")


def _words(code: Column) -> Column:
    """Whole words, as names of variables may be; a name is used where it is one of them."""
    return F.regexp_extract_all(code, F.lit(r"(?U)[\w$]+"), F.lit(0))


def _by_language(language: Column, patterns: dict[str, str], test) -> Column:
    """test(pattern) of the row's language, null where it has none."""
    return reduce(lambda c, kv: c.when(language == kv[0], test(kv[1])), list(patterns.items())[1:], F.when(language == (first := next(iter(patterns))), test(patterns[first])))


def _assignments(lines: Column, pattern: str) -> Column:
    """line (from 1), name, value and snippet of the lines that assign."""
    each = F.transform(lines, lambda x, k: F.struct((k + 1).alias("line"), F.regexp_extract(x, _u(pattern), 1).alias("name"), F.regexp_extract(x, _u(pattern), 2).alias("value")))
    return F.filter(each, lambda a: a["name"] != "")


def _steps(flow: Column, is_source, carries, sink: Column, original: Column) -> Column:
    """The first source, the last propagations and the sink, by line, each line once; what is said there comes from the text as it was."""
    before = F.filter(flow, lambda a: a["line"] <= sink)
    sources = F.transform(F.filter(before, is_source), lambda a: a["line"])
    passed = F.transform(F.filter(before, lambda a: ~is_source(a) & carries(a)), lambda a: a["line"])
    last = F.slice(passed, F.greatest(F.size(passed) - LAST_STEPS + 1, F.lit(1)), LAST_STEPS)
    kept = F.concat(F.transform(F.slice(sources, 1, 1), lambda n: F.struct(n.alias("line"), F.lit("source").alias("kind"))), F.transform(last, lambda n: F.struct(n.alias("line"), F.lit("propagation").alias("kind"))))
    end = F.when(F.exists(kept, lambda s: s["line"] == sink), F.slice(kept, 1, 0)).otherwise(F.array(F.struct(sink.alias("line"), F.lit("sink").alias("kind"))))
    return F.transform(F.array_sort(F.concat(kept, end)), lambda s: F.struct(s["line"].alias("line"), s["kind"].alias("kind"), snippet(F.get(original, s["line"] - 1)).alias("snippet")))


def _first_line(lines: Column, test) -> Column:
    """Number of the first line that passes the test, null if none does."""
    return F.get(F.filter(F.transform(lines, lambda x, k: F.when(test(x), k + 1)), lambda n: n.isNotNull()), 0)


def _free_of(category: str) -> Column:
    """No line rule of the category hits any line of _l."""
    return ~F.exists("_l", lambda x: reduce(lambda a, b: a | b, [x.rlike(unicode_pattern(r[5])) for r in RULES if r[2] == category]))


def _read(docs: DataFrame, key: str, text: str, language: str, sinks: dict[str, str]) -> DataFrame:
    """key, _lang, _o (lines as they are) and _l (without comments) of the texts in question."""
    df = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.lower(F.trim(F.col(language))).alias("_lang"))
    # a sink is looked for in whole texts first: most have none, and no worker of Python sees them
    df = df.filter(_by_language(F.col("_lang"), sinks, lambda p: F.col("_t").rlike(_u(p))))
    df = df.select(key, "_lang", split_lines("_t").alias("_o"), mask_udf("_t", "_lang").alias("_m"))
    return df.select(key, "_lang", "_o", split_lines("_m").alias("_l"))


def sql_flow(docs: DataFrame, key: str, text: str = "text", language: str = "language") -> DataFrame:
    """SQL-003, at most one of a text: key, rule_id, risk_type, category, severity, cwe, line, snippet, steps.

    Input that reaches a statement through assignments (ROUNDS of them against the order of lines),
    or a statement put together in place, at the first line that runs it. Texts in which a
    line rule has found the same category are left to it.
    """
    lang = F.col("_lang")
    source = lambda x: _by_language(lang, SQL_SOURCES, lambda p: x.rlike(_u(p)))
    says, built = (lambda x: x.rlike(_u(STATEMENT))), (lambda x: x.rlike(f"(?U){BUILT}"))
    df = _read(docs, key, text, language, SQL_SINKS).withColumn("_a", _assignments(F.col("_l"), ASSIGNMENT))
    df = df.withColumn("_a", F.transform("_a", lambda a: F.struct(
        a["line"].alias("line"), a["name"].alias("name"), _words(a["value"]).alias("words"), source(a["value"]).alias("source"), says(a["value"]).alias("says"), built(a["value"]).alias("built"))))

    def step(state: Column, a: Column) -> Column:
        fed = a["source"] | F.arrays_overlap(a["words"], state["tainted"])
        query = (a["says"] & (fed | a["built"])) | F.arrays_overlap(a["words"], state["queries"])
        add = lambda names, when: F.when(when, F.array_union(names, F.array(a["name"]))).otherwise(names)
        return F.struct(add(state["tainted"], fed).alias("tainted"), add(state["queries"], query).alias("queries"))

    df = df.withColumn("_s", F.aggregate(F.flatten(F.array_repeat("_a", ROUNDS)), F.struct(_none().alias("tainted"), _none().alias("queries")), step))

    def runs(x: Column) -> Column:
        rest = _by_language(lang, SQL_SINKS, lambda p: F.regexp_extract(x, f"{_u(p)}([^,]*)", 1))
        alone = F.regexp_extract(rest, r"(?U)^\s*([\w$]+)\s*\)?\s*;?\s*$", 1)
        return _by_language(lang, SQL_SINKS, lambda p: x.rlike(_u(p))) & ((says(x) & (source(x) | built(x))) | F.arrays_overlap(_words(x), F.col("_s.queries")) | F.array_contains("_s.tainted", alone))

    df = df.withColumn("_k", F.when(_free_of("SQL Injection"), _first_line(F.col("_l"), runs)))
    carried = F.array_union("_s.tainted", "_s.queries")
    steps = _steps(F.col("_a"), lambda a: a["source"], lambda a: F.array_contains(carried, a["name"]), F.col("_k"), F.col("_o"))
    return _finding(df, key, ("SQL-003", "vulnerable", "SQL Injection", 9, "CWE-89"), steps)


def path_flow(docs: DataFrame, key: str, text: str = "text", language: str = "language") -> DataFrame:
    """PATH-002, at most one of a Java text: columns as of ``sql_flow``.

    Input that goes, line by line, into a name, is joined to a path with ``+`` and opened as a
    file, at the first line that does so. Texts in which a line rule has found the same category are
    left to it.
    """
    # here a name is used between any two word borders, so that x is used in $x
    uses = lambda code, names: F.exists(names, lambda n: F.rlike(code, F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b"))))
    source = lambda x: x.rlike(_u(JAVA_SOURCE))
    df = _read(docs, key, text, language, {"java": JAVA_FILE_SINK}).withColumn("_a", _assignments(F.col("_l"), JAVA_ASSIGNMENT))
    add = lambda names, a, when: F.when(when, F.array_union(names, F.array(a["name"]))).otherwise(names)
    df = df.withColumn("_t", F.aggregate("_a", _none(), lambda names, a: add(names, a, source(a["value"]) | uses(a["value"], names))))
    df = df.withColumn("_p", F.array_distinct(F.transform(F.filter("_a", lambda a: F.contains(a["value"], F.lit("+")) & uses(a["value"], F.col("_t"))), lambda a: a["name"])))
    df = df.withColumn("_k", F.when(_free_of("Path Traversal"), _first_line(F.col("_l"), lambda x: x.rlike(_u(JAVA_FILE_SINK)) & uses(x, F.col("_p")))))
    carried = F.array_union("_t", "_p")
    steps = _steps(F.col("_a"), lambda a: source(a["value"]), lambda a: F.array_contains(carried, a["name"]), F.col("_k"), F.col("_o"))
    return _finding(df, key, ("PATH-002", "vulnerable", "Path Traversal", 8, "CWE-22"), steps)


def _finding(df: DataFrame, key: str, rule: tuple, steps: Column) -> DataFrame:
    named = [F.lit(v).alias(n) for n, v in zip(("rule_id", "risk_type", "category", "severity", "cwe"), rule, strict=True)]
    one = F.array(F.struct(*named, F.col("_k").alias("line"), snippet(F.get("_o", F.col("_k") - 1)).alias("snippet"), steps.alias("steps")))
    # not a filter: it would move down and carry the folds along, to be done again for each line
    return df.select(key, F.explode(F.when(F.col("_k").isNotNull(), one)).alias("_f")).select(key, "_f.*")


def flows(docs: DataFrame, key: str, text: str = "text", language: str = "language") -> DataFrame:
    """Findings of both rules."""
    return sql_flow(docs, key, text, language).unionByName(path_flow(docs, key, text, language))
