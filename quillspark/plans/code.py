"""Queries of code: functions by braces, labels of lines.

Each reads whole documents with a piece of code behind the text, which differs from document to
document; the SQL finds everything anew in the same text, character by character.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import patches, scan, spans, windows
from quillspark.plans.evaluation import table
from quillspark.plans.scanning import KINDS, docs

#: Code with {k} for the document's number: nested and anonymous bodies, a brace in a string, a head over two lines, a clause that runs on, a body that never ends.
CODE = [
    "class C{k} {\n  public static String a{k}(int x) {\n    if (x > {k}) { return x; }\n    return helper(x);\n  }\n\n  private int same(String s) { int y = 1; return y; }\n  private int same(long s) {\n    return 2;\n  }\n}",
    "interface I{k} {\n  void first{k}() throws IOException;\n  int second(List<String> x) {\n    return {k};\n  }\n}\nclass D {\n\n\n  void third(int[] a,\n      int b)\n      throws X{k}, Y {\n    use(new R() {\n      public void run() {\n        return;\n      }\n    });\n  }\n}",
    'void broken{k}() {\n  print("}");\n  return;\n}\nint after(int x) {\n  while (x) { x = same(x); }\n  return {k};',
    "x = call({k}) { return }\nfinal Map<A,B> make{k}() { return m; }",
    "no code here, only (some) {braces} of {k}",
]


def code_text(text: str = "text") -> F.Column:
    pick = F.element_at(F.array(*[F.lit(x) for x in CODE]), (F.pmod("doc_id", F.lit(len(CODE))) + 1).cast("int"))
    return F.concat(text, F.lit("\n;\n"), F.replace(pick, F.lit("{k}"), F.col("doc_id").cast("string")))


def _code(s, d):
    return docs(s, d, code_text().alias("text"))


def _functions(s, d):
    found = spans.functions(_code(s, d), "doc_id").join(_code(s, d), "doc_id")
    body = F.substring("text", F.col("body_start") + 1, F.col("body_end") - F.col("body_start"))
    return found.select("doc_id", "nth", "name", "start_line", "end_line", F.sha2(body, 256).alias("body"))


def _changed(s, d):
    """Lines that return something are changed; which function holds each."""
    both = _code(s, d).withColumn("new", F.replace("text", F.lit("return"), F.lit("throw")))
    lines = patches.differences(both, ["doc_id"], "text", "new").select("doc_id", F.explode(F.sequence(F.col("old_start") + 1, "old_end")).alias("line"))
    return spans.innermost(lines, spans.functions(_code(s, d), "doc_id"), "doc_id").select("doc_id", "line", "name", "start_line", "end_line")


def _labels(s, d):
    """Each document is a file of a case of three: the records name a method, which some files lack."""
    files = _code(s, d).select(F.floor(F.col("doc_id") / 3).alias("case"), F.col("doc_id").cast("string").alias("path"), "text")
    after = files.withColumn("text", F.replace("text", F.lit("return"), F.lit("throw")))
    k = F.col("doc_id")
    method = F.when(k % 5 == 0, "same").when(k % 5 == 1, F.concat(F.lit("first"), k.cast("string"))).when(k % 5 == 2, "none").otherwise("")
    records = docs(s, d).select(F.floor(k / 3).alias("case"), k.cast("string").alias("path"), method.alias("method"), F.concat(F.lit("CWE-"), k % 7).alias("cwe"))
    return spans.fix_labels(records.unionByName(records), files, after, "case")


def _trusted(s, d):
    """Documents labelled toxic stand for verified malicious files, those of poor quality for vulnerable ones."""
    label = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "vulnerable").otherwise("benign")
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    samples = rows.select("doc_id", "source", label.alias("label"), F.when(F.col("doc_id") % 4 > 0, "approved").otherwise("unreviewed").alias("review_status"), F.lit("own").alias("category"), F.lit("CWE-1").alias("cwe"), (F.col("doc_id") % 10 / 10).alias("label_confidence"))
    found = scan.line_findings(docs(s, d, "text"), "doc_id", KINDS).select("doc_id", "line", F.when(F.col("kind").isin("license", "marks"), "vulnerable").otherwise("malicious").alias("risk_type"), F.when(F.col("kind") != "key", F.col("kind")).alias("category"), F.when(F.col("kind") == "email", "CWE-9").alias("cwe"))
    return spans.trusted_locations(samples, found, "doc_id", TRUSTED)


def _pairs(s, d):
    """Every third document: as it is, and with some words changed."""
    new = F.replace(F.replace("text", F.lit("return"), F.lit("throw")), F.lit(" the "), F.lit(" ze "))
    return _code(s, d).filter("doc_id % 3 = 0").withColumn("good", new).withColumnRenamed("text", "bad")


def _pair_windows(s, d):
    found = windows.pair_windows(_pairs(s, d), "doc_id", F.col("doc_id") % 4 == 0)
    return found.withColumn("code", F.sha2("code", 256))


LIMITS = {"src0": (0.02, 20), "src1": (0.01, 10)}


def _window_dataset(s, d):
    """Windows of pairs, and of documents without one, of which some sources are limited; each window of a family once."""
    made = windows.pair_windows(_pairs(s, d), "doc_id", F.col("doc_id") % 4 == 0)
    rest = table(s, d, "documents").filter("doc_id % 3 > 0").select("doc_id", "source", F.col("text").alias("code"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sample_hash"))
    rest = rest.join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left").withColumn("bad", F.coalesce("toxic", F.lit(0)) == 1)
    kept = windows.limit_negatives(rest, ~F.col("bad"), made.filter("label = 1"), LIMITS)
    single = windows.source_windows(kept, "doc_id", F.col("bad")).withColumn("slot", F.lit(""))
    # a digest stands for the code from here on: windows are the same where it is, and what is sorted stays short
    both = made.withColumn("part", F.lit(0)).unionByName(single.withColumn("part", F.lit(1))).withColumn("code", F.sha2("code", 256))
    family = table(s, d, "documents").select("doc_id", F.col("source").alias("family"))
    return windows.first_of_each(both.join(family, "doc_id"), ["part", "doc_id", "seq"]).drop("part")


TRUSTED = {"malicious": ("src0", "src1", "src2", "src3"), "vulnerable": ("src0", "src5", "src6", "src7", "src8", "src9")}
QUERIES = {
    "java_functions": _functions,
    "changed_functions": _changed,
    "fix_labels": _labels,
    "trusted_labels": _trusted,
    "pair_windows": _pair_windows,
    "window_dataset": _window_dataset,
    "file_heads": lambda s, d: docs(s, d, F.sha2(windows.head_of_file(F.col("text"), 1000), 256).alias("head")),
}

_quote = lambda x: "'" + x.replace("'", "''") + "'"
_TEXTS = "c AS (SELECT doc_id, text || chr(10) || ';' || chr(10) || replace([" + ", ".join(_quote(x).replace("\n", "'||chr(10)||'") for x in CODE) + f"][doc_id % {len(CODE)} + 1], '{{k}}', CAST(doc_id AS VARCHAR)) AS text FROM documents)"
_HEAD = spans.HEAD.replace("(?mdU)", "(?m)")
#: Every character with the line ends and the braces up to it; an opening brace ends where the depth first falls below its own.
_SPANS = rf"""{_TEXTS},
  x AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) AS pos, unnest(string_split(text, '')) AS ch FROM c WHERE contains(text, '(')),
  y AS (SELECT *, 1 + sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER w AS line, sum(CASE ch WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT *, sum(CASE WHEN ch = '{{' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM y WHERE ch IN ('{{', '}}')),
  h AS (SELECT doc_id, k, regexp_extract(v, '{_HEAD}', 0) AS head, regexp_extract(v, '{_HEAD}', 1) AS name FROM
    (SELECT doc_id, k, CASE WHEN k > 1 THEN '{{' ELSE '' END || part AS v FROM (SELECT doc_id, unnest(string_split(text, '{{')) AS part, generate_subscripts(string_split(text, '{{'), 1) AS k FROM c))),
  o AS (SELECT e.*, name, line - (length(head) - length(replace(head, chr(10), ''))) AS start_line FROM e JOIN h USING (doc_id, k) WHERE ch = '{{' AND name <> ''),
  z AS (SELECT o.doc_id, o.pos, min(e.pos) AS to_at, min(e.line) AS to_line FROM o JOIN e ON e.doc_id = o.doc_id AND e.pos > o.pos AND e.depth < o.depth GROUP BY ALL),
  f AS (SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.pos) - 1 AS nth, name, start_line, depth, coalesce(to_line, length(text) - length(replace(text, chr(10), '')) + 1) AS end_line, o.pos, coalesce(to_at, length(text) + 1) AS to_at, text
    FROM o LEFT JOIN z ON z.doc_id = o.doc_id AND z.pos = o.pos JOIN c ON c.doc_id = o.doc_id)"""
#: Lines end where Python cuts them; those that hold a return are changed.
_BREAK = r"\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_CHANGED = rf"""ls AS MATERIALIZED (SELECT doc_id, string_split_regex(text, '{_BREAK}') AS ls FROM c), n AS (SELECT doc_id, unnest(ls) AS value, generate_subscripts(ls, 1) AS line FROM ls), r AS (SELECT doc_id, line FROM n WHERE contains(value, 'return'))"""
#: Bytes as hex; what an edge cuts goes.
_cut = lambda hexed, start, size: f"sha256(decode(unhex(regexp_replace(regexp_replace(substr({hexed}, 2 * {start} + 1, 2 * {size}), '^(?:[89AB].){{1,3}}', ''), '(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})$', ''))))"
_KEPT_LINES = r"[^\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]+$"
_SIZE = windows.WINDOW_BYTES
_START = "CAST(greatest(least(greatest(length({0}) // 2 - " + str(_SIZE) + ", 0), {1} + shift - " + str(_SIZE // 2) + "), 0) AS INTEGER)"
#: Changed lines have the same number on both sides; islands of them are places.
_PAIR_WINDOWS = f"""{_TEXTS}, b AS (SELECT doc_id, text AS bad, replace(replace(text, 'return', 'throw'), ' the ', ' ze ') AS good FROM c WHERE doc_id % 3 = 0),
  pl AS MATERIALIZED (SELECT doc_id, regexp_extract_all(bad, '{_KEPT_LINES}') AS o, regexp_extract_all(good, '{_KEPT_LINES}') AS n FROM b),
  li AS (SELECT doc_id, unnest(o) AS o, unnest(n) AS n, generate_subscripts(o, 1) AS line FROM pl),
  lb AS (SELECT *, coalesce(sum(strlen(o)) OVER w, 0) AS old_byte, coalesce(sum(strlen(n)) OVER w, 0) AS new_byte FROM li WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ch AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM lb WHERE o <> n),
  pf AS (SELECT doc_id, min(line) AS line, min(old_byte) AS old_byte, min(new_byte) AS new_byte FROM ch GROUP BY doc_id, island),
  pn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS nth, old_byte, new_byte FROM pf UNION ALL SELECT doc_id, 0, strlen(bad), strlen(good) FROM b WHERE bad IS NOT NULL AND bad = good UNION ALL SELECT doc_id, 0, 0, 0 FROM b WHERE bad IS NULL),
  hx AS (SELECT doc_id, coalesce(hex(encode(bad)), '') AS bad, coalesce(hex(encode(good)), '') AS good FROM b),
  sh(shift, j) AS (VALUES ({-_SIZE // 4}, 0), (0, 1), ({_SIZE // 4}, 2)),
  plc AS (SELECT * FROM pn JOIN hx USING (doc_id), sh WHERE (doc_id % 4 = 0 AND nth < {windows.FEW_PLACES} AND shift = 0) OR (doc_id % 4 > 0 AND nth < {windows.PLACES})),
  pw AS (SELECT doc_id, nth || ':' || shift AS slot, CAST((nth * 3 + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE j END) * 2 AS INTEGER) AS seq, 1 AS label, 'paired_diff_hunk' AS kind, {_START.format('bad', 'old_byte')} AS start, {_cut('bad', 'start', _SIZE)} AS code FROM plc
    UNION ALL SELECT doc_id, nth || ':' || shift, CAST((nth * 3 + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE j END) * 2 + 1 AS INTEGER), 0, 'paired_diff_hunk', {_START.format('good', 'new_byte')} AS start, {_cut('good', 'start', _SIZE)} FROM plc
    UNION ALL SELECT doc_id, '', 1000, 0, 'unchanged_context', 0, {_cut('bad', '0', _SIZE)} FROM pn JOIN hx USING (doc_id) WHERE nth = 0 AND old_byte >= {_SIZE})"""
_OWN = f"CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % greatest(n - {_SIZE - 1}, 1)"
SQL = {
    "pair_windows": f"WITH {_PAIR_WINDOWS} SELECT * FROM pw",
    "window_dataset": f"""WITH {_PAIR_WINDOWS},
      r AS (SELECT doc_id, source, coalesce(text, '') AS t, coalesce(toxic, 0) = 1 AS bad FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 3 > 0),
      k AS (SELECT *, row_number() OVER (PARTITION BY source, bad ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rank, (SELECT count(*) FROM pw WHERE label = 1) AS many FROM r),
      l AS (SELECT *, strlen(t) AS n, hex(encode(t)) AS h FROM k WHERE bad OR NOT (source = 'src0' AND rank > greatest(floor(many * {LIMITS['src0'][0]}), {LIMITS['src0'][1]}) OR source = 'src1' AND rank > greatest(floor(many * {LIMITS['src1'][0]}), {LIMITS['src1'][1]}))),
      st AS (SELECT *, CASE WHEN n <= {_SIZE} THEN [0] WHEN bad THEN list_sort(list_distinct([0, greatest(n // 2 - {_SIZE // 2}, 0), n - {_SIZE}])) ELSE [{_OWN}] END AS starts FROM l),
      sw AS (SELECT doc_id, '' AS slot, CAST(seq - 1 AS INTEGER) AS seq, CAST(bad AS INTEGER) AS label, 'source_window' AS kind, CAST(start AS INTEGER) AS start, {_cut('h', 'start', _SIZE)} AS code FROM (SELECT *, unnest(starts) AS start, generate_subscripts(starts, 1) AS seq FROM st)),
      al AS (SELECT 0 AS part, * FROM pw UNION ALL SELECT 1, * FROM sw)
      SELECT al.* EXCLUDE (part), source AS family FROM al JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source, label, code ORDER BY part, doc_id, seq) = 1""",
    "file_heads": f"SELECT doc_id, {_cut('h', '0', 1000)} AS head FROM (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents)",
    "java_functions": f"WITH {_SPANS} SELECT doc_id, CAST(nth AS INTEGER) AS nth, name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, sha256(substr(text, pos + 1, to_at - pos - 1)) AS body FROM f",
    "changed_functions": f"""WITH {_SPANS}, {_CHANGED} SELECT r.doc_id, CAST(line AS INTEGER) AS line, name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM r JOIN f ON r.doc_id = f.doc_id AND line BETWEEN start_line AND end_line
      QUALIFY row_number() OVER (PARTITION BY r.doc_id, line ORDER BY depth DESC, nth DESC) = 1""",
    "fix_labels": f"""WITH {_SPANS}, {_CHANGED},
      a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'first' || doc_id WHEN 2 THEN 'none' END AS method FROM documents),
      m AS (SELECT f.doc_id, start_line, end_line, name AS method, 'CWE-' || f.doc_id % 7 AS cwe FROM f JOIN a ON a.doc_id = f.doc_id AND a.method = f.name QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY nth) = 1),
      g AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM r WHERE doc_id NOT IN (SELECT doc_id FROM m)),
      w AS (SELECT doc_id // 3 AS k, max('CWE-' || doc_id % 7) AS cwe FROM documents GROUP BY 1),
      p AS (SELECT doc_id, min(line) AS start_line, max(line) AS end_line FROM g GROUP BY doc_id, island)
      SELECT doc_id // 3 AS "case", CAST(doc_id AS VARCHAR) AS path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, 'vulnerability_fix_target' AS label, cwe, method, 'fix_record' AS source, 0.95 AS confidence FROM m
      UNION ALL SELECT doc_id // 3, CAST(doc_id AS VARCHAR), start_line, end_line, 'vulnerability_patch_region', cwe, NULL, 'commit_diff', 0.95 FROM p JOIN w ON k = doc_id // 3""",
    "trusted_labels": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line, '{'vulnerable' if k in ('license', 'marks') else 'malicious'}' AS risk_type, '{'own' if k == 'key' else k}' AS label, '{'CWE-9' if k == 'email' else 'CWE-1'}' AS cwe FROM l WHERE regexp_matches(value, '{p}')" for k, p in KINDS.items())
    + f""") SELECT doc_id, CAST(line AS INTEGER) AS start_line, CAST(line AS INTEGER) AS end_line, f.label, risk_type, cwe, 'trusted_source_plus_static_locator' AS source, least(0.9, doc_id % 10 / 10) AS confidence FROM f JOIN labels USING (doc_id) JOIN documents USING (doc_id)
      WHERE doc_id % 4 > 0 AND ((toxic = 1 AND risk_type = 'malicious' AND source IN {TRUSTED['malicious']}) OR (toxic IS DISTINCT FROM 1 AND quality = 0 AND risk_type = 'vulnerable' AND source IN {TRUSTED['vulnerable']}))""",
}
