"""Scanner queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import languages, text as tx
from quillspark.operators import behaviors, curate as cu, rules, scan, taint
from quillspark.plans.evaluation import table

#: Patterns without \b, \w or \s mean the same to every regular expression engine.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,63}",
    "address": r"(^|[^0-9.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}($|[^0-9.])",
    "license": r"(^|[^A-Za-z])([Ll]icensed under|[Ll]icense,? [Vv]ersion|is licensed under)",
    "long_number": r"(^|[^0-9])[0-9]{12,19}($|[^0-9])",
    "marks": r"[#*$%&|<>]{3}",
    "key": r"(^|[^A-Za-z0-9_])(token|secret|password|api_key)[ ]*[:= ][ ]*[A-Za-z0-9]{8,}",
}


def docs(s, d, *cols):
    return table(s, d, "documents").select("doc_id", *cols)


#: Code appended to every 9th document, so that rules and chains have what to find.
SNIPPETS = [
    "password = \"correct horse battery\"\nrequests.post(url, data=password)",
    "x = base64.b64decode(blob)\n" + "pad\n" * 3 + "eval(x)",
    "curl https://files.example.com/run.sh\n" + "line\n" * 39 + "subprocess.Popen(cmd)",
    "curl https://files.example.com/run.sh\n" + "line\n" * 40 + "subprocess.Popen(cmd)",
    "eval(x)\nbase64 data",
    "os.walk(root)\nencryptor.encrypt(b)\nencryptor.encrypt(c)\nos.remove(f)\nvssadmin delete shadows",
    "verify=False\nAES MODE_ECB\njwt.decode(t, verify=False)",
]


def code(s, d):
    pick = F.element_at(F.array(*[F.lit(x) for x in SNIPPETS]), (F.pmod(F.floor(F.col("doc_id") / 9), F.lit(len(SNIPPETS))) + 1).cast("int"))
    return docs(s, d, "text").withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\n"), pick)).otherwise(F.col("text")))


#: Flows appended to the documents, one to each: input in a statement, a statement put together in place, a comment only, a path, nothing, a table of its own.
FLOWS = [
    ("python", "\nuid = request.args['id']\nq = 'replace ' + uid\ncur.execute(q)"),
    ("go", '\nid := r.FormValue("id")\ndb.Query(id)'),
    ("python", "\nuid = request.args['id']\n# cur.execute(uid)"),
    ("java", '\nString p = req.getParameter("f");\nString q = base + p;\nnew File(q);'),
    ("java", '\nString p = "f";\nString q = base + p;\nnew File(q);'),
    ("php", "\n$id = $_COOKIE['id'];\nmysqli_query($id);"),
]


def _flows(s, d):
    pick = lambda at: F.element_at(F.array(*[F.lit(x[at]) for x in FLOWS]), (F.pmod("doc_id", F.lit(len(FLOWS))) + 1).cast("int"))
    found = taint.flows(docs(s, d, F.concat("text", pick(1)).alias("text"), pick(0).alias("language")), "doc_id")
    return found.withColumn("steps", F.array_join(F.transform("steps", lambda x: F.concat(x["kind"], F.lit("|"), x["snippet"])), ";"))


def _chain_asof(s, d):
    ev = table(s, d, "events").select("user_id", F.unix_timestamp("ts").alias("at"), "event_type")
    return cu.nearest_following(ev.filter("event_type = 'view'"), ev.filter("event_type = 'purchase'"), ["user_id"], "at", 40 * 3600)


def _script_refs(s, d):
    p = table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<a[^>]* href=[\"']([^\"'#?]+)"), F.lit(1))).alias("target"))
    return p.groupBy("page_id", "target").agg(F.count("*").alias("n"))


QUERIES = {
    "line_findings": lambda s, d: scan.line_findings(docs(s, d, "text"), "doc_id", KINDS).groupBy("kind").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs")),
    "line_findings_rows": lambda s, d: scan.line_findings(docs(s, d, "text"), "doc_id", {k: KINDS[k] for k in ("email", "address", "license")}),
    "rule_scan": lambda s, d: rules.taxonomy(rules.scan_lines(code(s, d), "doc_id")).withColumn("domains", F.array_join("domains", ",")),
    "rule_hits_by_category": lambda s, d: rules.scan_lines(code(s, d), "doc_id").groupBy("category", "cwe").agg(F.count("*").alias("n"), F.max("severity").alias("severity")),
    "rule_coverage": lambda s, d: s.createDataFrame([(c, n, r) for c, n, ids in rules.TOP_TEN for r in ids], "category string, name string, rule_id string").groupBy("category").agg(F.count("*").alias("n_rules")),
    "data_flows": _flows,
    "behavior_tokens": lambda s, d: code(s, d).select("doc_id", F.array_join(behaviors.behavior_tokens(F.col("text"), F.lit("python"), 3), ",").alias("tokens")),
    "indicators": lambda s, d: scan.indicators(docs(s, d, "text"), "doc_id"),
    "behavior_chains": lambda s, d: scan.chains(code(s, d), "doc_id"),
    "destruction_chain": lambda s, d: scan.destruction(code(s, d), "doc_id"),
    "risk_signals": lambda s, d: code(s, d).select("doc_id", F.explode(scan.signals(F.col("text"))).alias("signal")).groupBy("signal").agg(F.count("*").alias("n")),
    "hidden_controls": lambda s, d: docs(s, d, "text").select("doc_id", F.array_join(scan.hidden_controls(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("a​b‮"))).otherwise(F.col("text"))), ",").alias("controls")).filter("controls <> ''"),
    "chain_asof": _chain_asof,
    "page_languages": lambda s, d: table(s, d, "pages").select("page_id", languages.language_of_path("url").alias("by_path"), languages.shown_language(languages.language_of("url", "html"), "url").alias("shown")),
    "content_languages": lambda s, d: table(s, d, "pages").select("page_id", languages.language_of_content("html").alias("language")),
    "char_entropy": lambda s, d: tx.add_entropy(docs(s, d, "text"), "text").select("doc_id", "entropy"),
    "token_buckets": lambda s, d: scan.token_buckets(docs(s, d, "text"), "doc_id"),
    "link_targets": _script_refs,
    "snippets": lambda s, d: docs(s, d, "text").select("doc_id", tx.snippet(F.element_at(F.split("text", "\n", -1), 1)).alias("snippet"), F.length(tx.preview("text")).alias("preview_chars")),
    "bounded_text": lambda s, d: docs(s, d, "text").select("doc_id", F.sha2(tx.head_and_tail("text", 1000), 256).alias("sha256")),
}


def _kinds(names):
    return " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS kind FROM l WHERE regexp_matches(value, '{KINDS[k]}')" for k in names)


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)"
_quote = lambda x: "'" + x.replace("'", "''") + "'"
_CODE = "c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || chr(10) || [" + ", ".join(map(_quote, SNIPPETS)) + f"][doc_id // 9 % {len(SNIPPETS)} + 1] ELSE text END AS text FROM documents)"
#: Lines end where Python's own cut them.
_CODE_LINES = _CODE + r""", s AS MATERIALIZED (SELECT doc_id, string_split_regex(regexp_replace(text, '(\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM c), l AS MATERIALIZED (SELECT doc_id, unnest(ls) AS value, unnest(range(1, len(ls) + 1)) AS line FROM s)"""
_values = lambda rows: ", ".join("(" + ", ".join(_quote(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_CHAINS = f"""WITH {_CODE_LINES}, g(grp, pattern) AS (VALUES {_values(scan.GROUPS.items())}), h AS (SELECT doc_id, grp, line FROM l, g WHERE regexp_matches(value, pattern)),
  k(lft, rgt, category, rule_id, severity, risk_type) AS (VALUES {_values([(c[0], c[1], c[2], c[3], c[4], c[5]) for c in scan.CHAINS])}),
  p AS (SELECT a.doc_id, rule_id, category, severity, risk_type, a.line AS left_at, min(b.line) AS right_at FROM k JOIN h a ON a.grp = lft JOIN h b ON b.grp = rgt AND b.doc_id = a.doc_id AND b.line >= a.line GROUP BY ALL)
  SELECT doc_id, rule_id, CAST(left_at AS INTEGER) AS left_at, CAST(right_at AS INTEGER) AS right_at, CAST(right_at - left_at AS INTEGER) AS gap, category, severity, risk_type FROM p WHERE right_at - left_at <= {scan.CHAIN_GAP} QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY right_at - left_at, left_at) = 1"""
#: The other engine has no look behind: one character is matched instead, and longer ones are counted off.
_no_look = lambda p: p.replace(r"(?<![\w.])", r"(?:^|[^\w.])")
_hit = lambda p: f"len(regexp_extract_all(value, {_quote(p.replace(chr(40) + '?<!def' + chr(92) + 's)', ''))})) > len(regexp_extract_all(value, {_quote(p.replace(chr(40) + '?<!def' + chr(92) + 's)', 'def' + chr(92) + 's'))}))" if "(?<!def" in p else f"regexp_matches(value, {_quote(p)})"
_rule = lambda r: f"SELECT doc_id, '{r[0]}' AS rule_id, '{r[1]}' AS risk_type, {_quote(r[2])} AS category, {r[3]} AS severity, '{r[4]}' AS cwe, CAST(line AS INTEGER) AS line, substr(trim(value), 1, 180) AS snippet FROM l WHERE regexp_matches(value, {_quote(_no_look(r[5]))})"
_RULES = f"WITH {_CODE_LINES}, f AS ({' UNION ALL '.join(map(_rule, rules.RULES))})"
_API = "CASE category " + " ".join(f"WHEN {_quote(c)} THEN {_quote(n)}" for c, n in rules.API_SECURITY.items()) + " END"
_DOMAINS = "array_to_string(list_filter(['application', CASE WHEN api_security IS NOT NULL THEN 'api' END, " + ", ".join(f"CASE WHEN category IN ({', '.join(map(_quote, c))}) THEN {_quote(d)} END" for d, c in rules.DOMAINS.items()) + "], lambda x: x IS NOT NULL), ',')"
#: What each of FLOWS comes to, by hand: its rule and steps; the sink is the last line.
_FLOW_STEPS = (
    ("SQL-003", "source|uid = request.args['id'];propagation|q = 'replace ' + uid;sink|cur.execute(q)"), ("SQL-003", 'source|id := r.FormValue("id");sink|db.Query(id)'), None,
    ("PATH-002", 'source|String p = req.getParameter("f");;propagation|String q = base + p;;sink|new File(q);'), None, ("SQL-003", "source|$id = $_COOKIE['id'];;sink|mysqli_query($id);"),
)
_FLOWS = rf"""WITH f(k, added, rule_id, steps) AS (VALUES {_values([(k, added, *said) for k, ((_, added), said) in enumerate(zip(FLOWS, _FLOW_STEPS, strict=True)) if said])}), c AS (SELECT doc_id, text || added AS text, rule_id, steps FROM documents JOIN f ON doc_id % {len(FLOWS)} = k),
  n AS (SELECT *, CAST(len(string_split_regex(text, '\r\n|[\n\r\v\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS INTEGER) AS line FROM c WHERE text IS NOT NULL)
  SELECT doc_id, rule_id, 'vulnerable' AS risk_type, CASE rule_id WHEN 'SQL-003' THEN 'SQL Injection' ELSE 'Path Traversal' END AS category, CASE rule_id WHEN 'SQL-003' THEN 9 ELSE 8 END AS severity, CASE rule_id WHEN 'SQL-003' THEN 'CWE-89' ELSE 'CWE-22' END AS cwe, line, string_split(steps, 'sink|')[2] AS snippet, steps FROM n"""
#: Each token by version, then chains of tokens of their version or an older one.
_TOKENS = f"""WITH {_CODE}, p(token, pattern, v) AS (VALUES {_values([(t, f"(?i){x}", v) for v, part in ((1, behaviors.TOKENS), (3, behaviors.VERSION_3), (3, behaviors.ALSO)) for t, x in part.items()])}), h AS (SELECT doc_id, token, min(v) AS v FROM c, p WHERE regexp_matches(text, pattern) GROUP BY doc_id, token),
  k(token, a, b, v) AS (VALUES {_values([(n, *ends, v) for v, part in ((1, behaviors.CHAINS), (3, behaviors.CHAINS_3)) for n, ends in part.items()])}), t AS (SELECT doc_id, token FROM h UNION SELECT x.doc_id, k.token FROM k JOIN h x ON x.token = k.a AND x.v <= k.v JOIN h y ON y.token = k.b AND y.v <= k.v AND y.doc_id = x.doc_id)
  SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN (SELECT doc_id, string_agg(token, ',' ORDER BY token) AS tokens FROM t GROUP BY doc_id) USING (doc_id)"""
_pick = lambda value, names: "CASE " + " ".join(f"WHEN {value} IN ({', '.join(map(_quote, keys))}) THEN '{n}'" for n, keys in names.items() if keys) + " ELSE 'unknown' END"
_content = lambda text: "CASE " + " ".join(f"WHEN regexp_matches(substr({text}, 1, 256000), {_quote(p)}) THEN '{n}'" for n, p in languages.CONTENT) + " ELSE 'unknown' END"
SQL = {
    "content_languages": f"SELECT page_id, {_content('html')} AS language FROM pages",
    "page_languages": rf"""WITH s AS (SELECT page_id, html, lower(regexp_extract(regexp_extract(url, '[^/\\]*$'), '[^.]([.][^.]*)$', 1)) AS ext FROM pages),
      p AS (SELECT *, {_pick('ext', languages.EXTENSIONS)} AS by_path FROM s), l AS (SELECT *, CASE WHEN by_path = 'unknown' THEN {_content('html')} ELSE by_path END AS language FROM p)
      SELECT page_id, by_path, CASE WHEN language = 'config' THEN {_pick('ext', {v: (k,) for k, v in languages.CONFIG_NAMES.items()}).replace("'unknown'", "'config'")} WHEN language = 'unknown' AND ext IN ('', '.txt') THEN 'text' ELSE language END AS shown FROM l""",
    "behavior_tokens": _TOKENS,
    "data_flows": _FLOWS,
    "risk_signals": f"WITH {_CODE}, g(signal, pattern) AS (VALUES {_values(scan.SIGNALS.items())}) SELECT signal, count(*) AS n FROM c, g WHERE regexp_matches(text, pattern) GROUP BY signal",
    "behavior_chains": _CHAINS,
    "destruction_chain": f"WITH {_CODE_LINES} SELECT * FROM (SELECT doc_id, " + ", ".join(f"CAST({'min' if w == 'first' else 'max'}(line) FILTER ({_hit(p)}) AS INTEGER) AS \"{n}\"" for n, p, w in scan.DESTRUCTION) + " FROM l GROUP BY doc_id) WHERE " + " AND ".join(f'"{n}" IS NOT NULL' for n, _, _ in scan.DESTRUCTION),
    "rule_scan": f"{_RULES}, a AS (SELECT *, {_API} AS api_security FROM f) SELECT *, {_DOMAINS} AS domains FROM a",
    "rule_hits_by_category": f"{_RULES} SELECT category, cwe, count(*) AS n, max(severity) AS severity FROM f GROUP BY ALL",
    "line_findings": f"{_LINES} SELECT kind, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM ({_kinds(KINDS)}) GROUP BY kind",
    "line_findings_rows": f"{_LINES} {_kinds(('email', 'address', 'license'))}",
    "rule_coverage": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({len(i)} AS BIGINT))" for c, _, i in rules.TOP_TEN) + ") t(category, n_rules)",
    "hidden_controls": "SELECT doc_id, '200b,202e' AS controls FROM documents WHERE doc_id % 5 = 0",
    "chain_asof": """WITH v AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, event_type FROM events), p AS (SELECT a.user_id, a.at_s AS left_at, min(b.at_s) AS right_at FROM v a JOIN v b ON a.user_id = b.user_id AND b.at_s >= a.at_s
      WHERE a.event_type = 'view' AND b.event_type = 'purchase' GROUP BY ALL) SELECT user_id, left_at, right_at, right_at - left_at AS gap FROM p WHERE right_at - left_at <= 144000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY right_at - left_at, left_at) = 1""",
    "char_entropy": "WITH c AS (SELECT doc_id, length(text) AS len, unnest(string_split(text, '')) AS ch FROM documents), k AS (SELECT doc_id, len, count(*) AS n FROM c GROUP BY doc_id, len, ch) SELECT doc_id, CASE WHEN any_value(len) > 0 THEN round(-sum(n / len * log2(n / len)), 3) ELSE 0 END AS entropy FROM k GROUP BY doc_id",
    "token_buckets": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')[1:12000]) AS token FROM documents) SELECT doc_id, CAST(concat('0x', substr(sha256(token), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM t GROUP BY ALL",
    "link_targets": r"""SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]* href=["'']([^"''#?]+)', 1)) AS target FROM pages) GROUP BY ALL""",
    "snippets": r"""SELECT doc_id, substr(trim(string_split(text, chr(10))[1], ' '), 1, 180) AS snippet, CAST(least(220, length(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))) AS INTEGER) AS preview_chars FROM documents""",
    "bounded_text": "SELECT doc_id, sha256(CASE WHEN length(text) > 1000 THEN substr(text, 1, 500) || chr(10) || '... truncated ...' || chr(10) || right(text, 500) ELSE text END) AS sha256 FROM documents",
}
