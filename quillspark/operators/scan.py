"""Scanners: indicators, behaviour chains, signals. Each takes texts and gives rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.needles import any_likely, folded, is_likely, likely, may_match
from quillspark.functions.text import line_of, split_lines
from quillspark.operators.curate import nearest_following

#: Indicator kinds in order, their severity and pattern.
INDICATORS = (
    ("url", 2, r"(?i)https?://[^\s\"'<>]{4,2048}"),
    ("webhook", 2, r"(?i)(?:discord(?:app)?\.com/api/webhooks|hooks\.slack\.com/services)/[^\s\"']+"),
    ("ip", 2, r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\d.])"),
    ("email", 1, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}"),
    ("domain", 1, r"(?i)(?<![@\w])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}(?::\d{1,5})?(?:/[^\s\"'<>]*)?"),
    ("path", 2, r"(?i)(?:/etc/passwd|/etc/shadow|[A-Z]:\\Users\\[^\s\"']+|%APPDATA%|%TEMP%|/proc/self|\.ssh/(?:id_rsa|authorized_keys))"),
)
#: A domain needs one of these endings.
DOMAIN_ENDINGS = ("com", "net", "org", "io", "co", "cn", "uk", "de", "fr", "ru", "pl", "jp", "kr", "dev", "app", "info", "biz", "xyz", "online", "site", "me", "tv", "cc", "top", "cloud", "tech", "ai")
INDICATOR_LIMIT = 120
#: Short patterns that find something in every line with an indicator of the kind.
SIGNS = {"url": "://", "webhook": r"\.[cC][oO][mM]/", "ip": r"[0-9]\.[0-9]", "email": "@", "domain": r"[A-Za-z0-9]\.[A-Za-z0-9]", "path": r"[/:%]"}

#: Patterns of the groups that chains are made of.
GROUPS = {
    "credential": r"(?i)(?:password|passwd|secret|token|api[_-]?key|credential|\.ssh|login)",
    "network": r"(?i)(?:https?://|fetch\s*\(|requests?\.(?:get|post)|curl|wget|socket|WebSocket|XMLHttpRequest)",
    "send": r"(?i)(?:send\s*\(|post\s*\(|upload|exfil|webhook|socket\.send)",
    "decode": r"(?i)(?:atob|fromCharCode|base64|base64decode|hex2bin|decode)",
    "execute": r"(?i)(?:eval\s*\(|exec\s*\(|system\s*\(|shell_exec\s*\(|passthru\s*\(|proc_open\s*\(|popen\s*\(|subprocess|child_process|spawn\s*\(|Runtime\.getRuntime|exec\.Command\s*\(|Start-Process\b|Invoke-Expression\b|\bIEX\s*(?:\(|\s))",
    "download": r"(?i)(?:\b(?:curl|wget)\b(?:\s+|$)|\b(?:urlopen|fetch|curl_init|http\.Get|download)\s*\(|\brequests?\s*\.\s*get\s*\(|\b(?:DownloadString|DownloadFile|Invoke-WebRequest|Invoke-RestMethod)\b\s*(?:\(|\s)|file_get_contents\s*\(\s*[\"']https?://)",
    "persistence": r"(?i)(?:crontab|schtasks|startup|registry|RunOnce|service\s+install|systemd|authorized_keys)",
    "hook": r"(?i)(?:postinstall|preinstall|setup\.py|install\s*hook|npm\s+install)",
    "write": r"(?i)(?:open\s*\(|write(?:File)?\s*\(|FileOutputStream|fs\.write)",
}
#: Fixed values: (left group, right group, category, rule, severity, risk type).
CHAINS = (
    ("credential", "send", "Credential Exfiltration", "CHAIN-CRED-EXFIL", 9, "malicious"),
    ("decode", "execute", "Obfuscated Payload", "CHAIN-DECODE-EXEC", 8, "malicious"),
    ("download", "execute", "Download and Execute", "CHAIN-DOWNLOAD-EXEC", 9, "malicious"),
    ("hook", "network", "Install Hook Execution", "CHAIN-HOOK-NET", 8, "malicious"),
    ("persistence", "execute", "Persistence", "CHAIN-PERSIST-EXEC", 8, "malicious"),
    ("network", "write", "Remote Load or Write", "CHAIN-NET-WRITE", 5, "context"),
)
CHAIN_GAP = 40
#: The stages of the file-destroying chain, and whether their first or last line counts.
DESTRUCTION = (
    ("traversal", r"(?i)\b(?:os\.walk|glob\.glob|fnmatch\.fnmatch)\s*\(", "first"),
    ("encryption", r"(?i)\b(?:encryptor\.encrypt|Fernet\s*\(|Cipher\s*\()", "last"),
    ("deletion", r"(?i)(?<!def\s)\b(?:os\.remove|os\.unlink|delete_file)\s*\(", "last"),
    ("recovery", r"(?i)vssadmin\s+delete\s+shadows", "first"),
)
#: Signals of a training row.
SIGNALS = {
    "dynamic code": r"(?i)\b(?:eval|exec)\s*\(",
    "system command": r"(?i)(?:os\.system|subprocess\.|child_process|runtime\.getruntime\(\)\.exec)",
    "interpreter": r"(?i)\b(?:powershell|cmd\.exe|/bin/(?:sh|bash))\b",
    "download": r"(?i)(?:curl\s|wget\s|requests\.(?:get|post)|urlopen\s*\(|downloadstring)",
    "hidden payload": r"(?i)(?:base64\.(?:b64decode|decodebytes)|frombase64string|atob\s*\()",
    "process injection": r"(?i)(?:virtualallocex|writeprocessmemory|createremotethread|ntmapviewofsection)",
    "deserialization": r"(?i)(?:pickle\.loads?|yaml\.load\s*\(|objectinputstream)",
    "socket": r"(?i)\b(?:socket\.socket|connect\s*\(|winsock)\b",
    "destruction": r"(?i)(?:rm\s+-rf|shutil\.rmtree|remove-item\s+.+-recurse)",
}
#: Characters that hide or reorder text.
HIDDEN = "​‌‍⁠﻿‪‫‬‭‮⁦⁧⁨⁩"


def text_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1), value."""
    return docs.select(key, F.posexplode(split_lines(F.coalesce(F.col(text), F.lit("")))).alias("p", "value")).select(key, (F.col("p") + 1).alias("line"), "value")


def line_findings(docs: DataFrame, key: str, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """key, line, kind of each line (line feeds alone) that a pattern matches."""
    # texts that no pattern can match aren't cut into lines
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(key, body.alias("_t"), likely(body, patterns.values()).alias("_may")).filter(any_likely(F.col("_may")))
    lines = texts.select(key, "_may", F.posexplode(F.split("_t", "\n", -1)).alias("p", "value"))
    kinds = F.array(*[F.when(is_likely(F.col("_may"), n) & F.col("value").rlike(p), F.lit(k)) for n, (k, p) in enumerate(patterns.items())])
    return lines.select(key, (F.col("p") + 1).cast("long").alias("line"), F.explode(kinds).alias("kind")).filter("kind IS NOT NULL")  # an array's own elements are matched once, a filtered one's three times


def indicators(docs: DataFrame, key: str, text: str = "text", limit: int = INDICATOR_LIMIT) -> DataFrame:
    """key, kind, value, severity, line: in order of kind and place, each value once, at most ``limit`` of a text.

    Domains inside URLs and of unknown endings are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(key, body.alias("_t"), likely(body, [p for _, _, p in INDICATORS]).alias("_may"))
    return listed_indicators(df.select(key, indicator_list(F.col("_t"), [is_likely(F.col("_may"), n) for n in range(len(INDICATORS))]).alias("_all")), key, "_all", limit)


def indicator_list(t: Column, may: list[Column]) -> Column:
    """All indicators of a text, repeats too; ``may`` says for each kind whether it is looked for."""
    cut = lambda x: F.regexp_replace(x, r"[.,;)]+$", "")
    empty = F.array().cast("array<struct<rank:int,kind:string,value:string,severity:int,line:int>>")
    parts = []

    def on_line(rank: int, kind: str, severity: int, pattern: str):
        def found(value: Column, k: Column) -> Column:
            source = F.regexp_replace(value, INDICATORS[0][2], " ") if kind == "domain" else value
            out = F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), cut)
            if kind == "domain":
                ending = lambda x: F.lower(F.regexp_extract(F.split(F.split(x, "/").getItem(0), ":").getItem(0), r"\.([^.]+)$", 1))
                out = F.filter(out, lambda x: ending(x).isin(*DOMAIN_ENDINGS))
            out = F.transform(out, lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x.alias("value"), F.lit(severity).alias("severity"), (k + 1).alias("line")))
            return F.when(value.rlike(SIGNS[kind]), out).otherwise(empty)

        return found

    for n, (kind, severity, pattern) in enumerate(INDICATORS):
        # no indicator holds a line end, so that each is found on its own line; texts without any aren't cut
        parts.append(F.when(may[n], F.flatten(F.transform(F.split(t, "\n", -1), on_line(n, kind, severity, pattern)))).otherwise(empty))
    return F.concat(*parts)


def listed_indicators(rows: DataFrame, key: str, found: str, limit: int = INDICATOR_LIMIT) -> DataFrame:
    """key, seq, kind, value, severity, line of the lists of ``indicator_list``."""
    # each (kind, value) once, found by hash; the first of each of the ``limit`` that stay
    names = F.slice(F.array_distinct(F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), F.lower(x["value"]).alias("low")))), 1, limit)
    first = F.transform(names, lambda n: F.get(F.filter(found, lambda y: (y["kind"] == n["kind"]) & (F.lower(y["value"]) == n["low"])), 0))
    return rows.select(key, F.posexplode(first).alias("seq", "i")).select(key, "seq", "i.kind", "i.value", "i.severity", "i.line")


#: Literals that may be encoded text.
BASE64_LITERAL = r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,}={0,2})(?![A-Za-z0-9+/])"
HEX_LITERAL = r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){8,}(?![0-9A-Fa-f])"
#: The same as runs that nothing has to follow.
BASE64_RUN, HEX_RUN = "[A-Za-z0-9+/]{16,}={0,2}", "[0-9A-Fa-f]{16,}"
DECODED_LIMIT, DECODED_BYTES = 80, 512
#: What isn't printable: by the Unicode of the engine, unassigned and format characters too; or the control characters and the fixed blank, which are the same everywhere.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \r\n\t]]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0]"


def _printable(raw: Column, odd: str) -> Column:
    """Bytes as text of four characters or more without ``odd`` ones, else null."""
    said = F.regexp_replace(F.regexp_replace(F.decode(raw, "UTF-8"), odd, ""), r"\A\p{Zs}+|\p{Zs}+\z", "")
    return F.when((F.octet_length(raw) <= DECODED_BYTES) & F.is_valid_utf8(raw.cast("string")) & (F.length(said) >= 4), said)


def decoded_literals(docs: DataFrame, key: str, text: str = "text", limit: int = DECODED_LIMIT, odd: str = UNPRINTABLE) -> DataFrame:
    """key, seq, encoding, source, decoded, line of literals that decode to printable text; nothing is run.

    Base64 before hex, each in order of place; at most ``limit`` of a text; the line is that of the literal's first place.
    ``odd`` characters are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(key, body.alias("_t"), likely(body, (BASE64_LITERAL, HEX_LITERAL)).alias("_may"))
    found = literal_list(F.col("_t"), [is_likely(F.col("_may"), n) for n in range(2)], limit, odd)
    return df.select(key, F.posexplode(found).alias("seq", "x")).select(key, "seq", "x.*")


def whole_literals(docs: DataFrame, key: str, text: str = "text", odd: str = UNPRINTABLE) -> DataFrame:
    """key, encoding, source, decoded, line of all literals, however many: a run of its characters on a line as a whole, with the blanks of base64 behind it.

    A literal is there as often as it stands in a text; the line is the first one on which it stands by itself, be it as base64 or as hex.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(key, body.alias("_t"), likely(body, (BASE64_RUN, HEX_RUN)).alias("_may"))
    none = F.array().cast("array<struct<at:int,source:string>>")
    each = lambda n, pattern: F.when(is_likely(F.col("_may"), n), F.transform(F.regexp_extract_all("_v", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(n).alias("at"), x.alias("source")))).otherwise(none)
    lines = df.filter(is_likely(F.col("_may"), 0) | is_likely(F.col("_may"), 1)).select(key, "_may", F.posexplode(F.split("_t", "\n", -1)).alias("_n", "_v"))
    found = lines.select(key, (F.col("_n") + 1).alias("line"), F.explode(F.concat(each(0, BASE64_RUN), each(1, HEX_RUN))).alias("x"))
    once = found.groupBy(key, F.col("x.source").alias("source")).agg(F.min("line").alias("line"), *[F.count_if(F.col("x.at") == n).cast("int").alias(f"_{n}") for n in range(2)])
    kinds = [F.struct(F.lit(name).alias("encoding"), F.when(F.length("source") % part == 0, _printable(F.try_to_binary("source", F.lit(name)), odd)).alias("decoded"), F.col(f"_{n}").alias("n")) for n, (name, part) in enumerate((("base64", 4), ("hex", 2)))]
    said = once.select(key, "source", "line", F.explode(F.filter(F.array(*kinds), lambda x: (x["n"] > 0) & x["decoded"].isNotNull())).alias("x"))
    return said.select(key, "x.encoding", "source", "x.decoded", "line", F.explode(F.array_repeat(F.lit(0), F.col("x.n"))).alias("_again")).drop("_again")


def literal_list(t: Column, may: list[Column], limit: int = DECODED_LIMIT, odd: str = UNPRINTABLE) -> Column:
    """encoding, source, decoded, line of a text's literals; ``may`` says whether base64 and hex are looked for."""
    none = F.array().cast("array<struct<encoding:string,source:string,decoded:string>>")
    each = lambda name, pattern, ok, fmt: F.transform(F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), ok), lambda x: F.struct(F.lit(name).alias("encoding"), x.alias("source"), _printable(F.try_to_binary(x, F.lit(fmt)), odd).alias("decoded")))
    found = F.concat(
        F.when(may[0], each("base64", BASE64_LITERAL, lambda x: F.length(x) % 4 == 0, "base64")).otherwise(none),
        F.when(may[1], each("hex", HEX_LITERAL, lambda x: F.length(x) % 2 == 0, "hex")).otherwise(none),
    )
    return F.transform(F.slice(F.filter(found, lambda x: x["decoded"].isNotNull()), 1, limit), lambda x: F.struct(x["encoding"].alias("encoding"), x["source"].alias("source"), x["decoded"].alias("decoded"), line_of(t, F.position(x["source"], t)).alias("line")))


def decoded_indicators(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Decoded literals that hold an address, a URL or a domain."""
    kinds = {k: p for k, _, p in INDICATORS}
    return decoded_literals(docs, key, text).filter(F.col("decoded").rlike(kinds["url"]) | F.col("decoded").rlike(kinds["ip"]) | F.col("decoded").rlike(kinds["domain"]))


def char_codes(values: Column) -> Column:
    """The text of a list of character codes (decimal or hex, at most 512), or null."""
    parts = F.transform(F.split(values, ","), lambda x: F.lower(F.trim(x)))
    number = lambda x: F.when(x.startswith("0x"), F.conv(F.substring(x, 3, 8), 16, 10)).otherwise(x).try_cast("long")
    ok = (F.size(parts) <= 512) & F.forall(parts, lambda x: x.rlike("^(?:0x[0-9a-f]{1,8}|[0-9]{1,6})$") & (number(x) <= 0x10FFFF) & ~number(x).between(0xD800, 0xDFFF))
    one = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(ok, F.array_join(F.transform(parts, lambda x: one(number(x))), ""))


def byte_entropy(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, entropy: Shannon entropy in bits of a text's bytes, to three places (0 for an empty one)."""
    raw = F.hex(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    df = docs.select(key, raw.alias("_h")).select(key, F.explode_outer(F.regexp_extract_all("_h", F.lit(".."), F.lit(0))).alias("b"))
    counts = df.groupBy(key, "b").agg(F.count("b").alias("n"))
    # sum of -p log p from counts alone
    return counts.groupBy(key).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")).otherwise(0.0)).alias("w")).select(key, F.when(F.col("s") > 0, F.round(F.log2("s") - F.col("w") / F.col("s"), 3)).otherwise(F.lit(0.0)).alias("entropy"))


#: Risky interfaces of Java code, and what a reviewer looks for line by line.
JAVA_APIS = {
    "command_execution": r"\b(?:Runtime\.getRuntime|ProcessBuilder|\.exec|GroovyShell|ScriptEngine)\b",
    "deserialization": r"\b(?:ObjectInputStream|readObject|XMLDecoder|XStream|Yaml\.load|SnakeYAML)\b",
    "xml_external_entity": r"\b(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|TransformerFactory|SchemaFactory)\b",
    "path_access": r"\b(?:FileInputStream|FileOutputStream|ZipEntry|Paths\.get|Path\.of|getCanonicalPath)\b",
    "injection_sink": r"\b(?:Statement\.execute|executeQuery|executeUpdate|createQuery|ExpressionFactory|\.eval)\b",
    "web_input_output": r"\b(?:getParameter|getHeader|sendRedirect|getWriter|\.print|\.write)\b",
}
REVIEWED = {
    "Command Execution": r"(?i)\b(eval|exec|system|popen|subprocess|child_process|powershell|cmd\.exe|/bin/sh)\b",
    "Network Access": r"(?i)(https?://|requests\.|urllib|fetch\s*\(|socket\.|curl\b|wget\b)",
    "Credential Collection": r"(?i)(\.ssh|\.aws|\.npmrc|\.pypirc|id_rsa|credentials|wallet|process\.env|os\.environ)",
    "Install Hook Execution": r"(?i)\b(preinstall|postinstall|postInstall|cmdclass|setup_requires|build_ext)\b",
    "Obfuscated Payload": r"(?i)(base64|b64decode|fromcharcode|\\x[0-9a-f]{2}|[A-Za-z0-9+/]{100,}={0,2})",
    "Sensitive File Access": r"(?i)(passwd|shadow|\.env\b|\.git-credentials|browser|cookies|keychain)",
    "Persistence": r"(?i)(startup|crontab|systemd|registry|\.pth\b|site-packages)",
    "Dynamic Download": r"(?i)(download|urlretrieve|writefile|response\.content|Invoke-WebRequest)",
}
FUNCTIONS = (
    r"\b(?:def|function|func|fun)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\b(?:public|private|protected|internal|static|async|virtual|override|final)\s+(?:[A-Za-z_$][A-Za-z0-9_$<>\[\],.?]*\s+)+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
    r"(?m)^\s*(?:[A-Za-z_][A-Za-z0-9_]*\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\([^;{}]*\)\s*\{",
)


def java_api_hits(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, category, n of the risky interfaces that a text names."""
    counted = F.array(*[F.struct(F.lit(k).alias("category"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).alias("n")) for k, p in JAVA_APIS.items()])
    return docs.select(key, F.explode(counted).alias("x")).select(key, "x.*").filter("n > 0")


def function_names(code: Column) -> Column:
    """Names of functions by three patterns, each once, in order of pattern and place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in FUNCTIONS]))


TOKENS = r"[A-Za-z_][A-Za-z0-9_.-]{1,}|--?[A-Za-z][A-Za-z0-9_-]*"


def scaled_buckets(docs: DataFrame, key: str, text: str = "text", buckets: int = 64, limit: int = 12_000) -> DataFrame:
    """key, bucket, weight: log1p of the count of a bucket's tokens over that of the fullest one."""
    tokens = F.slice(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKENS), F.lit(0)), 1, limit)
    bucket = F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("long") % buckets
    counts = docs.select(key, F.explode(tokens).alias("token")).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    most = counts.groupBy(key).agg(F.max("n").alias("most"))
    return counts.join(most, key).select(key, "bucket", (F.log1p("n") / F.log1p("most")).alias("weight"))


def chains(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, rule_id, category, severity, risk_type, left_at, right_at, gap: the nearest ordered pair of each chain within 40 lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(key, body.alias("_t"), likely(body, GROUPS.values()).alias("_may"))
    return paired(df.select(key, F.explode(group_hits(F.col("_t"), [is_likely(F.col("_may"), n) for n in range(len(GROUPS))])).alias("_h")).select(key, "_h.*"), key)


def group_hits(t: Column, may: list[Column]) -> Column:
    """line and grp of the lines that a group's pattern matches; groups without a counterpart in the text aren't looked for."""
    may = dict(zip(GROUPS, may, strict=True))
    wanted = {g: reduce(lambda a, b: a | b, [may[c[0]] & may[c[1]] for c in CHAINS if g in c[:2]]) for g in GROUPS}
    hit = lambda g, p, value, low: wanted[g] & may_match(low, p) & value.rlike(p.replace("(?i)", "(?iU)"))
    listed = lambda value, k, low: F.array_compact(F.array(*[F.when(hit(g, p, value, low), F.struct((k + 1).alias("line"), F.lit(g).alias("grp"))) for g, p in GROUPS.items()]))
    on_line = lambda value, k: F.get(F.transform(F.array(folded(value)), lambda low: listed(value, k, low)), 0)
    none = F.array().cast("array<struct<line:int,grp:string>>")
    # texts that can't hold both ends of any chain aren't cut into lines
    return F.when(reduce(lambda a, b: a | b, wanted.values()), F.flatten(F.transform(split_lines(t), on_line))).otherwise(none)


def paired(hits: DataFrame, key: str) -> DataFrame:
    """The chains of hits (key, line, grp)."""
    roles = F.explode(F.array_compact(F.array(*[x for left, right, _, rule, _, _ in CHAINS for x in (F.when(F.col("grp") == left, F.struct(F.lit(rule).alias("rule_id"), F.lit(0).alias("side"))), F.when(F.col("grp") == right, F.struct(F.lit(rule).alias("rule_id"), F.lit(1).alias("side"))))])))
    sided = hits.select(key, "line", roles.alias("r")).select(key, "r.rule_id", "r.side", "line")
    pair = nearest_following(sided.filter("side = 0"), sided.filter("side = 1"), [key, "rule_id"], "line", CHAIN_GAP)
    out = None
    for column, at in (("category", 2), ("severity", 4), ("risk_type", 5)):
        value = None
        for c in CHAINS:
            value = F.when(F.col("rule_id") == c[3], F.lit(c[at])) if value is None else value.when(F.col("rule_id") == c[3], F.lit(c[at]))
        out = (out if out is not None else pair).withColumn(column, value)
    return out


def destruction(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the line of each of the four stages, of texts that have them all."""
    low = docs.select(key, F.col(text).alias("_t"), folded(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    all_ = reduce(lambda a, b: a & b, [may_match(F.col("_low"), p) for _, p, _ in DESTRUCTION])
    lines = text_lines(low.select(key, F.when(all_, F.col("_t")).alias("_t")), key, "_t")
    stages = [(F.min if which == "first" else F.max)(F.when(F.col("value").rlike(p.replace("(?i)", "(?iU)")), F.col("line"))).alias(name) for name, p, which in DESTRUCTION]
    found = lines.groupBy(key).agg(*stages)
    for name, _, _ in DESTRUCTION:
        found = found.filter(F.col(name).isNotNull())
    return found


def signals(text: Column, low: Column | None = None) -> Column:
    """Names of the risk signals of a text, in order; ``low``, the text in small letters, saves patterns that can't match."""
    may = lambda p: text.rlike(p) if low is None else may_match(low, p) & text.rlike(p)
    return F.array_compact(F.array(*[F.when(may(p), F.lit(n)) for n, p in SIGNALS.items()]))


def hidden_controls(text: Column) -> Column:
    """The hidden characters of a text as code points (hex), sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(c)), F.lit(f"{ord(c):04x}")) for c in HIDDEN])))


def token_buckets(docs: DataFrame, key: str, text: str = "text", buckets: int = 64, limit: int = 12_000) -> DataFrame:
    """key, bucket, n: the first ``limit`` tokens by bucket of their SHA-256."""
    tokens = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), 1, limit)
    bucket = F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("long") % buckets
    return docs.select(key, F.explode(tokens).alias("token")).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
