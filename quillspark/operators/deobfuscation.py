"""Literals that hide text: calls that decode, escapes, character codes; what they decode to, and whether that is dangerous.

All runs in the JVM on one row a text: matches and the pieces between them come from one pattern,
so that a match's line is that of its own place. Nothing found is ever run. What is decoded may
hide text once more; ``depth`` rounds follow it, and the line stays that of the outermost literal.

Null or empty texts decode to nothing; unknown languages are read like any but the script
languages; text in UTF-16 is decoded within the basic plane; repeated rows give repeated rows if
their keys differ (a key is one text); further columns aren't read.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.lineage import ensure_folder
from quillspark.functions.masking import mask_udf
from quillspark.functions.needles import is_likely, likely
from quillspark.operators import scan
from quillspark.operators.rules import active, unicode_pattern

#: Calls that decode a literal, commands that are encoded, literals with escapes.
BASE64_CALL = (
    r"(?i)(?:base64\.(?:b64decode|urlsafe_b64decode)|base64_decode|(?:convert\.)?frombase64string|base64(?:\.(?:stdencoding|rawstdencoding|urlencoding))?\.decodestring"
    r"|base64\.getdecoder\(\)\.decode|atob|buffer\.from)\s*\(\s*(['\"])([A-Za-z0-9+/_-]{8,}={0,2})\1"
)
HEX_CALL = r"(?i)(?:(?:bytes|bytearray)\.fromhex|binascii\.unhexlify|hex2bin|hex\.decodestring|(?:convert\.)?fromhexstring)\s*\(\s*(['\"])([0-9a-f]{8,})\1"
ENCODED_COMMAND = r"(?i)(?:^|\s)-(?:e|en|enc|enco|encod|encode|encodedcommand)\s+(['\"]?)([A-Za-z0-9+/]{8,}={0,2})\1"
ESCAPED = r"(['\"])([^'\"\r\n]*(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\})[^'\"\r\n]*)\1"
HEX_RUN = r"(?:\\x[0-9a-fA-F]{2})+"
UNICODE = r"\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}"
CHAR_CODES = r"(?i)String\.fromCharCode\(([^)]{1,2000})\)"
ATOB = r"(?i)(?:atob|Buffer\.from)\(\s*(['\"])([A-Za-z0-9+/=]{8,})\1(?:\s*,\s*['\"]base64['\"])?\s*\)"
#: What is dangerous in decoded text, in order; the first that fits counts.
DANGEROUS = (
    ("DEOB-EXEC", "decoded_exec", 9, r"(?i)\b(?:eval|exec|system|popen|shell_exec|passthru)\s*\(|\bos\.system\s*\(|\bsubprocess\.(?:run|call|popen|check_output)\s*\(|\bchild_process\b|\bruntime\.getruntime\(\)\.exec\s*\(|\bprocessbuilder\s*\(|\bexec\.command\s*\(|\binvoke-expression\b|\biex\b|\bstart-process\b|\b(?:cmd(?:\.exe)?\s+/c|powershell(?:\.exe)?\s+-)"),
    ("DEOB-NETWORK", "decoded_network", 8, r"(?i)\b(?:fetch|xmlhttprequest)\s*\(|\brequests?\.(?:get|post|put)\s*\(|\binvoke-webrequest\b|\bdownloadstring\s*\(|\bwebclient\b|\b(?:curl|wget)\s+https?://|\bhttp\.(?:get|post)\s*\(|\bnet\.dial\s*\(|\bnew\s+socket\s*\("),
    ("DEOB-PERSISTENCE", "decoded_persistence", 8, r"(?i)\bschtasks\b|\brunonce\b|\bcrontab\b|\bsystemctl\s+enable\b|authorized_keys|\bnew-service\b"),
)
SCRIPT_DANGEROUS = (
    ("JS-DEOB-DYNAMIC", "Dynamic JavaScript execution", 8, r"(?i)\beval\s*\(|new\s+Function\s*\(|Function\s*\("),
    ("JS-DEOB-NETWORK", "Decoded network behavior", 6, r"(?i)(?:fetch|XMLHttpRequest|WebSocket|http\.request|https\.request)\s*\("),
    ("JS-DEOB-CMD", "Decoded process execution", 9, r"(?i)(?:child_process|spawn|execFile|require\s*\(\s*['\"]child_process)"),
)
SCRIPTS = ("javascript", "typescript", "html")
LIMIT, SCRIPT_LIMIT, BYTES, SOURCE, PREVIEW = 160, 120, 64 * 1024, 4000, 240
CONFIDENCE, EVIDENCE_LIMIT = 0.82, 160
_KIND = "array<struct<rank:int,encoding:string,source:string,decoded:string,line:int>>"
_ODD = scan.UNPRINTABLE


def _lines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _let(value: Column, use) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def _wide(raw: Column, order: str) -> Column:
    """Text of UTF-16 in the basic plane, else null."""
    high = F.regexp_replace(F.hex(raw), "(..)(..)", "$2 " if order == "UTF-16LE" else "$1 ")
    return F.when((F.octet_length(raw) % 2 == 0) & ~high.rlike("(?:^| )D[89A-F]"), F.decode(raw, order))


def _good(text: Column) -> Column:
    fits = lambda x: (F.length(x) >= 4) & ~F.contains(x, F.lit("\0")) & ((F.length(x) - F.regexp_count(x, F.lit(_ODD))) >= 0.9 * F.length(x))
    return _let(_strip(text), lambda x: F.when(fits(x), x))


def _utf8(raw: Column) -> Column:
    return _let(raw.cast("string"), lambda x: F.when(F.is_valid_utf8(x), x))


def readable(raw: Column, *encodings: str) -> Column:
    """Bytes as text in the first encoding that gives four characters or more, nine in ten printable; else null."""
    in_any = lambda r: F.coalesce(*[_good(_utf8(r) if e == "UTF-8" else _wide(r, e)) for e in (encodings or ("UTF-8",))])
    return _let(raw, lambda r: F.when(F.octet_length(r).between(1, BYTES), in_any(r)))


def _from_base64(value: Column) -> Column:
    padded = lambda c: F.rpad(c, (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))
    return _let(F.rtrim(F.translate(value, "-_", "+/"), F.lit("=")), lambda c: F.when(F.length(c) % 4 != 1, F.try_to_binary(padded(c), F.lit("base64"))))


def _from_hex(value: Column) -> Column:
    return F.when(F.length(value) % 2 == 0, F.unhex(value))


def _matches(text: Column, may: Column, rank: int, pattern: str, group: int, decode) -> Column:
    """Array of what a pattern's matches decode to. ``decode`` takes the group's text and gives a struct of encoding and text (null if none)."""
    # the pattern goes over the text once: no match hangs on what stands around it, so that its group is found in the match, its place as that string's next one
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<value:string,source:string,at:int>>").alias("m"))

    def place(a: Column, x: Column) -> Column:
        own = lambda p: F.struct((p + F.length(x)).alias("at"), F.concat(a["m"], F.array(F.struct(F.regexp_extract(x, pattern, group).alias("value"), F.substring(x, 1, SOURCE).alias("source"), p.alias("at")))).alias("m"))
        return _let(F.position(x, text, a["at"]), own)

    def one(m: Column) -> Column:
        line = (_lines(F.substring(text, F.lit(1), m["at"] - 1)) + 1).cast("int")
        return _let(decode(m["value"]), lambda d: F.struct(F.lit(rank).alias("rank"), d["encoding"].alias("encoding"), m["source"].alias("source"), F.substring(d["text"], 1, BYTES).alias("decoded"), line.alias("line")))

    placed = F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, place, lambda a: a["m"])
    return F.when(may, F.filter(F.transform(placed, one), lambda x: F.length(x["decoded"]) > 0)).otherwise(F.array().cast(_KIND))


def _zeros(hexed: Column, at: int) -> Column:
    pairs = F.length(hexed) / 4
    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(pairs.cast("int") - 1, F.lit(0))), lambda i: F.substring(hexed, i * 4 + at, F.lit(2)) == "00")) / pairs


def _said(encoding: str | Column, text: Column, was: Column) -> Column:
    return F.struct((F.lit(encoding) if isinstance(encoding, str) else encoding).alias("encoding"), text.alias("text"), was.alias("was"))


def _run(run: Column) -> Column:
    """Encoding and text of a run of hex escapes; the text is null where it isn't readable."""

    def of(h: Column) -> Column:
        even = (F.length(h) >= 8) & (F.length(h) % 4 == 0)
        little = even & (h.startswith("FFFE") | ((_zeros(h, 3) >= 0.4) & (_zeros(h, 1) <= 0.1)))
        big = even & (h.startswith("FEFF") | ((_zeros(h, 1) >= 0.4) & (_zeros(h, 3) <= 0.1)))
        text = lambda e: F.when(e == "utf-16le", readable(F.unhex(h), "UTF-16LE", "UTF-8")).when(e == "utf-16be", readable(F.unhex(h), "UTF-16BE", "UTF-8")).otherwise(readable(F.unhex(h)))
        return _let(F.when(little, "utf-16le").when(big, "utf-16be").otherwise("utf-8"), lambda e: _said(e, text(e), run))

    return _let(F.upper(F.replace(run, F.lit("\\x"), F.lit(""))), of)


def _code_point(token: Column) -> Column:
    number = F.conv(F.regexp_replace(token, r"[\\u{}]", ""), 16, 10).cast("long")
    char = lambda n: F.when((n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    return _said("unicode", _let(_let(number, char), lambda c: F.when(~c.rlike(_ODD), c)), token)


def _woven(parts: Column, found: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(found, i)["text"], F.get(found, i)["was"], F.lit("")))), "")


def unescaped(value: Column) -> Column:
    """Encoding and text of a literal with escapes; the text is null where none stands for something readable."""

    def of_runs(runs: Column) -> Column:
        def of_text(text: Column) -> Column:
            def of_points(points: Column) -> Column:
                used = F.array_distinct(F.transform(F.filter(F.concat(runs, points), lambda x: x["text"].isNotNull()), lambda x: x["encoding"]))
                out = lambda u: _let(_woven(F.split(text, UNICODE, -1), points), lambda o: F.when((F.size(u) > 0) & (o != value) & (F.length(_strip(o)) >= 4), o))
                return _let(used, lambda u: _said(F.concat(F.lit("escaped-"), F.array_join(u, "+")), out(u), value))

            return _let(F.transform(F.regexp_extract_all(text, F.lit(UNICODE), F.lit(0)), _code_point), of_points)

        return _let(_woven(F.split(value, HEX_RUN, -1), runs), of_text)

    return _let(F.transform(F.regexp_extract_all(value, F.lit(HEX_RUN), F.lit(0)), _run), of_runs)


#: Patterns of literals in the order in which ``_candidates`` takes what may be there.
LITERALS = (CHAR_CODES, ATOB, BASE64_CALL, HEX_CALL, ESCAPED, ENCODED_COMMAND, scan.BASE64_LITERAL, scan.HEX_LITERAL)


def _candidates(text: Column, language: Column, may: list[Column], odd: str) -> Column:
    """All that a text's literals decode to, by rank of the kind, with its place (``at``) in that of bare or other literals."""
    script, none = language.isin(*SCRIPTS), F.array().cast(_KIND)
    strict = lambda v: F.when((F.length(v) % 4 == 0) & v.rlike("^[A-Za-z0-9+/]*={0,2}$"), _utf8(_from_base64(v)))
    kind = lambda name, text: lambda v: F.struct(F.lit(name).alias("encoding"), text(v).alias("text"))
    found = F.concat(
        F.when(script, _matches(text, may[0], 0, CHAR_CODES, 1, kind("fromCharCode", scan.char_codes))).otherwise(none),
        F.when(script, _matches(text, may[1], 1, ATOB, 2, kind("base64", strict))).otherwise(none),
        _matches(text, may[2], 3, BASE64_CALL, 2, kind("base64-call", lambda v: readable(_from_base64(v), "UTF-8", "UTF-16LE"))),
        _matches(text, may[3], 4, HEX_CALL, 2, kind("hex-call", lambda v: readable(_from_hex(v)))),
        _matches(text, may[4], 5, ESCAPED, 2, unescaped),
        F.when(language == "powershell", _matches(text, may[5], 7, ENCODED_COMMAND, 2, kind("powershell-encoded-command", lambda v: readable(_from_base64(v), "UTF-16LE", "UTF-8")))).otherwise(none),
    )
    placed = lambda rank: lambda x, k: F.struct((x["rank"] if rank is None else rank).alias("rank"), k.alias("at"), x["encoding"].alias("encoding"), x["source"].alias("source"), x["decoded"].alias("decoded"), x["line"].cast("int").alias("line"))
    return F.concat(F.transform(scan.literal_list(text, may[6:], odd=odd), placed(F.when(script, 2).otherwise(6))), F.transform(found, placed(None)))


def _once(found: DataFrame, key: str, level: int) -> DataFrame:
    """Of what texts decode to (key, _l, _line, _p, rank, at, encoding, source, decoded, line) each (decoded, line) once, at most 160 of a text."""
    each = found.withColumn("line", F.coalesce("_line", "line")).groupBy(key, "_l", "decoded", "line").agg(F.min(F.struct("rank", "_p", "at", "encoding", "source")).alias("_f"))
    seq = F.row_number().over(Window.partitionBy(key).orderBy("_f.rank", "_f._p", "_f.at", "decoded")) - 1
    return each.select(key, "_l", F.lit(level).alias("depth"), seq.alias("seq"), "_f.encoding", "_f.source", "decoded", "line", F.col("_f.rank").alias("rank")).filter(F.col("seq") < LIMIT)


def decoded(docs: DataFrame, key: str, text: str = "text", language: str = "language", depth: int = 1, masked: bool = False, odd: str = scan.UNPRINTABLE) -> DataFrame:
    """key, depth, seq, encoding, source, decoded, line of what a text's literals decode to, each (decoded, line) once, at most 160 of a text and depth.

    Script languages come first with their own calls, then calls, escapes, bare literals and encoded commands.
    Comments don't count unless the text is masked already. Bare literals lose their ``odd`` characters.
    """
    named = F.lower(F.trim(F.coalesce(F.col(language), F.lit("unknown"))))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, named.alias("_l"), (body if masked else mask_udf(body, named)).alias("_t"), F.lit(None).cast("int").alias("_line"), F.lit(0).alias("_p"))
    out = []
    for level in range(1, depth + 1):
        seen = rows.withColumn("_may", likely(F.col("_t"), LITERALS))
        made = _candidates(F.col("_t"), F.col("_l"), [is_likely(F.col("_may"), k) for k in range(len(LITERALS))], odd)
        each = _once(seen.select(key, "_l", "_line", "_p", F.explode(made).alias("_x")).select(key, "_l", "_line", "_p", "_x.*"), key, level)
        out.append(each)
        rows = each.select(key, "_l", F.col("decoded").alias("_t"), F.col("line").alias("_line"), F.col("seq").alias("_p"))
    return reduce(DataFrame.unionByName, out).withColumnRenamed("_l", "language")


def _first_rule(value: Column, rules: tuple) -> Column:
    """The first rule that the text hits: rule_id, behavior, severity; null if none."""
    made = [F.when(value.rlike(unicode_pattern(p)), F.struct(F.lit(r).alias("rule_id"), F.lit(b).alias("behavior"), F.lit(s).alias("severity"))) for r, b, s, p in rules]
    return F.coalesce(*made)


def findings(docs: DataFrame, key: str, text: str = "text", language: str = "language", masked: bool = False, odd: str = scan.UNPRINTABLE) -> DataFrame:
    """key, seq, rule_id, behavior, severity, risk_type, line, snippet, encoding, preview, confidence: decoded text that would do something dangerous.

    Script languages have rules of their own; lines where those find something aren't looked at by the others.
    """
    return _dangerous(decoded(docs, key, text, language, 1, masked, odd), key)


def _dangerous(said: DataFrame, key: str) -> DataFrame:
    flat = F.substring(_strip(F.regexp_replace("decoded", r"(?U)[\s\x1C-\x1F]+", " ")), 1, PREVIEW)
    script = F.col("language").isin(*SCRIPTS) & (F.col("rank") <= 2) & (F.col("seq") < SCRIPT_LIMIT)
    own = said.withColumn("_own", F.when(script, _first_rule(F.col("decoded"), SCRIPT_DANGEROUS)))
    lines = F.max(F.col("_own").isNotNull()).over(Window.partitionBy(key, "line"))
    own = own.withColumn("_said", lines)
    rule = F.explode(F.array_compact(F.array(F.when(F.col("_own").isNotNull(), F.struct(F.lit(0).alias("part"), F.col("_own").alias("r"))), F.when(~F.col("_said"), F.struct(F.lit(1).alias("part"), _first_rule(F.col("decoded"), DANGEROUS).alias("r"))))))
    rows = own.select(key, "seq", "encoding", "line", F.substring("source", 1, PREVIEW).alias("snippet"), flat.alias("preview"), rule.alias("_f")).filter(F.col("_f.r").isNotNull())
    each = rows.groupBy(key, "_f.r.rule_id", "line", "encoding", "preview").agg(F.min(F.struct("_f.part", "seq", "_f.r.behavior", "_f.r.severity", "snippet")).alias("_m"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("_m.part", "_m.seq")) - 1
    return each.select(key, order.alias("seq"), "rule_id", "_m.behavior", "_m.severity", F.lit("malicious").alias("risk_type"), "line", "_m.snippet", "encoding", "preview", F.lit(CONFIDENCE).alias("confidence"))


def static_evidence(docs: DataFrame, key: str, text: str = "text", language: str = "language") -> DataFrame:
    """What static analysis says of each text: key, seq, source, rule_id, risk_type, severity, line, at most 160 of a text.

    Comments are masked and each text is read once; what is found there is saved as a row a text, since three
    kinds of evidence are made of it. Indicators come first, then decoded literals, then chains of behaviours;
    findings that only the rule engine may make are left out.
    """
    ensure_folder(docs.sparkSession)
    named = F.lower(F.trim(F.coalesce(F.col(language), F.lit("unknown"))))
    clear = docs.select(key, named.alias("_l"), mask_udf(F.coalesce(F.col(text), F.lit("")), named).alias("_t"))
    wanted = [[p for _, _, p in scan.INDICATORS], LITERALS, list(scan.GROUPS.values())]
    clear = clear.withColumn("_may", likely(F.col("_t"), [p for part in wanted for p in part]))
    starts = [0, *accumulate(map(len, wanted))]
    may = [[is_likely(F.col("_may"), k) for k in range(a, b)] for a, b in pairwise(starts)]
    seen = clear.select(
        key, "_l", scan.indicator_list(F.col("_t"), may[0]).alias("_all"), _candidates(F.col("_t"), F.col("_l"), may[1], scan.UNPRINTABLE).alias("_said"), scan.group_hits(F.col("_t"), may[2]).alias("_hits"),
    ).checkpoint()
    said = seen.select(key, "_l", F.lit(None).cast("int").alias("_line"), F.lit(0).alias("_p"), F.explode("_said").alias("_x")).select(key, "_l", "_line", "_p", "_x.*")
    row = lambda df, part, source, seq, rule, risk, line: df.select(key, F.lit(part).alias("part"), F.lit(source).alias("source"), seq.cast("int").alias("_at"), rule.alias("rule_id"), risk.alias("risk_type"), F.col("severity").cast("int").alias("severity"), line.cast("int").alias("line"))
    found = [
        row(scan.listed_indicators(seen, key, "_all"), 0, "strings_ioc", F.col("seq"), F.concat(F.lit("IOC-"), F.upper("kind")), F.lit("context"), F.col("line")),
        row(_dangerous(_once(said, key, 1).withColumnRenamed("_l", "language"), key), 1, "source_deobfuscation", F.col("seq"), F.col("rule_id"), F.col("risk_type"), F.col("line")),
        row(scan.paired(seen.select(key, F.explode("_hits").alias("_h")).select(key, "_h.*"), key), 2, "behavior_chain", F.col("left_at"), F.col("rule_id"), F.col("risk_type"), F.col("left_at")),
    ]
    rows = active(reduce(DataFrame.unionByName, found))
    seq = F.row_number().over(Window.partitionBy(key).orderBy("part", "_at", "rule_id")) - 1
    return rows.withColumn("seq", seq).filter(F.col("seq") < EVIDENCE_LIMIT).select(key, "seq", "source", "rule_id", "risk_type", "severity", "line")
