"""Licence recognition by sentence rules.

A text is cut into sentences (at line ends and after ``.``, ``;`` or ``:`` before white
space). A sentence that mentions a licence word or name is normalised (lower case, white space
and quotes collapsed) and looked up among the known sentences of licence texts and notices; one
that isn't known gets the identifier of the first pattern of SENTENCES that it matches, and one
that only mentions a licence becomes ``unknown``. An SPDX tag's expression gives an identifier for each licence that it
names, exceptions left out. Lines that name another identifier
together than apart are one sentence. The document's identifiers in order, joined by ``;``,
are then matched against the ordered RULES: each that matches names its licence, but general
rules (YIELDING) yield to their family's earlier ones. Both tables are fixed and small, and compile into one
projection without shuffle or user functions.

Defined results: null text counts as empty and has no licence; ties go to the rule that
stands first; repeated rows are scanned one by one; an empty table gives an empty table;
further columns are carried through by ``scan``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Sentences without any of these words are no licence sentences.
MENTIONS = "licen[sc]e|copyright|spdx|warrant|redistribut|all rights reserved|public domain|permission is hereby|neither the name of|liab"

#: Sentences of licence texts and notices as they stand there, by identifier.
KNOWN = {
    "apache-2": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "Apache License, Version 2.0", "you may not use this file except in compliance with the License."),
    "mit": ("Released under the MIT License.", "MIT License", "The MIT License (MIT)", "This project is licensed under the MIT License.", "Licensed under the MIT License."),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy",),
    "gpl-3": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License v3.0", "This program is licensed under the GNU General Public License, version 3."),
    "gpl-2": ("GNU General Public License v2.0", "This program is licensed under the GNU General Public License, version 2."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "bsd-redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-3": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "no-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.', "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "all-rights": ("All rights reserved.",),
}
#: Fixed values: (identifier, pattern of one licence of an SPDX expression); the first match counts.
SPDX = (
    ("spdx-apache-2", "apache-2[.]0[+]?"), ("spdx-mit", "mit(-0)?"), ("agpl", "agpl-.*"), ("lgpl-3", "lgpl-3.*"), ("lgpl-2", "lgpl-2.*"), ("gpl-3", "gpl-3.*"), ("gpl-2", "gpl-2.*"), ("gpl", "gpl-.*"), ("mpl-2", "mpl-2.*"), ("mpl", "mpl-.*"), ("epl", "epl-.*"),
    ("isc", "isc"), ("bsd-3", "bsd-3-clause.*"), ("bsd-2", "bsd-2-clause.*"), ("bsd", "bsd-.*|0bsd"), ("cc-by-nc-sa", "cc-by-nc-sa.*"), ("cc-by-nc-nd", "cc-by-nc-nd.*"), ("cc-by-nc", "cc-by-nc.*"), ("cc-by-sa", "cc-by-sa.*"), ("cc-by-nd", "cc-by-nd.*"),
    ("cc-by", "cc-by.*"), ("cc0", "cc0-.*"), ("spdx-other", ".*"),
)
SPDX_TAG = "spdx-license-identifier: *"
SPDX_EXPRESSION = SPDX_TAG + "([(]*[a-z0-9][a-z0-9.+-]*[)]*( +(and|or|with) +[(]*[a-z0-9][a-z0-9.+-]*[)]*)*)"
#: Fixed values: (identifier, pattern of a normalised sentence); the first match counts.
SENTENCES = (
    ("denied", r"\b(not|never) ([a-z]+ )?(under|by) (the |an? )?(terms of (the )?)?([a-z0-9.-]+ )*(licen[sc]e|[al]?gpl|bsd|mit)"),
    ("apache-2", r"apache license,? *(version|v)?\.? *2"),
    ("apache", r"apache (software )?license"),
    ("agpl", r"affero general public license|agpl"),
    ("lgpl-3", r"(lesser|library) general public license,? *(version|v)?\.? *3|lgpl[- ]?(v|version)? ?3"),
    ("lgpl-2", r"(lesser|library) general public license,? *(version|v)?\.? *2|lgpl[- ]?(v|version)? ?2"),
    ("lgpl", r"(lesser|library) general public license|lgpl"),
    ("gpl-3", r"general public license,? *(version|v)?\.? *3|gpl[- ]?(v|version)? ?3"),
    ("gpl-2", r"general public license,? *(version|v)?\.? *2|gpl[- ]?(v|version)? ?2"),
    ("gpl", r"general public license|gnu gpl"),
    ("mpl-2", r"mozilla public license,? *(version|v)?\.? *2|mpl[- ]?2"),
    ("mpl", r"mozilla public license"),
    ("epl", r"eclipse public license"),
    ("mit-grant", r"permission is hereby granted, free of charge"),
    ("mit", r"(under|the|is) (the )?(terms of the )?mit licen[sc]e|^mit licen[sc]e"),
    ("isc", r"isc licen[sc]e"),
    ("bsd-3", r"3-clause bsd|bsd[- ]3-clause|neither the name of"),
    ("bsd-2", r"2-clause bsd|bsd[- ]2-clause"),
    ("bsd-redistribution", r"redistribution and use in source and binary forms"),
    ("bsd-source", r"redistributions of source code must retain"),
    ("bsd-binary", r"redistributions in binary form must reproduce"),
    ("bsd", r"bsd licen[sc]e"),
    ("cc-by-nc-sa", r"cc[- ]by-nc-sa|attribution-noncommercial-sharealike"),
    ("cc-by-nc-nd", r"cc[- ]by-nc-nd|attribution-noncommercial-noderiv"),
    ("cc-by-nc", r"cc[- ]by-nc|attribution-noncommercial"),
    ("cc-by-sa", r"cc[- ]by-sa|attribution-sharealike"),
    ("cc-by-nd", r"cc[- ]by-nd|attribution-noderiv"),
    ("cc-by", r"cc[- ]by|creative commons attribution"),
    ("cc0", r"cc0|public domain"),
    ("all-rights", r"all rights reserved"),
    ("no-warranty", r"without (any )?warrant|provided .?as is|no event .* liab"),
    ("copyright", r"copyright *(\(c\)|©)? *[0-9]{4}|copyright \(c\)|^copyright"),
    ("unknown", r"licen[sc]ed? (under|by|to)|under (the|a) .*licen[sc]e|licensing terms"),
)

#: Fixed values: (licence, pattern of ";id;id;...;" of a document), in order; later rules only see what is not named yet by their family.
RULES = (
    ("Apache-2.0", "apache", r";(spdx-apache-2|apache-2);"),
    ("Apache", "apache", r";apache;"),
    ("AGPL", "agpl", r";agpl;"),
    ("LGPL-3.0", "lgpl", r";lgpl-3;"),
    ("LGPL-2.x", "lgpl", r";lgpl-2;"),
    ("LGPL", "lgpl", r";lgpl;"),
    ("GPL-3.0", "gpl", r";gpl-3;"),
    ("GPL-2.0", "gpl", r";gpl-2;"),
    ("GPL", "gpl", r";gpl;"),
    ("MPL-2.0", "mpl", r";mpl-2;"),
    ("MPL", "mpl", r";mpl;"),
    ("EPL", "epl", r";epl;"),
    ("MIT", "mit", r";(spdx-mit|mit-grant|mit);"),
    ("ISC", "isc", r";isc;"),
    ("BSD-3-Clause", "bsd", r";bsd-3;|;bsd-redistribution;(.*;)?bsd-source;(.*;)?bsd-binary;(.*;)?bsd-3;"),
    ("BSD-2-Clause", "bsd", r";bsd-2;|;bsd-redistribution;(.*;)?bsd-source;(.*;)?bsd-binary;"),
    ("BSD", "bsd", r";(bsd|bsd-redistribution);"),
    ("CC-BY-NC-SA", "cc", r";cc-by-nc-sa;"),
    ("CC-BY-NC-ND", "cc", r";cc-by-nc-nd;"),
    ("CC-BY-NC", "cc", r";cc-by-nc;"),
    ("CC-BY-SA", "cc", r";cc-by-sa;"),
    ("CC-BY-ND", "cc", r";cc-by-nd;"),
    ("CC-BY", "cc", r";cc-by;"),
    ("CC0", "cc0", r";cc0;"),
    ("Proprietary", "all-rights", r";all-rights;"),
    ("Other", "other", r";(spdx-other|unknown);"),
)


#: Names of licences in sentences that hold none of MENTIONS' words; whole words, as keys and hashes hold them by chance.
NAMES = r"\b[al]?gpl(v?[0-9]|\b)|\bmpl[- ]?2|\b[23]-clause bsd\b|\bbsd[- ][23]-clause\b|\bcc[- ]by\b|\bcc0\b|attribution-(noncommercial|sharealike|noderiv)|creative commons attribution|provided .?as is"
#: Texts without any of these have neither, on one line or across lines.
HINTS = r"licen[sc]e|copyright|spdx|warrant|redistribut|reserved|domain|permission|neither|liab|gpl|\bmpl|bsd|\bcc|attribution|provided"
#: Lines that a wrapped phrase may cover.
WRAPPED = (2, 3)
#: Rules that yield to the earlier ones of their family, unless their own pattern (if any) matches.
YIELDING = {"Apache": None, "LGPL": None, "GPL": None, "MPL": None, "BSD": None, "BSD-2-Clause": ";bsd-2;"}


def _known() -> dict[str, str]:
    """Normalised sentences and their identifiers."""
    return {re.sub(r"[\x20\x09-\x0D\x22*#/]+", " ", x.lower()).strip(): ident for ident, said in KNOWN.items() for x in said}


def _spdx(s: Column) -> Column:
    """Identifiers of the licences that an expression names, joined by ";"; null where there is none."""
    words = F.regexp_extract_all(F.regexp_extract(s, SPDX_EXPRESSION, 1), F.lit("[a-z0-9][a-z0-9.+-]*"), F.lit(0))

    def listed(w: Column) -> Column:
        kept = F.filter(w, lambda x, k: ~x.isin("and", "or", "with") & ((k == 0) | (F.get(w, k - 1) != "with")))
        one = lambda x: reduce(lambda c, p: c.when(x.rlike(f"^({p[1]})$"), p[0]), SPDX[1:], F.when(x.rlike(f"^({SPDX[0][1]})$"), SPDX[0][0]))
        return F.nullif(F.array_join(F.transform(kept, one), ";"), F.lit(""))

    return F.when(F.contains(s, F.lit(SPDX_TAG.removesuffix(" *"))), F.get(F.transform(F.array(words), listed), 0))


def _name(s: Column) -> Column:
    """The identifier of a normalised sentence (several joined by ";" where an expression names them), or null."""
    known = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    out = None
    for ident, pattern in SENTENCES:
        out = F.when(s.rlike(pattern), ident) if out is None else out.when(s.rlike(pattern), ident)
    return F.when(s.rlike(MENTIONS) | s.rlike(NAMES), F.coalesce(_spdx(s), F.try_element_at(known, s), out))


def _normalised(text: Column) -> Column:
    """All sentences and lines of a text, normalised."""
    # SPDX tags hold a colon and blank, and stay whole
    cut = F.split(F.regexp_replace(F.regexp_replace(text, r"(?i)(spdx-license-identifier:)[ \t]+", "$1"), r"([.;:])[ \t]+", "$1\n"), "\n", -1)
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[\x20\x09-\x0D\x22*#/]+", " ")))


def _across(lines: int) -> Column:
    """For each place of _n, the identifier that shows only when so many lines are joined, or null.

    Lines that end a sentence and blank ones are not joined.
    """
    def at(s: Column, k: Column) -> Column:
        part = F.slice("_n", k + 1, lines)
        whole = F.array_join(part, " ")
        near = (F.size(part) == lines) & ~F.exists(part, lambda x: x == "") & ~F.exists(F.slice(part, 1, lines - 1), lambda x: x.rlike("[.;:]$")) & (whole.rlike(MENTIONS) | whole.rlike(NAMES))
        ident = F.when(near, _name(whole))
        known = F.exists(F.slice("_i", k + 1, lines), lambda x: x.eqNullSafe(ident))
        if lines > 2:  # nor in fewer lines
            known = known | F.exists(F.slice("_j2", k + 1, lines - 1), lambda x: x.eqNullSafe(ident))
        return F.when(~known, ident)

    return F.transform("_n", at)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add license_sentences (identifiers in order), licenses (names in the order of RULES) and n_license_sentences."""
    whole = text_or_empty(text)
    empty = F.array().cast("array<string>")
    df = docs.select(F.struct("*").alias("row"), whole.alias("_t"))
    whole = F.col("_t")
    df = df.withColumn("_n", F.when(F.lower(whole).rlike(HINTS), _normalised(whole)).otherwise(empty))
    df = df.withColumn("_i", F.transform("_n", _name))
    for n in WRAPPED:
        df = df.withColumn(f"_j{n}", _across(n))

    def taken(k: Column) -> Column:
        """A phrase that began on an earlier line covers this one."""
        return F.exists(F.sequence(F.lit(1), F.lit(max(WRAPPED) - 1)), lambda b: (k >= b) & ((F.get(F.col("_j2"), k - b).isNotNull() & (b < 2)) | F.get(F.col("_j3"), k - b).isNotNull()))

    ids = F.transform("_i", lambda x, k: F.coalesce(F.get(F.col("_j2"), k), F.get(F.col("_j3"), k), F.when(~taken(k), x)))
    df = df.withColumn("license_sentences", F.flatten(F.transform(F.array_compact(ids), lambda x: F.split(x, ";")))).drop("_n", "_i", "_j2", "_j3")
    df = df.withColumn("_s", F.concat(F.lit(";"), F.array_join(F.transform("license_sentences", lambda x: F.concat(x, F.lit(";"))), "")))
    names, before = [], {}
    for licence, family, pattern in RULES:
        hit = F.col("_s").rlike(pattern)
        if family == "other":  # only where nothing else is named
            others = F.lit(False)
            for x in before.values():
                others = others | x
            names.append(F.when(hit & ~others, F.lit(licence)))
            continue
        free = hit
        if licence in YIELDING and family in before:
            own = YIELDING[licence]
            free = hit & (~before[family] if own is None else ~before[family] | F.col("_s").rlike(own))
        names.append(F.when(free, F.lit(licence)))
        before[family] = before[family] | hit if family in before else hit
    df = df.withColumn("licenses", F.when(F.size("license_sentences") == 0, empty).otherwise(F.array_compact(F.array(*names))))
    df = df.withColumn("n_license_sentences", F.size("license_sentences").cast("long"))
    own = ["license_sentences", "licenses", "n_license_sentences"]
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_license_sentences", F.array_join("license_sentences", ";").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    when = lambda x, pairs: "CASE " + " ".join(f"WHEN regexp_matches({x}, {quote(p)}) THEN '{i}'" for i, p in pairs) + " END"
    known = f"MAP {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in _known().items())}}}"
    words = lambda x: f"regexp_extract_all(regexp_extract({x}, {quote(SPDX_EXPRESSION)}, 1), '[a-z0-9][a-z0-9.+-]*')"
    spdx = lambda x: f"nullif(array_to_string(list_transform(list_filter({words(x)}, lambda y, k: y NOT IN ('and', 'or', 'with') AND (k = 1 OR {words(x)}[k - 1] <> 'with')), lambda y: {when('y', [(i, f'^({p})$') for i, p in SPDX])}), ';'), '')"
    said = lambda x: f"(regexp_matches({x}, {quote(MENTIONS)}) OR regexp_matches({x}, {quote(NAMES)}))"
    name = lambda x: f"CASE WHEN {said(x)} THEN coalesce({spdx(x)}, {known}[{x}], {when(x, SENTENCES)}) END"
    rules = ", ".join(f"({k}, '{n}', '{f}', {quote(p)}, {n in YIELDING}, {quote(YIELDING[n]) if YIELDING.get(n) else 'NULL'})" for k, (n, f, p) in enumerate(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, string_split(regexp_replace(regexp_replace(t, '(?i)(spdx-license-identifier:)[ \t]+', '\1', 'g'), '([.;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS x FROM d WHERE regexp_matches(lower(t), {quote(HINTS)})),
n AS MATERIALIZED (SELECT rid, k, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D\x22*#/]+', ' ', 'g'), ' ') AS s FROM (SELECT rid, unnest(x) AS raw, generate_subscripts(x, 1) AS k FROM x)),
w AS MATERIALIZED (SELECT rid, k, s, {name('s')} AS i, lead(s) OVER o AS s2, lead(s, 2) OVER o AS s3 FROM n WINDOW o AS (PARTITION BY rid ORDER BY k)),
v AS MATERIALIZED (SELECT *, lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3, CASE WHEN s <> '' AND s2 <> '' AND NOT regexp_matches(s, '[.;:]$') THEN s || ' ' || s2 END AS two,
  CASE WHEN s <> '' AND s2 <> '' AND s3 <> '' AND NOT regexp_matches(s, '[.;:]$') AND NOT regexp_matches(s2, '[.;:]$') THEN s || ' ' || s2 || ' ' || s3 END AS three FROM w WINDOW o AS (PARTITION BY rid ORDER BY k)),
u AS MATERIALIZED (SELECT *, {name('two')} AS n2, {name('three')} AS n3 FROM v),
j AS (SELECT *, CASE WHEN n2 IS DISTINCT FROM i AND n2 IS DISTINCT FROM i2 THEN n2 END AS j2 FROM u),
m AS (SELECT *, CASE WHEN n3 IS DISTINCT FROM i AND n3 IS DISTINCT FROM i2 AND n3 IS DISTINCT FROM i3 AND n3 IS DISTINCT FROM j2 AND n3 IS DISTINCT FROM lead(j2) OVER (PARTITION BY rid ORDER BY k) THEN n3 END AS j3 FROM j),
y AS (SELECT rid, k, coalesce(j2, j3, CASE WHEN lag(j2) OVER o IS NULL AND lag(j3) OVER o IS NULL AND lag(j3, 2) OVER o IS NULL THEN i END) AS id FROM m WINDOW o AS (PARTITION BY rid ORDER BY k)),
q AS (SELECT rid, string_agg(id, ';' ORDER BY k) AS ids FROM y WHERE id IS NOT NULL GROUP BY rid),
r(o, name, family, pattern, yields, own) AS (VALUES {rules}),
h AS (SELECT *, min(o) OVER (PARTITION BY rid, family) AS first, min(o) FILTER (family <> 'other') OVER (PARTITION BY rid) AS other FROM (SELECT rid, ids, r.* FROM q, r WHERE regexp_matches(';' || ids || ';', pattern))),
l AS (SELECT rid, string_agg(name, ',' ORDER BY o) AS licenses FROM h
  WHERE CASE WHEN family = 'other' THEN other IS NULL ELSE NOT yields OR first = o OR coalesce(regexp_matches(';' || ids || ';', own), false) END GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(string_split(ids, ';')), 0) AS BIGINT) AS n_license_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses FROM d LEFT JOIN q USING (rid) LEFT JOIN l USING (rid)
"""


OP8_SQL = _oracle()
