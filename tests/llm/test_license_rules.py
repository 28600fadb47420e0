"""Licences by SPDX expressions and denials; operator and SQL agree on every case."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import licenses

CASES = [
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.x"), ("// SPDX-License-Identifier: AGPL-3.0", "AGPL"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("SPDX-License-Identifier: CC-BY-4.0", "CC-BY"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) AND MIT */", "GPL-2.0,MIT"), ("SPDX-License-Identifier: Zlib", "Other"),
    ("SPDX-License-Identifier: MIT and some words", "MIT"), ("This is not under the MIT license", ""), ("It is not covered by the GPL.", ""), ("Not under the MIT license.\nReleased under the MIT License.", "MIT"), ("licensed under GPL-2.0. also GPL-3.0.", "GPL-3.0,GPL-2.0"),
    ("Released under GPL-3.0.", "GPL-3.0"), ("Distributed under the GNU GPL v2", "GPL-2.0"), ("CC BY-SA 4.0", "CC-BY-SA"), ("CC0", "CC0"), ("LGPL v3", "LGPL-3.0"), ("the 3-clause BSD", "BSD-3-Clause"), (" * under the GNU General Public\n * License, version 2", "GPL-2.0"),
    ("the GNU Lesser\nGeneral Public License, version 3", "LGPL-3.0"), ("GNU\nGeneral Public\nLicense", "GPL"), ("All rights\nreserved", "Proprietary"), ("CC-BY-NC one.\nCC-BY-SA other.", "CC-BY-NC,CC-BY-SA"), ("GNU GPL.\nGPL-3.0", "GPL-3.0"), ("2-clause BSD.\n3-clause BSD.", "BSD-3-Clause,BSD-2-Clause"),
    ("MIT License\nCopyright (c) 2020 A", "MIT"), ("key = 9acc0f71 and sampl 2", ""), ("for the general public\n\nlicense plates", ""), ("licensed under house rules", "Other"), (None, ""), ("", ""), ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.', ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice", "BSD-2-Clause"),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "doc_id long, text string")


def test_cases(cases):
    found = {r.doc_id: ",".join(r.licenses) for r in licenses.scan(cases).collect()}
    assert {CASES[k][0]: v for k, v in found.items()} == dict(CASES)


def test_sql_is_the_operator(cases):
    found = licenses.scan(cases).select("doc_id", "n_license_sentences", F.array_join("license_sentences", ";").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))
    documents = cases.toPandas()  # noqa: F841
    want = duckdb.sql(licenses.OP8_SQL).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_known_sentences_name_what_their_patterns_do(spark):
    said = [(ident, x) for ident, group in licenses.KNOWN.items() for x in group]
    rows = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(said)], "doc_id int, text string")
    got = {r.doc_id: r.license_sentences for r in licenses.scan(rows).collect()}
    assert all(got[k] == [ident] for k, (ident, x) in enumerate(said) if "." not in x.rstrip(".") or ident in ("apache-2", "cc-by-nc")), got
