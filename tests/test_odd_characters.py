"""Bare literals that decode to characters which only some engines take for printable, and shares that end in a half."""

import base64

import pytest

from quillspark import catalogue
from quillspark.operators import selection


@pytest.mark.parametrize("name", ["bare_literals", "decoded_texts", "decoded_findings"])
def test_unassigned_and_format_characters(name, spark, same_as_sql, tmp_path):
    said = ["eval(׬rzz_)", "sys­tem(y)", "zzz\u3000z\u07b5abc", "popen(\u200bab)", "eval(\x01\x9fab\xa0cd)"]
    rows = [(k, f"key {base64.b64encode((x + ' ' * (-len(x.encode()) % 3)).encode()).decode()} end") for k, x in enumerate(said)]
    spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    same_as_sql(catalogue.QUERIES[name], catalogue.SQL[name], str(tmp_path))


def test_a_half_rounds_up_whatever_the_order(spark):
    """Doubles fall below the half here in each order of the kinds."""
    cases = [([20, 13, 0, 9], [20, 16, 8, 20], 50.3), ([2, 13, 16, 0], [4, 16, 16, 5], 63.8), ([2, 0, 3, 2], [20, 20, 4, 4], 38.8), ([0, 0, 7, 9], [5, 4, 20, 20], 21.3)]
    claims = [(k, kind, f"{kind}{i}") for k, (_, n, _) in enumerate(cases) for kind, size in zip(selection.CLAIM_WEIGHTS, n, strict=True) for i in range(size)]
    seen = [(k, f"{kind}{i}") for k, (m, _, _) in enumerate(cases) for kind, size in zip(selection.CLAIM_WEIGHTS, m, strict=True) for i in range(size)]
    got = selection.similarity(spark.createDataFrame(claims, "k long, kind string, symbol string"), spark.createDataFrame(seen, "k long, symbol string"), "k")
    assert {r.k: (r.n_matched, r.similarity) for r in got.collect()} == {k: (sum(m), want) for k, (m, _, want) in enumerate(cases)}


def _written(rows, spark, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


def test_bare_literals_of_odd_texts(spark, same_as_sql, tmp_path):
    """More than 80 in a text, in front of more characters, inside longer ones, Unicode blanks at either end, repeated ids."""
    coded = lambda x: base64.b64encode((x + " " * (-len(x.encode()) % 3)).encode()).decode()
    one, hexed = coded("abc def ghi jkl."), b"some words".hex()
    many = "\n".join(coded(f"number {k:05d}") for k in range(200))
    ends = [coded(f"{chr(c)}abc zz{chr(c)}") for c in (0x2003, 0x3000, 0x1680, 0x202F, 0x205F, 0x2028, 0x2029, 0x85, 9, 13, 32)] + [coded(f"{chr(0x3000) * 2}abcd{chr(0x3000) * 3}"), coded(f"abc{chr(0x3000) * 4}")]
    texts = [many, f"averylongparameter={one}", f"ABCDEFGHIJKLMNOP=x QUJDREVGR0hJSktMTU==y {one}=z {one}==z", f"zz{one}zz\nx {one}\n{one} {one}", f"00{hexed}00\n\n{hexed}\n{hexed}{one}", "\n".join(ends), None, "", f"{one}\r\n{hexed}\r", f"{hexed}/x\n{hexed.upper()} {hexed}="]
    rows = [*enumerate(texts), (3, f"\n\n\n{one}"), (len(texts) - 2, one)]
    same_as_sql(catalogue.QUERIES["bare_literals"], catalogue.SQL["bare_literals"], _written(rows, spark, tmp_path))


def test_decoded_literals_of_short_and_null_texts(spark, same_as_sql, tmp_path):
    rows = enumerate([None, "", "a", "é", "ab", "  ", "  a  ", "éé" * 30, "\U0001f1e6\U0001f1ea" * 30, "tab\tx\r\ny\0", "kqskqskqskqskqskqskqskqs" * 2, "a" * 50, "sos" * 20])
    same_as_sql(catalogue.QUERIES["decoded_literals"], catalogue.SQL["decoded_literals"], _written(list(rows), spark, tmp_path))
