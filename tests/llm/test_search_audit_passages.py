"""Lexical search, filter audit and substring dedup against brute force, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_llm import KIND, odd_rows

from quillspark.llm import hashing, interaction, passages, search

SPACED = r"[^\x20\x09-\x0D]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# 11 -----------------------------------------------------------------------------------


def ranked(docs, items, k, multiplicity=False):
    terms = lambda t: re.findall(search.TERM, (t or "").translate(UPPER))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, want in asked.items():
        found = []
        for doc_id, c in counts:
            m = 50 + (50 * c.total() * n_docs) // max(n_terms, 1)
            score = sum((n if multiplicity else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, n in want.items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the x1 don't Édith"), (2, "ÑANDÚ wide xa0space under the MIT License"), (3, None), (4, "..."), (5, "nothing-like-it-anywhere"), (None, "one two"), (1, "the other the"), (7, "a0 the7 of3 and49 x142")]


@pytest.mark.parametrize("k, multiplicity, block", [(50, False, 1_000_000), (3, False, 1_000_000), (2, True, 4)])
def test_search_is_brute_force(spark, odd, k, multiplicity, block):
    items = spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS], "item_id long, text string, term string, score int")
    got = search.rank(odd, items, k, multiplicity, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked([(r[0], r[1]) for r in odd_rows()], ITEMS, k, multiplicity)


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert search.rank(none, items).count() == 0 and search.rank(odd, items.limit(0)).count() == 0
    assert search.rank(odd, spark.createDataFrame([("a", "!")], "item_id string, text string")).count() == 0


def test_terms_are_compared_byte_by_byte():
    words = search.Vocabulary(["abc", "abd", "ñandú", "x"])
    words.hashes[:] = words.hashes[0]  # as if all had one hash
    words.tries = 4
    buf = np.frombuffer("abd x ñandú abcd".encode(), np.uint8)
    starts, ends = np.array([0, 4, 6, 14]), np.array([3, 5, 13, 18])
    assert words.find(buf, starts, ends, np.full(4, words.hashes[0])).tolist() == [1, 3, 2, -1]


# 12 -----------------------------------------------------------------------------------


def audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(SPACED, t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        fails.append((part or "", {f for f in failed if failed[f]}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        rows, shapley = [x for x in fails if x[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = lambda x: x[1] & set(order[: step - 1])  # noqa: E731, B023
                here = [x for x in rows if f in x[1] and not gone(x)]
                shapley[f] += len(here)
                out[part, order, step] = [sum(not x[1] & set(order[:step]) for x in rows), len(here), sum(f in x[1] and bool(gone(x)) for x in rows), sum(x[1] == {f} for x in rows), sum(x[2] for x in here), sum(x[3] for x in here)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_audit_is_brute_force(spark, odd, none):
    labels = [(5, 1, 0), (6, 0, 1), (6, 1, 0), (7, 1, 1), (8, None, 1), (None, 1, 1), (16, 1, 0), (999, 1, 1)]
    said = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    parts = ["", None, "s", "t"]
    rows = [(r[0], r[1], parts[k % 4], "clash", 1, 2) for k, r in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string, mask int, n int").repartition(5)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in interaction.COUNTS] for r in interaction.audit(docs, said).collect()}
    assert got == audited([r[:3] for r in rows], labels) and len(got) == 3 * 600
    assert interaction.audit(none, said).count() == 0


def test_texts_of_one_fingerprint_stay_apart():
    chains = interaction.Chains()
    steps = [(7, "a", 5), (7, "b", 1), (7, "a", 3), (7, "a", 4), (7, "b", 1), (7, "a", 3)]
    copies = [row for f, t, i in steps for row in chains.add(f, t, i, 1, {"p": 1})]
    assert copies == [(5, "p", 17, 1), (4, "p", 17, 1)]
    assert [e for _, e in chains.rest()] == [["a", 3, 1, {"p": 2}], ["b", 1, 1, {"p": 2}]] and not chains.held


# 13 -----------------------------------------------------------------------------------


def cut(docs):
    smallest, words = {}, [(i, re.findall(SPACED, t or "")) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - 49):
            if i is not None:
                g = tuple(w[k : k + 50])
                smallest[g] = min(i, smallest.get(g, i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - 49) if i is not None and smallest[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages_of_all_kinds():
    r = random.Random(11)
    prose = lambda n: [f"w{r.randint(0, 40)}" for _ in range(n)]
    shared, other, copy = prose(73), prose(50), prose(400)
    docs = [prose(30) + shared + prose(20), shared + prose(5) + other, prose(49), shared[:49] + prose(60), other, prose(7) + shared[3:55] + prose(9) + other + shared, ["la"] * 300, ["la"] * 51 + prose(3), ["la", "li"] * 80, ["x"] + ["la", "li"] * 60]
    for _ in range(12):  # near copies, each with a word changed
        near = list(copy)
        near[r.randrange(400)] = "changed"
        docs.append(near)
    docs += [copy, copy, copy[100:300], copy[:200] + prose(3) + copy[200:]]
    rows = [(i, r.choice([" ", "\n", "\t ", " \r\n"]).join(w)) for i, w in enumerate(docs)]
    r.shuffle(rows)
    return [*rows, (3, " ".join(shared)), (None, " ".join(copy)), (-1, " ".join(other)), (50, " ".join(prose(20_000))), (51, "x " * 40_000)]


def test_passages_are_brute_force(spark, odd, none):
    for rows, df in ((odd_rows(), odd), (passages_of_all_kinds(), spark.createDataFrame(passages_of_all_kinds(), "doc_id long, text string").repartition(4))):
        got = passages.report(df)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == cut([r[:2] for r in rows])
    assert passages.report(none).count() == 0


def test_passages_go_from_the_texts(spark, odd, none):
    out = passages.clean(odd)
    assert out.columns == odd.columns and out.schema == odd.schema and passages.clean(none).count() == 0
    by_id = defaultdict(list)
    for row in out.collect():
        by_id[row.doc_id].append(row)
    (first,), (second,) = by_id[5], by_id[6]
    assert first.text == odd_rows()[5][1] and second.text == "" and second.line == "clash" and second.n_words == 7
    assert by_id[0][0].text is None and by_id[3][0].text == "one" and by_id[1][0].text == ""


def test_each_window_is_in_one_run(monkeypatch):
    texts = [t.encode() for _, t in passages_of_all_kinds()]
    doc, h = passages.words_of(texts)
    whole = {k for k in range(len(h) - 49) if doc[k] == doc[k + 49]}
    for segment in (400_000, 997):
        monkeypatch.setattr(passages, "SEGMENT", segment)
        covered = [s + j for _, starts, n, *_ in passages.runs(doc, h) for s, m in zip(starts.tolist(), n.tolist(), strict=True) for j in range(m)]
        assert len(covered) == len(set(covered)) and set(covered) == whole
        assert all(n.max() < passages.CODE for _, _, n, *_ in passages.runs(doc, h))


def test_sketch_never_estimates_too_little(spark):
    docs = spark.createDataFrame([(i, t) for i, t in passages_of_all_kinds()], "doc_id long, text string")
    bits = passages.sketch_bits(docs)
    merged = passages.sketch(docs.repartition(5), bits)
    seen = defaultdict(set)
    for k, (_, t) in enumerate(passages_of_all_kinds()):
        for _, _, _, anchor, _, _ in passages.runs(*passages.words_of([t.encode()])):
            for a in anchor.tolist():
                seen[a].add(k)
    anchors = np.array(list(seen), np.uint64)
    twice = passages._twice(merged, passages._cells(anchors, bits))
    assert all(t for a, t in zip(anchors.tolist(), twice.tolist(), strict=True) if len(seen[a]) > 1)
    assert not all(twice)  # it does leave out


def test_words_are_those_of_split():
    texts = ["a bb\tccc\x0bñ\x1cx", "", " \n", "é" * 3_000_000 + " end", "x " * 5]
    found = [(int(d), bytes(buf[s:e])) for buf, doc, starts, ends, _ in hashing.word_chunks([t.encode() for t in texts], hashing.SPACE) for d, s, e in zip(doc, starts, ends, strict=True)]
    assert found == [(k, w) for k, t in enumerate(texts) for w in t.encode().split()]
