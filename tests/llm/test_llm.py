"""The ten operators: SQL where there is one, brute force elsewhere, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, common, components, decontaminate, licenses, lines, minhash, packing, quality, registry, suffixes, tokens, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, line string, n_words long, _t string"


def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows, equal texts, odd white space."""
    r = random.Random(5)
    words = ["the", "of", "and", "thonre", "Édith", "ñandú", "x1", "don't", "...", "a"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randint(0, 50)) for _ in range(n))
    long, shared = prose(6000), prose(120)
    texts = [None, "", " \n\t ", "one", "two words", long, long, shared, shared, shared + " tail", "x " + shared, "a\n\nb\r\n c ", "<|endoftext|> in text", "same line here now 1\nother", "same line here now 2\nmore", "same line here now 3",
             "é" * 500, "Licensed under the MIT License.", prose(60), prose(300), prose(9), "　wide\xa0space", "😀 " * 20]
    rows = [(i, t, "en", "s", None, 1.5, "clash", 7, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id at all here", None, None, None, None, None, None, None), (-3, shared, "en", "s", 1, 0.0, "", 0, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.SQL[name])


def words_of(pattern, text):
    return re.findall(pattern, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


# 1 ------------------------------------------------------------------------------------


def test_lines_templates(spark, odd, none):
    out = {r.doc_id: r for r in lines.drop_recurring(odd, report=True).collect() if r.doc_id is not None}
    assert out[13].text == "same line here now 1\nother" and out[14].text == "more" and out[15].text == ""  # one template, its first line stays
    assert out[0].text is None and out[1].text == "" and out[13].line == "clash" and out[4].text == "two words"
    assert lines.drop_recurring(odd).count() == odd.count() and lines.drop_recurring(none).count() == 0
    assert lines.drop_recurring(odd).columns == odd.columns


def test_lines_keep_chance_neighbours(spark):
    rows = [(i, f"of the and {a} {b} {c} {d} {e}") for i, (a, b, c, d, e) in enumerate([("k", "l", "m", "n", "o"), ("p", "q", "r", "s", "t"), ("u", "v", "w", "x", "y")])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.text for r in lines.drop_recurring(df).collect()} == {t for _, t in rows}


def test_long_lines_recur_in_two_documents(spark):
    import corpus_pipeline

    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    near = passage.replace("wordka", "other").replace("wordma", "another")  # joins the passage's template in a third document
    once = " ".join(f"alone{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, f"{passage}\nfirst"), (2, f"second\n{passage}\n{passage}"), (3, f"short line in two\n{once}\n{once}"), (4, "short line in two\nrest")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_recurring_lines(spark, df, "").collect()}
    assert {i: r.text for i, r in got.items()} == dict(rows) | {2: "second"} and got[2].n_chars == 6
    more = df.unionByName(df.filter("doc_id = 1").withColumn("doc_id", F.lit(5).cast("long")).withColumn("text", F.lit(near)))
    assert {r.doc_id: r.text for r in lines.drop_recurring(more).collect()} == dict(rows) | {2: "second", 5: ""}


# 2 ------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def direct(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def test_token_counts(odd, none):
    for name, leads in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        got = tokens.add_counts(odd, name, leads, budget=50, prefixes=True).collect()
        assert len(got) == odd.count()
        for r in got:
            assert r.n_tokens == len(direct(name, r.text)) == r.prefix_tokens[-1]
            assert len(direct(name, (r.text or "")[: r.fit_chars])) <= 50
    assert tokens.add_counts(none, "word_bpe_49k.json").count() == 0


@pytest.mark.parametrize(("name", "leads"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_and_prefixes(name, leads):
    enc, r = tokens.PieceEncoder(tokens.vocabulary_path(name), leads), random.Random(3)
    parts = ["a", "The", "é", "ß", "Ñandú", "'s", "don't", ".", ",", "...", "!?", " ", "  ", "\n", "\n\n", "\t", "\xa0", "<|endoftext|>", "<|startoftext|>", "́", "数", "1", "23", "²", "_", "\x1c", " ", "x" * 30, "😀", "İ", "​", "\x00"]
    for _ in range(400):
        text = "".join(r.choice(parts) + (" " if r.random() < 0.3 else "") for _ in range(r.randint(0, 12)))
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == direct(name, text)
        counts = tokens.PrefixCounts(text, enc)
        for n in range(0, len(text) + 1, 3):
            assert counts.at(n) == len(direct(name, text[:n])), (text, n)


@pytest.mark.parametrize(("name", "leads"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_budgets_reach_the_last_whole_word(spark, name, leads):
    texts = ["First part, of words.\n\nSecond  part:\tx = 1\r\n   y\xa0= 'unbelievable'\u3000end \n", "\n\nlead", "tail  ", "one two three four five", " \t ", "a\n\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for budget in (1, 3, 8, 15):
        got = {r.doc_id: r for r in tokens.add_counts(df, name, leads, budget=budget, prefixes=True).collect()}
        for k, text in enumerate(texts):
            steps = [0, *(n for n in range(1, len(text)) if not text[n - 1].isspace() and text[n].isspace()), len(text)]
            assert got[k].fit_chars in (want := max(n for n in steps if len(direct(name, text[:n])) <= budget), want + 1), (text, budget)
            assert all(len(direct(name, text[:n])) == c for n, c in zip(got[k].prefix_chars, got[k].prefix_tokens, strict=True))


# 3 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_set", [decontaminate.MAX_SET, 0])
def test_decontaminate(spark, odd, none, max_set):
    shared = odd_rows()[7][1]
    items = spark.createDataFrame([(1, " ".join(shared.split()[5:30])), (2, "TWO Words"), (10, "two"), (3, None), (4, "never in any text of these rows at all, is it so?")], "item_id long, text string")
    got = decontaminate.report(odd, items, max_set=max_set).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(by[7]) == 2 and by[4][0].n_hit == 2 and by[4][0].items_sha256 == hashlib.sha256(b"10,2").hexdigest() and by[0][0].n_words == 0
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = defaultdict(set)
    for i, t in [(r.item_id, words_of(pattern, r.text)) for r in items.collect()]:
        n = min(len(t), 10)
        for k in range(len(t) - n + 1 if n else 0):
            grams[tuple(t[k : k + n])].add(str(i))
    for doc_id, text, *_ in odd_rows():
        w = words_of(pattern, text)
        hit, found = set(), set()
        for g, own in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= own
        for r in by[doc_id]:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    kept = decontaminate.clean(odd, items, max_set=max_set)
    assert kept.columns == odd.columns and kept.count() == sum(not r.contaminated for r in got)
    cut = {r.doc_id: r.text for r in decontaminate.clean(odd, items, max_set=max_set, remove="spans").collect()}
    assert cut[4] == "" and cut[3] == "one" and cut[0] is None and len(cut[7]) < len(shared)
    assert decontaminate.report(none, items).count() == 0 and decontaminate.report(odd, items.limit(0)).filter("contaminated").count() == 0


# 4 ------------------------------------------------------------------------------------


def test_quality_measures(odd, none):
    got = quality.apply_rules(quality.measure(odd))
    assert {"lang", "score", "line"} <= set(got.columns) and got.count() == odd.count() and quality.apply_rules(quality.measure(none)).count() == 0
    for r in got.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        seen = defaultdict(list)
        for k in range(len(w) - 2):
            seen[tuple(w[k : k + 3])].append(k)
        covered = {p + d for places in seen.values() if len(places) > 1 for p in places for d in range(3)}
        full = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(full) - len(set(full)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)


# 5 ------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    where = defaultdict(list)
    for k, data in enumerate(rows):
        for s in range(len(data) - length + 1):
            where[data[s : s + length]].append((k, s))
    gone = [np.zeros(len(d), bool) for d in rows]
    for places in where.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + length] = True
    return gone


def test_suffixes(spark, odd, none):
    r = random.Random(11)
    base = "".join(r.choice("abcdefgh ") for _ in range(900))
    more = [base, base[:500] + "X" + base[501:], "q" * 450 + base[100:520], base[300:699], base[300:700], "ab" * 700, "z" * 401, "z" * 399, base[:100] + base[200:640] + base[200:640]]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = df.collect()
    gone = brute_repeats([(x.text or "").encode() for x in rows], 400)
    want = sorted((str(x.doc_id), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer((x.text or "").encode(), np.uint8)[~g].tobytes()).hexdigest()) for x, g in zip(rows, gone, strict=True))
    got = suffixes.digest(suffixes.mark_repeats(df)).collect()
    assert sorted((str(x.doc_id), x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    assert suffixes.digest(suffixes.mark_repeats(none)).count() == 0 and suffixes.remove_repeats(odd).columns == odd.columns


def test_suffixes_of_long_periodic_texts(spark):
    """Megabytes of one byte or pattern are a few ranges; a passage in every document leaves all of them."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(450))
    prose = lambda n: "".join(r.choice("ijklmnop ") for _ in range(n))
    texts = ["a" * 20_000_000, "a" * 401, "b" + "a" * 400 + "c", "a" * 399 + "d", ("xyz " * 2_000_000) + prose(100), "xyz " * 100 + "w", prose(1_200_000) + passage, *(prose(300) + passage + prose(200) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in suffixes.digest(suffixes.mark_repeats(df)).collect()}
    assert (got[0].n_removed, got[1].n_removed, got[2].n_removed, got[3].n_removed) == (20_000_000, 401, 400, 0)
    assert got[4].n_removed == 8_000_000 and got[5].n_removed == 400
    assert all(450 <= got[k].n_removed < 480 and got[k].n_spans == 1 for k in range(6, 307))  # chance neighbours go too


def test_runs_of_equal_suffixes_are_exact():
    """Periods of all kinds within brute force, at their edges too."""
    r = random.Random(8)
    for _ in range(12):
        rows = []
        for _ in range(4):
            unit = "".join(r.choice("abcd") for _ in range(r.choice((1, 2, 3, 40, 90, 200))))
            rows.append(("".join(r.choice("efgh") for _ in range(r.randint(0, 30))) + unit * r.randint(1, 900 // len(unit)) + unit[: r.randint(0, len(unit))] + "".join(r.choice("efgh") for _ in range(r.randint(0, 30)))).encode())
        for data in rows:
            buf = np.frombuffer(data, np.uint8)
            place, least, greatest = suffixes.choose(buf)
            begin, until = suffixes.runs_of_equal(buf, place, least, greatest, 400)
            for a, b in zip(begin.tolist(), until.tolist(), strict=True):
                said = {data[p - int(greatest[a]) : p + 400 - int(least[a])] for p in place[a:b].tolist()}
                assert len(said) == 1 and all(q - p <= 256 for p, q in zip(place[a : b - 1].tolist(), place[a + 1 : b].tolist(), strict=True))


def test_loser_tree_merges_with_true_prefixes():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(300)]
    runs = [sorted(strings[k::7]) for k in range(7)]
    coded = [[(k, s) for k, s, _, _ in suffixes.front_decode(suffixes.front_code([(s, b"", i) for i, s in enumerate(run)]))] for run in runs]
    out = list(suffixes.LoserTree([iter(x) for x in coded]))
    assert [s for _, s in out] == sorted(strings)
    assert all(k == suffixes.common_prefix(a, b) for (_, a), (k, b) in zip(out, out[1:], strict=False))


# 6 ------------------------------------------------------------------------------------


def test_packing(odd, none):
    got = packing.pack(odd, "byte_bpe_50k.json", capacity=64).collect()
    texts = {x[0]: x[1] for x in odd_rows()}
    seqs, docs = defaultdict(list), defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
        docs[x.doc_id].append(x)
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for i, own in docs.items():
        ids = np.asarray([*direct("byte_bpe_50k.json", texts[i]), 2], "<u4")
        for x in own:
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
        assert sum(x.length for x in own) == len(ids) * (2 if i == 7 else 1)
        assert len(own) == -(-len(ids) // 64) * (2 if i == 7 else 1)
    assert packing.pack(none, "byte_bpe_50k.json").count() == 0


def test_best_fit_is_that_of_one_piece_at_a_time():
    r = random.Random(4)
    for _ in range(60):
        capacity, sizes = 32, [r.randint(1, 32) for _ in range(r.randint(0, 80))]
        bins: list[int] = []
        for n in sorted(sizes, reverse=True):
            fit = [k for k, left in enumerate(bins) if left >= n]
            if fit:
                k = min(fit, key=lambda k: bins[k])
                bins[k] -= n
            else:
                bins.append(capacity - n)
        counts = {n: sizes.count(n) for n in set(sizes)}
        classes = packing.best_fit_decreasing(counts, capacity)
        assert sorted(capacity - sum(n * c for n, c in content.items()) for bins_of, content in classes for _ in range(bins_of)) == sorted(bins)
        rows = packing.plan_rows(classes)
        assert {n: sum(b - a for m, a, b, *_ in rows if m == n) for n in counts} == counts


# 7 ------------------------------------------------------------------------------------


def test_chat(spark):
    odd = "a\\b<|user|>\n<|end|>\n</turn>\\"
    rows = [(1, 1, "assistant", odd), (1, 0, "us|er\n<", odd), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, 0, None, "x"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    said = [("user", "first"), ("us|er\n<", odd), ("assistant", odd)]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, len(odd), hashlib.sha256(odd.encode()).hexdigest()) and got[2].n_turns == 2 and got[None].n_turns == 1
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


def test_chat_events(spark):
    log = [(1, 0, "message", "user", "hi", None), (1, 1, "delta", "assistant", "he", None), (1, 2, "delta", "assistant", "llo", None), (1, 3, "message", "user", "agan", None), (1, 4, "edit", "user", "again", 2),
           (1, 5, "delta", "assistant", "bad", None), (1, 6, "regenerate", None, None, None), (1, 7, "delta", "assistant", "good", None), (2, 0, "delta", "assistant", "x", None)]
    random.Random(1).shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, target long")
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.reconstruct(df).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "again"), (1, 3, "assistant", "good"), (2, 0, "assistant", "x")]


def test_chat_query_by_hand(spark):
    """The query goes through the fold and holds its own conversation; every column by hand."""
    from conftest import DATA

    probe = r"\### Assistant: </turn> ok"
    said = defaultdict(list)
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    for r in [*rows, *((-7, k, role, probe) for k, role in enumerate(("user", "assistant")))]:
        said[r[0]].append((r[1], r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat.op7_chat_format(spark, DATA).collect()}
    assert set(got) == set(said) and got[-7].n_turns == 2 and got[-7].loss_chars == len(probe)
    for conv, turns in said.items():
        turns = [t[1:] for t in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(chat.render(role, t)[0] for role, t in turns)
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == want
        assert chat.parse(whole) == turns


def test_chat_turns_leave_when_settled(spark):
    """A long log without edits isn't held; one whose edit comes late is right all the same."""
    fold = chat.Fold()
    for k in range(1000):
        fold.apply("message", "user", str(k))
        fold.settle()
    assert len(fold.turns) == 1 and fold.settled == 999
    log = [(1, k, "message", "user", f"t{k}", None) for k in range(50)] + [(1, 50, "edit", "user", "new", 3), (1, 51, "delta", "assistant", "a", None), (1, None, "edit", "user", "lost", 7), (2, 0, "message", "user", "x", None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, target long")
    got = {(r.conv_id, r.turn): r.text for r in chat.reconstruct(df).collect()}
    assert got == {(1, k): ("new" if k == 3 else f"t{k}") for k in range(50)} | {(1, 50): "a", (2, 0): "x"}


# 8 ------------------------------------------------------------------------------------


def test_licenses(spark, odd, none):
    bsd = "Redistribution and use in source and binary forms are permitted.\nRedistributions of source code must retain this.\nRedistributions in binary form must reproduce this.\nNeither the name of X may be used."
    rows = [(1, "// SPDX-License-Identifier: Apache-2.0"), (2, "Licensed under the Apache License, Version 2.0."), (3, bsd), (4, "Licensed under CC BY-NC 4.0."), (5, "no such thing"), (6, None), (7, "GNU General Public License, version 3."), (8, "licensed under house rules")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["Apache-2.0"], 3: ["BSD-3-Clause"], 4: ["CC-BY-NC"], 5: [], 6: [], 7: ["GPL-3.0"], 8: ["Other"]}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_licenses_by_name_across_lines_and_several(spark):
    cases = [("Released under GPL-3.0.", ["GPL-3.0"]), ("Distributed under the GNU GPL v2", ["GPL-2.0"]), ("CC BY-SA 4.0", ["CC-BY-SA"]), ("CC0", ["CC0"]), ("MPL-2.0", ["MPL-2.0"]), ("LGPL v3", ["LGPL-3.0"]), ("the 3-clause BSD", ["BSD-3-Clause"]),
             (" * under the GNU General Public\n * License, version 2", ["GPL-2.0"]), ("the GNU Lesser\nGeneral Public License, version 3", ["LGPL-3.0"]), ("GNU\nGeneral Public\nLicense", ["GPL"]), ("All rights\nreserved", ["Proprietary"]),
             ("GPL-2.0 here.\nGPL-3.0 there.", ["GPL-3.0", "GPL-2.0"]), ("CC-BY-NC one.\nCC-BY-SA other.", ["CC-BY-NC", "CC-BY-SA"]), ("GNU GPL.\nGPL-3.0", ["GPL-3.0"]), ("2-clause BSD.\n3-clause BSD.", ["BSD-3-Clause", "BSD-2-Clause"]),
             ("MIT License\nCopyright (c) 2020 A", ["MIT"]), ("key = 9acc0f71 and sampl 2", []), ("for the general public\n\nlicense plates", [])]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {cases[r.doc_id][0]: r.licenses for r in licenses.scan(df).collect()} == dict(cases)
    warranty = licenses.scan(spark.createDataFrame([(1, "It is provided as is")], df.schema)).first()
    assert warranty.license_sentences == ["no-warranty"]


# 9 ------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    from itertools import product

    r = np.random.default_rng(3)
    e, trans = r.normal(size=(1, 6)), r.normal(size=(2, 2))
    weight = np.zeros((6, 2))
    for y in product((0, 1), repeat=6):
        w = np.exp(sum(e[0, t] * y[t] for t in range(6)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        for t in range(6):
            weight[t, y[t]] += w
    f, b = toxicity.forward_backward(e, trans, np.ones((1, 6), bool))
    assert np.allclose(f + b, np.log(weight[:, 1] / weight[:, 0]))


def test_toxicity(spark, odd, none):
    r = random.Random(9)
    clean = [f"w{i}" for i in range(200)]
    make = lambda bad: " ".join(r.choice(clean) if r.random() > 0.1 or not bad else f"grrb{r.choice('xyz')}{r.randint(0, 9)}" for _ in range(60))
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = toxicity.fit(df.select("doc_id", "text"), labels)
    got = toxicity.add_scores(df.withColumn("score", F.lit("clash")), model, spans=True).withColumn("held", toxicity.held_out()).collect()
    held = [x for x in got if x.held]
    assert len(held) > 50 and np.mean([(x.score >= 0.5) == x.toxic for x in held]) > 0.97
    bad = next(x for x in got if x.toxic and x.toxic_spans)
    assert all(bad.text[s.start : s.end].startswith("grrb") for s in bad.toxic_spans)
    scored = toxicity.add_scores(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= x.score <= 1 for x in scored) and toxicity.add_scores(none, model).count() == 0
    assert toxicity.fit(df.select("doc_id", "text"), labels.limit(0)).base == 0.0
    assert toxicity.add_scores(odd, toxicity.fit(df.select("doc_id", "text"), labels.filter("toxic = 0"))).agg(F.max("score")).first()[0] == 0


def test_toxicity_sample_survives_long_texts_and_copies(spark):
    r = random.Random(9)
    clean = [f"w{i}" for i in range(200)]
    make = lambda bad, n: " ".join(r.choice(clean) if r.random() > 0.1 or not bad else f"grrb{r.choice('xyz')}{r.randint(0, 9)}" for _ in range(n))
    rows = [(i, make(i % 4 == 0, 60), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    first = [df.filter(~toxicity.held_out()).filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id")).first().doc_id for k in (0, 1)]
    labels, copied = df.select("doc_id", "toxic"), df.filter(F.col("doc_id") == first[1]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k")
    long = {i: make(i == first[1], 60_000) for i in first}  # each longer than all characters of its class
    for docs in (spark.createDataFrame([(i, long.get(i, t), y) for i, t, y in rows], df.schema), df.unionByName(copied)):
        model = toxicity.fit(docs.select("doc_id", "text"), labels, max_chars=60_000)
        held = [x for x in toxicity.add_scores(df, model).withColumn("held", toxicity.held_out()).collect() if x.held]
        assert model.weights is not None and np.mean([(x.score >= 0.5) == x.toxic for x in held]) > 0.97


# 10 -----------------------------------------------------------------------------------


def test_near_duplicates(spark, odd, none):
    r = random.Random(21)
    vocabulary = [f"v{i}" for i in range(900)]
    extra, k = [], 200
    for _ in range(25):  # copies at various distances, and copies of those
        base = [r.choice(vocabulary) for _ in range(r.choice((6, 30, 150)))]
        for _ in range(r.randint(1, 6)):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 25))):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            extra.append((k, " ".join(x)))
            base, k = (x if r.random() < 0.5 else base), k + 1
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(x.doc_id, x.text) for x in df.collect()]
    sets = {}
    for i, t in rows:
        w = words_of(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    groups = components.UnionFind()
    ids = sorted(i for i, s in sets.items() if s and i is not None)
    for a_at, a in enumerate(ids):
        for b in ids[a_at + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                groups.union(a, b)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.n_shingles == len(sets[x.doc_id])
        assert x.component_id == (None if x.doc_id is None else groups.find(x.doc_id)) and x.kept == (x.doc_id == x.component_id or x.doc_id is None)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and {0, 1, 2, -3} <= {x.doc_id for x in kept.collect()}


def test_links_that_no_pivot_shows():
    """Both sides of a block find the links between components, and only as many as join them."""
    doc, h = minhash.shingle_sets([b" ".join(f"x{i}".encode() for i in range(n, n + 100)) for n in (0, 3, 6, 9, 500)])
    sets, sig = [h[doc == k] for k in range(5)], minhash.superminhash(doc, h, 5)
    one = minhash._links_across(sig, sets, [0, 1, 2, 3, 4], [0, 1, 2, 3, 4], np.zeros(5, int))
    groups = components.UnionFind()
    assert all(groups.union(a, b) for a, b in one) and len({groups.find(k) for k in range(4)}) == 1 and groups.find(4) == 4
    two = minhash._links_across(sig, sets, [0, 1, 2, 3, 4], [0, 0, 2, 2, 4], np.array([0, 0, 1, 1, 1]))
    assert len(two) == 1


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(500 + k, 501 + k) for k in range(60)] + [(1000, 1000 + k) for k in range(80)]
    want = components.UnionFind()
    for a, b in edges:
        want.union(a, b)
    for last in (components.LAST_LINKS, 0):  # in one task, and by star rounds to the end
        got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "src long, dst long").repartition(5), last_links=last).collect()}
        assert got == {n: want.find(n) for e in edges for n in e if e[0] != e[1]} | {n: want.find(n) for n in got}


# all ----------------------------------------------------------------------------------


def test_no_name_of_an_operators_own_clashes(spark, tmp_path):
    """Every operator carries columns named like its inner ones through."""
    names = "row _t _h _l _left _all _later _id _key _m _t2 _own _w _g _p _lines _f _gone one other _one _other spans _spans _c _s _n _i _j2 _j3 gone _d place line own prefix_chars places".split()
    texts = ["same line here now 1\nother", "same line here now 2", "same line here now 3", None, "two words and more", "a" * 900]
    df = spark.createDataFrame([(k, t, *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    model = toxicity.Model(None, None, None, 0.0)
    results = {
        "lines": lines.drop_recurring(df, report=True), "quality": quality.apply_rules(quality.measure(df)), "documents": decontaminate.clean(df, items), "spans": decontaminate.clean(df, items, remove="spans"),
        "suffixes": suffixes.remove_repeats(df), "tokens": tokens.add_counts(df, "word_bpe_49k.json"), "licenses": licenses.scan(df), "toxicity": toxicity.add_scores(df, model), "minhash": minhash.keep_one(df),
    }
    for name, out in results.items():
        rows = out.collect()
        assert len(rows) == len(texts) - (name == "documents"), name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name


def test_checkpoint_folder_of_the_cluster_stays(spark):
    before = spark.sparkContext.getCheckpointDir()
    common.with_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import DATA

    docs, counts = spark.read.parquet(f"{DATA}/documents.parquet"), []
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        counts.append(docs.count())
        assert docs.columns == columns and counts[-1] <= before.count()
        if name == "line_dedup":
            assert counts[-1] == before.count()
    out = corpus_pipeline.run(spark, DATA)
    assert out.select("doc_id").distinct().count() == counts[-1]
