"""Near-duplicates by order against a plain fold over the rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from quillspark.operators import neardup


def plain_signature(text):
    values = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in neardup.shingles(text)]
    return tuple(min(((2 * s + 1) * v + (s + 1) * neardup.STEP) % neardup.PRIME for v in values) for s in range(neardup.SLOTS))


def test_signature_is_that_of_whole_numbers():
    r = random.Random(3)
    values = [r.randrange(2**64) for _ in range(400)] + [2**64 - 1, 2**64 - 60, 0, 1, 2**32]
    for v in values:
        assert neardup.signature(np.array([v], np.uint64)).tolist() == [((2 * s + 1) * v + (s + 1) * neardup.STEP) % neardup.PRIME for s in range(16)]
    assert len(neardup.shingles(" ".join(f"w{k}" for k in range(9000)))) == neardup.MOST_SHINGLES and neardup.shingles("") == {""}


def test_rows_go_as_in_a_fold(spark):
    r = random.Random(6)
    base = [[f"w{r.randint(0, 500)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for k in range(160):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            words[r.randrange(120)] = f"x{r.randint(0, 9)}"
        rows.append((k, r.choice(["a", "a", "b", None]), " ".join(words[: r.choice([120, 120, 110])])))
    rows += [(200, "a", None), (201, "a", ""), (202, "b", "some"), (203, "b", "some"), (204, "a", "only one")]
    texts = defaultdict(list)
    for seq, label, text in rows:
        texts[text or ""].append((seq, label))
    want, kept, buckets = {}, {}, defaultdict(list)
    for seq, label, text in rows:
        same = texts[text or ""]
        if len({x for _, x in same}) > 1:
            want[seq] = "conflict"
        elif same[0][0] != seq:
            want[seq] = "copy"
        else:
            sig = plain_signature(text or "")
            near = {o for b in range(4) for o in buckets[label, b, sig[b * 4 : b * 4 + 4]] if sum(x == y for x, y in zip(sig, kept[o], strict=True)) >= 0.9 * 16}
            want[seq] = "near" if near else "kept"
            if not near:
                kept[seq] = sig
                for b in range(4):
                    buckets[label, b, sig[b * 4 : b * 4 + 4]].append(seq)
    df = spark.createDataFrame(rows, "seq long, label string, text string").repartition(3)
    got = {x.seq: x.reason for x in neardup.near_dedup(df, "seq", "label", "text").collect()}
    assert got == want and {"kept", "copy", "conflict", "near"} == set(got.values())
    assert neardup.near_dedup(df.limit(0), "seq", "label", "text").count() == 0


def test_rows_that_share_bands_and_differ_take_few_rounds(spark, monkeypatch):
    """Three hundred rows in one bucket of a band, none of which resembles another, after one another; and copies of a signature."""
    rows = [(k, "a", [1, 2, 3, 4] + [k * 20 + j for j in range(12)]) for k in range(300)] + [(300 + k, "a", [1, 2, 3, 4] + [k * 20 + j for j in range(11)] + [-1]) for k in range(4)] + [(400, "b", [1, 2, 3, 4] + list(range(12))), (401, "b", [1, 2, 3, 4] + list(range(12)))]
    rounds = []
    kind = type(spark.range(1))
    whole = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda df: rounds.append(1) or whole(df))
    got = {r.seq for r in neardup.resembling(spark.createDataFrame(rows, "seq long, label string, sig array<long>")).collect()}
    assert got == {300, 301, 302, 303, 401} and len(rounds) <= 3


def test_every_run_of_a_long_text_counts(spark):
    """Texts of 9,000 and of 900 tokens that differ where no run was looked at before, held against all runs at once."""
    long = [f"w{k}" for k in range(9000)]
    other = [f"v{k}" if 1700 < k < 3900 else w for k, w in enumerate(long)]  # between an end and the middle
    small = [f"w{k}" for k in range(900)]
    rows = [(0, "a", " ".join(long)), (1, "a", " ".join(other)), (2, "b", " ".join(small)), (3, "b", " ".join(reversed(small))), (4, "a", " ".join([*long, "tail"])), (5, "c", ""), (6, "c", "one two")]
    want = {}
    for seq, _, text in rows:
        tokens = text.split()
        runs = {"\x1f".join(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))}
        values = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in runs]
        want[seq] = [min(((2 * s + 1) * v + (s + 1) * neardup.STEP) % neardup.PRIME for v in values) for s in range(neardup.SLOTS)]
    df = spark.createDataFrame(rows, "seq long, label string, text string")
    got = {r.seq: [x % 2**64 for x in r.sig] for r in neardup.signatures(df, "seq", "label", "text").collect()}
    assert got == want
    assert {r.seq: r.reason for r in neardup.near_dedup(df, "seq", "label", "text").collect()} == {k: "near" if k == 4 and sum(x == y for x, y in zip(want[0], want[4], strict=True)) >= 15 else "kept" for k in want}
