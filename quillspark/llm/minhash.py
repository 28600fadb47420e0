"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find.

1. A document's set is its distinct shingles of five words (all words as one shingle if there
   are fewer). One Arrow pass computes its size, a 128-bit hash of the set and a SuperMinHash
   signature of 128 slots: each element deals correlated ranks over all slots by an
   incremental shuffle, level by level, and a document stops at the level that leaves no slot
   empty. All documents of a batch go through a level together.
2. Documents with one set are one class; from here on a class is its smallest document.
3. 32 bands of four slots. A pair at similarity 0.75 shares none with probability 5e-6. In
   each bucket the most central member (that with the fullest buckets) is the pivot, and all
   others are compared with it: no bucket is expanded into its pairs.
4. Links are confirmed on the full sets, recomputed from the texts of the classes in question.
   A set goes once to each pivot it is compared with, a pivot's own set once to each block of
   BLOCK_BYTES of those; first with the pivot that shares most buckets, then, where components
   still differ, with the others. Union-find and star contraction give components.
5. Buckets that still span several components hold links that no pivot has shown, if any.
   Their members are compared across components only, in blocks of bounded bytes: signatures
   leave what may reach the threshold (six standard deviations), the full sets decide, and
   components that have met are not compared again. The largest component of what is compared
   is only dealt against the others, never against itself.

Defined results: null texts, texts without words: empty set, size 0, linked with nothing;
null ids: likewise linked with nothing and kept; rows with one id are one document and share
its component; exact copies are one class; an empty table gives an empty table; further
columns are carried through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, saved, table, unused
from .components import UnionFind, components

SLOTS, BAND = 128, 4
WORDS = 5
PERCENT = 75
#: Signatures agree in at least this share where the similarity is PERCENT, but for chances of 1 in 100 million.
MAY_REACH = 0.52
#: Ids (with where their sets go) are broadcast up to this number, else joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Bytes of sets and signatures on each side of a block that one task compares.
BLOCK_BYTES = 12_000_000
CHUNK = 2_000_000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 4096), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer that ends with white space; A-Z count as lower case."""
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * _power(_BASE, len(buf)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(buf))[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all distinct shingles, sorted by document and hash."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = b"\n".join(texts) + b"\n"
    ends = np.cumsum([len(t) + 1 for t in texts])
    buf = np.frombuffer(joined, np.uint8)
    starts_all, hashes, at = [], [], 0
    while at < len(buf):  # cut at white space, so that long texts need no more memory than short ones
        end = min(at + CHUNK, len(buf))
        while end < len(buf) and not _SPACE[buf[end - 1]]:
            more = np.flatnonzero(_SPACE[buf[end : end + 65536]])
            end = end + int(more[0]) + 1 if len(more) else min(end + 65536, len(buf))
        s, h = _word_hashes(buf[at:end])
        starts_all.append(s + at)
        hashes.append(h)
        at = end
    starts, words = np.concatenate(starts_all), np.concatenate(hashes)
    doc = np.searchsorted(ends, starts, side="right")
    per_doc = np.bincount(doc, minlength=len(texts))
    parts_doc, parts_hash = [], []
    for n in range(1, WORDS + 1):
        if len(words) < n:
            continue
        here = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        here = here[per_doc[doc[here]] == n] if n < WORDS else here
        h = np.full(len(here), n, np.uint64)
        for k in range(n):
            h = h * _U(0xD6E8FEB86659FD93) + words[here + k]
            h ^= h >> _U(29)
        parts_doc.append(doc[here])
        parts_hash.append(mix(h))
    doc, h = np.concatenate(parts_doc or [np.zeros(0, np.int64)]), np.concatenate(parts_hash or [np.zeros(0, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[first], h[first]


def superminhash(doc: np.ndarray, h: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs, slots) of sets given as sorted (document, hash); 16 bits a slot, documents without elements 0."""
    empty = np.iinfo(np.uint64).max
    values = np.full(n_docs * slots, empty, np.uint64)
    perm = None
    base, elem = doc * slots, h
    for level in range(slots):
        if not len(elem):
            break
        r = mix(elem + _U((2 * level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        value = (r >> _U(16)) | (_U(level) << _U(48))
        other = level + ((r & _U(0xFFFF)) * _U(slots - level) >> _U(16)).astype(np.int64)
        if level == 0:
            place = other
        else:
            rows = np.arange(len(elem))
            if perm is None:  # the shuffle after level 0, element by element
                perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(elem), slots)).copy()
                perm[rows, 0], perm[rows, first_place] = first_place, 0
            place = perm[rows, other].astype(np.int64)
            perm[rows, other] = perm[rows, level]
            perm[rows, level] = place
        np.minimum.at(values, base + place, value)
        unfilled = (values.reshape(n_docs, slots) == empty).any(axis=1)
        go = unfilled[base // slots]
        if level == 0:
            first_place = place[go].astype(np.uint8)
        elif perm is not None:
            perm = perm[go]
        base, elem = base[go], elem[go]
    out = (mix(values) & _U(0xFFFF)).astype("<u2").reshape(n_docs, slots)
    out[np.bincount(doc, minlength=n_docs) == 0] = 0
    return out


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
    """Start, end and texts in parts of about CHUNK bytes; texts as views of the batch."""
    at, size, own = 0, 0, []
    for k, t in enumerate(texts):
        own.append(t.as_buffer() if t.is_valid else b"")
        size += len(own[-1])
        if size >= CHUNK or k == len(texts) - 1:
            yield at, k + 1, own
            at, size, own = k + 1, 0, []


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, texts in _parts(batch.column(1)):
            doc, h = shingle_sets(texts)
            n = np.bincount(doc, minlength=len(texts))
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(texts), np.uint64)
                np.add.at(total, doc, mix(h + _U(salt * 0xA24BAED4963EE407 & (2**64 - 1))))
                sums.append(total.view(np.int64))
            sig = superminhash(doc, h, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, ...) with the set in the text's place."""
    for batch in batches:
        for start, end, texts in _parts(batch.column(1)):
            doc, h = shingle_sets(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            others = [batch.column(k).slice(start, end - start) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(rows, pa.binary()), *others], names=["id", "shingles", *batch.schema.names[2:]])


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(_sign, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def sets_to(docs: DataFrame, where: DataFrame, kind: str, text: str) -> DataFrame:
    """The full sets, a row for each row of ``where`` (id and the columns of ``kind``); ``where`` must be saved."""
    names = [c.split()[0] for c in kind.split(", ")]
    lists = where.groupBy("id").agg(F.collect_list(F.struct(*names)).alias("to"))
    needed = F.broadcast(lists) if where.count() <= MAX_BROADCAST_IDS else lists
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).join(needed, "id")
    made = found.mapInArrow(_sets, f"id long, shingles binary, to array<struct<{', '.join(c.replace(' ', ':') for c in kind.split(', '))}>>")
    return made.select("id", "shingles", F.explode("to").alias("to")).select("id", "shingles", "to.*")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    at = np.searchsorted(a, b)
    shared = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _against_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members with their pivot; rows come sorted by (pivot, block, role), the pivot's set (role 0) first."""
    now, pivots = None, []
    for batch in batches:
        out: list[tuple[int, int]] = []
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "block", "role", "id")), strict=True))
        for (pivot, block, role, own), data in zip(keys, batch.column(batch.schema.get_field_index("shingles")), strict=True):
            if (pivot, block) != now:
                now, pivots = (pivot, block), []
            if role == 0:
                pivots.append(np.frombuffer(data.as_py(), np.uint64))
            elif any(_similar(p, np.frombuffer(data.as_buffer(), np.uint64)) for p in pivots):
                out.append((min(pivot, own), max(pivot, own)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def verified(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(src, dst) of the pairs (pivot, rep, n: shingles of rep) whose full sets are similar enough; ``pairs`` must be saved."""
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES).cast("int").alias("nb"))
    members = pairs.join(blocks, "pivot").select(F.col("rep").alias("id"), "pivot", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int").alias("block"), F.lit(1).alias("role"))
    pivots = blocks.select(F.col("pivot").alias("id"), "pivot", F.explode(F.expr("sequence(0, nb - 1)")).alias("block"), F.lit(0).alias("role"))
    where = saved(members.unionByName(pivots))
    dealt = sets_to(docs, where, "pivot long, block int, role int", text)
    links = saved(dealt.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "role").mapInArrow(_against_pivots, "src long, dst long").distinct())
    release(where)
    return links


def _links_across(sig: np.ndarray, sets: list[np.ndarray], rep: list[int], comp: list[int], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different components of one block (of its two sides, if it has two).

    Signatures choose the candidates, full sets decide; a pair whose components have met is not looked at again.
    """
    groups = UnionFind()
    n = np.array([len(x) for x in sets])
    need, two = int(MAY_REACH * SLOTS), side.min() != side.max()
    links = []
    for k in range(len(rep)):
        if two and side[k]:
            continue
        mask = (100 * n >= PERCENT * n[k]) & (PERCENT * n <= 100 * n[k])
        mask &= side == 1 if two else np.arange(len(rep)) > k
        own = np.flatnonzero(mask)
        own = own[(sig[own] == sig[k]).sum(axis=1) >= need]
        mine = groups.find(comp[k])
        own = np.array([j for j in own.tolist() if groups.find(comp[j]) != mine], dtype=np.int64)
        if not len(own):
            continue
        theirs = np.concatenate([sets[j] for j in own.tolist()])
        at = np.searchsorted(sets[k], theirs)
        hit = sets[k][np.minimum(at, len(sets[k]) - 1)] == theirs
        shared = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(n[own])[:-1])))
        for j in own[100 * shared >= PERCENT * (n[k] + n[own] - shared)].tolist():
            if groups.union(comp[k], comp[j]):
                links.append((min(rep[k], rep[j]), max(rep[k], rep[j])))
    return links


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block; rows come sorted by block (coarse, i, j)."""
    rows: list[tuple] = []
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(rows) > 1:
            sig = np.stack([np.frombuffer(r[4], "<u2") for r in rows])
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            out.extend(_links_across(sig, sets, [r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows])))
        rows.clear()

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("coarse", "i", "j")), strict=True)
        values = zip(*(batch.column(c).to_pylist() for c in ("rep", "comp", "side", "sig", "shingles")), strict=True)
        for key, value in zip(keys, values, strict=True):
            if rows and rows[0][0] != key:
                close()
            rows.append((key, *value))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])
        out.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def links_of_rest(rest: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links between components that meet in a bucket: ``rest`` has (key, rep, comp) of such buckets.

    Buckets that share a member are taken together, so that a set travels once. What is
    taken together is cut into parts of bounded bytes. Every two parts meet in one task, but
    for parts of its largest component, which only meet those of the others.
    """
    least = rest.groupBy("key").agg(F.min("rep").alias("dst"))
    coarse = components(rest.join(least, "key").select(F.col("rep").alias("src"), "dst").filter("src <> dst").distinct())
    reps = rest.select("rep", "comp").distinct().join(coarse.select(F.col("node").alias("rep"), F.col("component").alias("coarse")), "rep")
    reps = saved(reps.join(classes.select("rep", "sig", "n_shingles"), "rep"))
    sizes = reps.groupBy("coarse", "comp").agg(F.sum(F.col("n_shingles") * 8 + 2 * SLOTS).alias("size"))
    sizes = sizes.groupBy("coarse").agg(F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("most"))
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES)).cast("int")
    sizes = sizes.select("coarse", F.col("most.comp").alias("largest"), parts(F.col("all") - F.col("most.size")).alias("few"), parts(F.col("most.size")).alias("many"))
    dealt = reps.drop("sig").join(sizes, "coarse")
    is_most = F.col("comp") == F.col("largest")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    dealt = dealt.withColumn("own", F.when(is_most, F.col("few") + place("many")).otherwise(place("few")))
    dealt = dealt.withColumn("other", F.explode(F.when(is_most, F.expr("sequence(0, few - 1)")).otherwise(F.expr("sequence(0, few + many - 1)"))))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    where = saved(dealt.select(F.col("rep").alias("id"), "coarse", i.alias("i"), j.alias("j"), "comp", F.when(F.col("own") == i, 0).otherwise(1).alias("side")))
    sets = sets_to(docs, where, "coarse long, i int, j int, comp long, side int", text).withColumnRenamed("id", "rep")
    dealt = sets.join(reps.select("rep", "sig"), "rep")
    more = saved(dealt.repartition("coarse", "i", "j").sortWithinPartitions("coarse", "i", "j", "rep").mapInArrow(_blocks, "src long, dst long"))
    release(reps, where)
    return more


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document row: doc_id, n_shingles, component_id, kept."""
    sig = saved(signatures(docs, text))
    classes = saved(
        sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    )
    bands = F.expr(f"transform(sequence(0, {SLOTS // BAND - 1}), k -> xxhash64(substring(sig, k * {2 * BAND} + 1, {2 * BAND}), k))")
    banded = classes.select("rep", F.col("n_shingles").alias("n"), F.explode(bands).alias("key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = saved(banded.join(counts, "key").select("key", "rep", "n", "c"))
    links = None
    if not members.isEmpty():
        central = members.groupBy("rep").agg(F.sum("c").alias("weight"))
        weighed = members.join(central, "rep")
        pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"), "n")).alias("p"))
        pairs = weighed.join(pivots.select("key", (-F.col("p.r")).alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.weight").alias("pivot_weight")), "key").filter("rep <> pivot")
        # sets of sizes too far apart can't be similar enough
        pairs = pairs.filter(f"100 * least(n, pivot_n) >= {PERCENT} * greatest(n, pivot_n)")
        pairs = saved(pairs.groupBy("rep", "pivot").agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("pivot_weight").alias("pivot_weight")))
        best = pairs.groupBy("rep", "n").agg(F.max(F.struct("shared", "pivot_weight", "pivot")).alias("b")).select("rep", "n", F.col("b.pivot").alias("pivot"))
        best = saved(best)
        links = verified(best, docs, text)
        comps = components(links)
        of = lambda name: comps.select(F.col("node").alias(name), F.col("component").alias(f"{name}_comp"))
        others = pairs.join(best.select("rep", "pivot"), ["rep", "pivot"], "left_anti").join(of("rep"), "rep", "left").join(of("pivot"), "pivot", "left")
        others = saved(others.filter("coalesce(rep_comp, rep) <> coalesce(pivot_comp, pivot)").select("rep", "n", "pivot"))
        if not others.isEmpty():
            links = links.unionByName(verified(others, docs, text))
            comps = components(links)
        release(pairs, best, others)
        known = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        split = known.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("key")
        rest = saved(known.join(split, "key").select("key", "rep", "comp"))
        if not rest.isEmpty():
            more = links_of_rest(rest, classes, docs, text)
            if not more.isEmpty():
                comps = components(links.unionByName(more))
        release(rest)
        found = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    else:
        found = classes.select("h1", "h2", "n_shingles", F.col("rep").alias("component"))
    release(members)
    out = sig.drop("sig").join(found, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id) of each group of near-duplicates."""
    (gone_id,) = unused(docs, "_gone")
    gone = near_duplicates(docs, text).filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
