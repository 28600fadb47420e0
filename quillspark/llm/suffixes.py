"""Removal of long repeated strings by a distributed, common-prefix-aware suffix sort.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

1. *Sparse suffixes.* A window of ``length`` bytes is looked up at one place of its own
   choice: where, among its first SPAN positions, a local 16-byte hash is least (leftmost on
   ties). Equal windows choose the same place, so that only the suffixes there need sorting,
   about one in SPAN / 2. A window is (suffix, distance back to its start).
2. *Approximate distinguishing prefixes.* Of each suffix, a 64-bit hash of the part that all
   its windows share is counted over the corpus with partial aggregates; a suffix whose part
   is unique has no repeated window and is neither exchanged nor sorted.
3. *Runs.* Each task sorts its remaining suffixes (``length`` bytes, and up to SPAN bytes to
   their left) and collapses equal ones. Runs are cut into ranges of the
   shared part's hash (which keeps equal parts together and ranges even without sampling),
   front-coded (common prefix with the one before, then the rest) and exchanged. Copies
   collapse before that, so that a string's share of a range is one entry for each task,
   however often it occurs.
   Periodic text (one byte, one short pattern over megabytes) chooses equal suffixes at
   every period; such a run of neighbours travels as one range, not place by place.
4. *Merge.* A loser tree combines the runs of a range. Each run's head carries the length of
   its common prefix with the last winner, and strings are only compared behind it.
5. *Windows.* Neighbours in the merged order give the common prefixes; a group with a common
   prefix that some window needs is searched for equal windows (suffix part and left part),
   and what repeats goes back as byte ranges of its documents, which are then cut.

Defined results: null texts are empty; texts shorter than ``length`` stay; strings don't
cross documents; rows with the same id and text are two occurrences (each loses what repeats
in the other); an empty table gives an empty table; further columns are carried through by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

LENGTH = 400
SPAN = 256
#: Suffixes (copies included) that a range holds on average.
PER_RANGE = 60_000
CHUNK = 4_000_000
#: A sorted run is closed at so many suffixes.
RUN = 150_000
_U = np.uint64
_BITS = _U(20)


def choose(buf: np.ndarray, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the chosen suffixes of one text, with the least and greatest distance back to a window's start."""
    none = np.zeros(0, np.int64)
    windows = len(buf) - length + 1
    if windows <= 0:
        return none, none, none
    places, firsts, lasts = [], [], []
    low = _U((1 << int(_BITS)) - 1)
    step = (1 << int(_BITS)) - span
    for at in range(0, windows, step):  # places fit the low bits block by block, and memory is that of a block
        some = min(step, windows - at)
        # the 16-byte hash at each position that a window's first part may choose
        n = some + span - 1
        packed = np.ascontiguousarray(np.lib.stride_tricks.as_strided(buf[at:], shape=(n + 8, 8), strides=(1, 1))).view("<u8").ravel()
        h = packed[:n] * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h = (h + packed[8 : n + 8]) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        least = (h & ~low) | np.arange(n, dtype=np.uint64)
        width = 1
        while width < span:  # minima over a span that doubles
            move = min(width, span - width)
            least = np.minimum(least[: len(least) - move], least[move:])
            width += move
        chosen = (least & low).astype(np.int64) + at  # by window start
        edge = np.flatnonzero(np.diff(chosen, prepend=-1))
        place, first, last = chosen[edge], edge + at, np.append(edge[1:], len(chosen)) - 1 + at
        if places and places[-1][-1] == place[0]:  # its windows reach over the block's start
            lasts[-1][-1] = last[0]
            place, first, last = place[1:], first[1:], last[1:]
        places.append(place)
        firsts.append(first)
        lasts.append(last)
    place = np.concatenate(places)
    return place, place - np.concatenate(lasts), place - np.concatenate(firsts)


#: Offsets at which neighbouring suffixes are compared before all their bytes are.
PROBES = (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
#: So many neighbours at one distance are compared by one pass over the text.
MANY = 256


def runs_of_equal(buf: np.ndarray, place: np.ndarray, least: np.ndarray, greatest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of runs of neighbouring suffixes with equal bytes and windows: periodic text chooses a place in each period.

    Neighbours are nearer than a window is long, so that a run's windows cover one range.
    """
    begins = np.ones(len(place), bool)
    p, q = place[:-1], place[1:]
    alike = (least[1:] == least[:-1]) & (greatest[1:] == greatest[:-1])
    for k in PROBES:
        alike &= buf[p + k] == buf[q + k]
    pairs = np.flatnonzero(alike)
    start, end, gap = p[pairs] - greatest[pairs], p[pairs] + length - least[pairs], q[pairs] - p[pairs]
    same = np.zeros(len(pairs), bool)
    for d, n in zip(*np.unique(gap, return_counts=True), strict=True):
        own = np.flatnonzero(gap == d)
        if n < MANY:
            same[own] = [bytes(buf[start[k] : end[k]]) == bytes(buf[start[k] + d : end[k] + d]) for k in own.tolist()]
            continue
        low, high = int(start[own].min()), int(end[own].max())
        differ = np.zeros(high - low + 1, np.int32)
        np.cumsum(buf[low:high] != buf[low + d : high + d], out=differ[1:])
        same[own] = differ[end[own] - low] == differ[start[own] - low]
    begins[pairs[same] + 1] = False
    begin = np.flatnonzero(begins)
    return begin, np.append(begin[1:], len(place)) if len(begin) else begin


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for t in batch.column(k):
        data = t.as_buffer() if t.is_valid else None
        yield np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _shared(buf: np.ndarray, place: np.ndarray, length: int, span: int) -> np.ndarray:
    """Hashes of the bytes that all windows of each suffix have."""
    view, part = memoryview(buf), length - span + 1
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[p : p + part]) for p in place.tolist()), np.uint64, len(place)).view(np.int64)


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n  # a[:low] agrees, a[:high] doesn't
    step = 16
    while low + step < high and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low] != b[low] else low + 1


def front_code(run: list[tuple]) -> bytes:
    """Entries (suffix, left, number) in order as bytes; suffixes without what they share with the one before."""
    out, before = [], b""
    for suffix, left, number in run:
        k = common_prefix(before, suffix)
        rest = suffix[k:]
        out += [k.to_bytes(2, "little"), len(rest).to_bytes(2, "little"), len(left).to_bytes(2, "little"), number.to_bytes(8, "little"), rest, left]
        before = suffix
    return b"".join(out)


def front_decode(data: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(common prefix with the entry before, suffix, left, number)."""
    at, before = 0, b""
    while at < len(data):
        k = int.from_bytes(data[at : at + 2], "little")
        n = int.from_bytes(data[at + 2 : at + 4], "little")
        m = int.from_bytes(data[at + 4 : at + 6], "little")
        number = int.from_bytes(data[at + 6 : at + 14], "little")
        at += 14
        before = before[:k] + data[at : at + n]
        yield k, before, data[at + n : at + n + m], number
        at += n + m


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, string, ...).

    A run's head is kept with its common prefix with the last winner. Of two heads, the one
    with the longer prefix is smaller; only equal prefixes need bytes, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.heads: list[tuple | None] = [None] * self.size
        self.prefix = [0] * self.size
        for k, r in enumerate(self.runs):
            self.heads[k] = next(r, None)
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.prefix[a], self.prefix[b]
        if p != q:  # the one nearer to the last winner is smaller, and the other's prefix stays true
            return (a, b) if p > q else (b, a)
        s, t = x[1], y[1]
        k = common_prefix(s, t, p)
        if k == len(s) or (k < len(t) and s[k] < t[k]):
            self.prefix[b] = k
            return a, b
        self.prefix[a] = k
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        """(common prefix with the last one, string, ...) in order."""
        while (head := self.heads[self.winner]) is not None:
            k = self.winner
            yield (self.prefix[k], *head[1:])
            self.heads[k] = new = next(self.runs[k], None) if k < len(self.runs) else None
            if new is not None:
                self.prefix[k] = new[0]
            node, won = (k + self.size) // 2, k
            while node:
                a, b = self._play(won, self.loser[node])
                won, self.loser[node] = a, b
                node //= 2
            self.winner = won


def repeated_windows(group: list[tuple[bytes, bytes, int, int, int]], length: int) -> list[set[int]]:
    """For entries (suffix, left, copies, least, greatest), the distances back at which a window occurs more than once.

    Of an entry with several copies, the caller knows already that every window does.
    """
    seen: dict[bytes, tuple[int, int]] = {}
    out: list[set[int]] = [set() for _ in group]
    digest = xxhash.xxh3_128_digest
    for k, (suffix, left, copies, least, greatest) in enumerate(group):
        whole, cut = left + suffix, len(left)
        for back in range(least, greatest + 1):
            first = seen.setdefault(digest(whole[cut - back : cut - back + length]), (k, back))
            if first[0] != k or first[1] != back:
                out[k].add(back)
                out[first[0]].add(first[1])
    return out


def _spans(distances: set[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers."""
    runs: list[tuple[int, int]] = []
    for x in sorted(distances):
        if runs and runs[-1][1] == x - 1:
            runs[-1] = (runs[-1][0], x)
        else:
            runs.append((x, x))
    return runs


def repeated_ranges(docs: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(one, other, start, end): the byte ranges of keyed documents (one long, other long, text) that windows with a twin cover.

    Rows with equal keys must have equal texts; they count as so many occurrences. Ranges may overlap.
    """
    assert 16 <= span <= length - 32 - 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, copies = [], []
            for buf in _texts(batch, 2):
                place, least, greatest = choose(buf, length, span)
                if len(place):
                    begin, end = runs_of_equal(buf, place, least, greatest, length)
                    parts.append(_shared(buf, place[begin], length, span))
                    copies.append(end - begin)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            unique, where = np.unique(cat(parts), return_inverse=True)
            n = np.zeros(len(unique), np.int64)
            np.add.at(n, where, cat(copies))
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n)], names=["part", "n"])

    parts = docs.mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).filter("n > 1")
    parts = saved(parts.select("part", "n"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, others, all_parts, at = [], [], [], []
            for one, other, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), strict=True):
                place, least, greatest = choose(buf, length, span)
                if len(place):
                    begin, _ = runs_of_equal(buf, place, least, greatest, length)
                    ones.append(np.full(len(begin), one))
                    others.append(np.full(len(begin), other))
                    at.append(place[begin])
                    all_parts.append(_shared(buf, place[begin], length, span))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(x)) for x in (ones, others, at, all_parts)], names=["one", "other", "place", "part"])

    found = docs.mapInArrow(places, "one long, other long, place long, part long").join(parts.select("part"), "part")
    kept = found.groupBy("one", "other").agg(F.sort_array(F.collect_set(F.struct("place", "part"))).alias("places"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_ranges = int(max(1, -(-total // PER_RANGE)))
    joined = docs.join(kept, ["one", "other"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, closed = TaskContext.get().partitionId(), 0
        pending: dict[tuple, list] = {}
        width = -(-(2**64) // n_ranges)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal closed
            by_range: dict[int, list[tuple]] = defaultdict(list)
            for (part, suffix, left), where in pending.items():
                by_range[(part + 2**63) // width].append((suffix, left, where))
            for r, entries in sorted(by_range.items()):
                entries.sort(key=lambda e: e[:2])
                coded = front_code([(s, x, k) for k, (s, x, _) in enumerate(entries)])
                flat = np.array([(k, *w) for k, (_, _, where) in enumerate(entries) for w in where], dtype=np.int64)  # entry, document, first and last place, copies, distances
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([(task << 20) | closed], pa.int64()), pa.array([coded], pa.binary()), pa.array([flat.tobytes()], pa.binary())],
                    names=["range", "run", "coded", "places"],
                )
            pending.clear()
            closed += 1

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in (0, 1))
            for one, other, buf, keep in zip(*columns, _texts(batch, 2), batch.column(3).to_pylist(), strict=True):
                place, least, greatest = choose(buf, length, span)
                data = buf.tobytes()
                begin, until = runs_of_equal(buf, place, least, greatest, length)
                index = np.searchsorted(place[begin], [x["place"] for x in keep])
                for x, r in zip(keep, index.tolist(), strict=True):
                    k, end = int(begin[r]), int(until[r])
                    p, a, b = int(place[k]), int(least[k]), int(greatest[k])
                    key = (x["part"], data[p : p + length - a], data[p - b : p])
                    pending.setdefault(key, []).append((one, other, p, int(place[end - 1]), end - k, a, b))
                if len(pending) >= RUN:
                    yield from close()
        yield from close()

    coded = joined.mapInArrow(runs, "range int, run long, coded binary, places binary")

    def merge(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("run").to_numpy())
        data = [group.column("coded")[k].as_py() for k in order.tolist()]
        where: list[dict[int, list]] = []
        for k in order.tolist():
            own: dict[int, list] = defaultdict(list)
            for e, *at in np.frombuffer(group.column("places")[k].as_py(), np.int64).reshape(-1, 8).tolist():
                own[e].append(at)
            where.append(own)

        def stream(k: int) -> Iterator[tuple]:
            for prefix, suffix, left, number in front_decode(data[k]):
                yield prefix, suffix, left, where[k][number]

        rows: list[tuple[int, int, int, int]] = []
        need = length - span + 1

        def emit(block: list[tuple[bytes, bytes, list]], ahead: list[int]) -> None:
            """A maximal block of entries that share ``need`` bytes; ``ahead``: prefix with the next."""
            merged: dict[tuple[bytes, bytes], list] = {}
            reach: dict[tuple[bytes, bytes], int] = {}
            for k, (suffix, left, places) in enumerate(block):
                key = (suffix, left)
                merged.setdefault(key, []).extend(places)
                best = max(ahead[k - 1] if k else 0, ahead[k] if k + 1 < len(block) else 0)
                reach[key] = max(reach.get(key, 0), best)
            entries, keys = [], []
            for key, places in merged.items() if len(merged) > 1 else ():
                least, greatest = places[0][5], places[0][6]  # equal keys have equal bounds
                least = max(least, length - reach[key])  # a window is no longer than the common prefix behind the suffix's start
                if least <= greatest:
                    entries.append((key[0], key[1], sum(x[4] for x in places), least, greatest))
                    keys.append(key)
            found = dict(zip(keys, repeated_windows(entries, length), strict=True))
            for key, places in merged.items():
                least, greatest = places[0][5], places[0][6]
                spans = [(least, greatest)] if len(places) > 1 or places[0][4] > 1 else _spans(found.get(key, set()))
                for one, other, p, last, *_ in places:
                    rows.extend((one, other, p - high, last - low + length) for low, high in spans)

        block: list[tuple] = []
        ahead: list[int] = []
        for prefix, suffix, left, places in LoserTree([stream(k) for k in range(len(data))]):
            if block and prefix < need:
                emit(block, [*ahead, 0])
                block, ahead = [], []
            elif block:
                ahead.append(prefix)
            block.append((suffix, left, places))
        if block:
            emit(block, [*ahead, 0])
        columns = list(zip(*set(rows), strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("one", "other", "start", "end"), columns, strict=True)})

    return coded.groupBy("range").applyInArrow(merge, "one long, other long, start long, end long")


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def mark_repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, text: str = "text") -> DataFrame:
    """row (the columns of ``docs``) and spans: null, or the (start, end) in bytes that repeated strings cover, overlaps included."""
    # a document's key: its id (a place of its own for null) and the hash of its text
    own = docs.select(F.struct("*").alias("row"))
    keyed = own.withColumns({"_one": F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(-(2**63))), "_other": F.xxhash64(F.col("row")[text])})
    given = keyed.select(F.col("_one").alias("one"), F.col("_other").alias("other"), F.coalesce(F.col("row")[text], F.lit("")).cast("binary").alias("text"))
    spans = repeated_ranges(given, length, span).groupBy("one", "other").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return keyed.join(spans, (F.col("_one") == F.col("one")) & (F.col("_other") == F.col("other")), "left").select("row", "spans")


def _cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    runs = union_of([(x["start"], x["end"]) for x in spans or []])
    left, at = [], 0
    for a, b in runs:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]]), runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, text: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes; a character cut in the middle is replaced by U+FFFD."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _cut(t.encode("utf-8", "surrogatepass"), list(s))[0].decode("utf-8", "replace") for t, s in zip(texts, spans, strict=True)])

    old = F.col("row")[text]
    new = F.when(F.col("spans").isNull(), old).otherwise(cut(F.coalesce(old, F.lit("")), "spans"))
    return mark_repeats(docs, length, span, text).select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def digest(marked: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of marked documents."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, runs = _cut(data, spans)
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    given = marked.select(F.col("row")["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.col("row")[text], F.lit("")).cast("binary").alias("text"), "spans")
    return given.mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
