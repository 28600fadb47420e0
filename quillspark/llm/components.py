"""Connected components by union-find inside partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved

LINKS = "src long, dst long"


class UnionFind:
    """Disjoint sets whose representative is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


#: A partition's sets are let go, as a forest, once they hold so many members.
FOREST_NODES = 500_000
#: So many links are one task's work (no more than FOREST_NODES members): its forest is the result.
LAST_LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(sets: UnionFind) -> pa.RecordBatch:
        pairs = [(x, sets.find(x)) for x in sets.parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > FOREST_NODES:
            yield out(sets)
            sets = UnionFind()
    yield out(sets)


def components(links: DataFrame, max_rounds: int = 60, last_links: int = LAST_LINKS) -> DataFrame:
    """(node, component) of all nodes that ``links`` (src, dst) name; the component is the smallest node reachable.

    Each round is: union-find within each partition, then each node's larger neighbours and
    itself are linked to its smallest neighbour (large star), then its smaller ones (small
    star). Aggregates are combined before the shuffle, joins on hub nodes are split by AQE.
    Rounds end when nothing changes, or at once where ``last_links`` or fewer are left.
    """
    edges = saved(links.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst").mapInArrow(_forest, LINKS))
    before, last = None, min(last_links, FOREST_NODES // 2)
    for _ in range(max_rounds):
        # a forest of stars: every source has one target, and no target is a source
        state = edges.agg(F.count("*"), F.sum(F.hash("src", "dst").cast("long")), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            break
        if state[0] <= last:
            done = saved(edges.coalesce(1).mapInArrow(_forest, LINKS))
            release(edges)
            edges = done
            break
        before = state
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        down = saved(large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(low, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        new = saved(small.filter("src <> dst").distinct())
        release(edges, down)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
