"""Graphs as numbered matrices, and a preview of a graph under two budgets.

Nodes and edges are tables with a column for the graph; no graph is ever one row or one task's
own. Positions are dealt by ranges of the order first, so that a very large graph is numbered in
many tasks. Edges with an end that isn't a node, or of an unknown type, are left out.

Defined results: graphs without nodes give nothing; a node's id is unique in its graph (of several
rows the last by order counts for edges); null types and languages have no place in a one-hot
part; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.lineage import ensure_folder
from quillspark.functions.text import hash_bucket

#: Types of nodes and edges, and buckets of names, of the layouts of features.
NODE_TYPES = ("package", "file", "function", "dangerous_api")
EDGE_TYPES = ("contains", "declares", "import", "dependency", "call", "version_diff")
NAME_BUCKETS, LEXICAL_BUCKETS = 32, 64
#: Nodes and edges of a preview.
PREVIEW_NODES, PREVIEW_EDGES = 22, 30
DEAL = 65536


def numbered(nodes: DataFrame, graph: str, order: str) -> DataFrame:
    """Add position (from 0) of each node in its graph by a whole-number order. A task numbers a stretch of the order; sizes of the stretches before are added."""
    part = F.floor(F.col(order) / DEAL)
    sizes = nodes.groupBy(F.col(graph).alias("_g"), part.alias("_s")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_g", "_s", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(graph, "_part").orderBy(order)) - 1
    ranked = nodes.withColumn("_part", part).withColumn("_own", own)
    return ranked.join(sizes, F.col(graph).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_s"))).withColumn("position", (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_g", "_s", "_before")


def _one_hot(value: Column, known: tuple[str, ...], start: int) -> Column:
    """Entry (index, value) of a one-hot part, as an array that may be empty."""
    at = F.array_position(F.array(*[F.lit(x) for x in known]), value)
    entry = F.array(F.struct((at - 1 + start).cast("int").alias("index"), F.lit(1.0).alias("value")))
    return F.when(at > 0, entry).otherwise(F.slice(entry, 1, 0))


def dimension(version: int, languages: tuple[str, ...], apis: tuple[str, ...] = ()) -> int:
    """Features of a node by version of the layout: names are hashed up to 3, interfaces count from 2, lexical buckets from 7."""
    return len(NODE_TYPES) + len(languages) + (NAME_BUCKETS if version < 4 else 0) + 2 + (len(apis) if version >= 2 else 0) + (LEXICAL_BUCKETS if version >= 7 else 0)


def matrices(nodes: DataFrame, edges: DataFrame, graph: str, languages: tuple[str, ...], order: str = "seq", version: int = 1, apis: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(graph, position, node_id, features; graph, source, target, type_index) of nodes (graph, node_id, type, name, language, order) and edges (graph, src, dst, type).

    Features are the entries (index, value) that aren't 0, by index. Each edge is there in both
    directions; a graph without any has a loop at each node, of no type (-1). From version 7 on nodes have ``lexical``, an array of weights.
    """
    placed = numbered(nodes, graph, order)
    ids = placed.groupBy(graph, F.col("node_id").alias("_id")).agg(F.max("position").alias("_at"))
    kind = F.array_position(F.array(*[F.lit(t) for t in EDGE_TYPES]), F.col("type")) - 1
    one = edges.select(graph, "src", "dst", kind.cast("int").alias("type_index")).filter("type_index >= 0")
    one = one.join(ids.withColumnsRenamed({"_id": "src", "_at": "source"}), [graph, "src"]).join(ids.withColumnsRenamed({"_id": "dst", "_at": "target"}), [graph, "dst"])
    both = one.select(graph, "type_index", F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))).alias("_e")).select(graph, "_e.source", "_e.target", "type_index")
    loops = placed.join(both.select(graph).distinct(), graph, "left_anti").select(graph, F.col("position").alias("source"), F.col("position").alias("target"), F.lit(-1).alias("type_index"))
    degree = both.groupBy(graph, F.col("source").alias("position")).agg(F.count("*").alias("_d"))
    size = placed.groupBy(graph).agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("_most"))
    df = placed.join(degree, [graph, "position"], "left").join(size, graph)
    start = len(NODE_TYPES) + len(languages)
    parts = [_one_hot(F.col("type"), NODE_TYPES, 0), _one_hot(F.coalesce("language", F.lit("unknown")), languages, len(NODE_TYPES))]
    name = F.coalesce(F.col("name"), F.col("node_id"))
    if version < 4:
        parts.append(F.array(F.struct((hash_bucket(name, NAME_BUCKETS) + start).cast("int").alias("index"), F.lit(1.0).alias("value"))))
        start += NAME_BUCKETS
    # ends are counted with the loops left out, as both directions are there in- and out-degree are the same
    share = F.coalesce("_d", F.lit(0)) / F.col("_most")
    parts.append(F.filter(F.array(*[F.struct(F.lit(start + k).alias("index"), share.alias("value")) for k in (0, 1)]), lambda x: x["value"] != 0))
    start += 2
    if version >= 2 and apis:
        parts.append(_one_hot(F.when(F.col("type") == "dangerous_api", F.lower(name)), apis, start))
    start += len(apis) if version >= 2 else 0
    if version >= 7:
        weights = F.slice(F.coalesce(F.col("lexical"), F.array().cast("array<double>")), 1, LEXICAL_BUCKETS)
        parts.append(F.filter(F.transform(weights, lambda x, k: F.struct((k + start).cast("int").alias("index"), x.cast("double").alias("value"))), lambda x: x["value"] != 0))
    return df.select(graph, "position", "node_id", F.concat(*parts).alias("features")), both.unionByName(loops)


def preview(edges: DataFrame, nodes: DataFrame, graph: str, most_nodes: int = PREVIEW_NODES, most_edges: int = PREVIEW_EDGES) -> tuple[DataFrame, DataFrame]:
    """(graph, node_id, place; graph, src, dst, relation) of the part of each graph that a preview shows.

    Edges are gone through by the greater risk of their ends, the sum of their degrees, then by
    name; one is taken unless it would need more nodes than are left, until there are
    enough. Nodes by risk and degree fill what is left. Places (from 1) go by degree, risk and name.

    A round takes all edges that are sure to fit: half as many with new nodes as there are nodes
    left, and what needs no new node before the last of them. So there are at most as many rounds
    as nodes in a preview, whatever the size of the graphs; only what is shown is kept between them.
    """
    ensure_folder(edges.sparkSession)
    edges = edges.select(graph, "src", "dst", "relation").filter("src <> dst").distinct()
    ends = edges.select(graph, F.explode(F.array("src", "dst")).alias("node_id")).groupBy(graph, "node_id").agg(F.count("*").alias("degree"))
    known = nodes.groupBy(graph, "node_id").agg(F.max(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("risk").cast("int"), F.lit(0))))).alias("risk"))
    known = known.join(ends, [graph, "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    side = lambda c: known.select(graph, F.col("node_id").alias(c), F.col("risk").alias(f"_r{c}"), F.col("degree").alias(f"_d{c}"))
    order = F.struct((-F.greatest("_rsrc", "_rdst")).alias("a"), (-(F.col("_dsrc") + F.col("_ddst"))).alias("b"), F.lower("src").alias("c"), F.lower("dst").alias("d"), F.col("relation").alias("e"), F.col("src").alias("f"), F.col("dst").alias("g"))
    ranked = edges.join(side("src"), [graph, "src"]).join(side("dst"), [graph, "dst"]).select(graph, "src", "dst", "relation", order.alias("_o")).checkpoint()
    shown = ranked.limit(0).select(graph, "_o")
    taken = known.limit(0).select(graph, "node_id")
    left = ranked
    for _ in range(most_nodes + 1):
        if left.isEmpty():
            break
        used = taken.groupBy(graph).agg(F.count("*").alias("_n"))
        here = lambda c: taken.select(graph, F.col("node_id").alias(c), F.lit(1).alias(f"_has_{c}"))  # noqa: E731, B023
        rows = left.join(here("src"), [graph, "src"], "left").join(here("dst"), [graph, "dst"], "left").join(used, graph, "left")
        free = F.lit(most_nodes) - F.coalesce("_n", F.lit(0))
        cost = 2 - F.coalesce("_has_src", F.lit(0)) - F.coalesce("_has_dst", F.lit(0))
        rows = rows.withColumns({"_free": free, "_cost": cost}).filter(F.col("_cost") <= F.col("_free"))
        new = rows.filter("_cost > 0").withColumn("_k", F.row_number().over(Window.partitionBy(graph).orderBy("_o"))).filter(F.col("_k") <= most_nodes)
        sure = new.filter(F.col("_k") <= F.greatest(F.floor(F.col("_free") / 2), F.lit(1)))
        last = sure.groupBy(graph).agg(F.max("_o").alias("_last"))
        # a graph that takes no new node any more takes all that needs none
        kept = rows.join(last, graph, "left").filter((F.col("_last").isNull() & (F.col("_cost") == 0)) | (F.col("_o") <= F.col("_last"))).select(graph, "src", "dst", "_o")
        first = kept.withColumn("_k", F.row_number().over(Window.partitionBy(graph).orderBy("_o"))).filter(F.col("_k") <= most_edges).drop("_k")
        both = shown.select(graph, "_o").unionByName(first.select(graph, "_o")).withColumn("_k", F.row_number().over(Window.partitionBy(graph).orderBy("_o"))).filter(F.col("_k") <= most_edges).drop("_k")
        shown = both.checkpoint()
        held = ranked.join(shown, [graph, "_o"], "left_semi")
        taken = held.select(graph, F.explode(F.array("src", "dst")).alias("node_id")).distinct().checkpoint()
        full = shown.groupBy(graph).agg(F.count("*").alias("_m")).filter(F.col("_m") >= most_edges).select(graph)
        left = left.join(last, graph).filter(F.col("_o") > F.col("_last")).drop("_last").join(full, graph, "left_anti").select(ranked.columns).checkpoint()
    room = known.join(taken, [graph, "node_id"], "left_anti").join(taken.groupBy(graph).agg(F.count("*").alias("_n")), graph, "left")
    fill = room.withColumn("_k", F.row_number().over(Window.partitionBy(graph).orderBy(F.desc("risk"), F.desc("degree"), F.lower("node_id"), "node_id"))).filter(F.col("_k") <= most_nodes - F.coalesce("_n", F.lit(0)))
    chosen = known.join(taken.unionByName(fill.select(graph, "node_id")), [graph, "node_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy(graph).orderBy(F.desc("degree"), F.desc("risk"), F.lower("node_id"), "node_id"))
    return chosen.select(graph, "node_id", place.alias("place")), ranked.join(shown, [graph, "_o"], "left_semi").select(graph, "src", "dst", "relation")
