"""Nodes and edges of projects: as two tables, never as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of function definitions, imports and calls of note.
FUNCTIONS = (r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(", r"(?m)^\s*(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+([A-Za-z_]\w*)\s*\([^)]*\)\s*\{")
IMPORTS = (r"(?m)^\s*import\s+([A-Za-z_][\w.]*)", r"(?m)^\s*from\s+([A-Za-z_.][\w.]*)\s+import", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?m)^\s*import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"(?m)^\s*#include\s*[<\"]([^>\"]+)[>\"]")
DANGEROUS = r"\b(eval|exec|system|popen|subprocess|child_process|spawn|shell_exec|passthru|pickle\.loads|yaml\.load|socket|urlopen|requests\.(?:get|post))\b"


def _all(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])))


def extract(files: DataFrame, text: str = "text") -> DataFrame:
    """Add functions (at most 50), imports (50) and apis (30), each once, in order of first sight."""
    t = F.coalesce(F.col(text), F.lit(""))
    return files.withColumns({
        "functions": F.slice(_all(t, FUNCTIONS), 1, 50), "imports": F.slice(_all(t, IMPORTS), 1, 50), "apis": F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(DANGEROUS), F.lit(1))), 1, 30),
    })


def build(files: DataFrame, graph: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: graph, node_id, type, name; edges: graph, src, dst, type) of extracted files."""
    own = F.concat(F.lit("file:"), F.col(path))
    parts = [("functions", "function", "defines", F.concat(F.lit("function:"), F.col(path), F.lit("#"), F.col("x"))), ("imports", "dependency", "imports", F.concat(F.lit("dependency:"), F.col("x"))), ("apis", "dangerous_api", "calls", F.concat(F.lit("api:"), F.col("x")))]
    nodes = files.select(graph, own.alias("node_id"), F.lit("file").alias("type"), F.col(path).alias("name"))
    nodes = nodes.unionByName(files.select(graph, F.concat(F.lit("package:"), F.col(graph).cast("string")).alias("node_id"), F.lit("package").alias("type"), F.col(graph).cast("string").alias("name")))
    edges = files.select(graph, F.concat(F.lit("package:"), F.col(graph).cast("string")).alias("src"), own.alias("dst"), F.lit("contains").alias("type"))
    for column, kind, edge, node_id in parts:
        each = files.select(graph, path, F.explode(column).alias("x"))
        nodes = nodes.unionByName(each.select(graph, node_id.alias("node_id"), F.lit(kind).alias("type"), F.col("x").alias("name")))
        edges = edges.unionByName(each.select(graph, own.alias("src"), node_id.alias("dst"), F.lit(edge).alias("type")))
    return nodes.distinct(), edges.distinct()


def attached(edges: DataFrame, nodes: DataFrame, graph: str) -> DataFrame:
    """Edges whose both ends exist."""
    ids = nodes.select(graph, "node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), [graph, "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), [graph, "dst"], "left_semi")


def degrees(edges: DataFrame, graph: str) -> DataFrame:
    ends = edges.select(graph, F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy(graph, "node_id").agg(F.count("*").alias("degree"))


def histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def features(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """Sizes (log scaled) and ratios of each graph."""
    n = nodes.groupBy(graph).agg(F.count("*").alias("n_nodes"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("file", "function", "dependency", "dangerous_api")])
    e = edges.groupBy(graph).agg(F.count("*").alias("n_edges"), F.count_if(F.col("type") == "calls").alias("n_calls"))
    df = n.join(e, graph, "left").fillna(0, ["n_edges", "n_calls"])
    ratio = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.lit(1), F.col(b)))
    return df.withColumns({"log_nodes": F.log1p("n_nodes"), "log_edges": F.log1p("n_edges"), "api_share": ratio("n_dangerous_api", "n_nodes"), "call_share": ratio("n_calls", "n_edges"), "has_api": F.col("n_dangerous_api") > 0})


def mode_label(rows: DataFrame, graph: str, label: str, seq: str) -> DataFrame:
    """The most frequent label of each graph, the first seen on ties."""
    counts = rows.groupBy(graph, label).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(graph).agg(F.max_by(label, F.struct("n", (-F.col("first")).alias("x"))).alias(label))


def dominant_language(rows: DataFrame, graph: str, lang: str) -> DataFrame:
    """The most frequent language, the greatest name on ties."""
    return rows.groupBy(graph, lang).agg(F.count("*").alias("n")).groupBy(graph).agg(F.max_by(lang, F.struct("n", lang)).alias(lang))


def without_file(nodes: DataFrame, edges: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """For each file of each graph, the graph without it: (nodes, edges), keyed by graph and left_out; nodes that lose their last edge go."""
    files = nodes.filter("type = 'file'").select(graph, F.col("node_id").alias("left_out"))
    e = edges.join(files, graph).filter("src <> left_out AND dst <> left_out")
    alive = e.select(graph, "left_out", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(alive, [graph, "node_id"]), e


def ablation(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """For each file of each graph, what is left without it: graph, left_out, n_nodes, n_edges.

    The sizes of ``without_file`` without its rows: the graph's totals less the file's own edges,
    the file, and the nodes that have edges with nothing but the file.
    """
    other = F.when(F.col("node_id") == F.col("src"), F.col("dst")).otherwise(F.col("src"))
    ends = edges.select(graph, "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id")).withColumn("other", other)
    ends = ends.groupBy(graph, "node_id").agg(F.count("*").alias("own"), F.min("other").alias("a"), F.max("other").alias("b"))
    known = nodes.join(ends, [graph, "node_id"])
    lost = known.filter("a = b AND a <> node_id").groupBy(graph, F.col("a").alias("left_out")).agg(F.count("*").alias("lost"))
    totals = known.groupBy(graph).agg(F.count("*").alias("all_nodes")).join(edges.groupBy(graph).agg(F.count("*").alias("all_edges")), graph)
    files = nodes.filter("type = 'file'").join(ends, [graph, "node_id"], "left").select(graph, F.col("node_id").alias("left_out"), F.coalesce("own", F.lit(0)).alias("own"))
    df = files.join(lost, [graph, "left_out"], "left").join(totals, graph)
    left = F.col("all_nodes") - F.coalesce("lost", F.lit(0)) - F.when(F.col("own") > 0, 1).otherwise(0)
    return df.select(graph, "left_out", left.alias("n_nodes"), (F.col("all_edges") - F.col("own")).alias("n_edges"))
