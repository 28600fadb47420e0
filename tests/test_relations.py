"""Matrices, previews, pacing and token windows against plain folds, and odd rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.operators import pacing, relations as rel, windows


def test_positions_dealt_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(rel, "DEAL", 7)
    df = spark.range(200).select((F.col("id") % 3).alias("g"), (F.col("id") * 5).alias("seq"), F.col("id").cast("string").alias("node_id"))
    got = {(r.g, r.seq): r.position for r in rel.numbered(df, "g", "seq").collect()}
    assert got == {(g, i * 5): k for g in range(3) for k, i in enumerate(range(g, 200, 3))}


def test_matrices_of_small_graphs(spark):
    nodes = spark.createDataFrame([(1, 0, "a", "file", "python", "A"), (1, 1, "b", "dangerous_api", None, "EVAL"), (1, 2, "c", "odd", "odd", None), (2, 5, "x", "package", "python", "x"), (2, 9, "y", "file", "python", "y")], "g int, seq int, node_id string, type string, language string, name string")
    edges = spark.createDataFrame([(1, "a", "b", "call"), (1, "a", "a", "import"), (1, "a", "gone", "call"), (1, "a", "b", "odd"), (1, "a", "b", "call"), (3, "a", "b", "call")], "g int, src string, dst string, type string")
    made, links = rel.matrices(nodes, edges, "g", ("python", "unknown"), version=4, apis=("eval",))
    got = {r.node_id: (r.position, {x["index"]: x["value"] for x in r.features}) for r in made.collect()}
    assert got == {"a": (0, {1: 1.0, 4: 1.0, 6: 2.0, 7: 2.0}), "b": (1, {3: 1.0, 5: 1.0, 6: 1.0, 7: 1.0, 8: 1.0}), "c": (2, {}), "x": (0, {0: 1.0, 4: 1.0}), "y": (1, {1: 1.0, 4: 1.0})}
    assert sorted(map(tuple, links.collect())) == [(1, 0, 0, 2), (1, 0, 0, 2), (1, 0, 1, 4), (1, 0, 1, 4), (1, 1, 0, 4), (1, 1, 0, 4), (2, 0, 0, -1), (2, 1, 1, -1)]
    assert rel.dimension(1, ("python",)) == 4 + 1 + 32 + 2 and rel.dimension(7, ("python",), ("eval",)) == 4 + 1 + 2 + 1 + 64
    lexical = nodes.filter("g = 2").withColumn("lexical", F.array(F.lit(0.5), F.lit(0.0), F.lit(0.25)))
    found = rel.matrices(lexical, edges, "g", ("python",), version=7)[0].filter("node_id = 'x'").first().features
    assert [tuple(x) for x in found] == [(0, 1.0), (4, 1.0), (7, 0.5), (9, 0.25)]
    assert rel.matrices(nodes.limit(0), edges, "g", ("python",))[0].count() == 0


def folded(edges, risks, most_nodes, most_edges):
    degree = defaultdict(int)
    for s, d, _ in edges:
        degree[s] += 1
        degree[d] += 1
    order = sorted(edges, key=lambda e: (-max(risks[e[0]], risks[e[1]]), -(degree[e[0]] + degree[e[1]]), e[0], e[1], e[2]))
    nodes, chosen = set(), []
    for e in order:
        if len(nodes | {e[0], e[1]}) > most_nodes:
            continue
        nodes |= {e[0], e[1]}
        chosen.append(e)
        if len(chosen) >= most_edges:
            break
    for n in sorted(risks, key=lambda n: (-risks[n], -degree[n], n)):
        if len(nodes) < most_nodes:
            nodes.add(n)
    return nodes, set(chosen)


def test_preview_is_a_greedy_fold(spark):
    r = random.Random(8)
    nodes, edges, want = [], [], {}
    for g, (n, m) in enumerate([(6, 5), (12, 30), (30, 25), (3, 0), (9, 40)]):
        risks = {f"n{k}": r.randint(0, 3) for k in range(n)}
        own = {(s, d, r.choice("xy")) for s, d in ((r.choice(list(risks)), r.choice(list(risks))) for _ in range(m)) if s != d}
        nodes += [(g, k, v) for k, v in risks.items()]
        edges += [(g, *e) for e in own]
        want[g] = folded(own, risks, 7, 9)
    shown, links = rel.preview(spark.createDataFrame(edges, "g int, src string, dst string, relation string"), spark.createDataFrame(nodes, "g int, node_id string, risk int"), "g", 7, 9)
    got_nodes, got_edges = defaultdict(set), defaultdict(set)
    for x in shown.collect():
        got_nodes[x.g].add(x.node_id)
    for x in links.collect():
        got_edges[x.g].add((x.src, x.dst, x.relation))
    assert all(got_nodes[g] == want[g][0] and got_edges[g] == want[g][1] for g in want)


def let_through(rows, pause):
    state, out = {}, set()
    for job, at, stage, seq in sorted(rows, key=lambda x: (str(x[0]), x[1], x[3])):
        last = state.get(job)
        if last is None or stage != last[0] or at - last[1] >= pause:
            out.add((job, seq))
            state[job] = (stage, at)
        else:
            state[job] = (stage, last[1])
    return out


def test_batch_and_stream_let_the_same_through(spark, tmp_path):
    r = random.Random(5)
    rows = sorted(((r.choice(["a", "b", "c"]), r.randint(0, 400) / 4, r.choice(["s", "s", "s", "s", "t"]), k) for k in range(400)), key=lambda x: (x[1], x[3]))
    rows += [("d", k / 8, "s", 1000 + k) for k in range(120)]
    kind = "job string, at double, stage string, seq long"
    df = spark.createDataFrame(rows, kind).repartition(5)
    want = let_through(rows, 1.0)
    assert {(x.job, x.seq) for x in pacing.throttled(df).collect()} == want and 50 < len(want) < 400
    assert {(x.key, x.seq) for x in pacing.fetched(df.select(F.col("job").alias("key"), "at", "seq"), kept=5.0).collect()} == let_through([(a, b, "", d) for a, b, _, d in rows], 5.0)
    for k, part in enumerate((rows[:150], rows[150:400], rows[400:])):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = pacing.throttled_stream(stream).writeStream.format("memory").queryName("let_through").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert {(x.job, x.seq) for x in spark.table("let_through").collect()} == want
    odd = spark.createDataFrame([(None, 1.0, None, 1), (None, 1.5, None, 2), (None, 2.0, None, 3), ("x", None, "s", 4)], kind)
    assert {(x.job, x.seq) for x in pacing.throttled(odd).collect()} == {(None, 1), (None, 3)} and pacing.throttled(df.limit(0)).count() == 0


def test_windows_of_tokens(spark):
    for n, length, shared, most in ((0, 512, 128, 24), (510, 512, 128, 24), (511, 512, 128, 24), (5000, 512, 128, 24), (20_000, 512, 128, 24), (11, 6, 3, 24)):
        size, step, want, k = length - 2, length - 2 - min(shared, length // 2), [], 0
        while k < most:
            want.append((k, k * step, min(n, k * step + size)))
            if want[-1][2] >= n:
                break
            k += 1
        got = spark.range(1).select(windows.token_windows(F.lit(n), length, shared, most).alias("w")).first().w
        assert [tuple(x) for x in got] == want, n
    rows = spark.createDataFrame([(1, [1.0, -5.0, 2.0, 3.0, -1.0, 2.0], [1, 1, 2, 2, 3, 4]), (2, [], []), (3, None, None), (4, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], list(range(7)))], "id int, s array<double>, l array<int>")
    got = {r.id: tuple(r)[1:] for r in windows.greatest_window(rows, "id", "s", "l", length=6, shared=2).collect()}
    assert got[1] == (2, 1, 6.0, 2, 4) and got[2] == (1, 0, 0.0, None, None) and got[3] == (1, 0, 0.0, None, None) and got[4] == (3, 0, 4.0, 0, 3)
