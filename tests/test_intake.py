"""Ingest by signature, and the sample of a stream against that of a batch."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import ingest
from quillspark.streaming import sampling

FILES = "source string, path string, size long, modified long"


def test_only_changed_sources_are_read(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []

    def build(files):
        seen.append(sorted({r.source for r in files.collect()}))
        return files.filter("size > 0").select("source", F.concat("path", F.lit("!")).alias("row"), (F.col("size") % 2).alias("label"))

    files = [("a", "1", 5, 1), ("a", "2", 6, 1), ("b", "3", 7, 1), ("empty", "4", 0, 1), ("b", "5", None, None)]
    df = lambda rows: spark.createDataFrame(rows, FILES)
    assert ingest.current(spark, store).count() == 0 and ingest.rows(spark, store).count() == 0
    first = {r.source: r for r in ingest.ingest(df(files), build, store).collect()}
    assert seen == [["a", "b", "empty"]] and {k: r.n_rows for k, r in first.items()} == {"a": 2, "b": 1, "empty": 0}
    ingest.ingest(df(files[::-1]).repartition(3), build, store)
    assert len(seen) == 1  # nothing changed, whatever the order
    second = {r.source: r for r in ingest.ingest(df([*files[:2], ("b", "3", 7, 2), ("c", "9", 1, 1)]), build, store).collect()}
    assert seen[1] == ["b", "c"] and second["a"].run == first["a"].run and second["b"].run != first["b"].run and "empty" not in second
    assert sorted(r.row for r in ingest.rows(spark, store).collect()) == ["1!", "2!", "3!", "9!"]
    assert {r.source: r.n for r in ingest.recount(spark, store, "source").collect()} == {"a": 2, "b": 1, "c": 1} and len(seen) == 2
    ingest.ingest(df([*files[:2], ("b", "3", 7, 2), ("c", "9", 1, 1)]), build, store, settings="other")
    assert seen[2] == ["a", "b", "c"]


def test_a_run_that_dies_leaves_what_was_there(spark, tmp_path):
    store = str(tmp_path / "store")
    keep = lambda files: files.select("source", "path")
    ingest.ingest(spark.createDataFrame([("a", "1", 5, 1)], FILES), keep, store)

    def dies(files):
        return files.select("source", F.raise_error(F.lit("dies")).cast("string").alias("path"))

    with pytest.raises(Exception, match="dies"):
        ingest.ingest(spark.createDataFrame([("a", "2", 5, 1)], FILES), dies, store)
    assert [r.path for r in ingest.rows(spark, store).collect()] == ["1"]


def test_sample_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    ids = [*range(500), *range(100, 300), None]
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string")
    want = [(str(r.id), r.hash) for r in sampling.sample(rows, "id", 40).collect()]
    assert len(want) == 40 and [h for _, h in want] == sorted(h for _, h in want)
    parts = rows.repartition(4).withColumn("_p", F.spark_partition_id())
    for k in range(4):
        parts.filter(F.col("_p") == k).drop("_p").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    said = []
    query = sampling.sample_stream(sampling.clean_only(stream, "text"), "id", 40).writeStream.foreachBatch(lambda df, _: said.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(150)
    shards = spark.createDataFrame(said, "shard int, seen long, hash string, id string")
    assert [(r.id, r.hash) for r in sampling.merged(shards, 40).collect()] == want


def test_hidden_characters_end_the_pass(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, None)], "id long, text string")
    assert sampling.clean_only(rows, "text").count() == 2
    with pytest.raises(Exception, match="202e"):
        sampling.clean_only(rows.unionByName(spark.createDataFrame([(3, "a‮b")], rows.schema)), "text").collect()
    labels = spark.createDataFrame([(1, "a  b", 0), (2, "a b ", 1), (3, "c​", None), (4, None, 1), (5, "", 1)], "id long, text string, label int")
    assert tuple(sampling.summary(labels, "id", "text", "label").first()) == (5, 1, 3, 1, 1)
