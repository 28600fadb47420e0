"""Ingest by signature: sources whose files and settings are as before aren't read again.

A source's signature comes from sums over its files, so that it needs no order and tasks combine
it; a source of any number of files is never in one task. A store holds the rows of each run, and
manifests that say for each source in which run its rows are. A manifest counts once the
pointer to it is renamed into place: a run that dies before leaves what was there, and its files unused.

Defined results: null sizes and times count as their own value; a source without files isn't in the
manifest; a source that builds no rows is, with none; rows of a source that is gone are no longer read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.lineage import ensure_folder

MANIFEST = "source string, signature string, n_files long, run string, n_rows long"


def signatures(files: DataFrame, settings: str = "", source: str = "source") -> DataFrame:
    """source, signature, n_files of files (source, path, size, modified)."""
    own = F.sha2(F.concat_ws("|", "path", F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce(F.col("modified").cast("string"), F.lit(""))), 256)
    part = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = files.select(F.col(source).alias("source"), own.alias("_h")).groupBy("source").agg(F.count("*").alias("n_files"), part(1).alias("_a"), part(16).alias("_b"), part(31).alias("_c"), part(46).alias("_d"))
    return sums.select("source", F.sha2(F.concat_ws("|", F.col("n_files").cast("string"), "_a", "_b", "_c", "_d", F.lit(settings)), 256).alias("signature"), "n_files")


def _files(spark: SparkSession, store: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    return spark.sparkContext._jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, store: str) -> DataFrame:
    """The manifest that counts: source, signature, n_files, run, n_rows. Empty where nothing was ingested."""
    jvm, fs = _files(spark, store)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{store}/CURRENT")
    if not fs.exists(pointer):
        return spark.createDataFrame([], MANIFEST)
    name = spark.read.text(f"{store}/CURRENT").first()[0]
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests/{name}")


def _publish(spark: SparkSession, store: str, name: str) -> None:
    jvm, fs = _files(spark, store)
    made, pointer = (jvm.org.apache.hadoop.fs.Path(f"{store}/{x}") for x in (f".{name}", "CURRENT"))
    out = fs.create(made, True)
    out.writeBytes(name)
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, pointer, options)


def ingest(files: DataFrame, build: Callable[[DataFrame], DataFrame], store: str, settings: str = "") -> DataFrame:
    """Bring the store up to date and return its manifest.

    ``build`` makes rows (with a column ``source``) of the files of sources that are new or changed;
    it never sees those of others.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex
    ensure_folder(spark)
    now, before = signatures(files, settings), current(spark, store)
    same = now.join(before.select("source", "signature", "run", "n_rows"), ["source", "signature"])
    changed = now.join(before, ["source", "signature"], "left_anti").checkpoint()
    if changed.isEmpty() and same.count() == before.count():
        return before
    place = f"{store}/rows/{run}"
    build(files.join(changed.select("source"), "source", "left_semi")).write.parquet(place)
    sizes = spark.read.parquet(place).groupBy("source").agg(F.count("*").alias("n_rows"))
    fresh = changed.join(sizes, "source", "left").select("source", "signature", "n_files", F.lit(run).alias("run"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    same.select("source", "signature", "n_files", "run", "n_rows").unionByName(fresh).write.parquet(f"{store}/manifests/{run}")
    _publish(spark, store, run)
    return current(spark, store)


def rows(spark: SparkSession, store: str) -> DataFrame:
    """The rows that the manifest names, from the runs that made them."""
    manifest = current(spark, store)
    runs = [r.run for r in manifest.select("run").distinct().collect()]  # one for each run that still counts
    out = None
    for run in runs:
        part = spark.read.parquet(f"{store}/rows/{run}").join(manifest.filter(F.col("run") == run).select("source"), "source", "left_semi")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "source string")


def recount(spark: SparkSession, store: str, *by: str) -> DataFrame:
    """Counts of the stored rows by columns, without a new ingest."""
    return rows(spark, store).groupBy(*by).agg(F.count("*").alias("n"))
