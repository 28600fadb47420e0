"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder. A local one is made only in local mode, where all is one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quill_ckpt_"))


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def saved(df: DataFrame) -> DataFrame:
    """The frame, computed and written as a table in the shared checkpoint folder, with its lineage cut.

    Small tables come back in few partitions, whatever the number of shuffle partitions.
    The table goes with ``release`` or else when the application ends.
    """
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_saved_at", None)) is not None:
            fs, at = _file_system(df.sparkSession, path)
            fs.delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of the frame has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k = 0
        while (found := name if not k else f"{name}_{k}").lower() in taken:
            k += 1
        taken.add(found.lower())
        out.append(found)
    return out


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the JVM's quick path, which gives the same there."""
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(
        F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
