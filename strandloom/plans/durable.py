"""Cutting lineage through files in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder. Where the setting is absent, a local one on a local master (tests), and an error on a cluster."""
    sc = spark.sparkContext
    if (where := sc.getCheckpointDir()) is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-ckpt-"))
        where = sc.getCheckpointDir()
    return where


def durable(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write as Parquet and read again, so that a lost executor costs no recomputation; the files go when the application ends.

    Nothing reads behind a cut, but Spark's cleaner drops shuffle files only when the driver collects garbage; with
    `sweep` it does so here, for chains of cuts that each leave much behind.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/strandloom-{uuid.uuid4().hex}"
    if sweep:
        spark._jvm.System.gc()  # what the cut before left
    df.write.option("compression", "zstd").parquet(path)
    if sweep:
        spark._jvm.System.gc()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """A durable cut bucketed by a key: joins on the key do not shuffle it again, however often it is read.

    The table's name goes at once, as only its files are needed; discard() deletes them.
    """
    spark = df.sparkSession
    name, n = f"strandloom_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{checkpoint_folder(spark)}/strandloom-{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def discard(df: DataFrame) -> None:
    """Delete the files of a durable() result that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/strandloom-" in folder:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
