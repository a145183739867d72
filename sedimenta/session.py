"""Session helpers: the shared folder, tables that cut a lineage, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset a local one is made, but only under a local master: on a cluster executors would write to their
    own disks, so ValueError.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/sedimenta-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path among this application's intermediate tables."""
    return f"{tables_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: lost executors cost a reread, not a recomputation. The table stays until release() or
    clean_up() removes it.
    """
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned and nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = df.__dict__.get("_table_path")
        if path:
            _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables; results that read them must have been written before."""
    if spark.conf.get("spark.checkpoint.dir", None):
        _delete(spark, tables_dir(spark))
