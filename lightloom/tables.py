"""Scratch tables: how loops and multi-step plans cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder, kept in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="lightloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a Parquet table (with the writer's ``options``) in the shared folder and read back: survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lightloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    spark._jvm.System.gc()  # the context cleaner drops shuffle files only once the driver has collected its garbage
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more."""
    path = getattr(df, "stored_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
