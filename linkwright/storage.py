"""Tables written to the folder that all executors share, to end lineage and to know sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and all executors are on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="linkwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; tables of narrow rows are written as fewer files."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    at = f"{shared_dir(spark)}/linkwright/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._linkwright_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: whatever was made of them is written too.

    A plan that still reads one of them, if a caller keeps it, fails from then on.
    """
    for table in tables:
        delete(table.sparkSession, table._linkwright_at)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
