"""What the operators share: tables, bytes of texts and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.storage import materialize, release, shared_dir

__all__ = ["body", "materialize", "release", "shared_dir", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: str | Column = "text") -> Column:
    """Whole text as UTF-8 bytes; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(b""))


def without(docs: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """The rows of ``docs`` whose keys are not in ``gone``, whatever their columns are called; nulls are equal."""
    rows = docs.select(F.struct("*").alias("row"), *(k.alias(f"key{i}") for i, k in enumerate(keys)))
    lost = gone.toDF(*(f"lost{i}" for i in range(len(keys)))).distinct()
    same = [F.col(f"key{i}").eqNullSafe(F.col(f"lost{i}")) for i in range(len(keys))]
    return rows.join(lost, same, "left_anti").select("row.*")
