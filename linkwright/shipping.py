"""Sends this package's modules to the executors, for the functions that run in Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def ship(spark: SparkSession) -> None:
    """Once for each application: executors may not have this package installed."""
    context = spark.sparkContext
    if getattr(context, "_linkwright_shipped", False):
        return
    top = Path(__file__).parent
    handle, name = tempfile.mkstemp(prefix="linkwright-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(name)
    context._linkwright_shipped = True


def arrow_map(df: DataFrame, batches: Batches, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(batches, schema)


def arrow_helper(f: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """A column function of Arrow arrays with this package at hand."""
    ship(SparkSession.active())
    return F.arrow_udf(f, kind)


def slices(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most, so that what is made of one stays small."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
