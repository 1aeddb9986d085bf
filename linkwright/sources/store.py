"""Versions of tables: each write goes to folders of its own, and readers see it once a line that names it is published.

A version is whole or not there: its tables are written first, each beside those of earlier versions, and the line,
one small file in ``published``, comes last. A write that fails on the way leaves readers where they were. Readers
take the published line of the highest version and keep its folder, whatever is published meanwhile.

Tables may be dealt out by a key: rows of equal keys then share a bucket, in the same buckets for all tables of one
store, so that joins and groups by that key need no exchange. Their layout is registered with the session's catalog
when a version is read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkwright.storage import delete

PUBLISHED = "version bigint, folder string, tables string"


def _published(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(PUBLISHED).json(f"{path}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str) -> tuple[int, str, dict] | None:
    """(version, folder, tables) of what is published, None before the first version."""
    lines = _published(spark, path)
    top = lines.orderBy(F.desc("version"), F.desc("folder")).first() if lines is not None else None
    return None if top is None else (top["version"], top["folder"], json.loads(top["tables"]))


def _table_name(folder: str, name: str) -> str:
    return "linkwright_" + re.sub("[^0-9a-z]", "_", f"{folder}_{name}".lower())


def publish(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None, buckets: int = 16) -> int:
    """Write ``tables`` as the next version and publish it; those with a key are dealt out by it. Gives the version."""
    keys = dict(keys or {})
    before = current(spark, path)
    version, folder = (before[0] if before else 0) + 1, uuid.uuid4().hex
    layout = {}
    for name, df in tables.items():
        at = f"{path}/versions/{folder}/{name}"
        key = keys.get(name)
        if key is None:
            df.write.parquet(at)
        else:
            # one file for each bucket: the exchange deals rows out as the buckets do
            table = _table_name(folder, name)
            df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", at).saveAsTable(table)
        layout[name] = {"key": key, "buckets": buckets if key else None, "schema": df.schema.json()}
    line = spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.lit(json.dumps(layout)).alias("tables"))
    line.coalesce(1).write.mode("append").json(f"{path}/published")
    return version


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the published version, all of one version."""
    now = current(spark, path)
    if now is None:
        raise ValueError(f"nothing is published at {path}")
    _, folder, layout = now
    out = {}
    for name, how in layout.items():
        at, schema = f"{path}/versions/{folder}/{name}", StructType.fromJson(json.loads(how["schema"]))
        if how["key"] is None:
            out[name] = spark.read.schema(schema).parquet(at)
            continue
        table = _table_name(folder, name)
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{how['key']}`) SORTED BY (`{how['key']}`) INTO {how['buckets']} BUCKETS LOCATION '{at}'")
        out[name] = spark.table(table)
    return out


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the tables of all but the last ``keep`` published versions, whose readers then fail; gives how many went.

    Versions are few, one for each load, so their lines are read by the driver.
    """
    if keep < 1:
        raise ValueError("the published version stays")
    lines = _published(spark, path)
    old = lines.orderBy(F.desc("version"), F.desc("folder")).offset(keep).collect() if lines is not None else []
    for line in old:
        delete(spark, f"{path}/versions/{line['folder']}")
        for name in json.loads(line["tables"]):
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(line['folder'], name)}")
    return len(old)


def counts(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """One row with the number of rows of some published tables."""
    tables = read(spark, path)
    each = [tables[n].agg(F.count(F.lit(1)).alias(n)) for n in names]
    out = each[0]
    for more in each[1:]:
        out = out.join(more, F.lit(True))
    return out
