"""Titles that some artists bring together."""

import random

from pyspark.sql import functions as F

from linkwright.operators import linkage as L
from test_fan_out import written  # noqa: F401


def keys(spark, rng, side, n):
    pick = lambda some, k: rng.sample(some, rng.randint(0, k))
    rows = [(k, pick(["alpha band", "beta crew", "gamma", "delta alpha"], 2), pick(["song alpha", "song", "beta tune", "tune"], 2), pick(["alpha", "beta", "zeta"], 1)) for k in range(n)]
    return L.distinct_keys(L.keyed(spark.createDataFrame(rows, "id bigint, artist array<string>, title array<string>, tags array<string>"), "id", side), side)


def test_compatible_titles(spark, written):  # noqa: F811
    """As by all keys of all artists, without their rows."""
    rng = random.Random(4)
    t, m = keys(spark, rng, "tkey", 400).cache(), keys(spark, rng, "mkey", 400).cache()
    artists = t.select(F.col("who").alias("t_who")).distinct().crossJoin(m.select(F.col("who").alias("m_who")).distinct())
    artists = artists.where(F.xxhash64("t_who", "m_who") % 3 != 0).cache()
    ids = lambda df, side: df.select(F.col("who").alias(f"{side}_who"), F.col("what").alias(f"{side}_what"))
    rows = artists.join(ids(t, "t"), "t_who").join(ids(m, "m"), "m_who").select(*L.MATCHED)
    want = {tuple(r) for r in L.compatible(rows, t, m).select("t_what", "m_what").distinct().collect()}
    got = [tuple(r) for r in L.compatible_titles(artists, t, m).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)
    assert max(written) < rows.count() / 2
