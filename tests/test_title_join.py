"""Rows of equal keys don't meet each other."""

from linkwright.operators import linkage as L


def test_equal_keys_meet_once(spark):
    """Both sides of the title join are distinct before they meet."""
    t = spark.createDataFrame([("k", ["k"], ["k"])] * 20, "tkey string, title array<string>, artist array<string>")
    m = spark.createDataFrame([("n", ["k"])] * 30, "mkey string, title array<string>")
    pairs = L.exact_title_pairs(t, m)
    assert [tuple(r) for r in pairs.collect()] == [("k", "n")]
    below = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert below.count("Aggregate [") >= 2
