"""Work that grows with a text's length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from linkwright.functions import textkeys as T


@pytest.mark.parametrize("made", [lambda s: F.size(T.trigrams(s)), lambda s: F.size(T.unique_trigrams(s))], ids=["n13", "n14"])
def test_trigrams_of_a_long_text(spark, made):
    """Each trigram used to be looked for from the front of the text, which took minutes for this one."""
    text = "".join(random.Random(1).choices("aé😀b\n", k=400_000))
    rows = spark.createDataFrame([(text,), ("aé😀",)], "s string").repartition(1)
    began = time.time()
    got = sorted(r[0] for r in rows.select(made(F.col("s"))).collect())
    assert time.time() - began < 40
    assert got in ([1, 399_998], [1, len({text[i : i + 3] for i in range(399_998)})])
