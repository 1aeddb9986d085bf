"""Query of BPE encoding and decoding."""

from pyspark.sql import functions as F

from linkwright.llm.bpe import bpe
from linkwright.llm.common import table


def tokenizer_path(name="byte_bpe_50k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(coded):
    """The contract's columns of what ``bpe`` returns."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir):
    return digests(bpe(table(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES = {}
