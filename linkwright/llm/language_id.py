"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each language: the likelihood of the text; of the declared markup
language and of the address suffix, each estimated by grouped sums of text posteriors over all rows; and the
prior of the host, smoothed towards its domain's (hosts without a dot have none), which is smoothed towards the
whole corpus'. A row's own posterior is taken out of the sums. An undetermined language competes with the others; a
share FLOOR of the prior is always its own, so that text evidence can reject any row.

A text's likelihood has two factors. One is the mean one of its trigrams of letters and spaces, worth as many of them as
are different, EVIDENCE at most, as neighbours and repeated ones depend on each other; the undetermined language has all
of them equally likely. The other is
that of their share among all trigrams of a text with LEAST of them, in COVERAGE bands: texts of digits, marks and keys
are rare in a language and as likely as any in the undetermined one. It counts once for every SPREAD of those trigrams.

The text model has every language with labels, however many, and is fitted on at most MAX_FIT different
texts of each, with counts from a grouped aggregation. It is kept sparse; LANGUAGES_AT_ONCE languages are laid
out as a table at a time. All rows are scored whole. Evidence is an array of one number for each language.

Defined results: a null text, and one of fewer than three bytes, has no text evidence; null labels are not learned
from; missing declarations, suffixes and hosts are no evidence; unknown declared languages are one value; a row without
a trigram of letters and without other evidence is undetermined and rejected; of languages that tie, the first in alphabetical order wins, and the
undetermined one last; each row gives one row, equal rows equal ones; without labelled rows all are undetermined;
a very long text is read whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.bytewords import groups
from linkwright.llm.common import body, materialize, without
from linkwright.shipping import arrow_map

#: Buckets of byte trigrams; different labelled texts of each language; languages in a table.
BUCKETS, MAX_FIT, LANGUAGES_AT_ONCE = 1 << 15, 1500, 32
#: Times that a trigram counts in one fitted text.
REPEATS = 2
#: Trigrams that a text counts for at most; pseudo-rows of smoothing.
EVIDENCE, SMOOTH = 60.0, 5.0
#: Lower bounds of the bands of the share of trigrams that have letters and spaces only; the first band is no such trigram.
COVERAGE = (0.0, 0.05, 0.15, 0.3, 0.5)
#: Trigrams from which their share counts, and that it counts once for.
LEAST, SPREAD = 8, 15.0
#: Share of the prior that stays with the undetermined language.
FLOOR = 0.01
#: Posterior from which a language is accepted.
ACCEPT = 0.5
UNDETERMINED = "und"


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each position but the last two; ASCII capitals count as small letters."""
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


_LETTER = np.zeros(256, bool)
_LETTER[[0x20, 0x27, *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def worded(buf: np.ndarray) -> np.ndarray:
    """Whether the trigram at each position has letters and spaces only: numbers and keys say nothing about the language."""
    ok = _LETTER[buf]
    return ok[:-2] & ok[1:-1] & ok[2:]


def band(worded_: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Band of COVERAGE of some counts of trigrams; the last one has texts of fewer than LEAST."""
    return np.where(of < LEAST, len(COVERAGE) + 1, np.where(worded_ > 0, np.searchsorted(COVERAGE[1:], worded_ / np.maximum(of, 1), "right") + 1, 0))


N_BANDS = len(COVERAGE) + 2


def wordless(text: bytes) -> bool:
    """Whether no trigram has letters and spaces only."""
    return len(text) < 3 or not worded(np.frombuffer(text, np.uint8)).any()


def text_evidence(texts: list[bytes], table: np.ndarray, coverage: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text under each column of ``table`` (trigrams) and ``coverage`` (bands)."""
    out = []
    for some in groups(texts):
        ll = np.zeros((len(some), table.shape[1]))
        full = [k for k, t in enumerate(some) if len(t) > 2]
        if full:
            size = np.array([len(some[k]) for k in full])
            buf = np.frombuffer(b"".join(some[k] for k in full) + b"\0\0", np.uint8)
            at = np.cumsum(size) - size
            on = worded(buf)
            on[at + size - 1] = on[at + size - 2] = False  # they reach into the next text
            code = trigrams(buf)
            own = np.repeat(np.arange(len(full)), size)[on]
            n = np.bincount(own, minlength=len(full))
            different = np.bincount(np.unique(own * BUCKETS + code[on]) // BUCKETS, minlength=len(full))
            mean = np.add.reduceat(table[code] * on[:, None], at, dtype=np.float64) / np.maximum(n, 1)[:, None]
            ll[full] = mean * np.minimum(different, EVIDENCE)[:, None] + coverage[band(n, size - 2)] * (np.minimum(size - 2, EVIDENCE) / SPREAD)[:, None]
        out.append(ll)
    return np.concatenate(out) if out else np.zeros((0, table.shape[1]))


class TextModel:
    """Log-probabilities of buckets under each language, and last under the undetermined one. Unseen buckets of a language share one value."""

    def __init__(self, n: int, k: np.ndarray, b: np.ndarray, count: np.ndarray) -> None:
        """Counts by language k and bucket b; buckets from BUCKETS on count the texts of each band."""
        bands = np.full((N_BANDS, n + 1), 0.5)
        np.add.at(bands[:, :n], (b[b >= BUCKETS] - BUCKETS, k[b >= BUCKETS]), count[b >= BUCKETS])
        self.bands = np.log(bands / bands[:-1].sum(0))
        self.bands[-1] = 0
        k, b, count = (x[b < BUCKETS] for x in (k, b, count))
        order = np.lexsort((b, k))
        self.n, self.k, self.b, self.made = n, k[order], b[order], {}
        total = np.bincount(self.k, count[order], minlength=n) + 0.5 * BUCKETS
        self.unseen = np.append(np.log(0.5 / total), -np.log(BUCKETS))
        self.seen = np.log((count[order] + 0.5) / total[self.k]).astype(np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}}

    def table(self, at: int) -> np.ndarray:
        """The columns from ``at``; one table is kept."""
        if at not in self.made:
            end = min(at + LANGUAGES_AT_ONCE, self.n + 1)
            lo, hi = np.searchsorted(self.k, [at, end])
            t = np.repeat(self.unseen[None, at:end].astype(np.float32), BUCKETS, axis=0)
            t[self.b[lo:hi], self.k[lo:hi] - at] = self.seen[lo:hi]
            self.made = {at: t}
        return self.made[at]

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([text_evidence(texts, self.table(at), self.bands[:, at : at + LANGUAGES_AT_ONCE]) for at in range(0, self.n + 1, LANGUAGES_AT_ONCE)], axis=1)


def fitting_sample(labelled: DataFrame) -> DataFrame:
    """(lang, text) of at most MAX_FIT different texts of each language, in the order of their hashes."""
    hashed = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    different = materialize(hashed.select("lang", "h").distinct(), narrow=True)
    sizes = different.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # about twice as many as are needed come to the task that takes the first ones of a language
    few = different.join(F.broadcast(sizes), "lang").where(F.col("h") / 2.0**64 + 0.5 <= 2.0 * MAX_FIT / F.col("n"))
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= MAX_FIT)
    return hashed.join(F.broadcast(first.select("lang", "h")), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, label: Column, text: Column) -> tuple[list[str], TextModel]:
    """All labelled languages and their text model."""
    labelled = docs.select(label.alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 2))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            by = {}
            for lang, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                n = np.zeros(BUCKETS + N_BANDS, np.int64)
                for t in texts:
                    b = np.frombuffer(t, np.uint8)
                    seen = trigrams(b)[worded(b)]
                    n += np.minimum(np.bincount(seen, minlength=len(n)), REPEATS)
                    n[BUCKETS + band(np.array(len(seen)), np.array(len(b) - 2))] += 1
                at = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "b", "n"])

    found = arrow_map(fitting_sample(labelled), batches, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    number = {lang: k for k, lang in enumerate(langs)}
    k = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
    return langs, TextModel(len(langs), k, found["b"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64))


def soft(logs: Column) -> Column:
    """Normalised probabilities of an array of logarithms."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(raw), lambda a: F.transform(a, lambda x: x / total(a)))[0]


def summed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Text posteriors summed by a key: (key, sums)."""
    got = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(*(F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)))
    return got.select(f"_{key}", F.array(*(F.col(f"s{k}") for k in range(n))).alias(f"sum_{key}"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def towards(sums: Column, prior: Column) -> Column:
    """Shares of sums smoothed by SMOOTH rows of a prior."""
    plus = F.zip_with(sums, prior, lambda s, p: F.greatest(s, F.lit(0.0)) + SMOOTH * p)
    total = F.aggregate(plus, F.lit(0.0), lambda s, x: s + x)
    return F.transform(plus, lambda x: x / total)


def domain_of(host: Column) -> Column:
    """The last two labels of a host, null for one label."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    """The last label of a host, null if it is the only one."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def identify(rows: DataFrame, id_col: str, text: Column, label: Column, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """One row per row: id_col, language, confidence, text_language, kept."""
    langs, model = fit(rows, label, body(text))
    n = len(langs) + 1
    small = rows.select(F.col(id_col).alias("id"), body(text).alias("text"), declared.cast("string").alias("declared"), host.cast("string").alias("host"), suffix.cast("string").alias("suffix"))
    kind = small.schema["id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch["text"].to_pylist()
            own = [pa.array(model.evidence(texts).tolist(), pa.list_(pa.float64())), pa.array([wordless(t) for t in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["declared"], batch["host"], batch["suffix"], *own], ["id", "declared", "host", "suffix", "ll", "wordless"])

    seen = arrow_map(small, batches, f"id {kind}, declared string, host string, suffix string, ll array<double>, wordless boolean")
    seen = seen.withColumn("post", soft(F.col("ll"))).withColumn("domain", domain_of(F.col("host")))
    seen = seen.withColumn("declared", F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit(UNDETERMINED)))
    seen = materialize(seen)
    every = F.array(*(F.lit(1.0 / n) for _ in range(n)))
    whole = seen.agg(*(F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n))).first()  # one number for each language
    out = seen.withColumn("whole", F.array(*(F.lit(float(x or 0.0)) for x in whole)))
    for key in ("host", "domain", "declared", "suffix"):
        out = out.join(materialize(summed(seen, key, n), narrow=True), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    none = F.array(*(F.lit(0.0) for _ in range(n)))
    without = lambda c: add(F.coalesce(c, F.col("post")), F.col("post"), -1)
    overall = towards(without(F.col("whole")), every)
    domain = F.when(F.col("domain").isNotNull(), towards(without(F.col("sum_domain")), F.col("overall"))).otherwise(F.col("overall"))
    prior = F.when(F.col("host").isNotNull(), towards(without(F.col("sum_host")), F.col("of_domain"))).otherwise(F.col("overall"))
    given = lambda key: F.when(  # noqa: E731  likelihood of a value under each language: its sums against all sums
        F.col(key).isNotNull(), F.transform(F.zip_with(without(F.col(f"sum_{key}")), without(F.col("whole")), lambda s, w: (F.greatest(s, F.lit(0.0)) + 0.5) / (F.greatest(w, F.lit(0.0)) + 0.5 * (n + 1))), lambda x: F.log(x))
    ).otherwise(none)
    out = out.withColumn("overall", overall).withColumn("of_domain", domain).withColumn("prior", prior)
    own = F.array(*(F.lit(FLOOR * (k == len(langs))) for k in range(n)))
    out = out.withColumn("prior", F.zip_with("prior", own, lambda p, f: (1 - FLOOR) * p + f))
    logs = add(add(add(F.col("ll"), F.transform("prior", lambda x: F.log(x))), given("declared")), given("suffix"))
    out = out.withColumn("fused", soft(logs))
    best = lambda p: F.get(F.lit([*langs, UNDETERMINED]), F.array_position(p, F.array_max(p)).cast("int") - 1)
    silent = F.col("wordless") & F.col("declared").isNull() & F.col("host").isNull() & F.col("suffix").isNull()
    language = F.when(silent, F.lit(UNDETERMINED)).otherwise(best(F.col("fused")))
    out = out.select(F.col("id").alias(id_col), language.alias("language"), F.array_max("fused").alias("confidence"), best(F.col("post")).alias("text_language"))
    return out.withColumn("kept", (F.col("language") != UNDETERMINED) & (F.col("confidence") >= ACCEPT))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents: ``lang`` is the declared language and labels the fitting sample, ``source`` is the host or the name of one."""
    return identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("lang"), F.col("source"), suffix_of(F.col("source")))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, suffix) of web pages, from html and url."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.col("url"), r"^[a-z+]+://([^/:?#]+)", 1)), F.lit(""))
    folder = F.regexp_extract(F.col("url"), r"^[a-z+]+://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.concat_ws("/", F.substring_index(host, ".", -1), F.nullif(folder, F.lit("")))
    return pages.select("page_id", bare.alias("text"), declared.alias("declared"), host.alias("host"), F.when(F.length(suffix) > 0, suffix).alias("suffix"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Web pages: declared markup language, host and address suffix (top-level domain and language folder)."""
    rows = page_evidence(pages)
    return identify(rows, "page_id", F.col("text"), F.col("declared"), F.col("declared"), F.col("host"), F.col("suffix"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified; of rows that share a doc_id each stays or goes by its own text."""
    # written first: a filter on ``kept`` would otherwise carry copies of all the expressions behind it
    key = F.struct("doc_id", F.xxhash64(body()).alias("hash"))
    found = identify(docs.withColumn("_key", key), "_key", F.col("text"), F.col("lang"), F.col("lang"), F.col("source"), suffix_of(F.col("source")))
    gone = materialize(found).where(~F.col("kept")).select("_key.doc_id", "_key.hash")
    return without(docs, gone, F.col("doc_id"), F.xxhash64(body()))
