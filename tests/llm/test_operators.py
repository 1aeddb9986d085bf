"""Each operator against a brute-force version on a small table, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkwright.llm import bpe, byte_cnn, exact_dedup, jaccard_join, language_id, line_dedup, mixing, quality_rules, suffix_dedup, toxicity
from linkwright.llm.q05 import digests, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", None if sources is None else sources[i], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


LONG = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, copies, repeated rows, columns whose names the operators use themselves."""
    rows = [(0, None), (1, ""), (2, LONG), (3, LONG), (4, "  \n\n "), (5, "a b"), (6, "a b"), (6, "a b"), (None, "no id at all here"), (None, None), (7, "x\x00y <|endoftext|> z\r\n\t 日本語 😀")]
    df = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "x", 5) for i, t in rows], COLUMNS + ", name int, node int, _id int, score string, slot int")
    return df.withColumnRenamed("name", "root")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (5, 1, 0), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, {r.doc_id: r.text for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- 1: language ID ----


def test_language_id(spark, real, awkward):
    df, _ = real
    got = language_id.identify_documents(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.98 * len(got)
    assert all(r.kept for r in got)
    rows = language_id.identify_documents(awkward).collect()
    assert len(rows) == awkward.count() and not any(r.kept for r in rows)  # no labelled rows
    assert language_id.identify_documents(empty(spark)).count() == 0


def test_language_id_weighs_evidence(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    declared = language_id.page_evidence(pages)
    got = language_id.identify_pages(pages).join(declared, "page_id").collect()
    assert len(got) == pages.count() and sum(r.language == r.declared for r in got) >= 0.98 * len(got)
    ev = language_id.page_evidence(spark.createDataFrame([(1, "https://blog.x.example.de/fr/a?b", '<html lang="FR-be"><script>x</script><p>Le &amp; la</p>'), (2, None, None)], "page_id long, url string, html string")).collect()
    assert (ev[0].declared, ev[0].host, ev[0].suffix, ev[0].text.split()) == ("fr", "blog.x.example.de", "de/fr", ["Le", "la"])
    assert (ev[1].declared, ev[1].host, ev[1].suffix) == (None, None, None)
    # without text, the host's other rows decide
    df, extra = spark.read.parquet(f"{sf_dir}/documents.parquet"), [(10_000, "", None, "host.de", 0), (10_001, None, None, None, 0)]
    hosted = df.withColumn("source", F.concat(F.lit("host."), "lang"))
    both = hosted.unionByName(spark.createDataFrame(extra, COLUMNS))
    out = {r.doc_id: r for r in language_id.identify_documents(both).where("doc_id >= 10000").collect()}
    assert out[10_000].language == "de" and out[10_001].language == "und" and not out[10_001].kept


def test_every_labelled_language_has_a_model(spark):
    """Forty languages of made-up words, the smallest ones past the first 32."""
    rng = random.Random(9)
    rows, at = [], 0
    for k in range(40):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
        for _ in range(30 if k < 32 else 12):
            rows.append((at, " ".join(rng.choice(own) for _ in range(60)), f"l{k:02}", None, 0))
            at += 1
    got = language_id.identify_documents(spark.createDataFrame(rows, COLUMNS)).collect()
    want = {r[0]: r[2] for r in rows}
    assert all(r.language == want[r.doc_id] == r.text_language and r.kept for r in got) and len(got) == len(rows)


def brute_fusion(rows, langs, model):
    """(language, confidence) of rows (text, declared, host, suffix), sum by sum."""
    n, floor, smooth = len(langs) + 1, language_id.FLOOR, language_id.SMOOTH
    ll = model.evidence([(t or "").encode() for t, *_ in rows])
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    post = np.array([soft(x) for x in ll])
    rows = [(t, d if d in langs else None if d is None else "und", h, s) for t, d, h, s in rows]
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None
    shares = lambda sums, prior: (np.maximum(sums, 0) + smooth * prior) / (np.maximum(sums, 0) + smooth * prior).sum()
    out = []
    for i, (t, d, h, s) in enumerate(rows):
        others = lambda f: sum((post[j] for j in range(len(rows)) if j != i and f(rows[j])), np.zeros(n))
        prior = shares(others(lambda r: True), np.full(n, 1 / n))
        if domain(h):
            prior = shares(others(lambda r: domain(r[2]) == domain(h)), prior)
        if h is not None:
            prior = shares(others(lambda r: r[2] == h), prior)
        prior = (1 - floor) * prior + floor * np.eye(n)[-1]
        logs = ll[i] + np.log(prior)
        for k, v in ((1, d), (3, s)):
            if v is not None:
                logs = logs + np.log((others(lambda r: r[k] == v) + 0.5) / (others(lambda r: True) + 0.5 * (n + 1)))
        fused = soft(logs)
        silent = language_id.wordless((t or "").encode()) and d is None and h is None and s is None
        out.append(("und" if silent else [*langs, "und"][int(fused.argmax())], float(fused.max())))
    return out


def test_fusion_by_brute_force(spark):
    rng = random.Random(6)
    own = {k: ["".join(rng.choice(a) for _ in range(5)) for _ in range(25)] for k, a in (("aa", "abcdef"), ("bb", "defghi"), ("cc", "mnopqr"))}
    rows = []
    for i in range(160):
        k = rng.choice(list(own))
        text = " ".join(rng.choice(own[k]) for _ in range(rng.choice([1, 2, 30])))
        text = rng.choice([text, text, text, "12 | 34 || 56 " * 9, "q7w8 z9x1 " * 12, "", None])
        declared = rng.choice([k, k, None, "zz", rng.choice(list(own))])
        host = rng.choice([f"{k}.example.{k}", f"{k}.example.{k}", f"x.example.{k}", "plain", None])
        rows.append((text, declared, host, rng.choice([None, k])))
    rows += [rows[3]] * 4 + [(None, None, None, None), ("12 34 56 78 90 12", None, None, None), ("", "aa", None, None)]
    df = spark.createDataFrame([(i, *r, r[1] if r[1] in own and i % 3 else None) for i, r in enumerate(rows)], "id long, text string, declared string, host string, suffix string, label string")
    col = F.col
    langs, model = language_id.fit(df, col("label"), language_id.body("text"))
    assert langs == ["aa", "bb", "cc"]
    got = {r.id: r for r in language_id.identify(df, "id", col("text"), col("label"), col("declared"), col("host"), col("suffix")).collect()}
    want = brute_fusion(rows, langs, model)
    for i, (language, confidence) in enumerate(want):
        assert got[i].language == language and got[i].confidence == pytest.approx(confidence, abs=1e-6), rows[i]
        assert got[i].kept == (language != "und" and confidence >= language_id.ACCEPT)
    assert len({x for x, _ in want}) == 4
    # without text and other evidence all languages tie: the first one wins
    tie = spark.createDataFrame([(0, "", None, "h", None, None), (1, "aaaa aaaa", None, None, None, "aa"), (2, "aaaa aaaa", None, None, None, "bb")], df.schema)
    out = {r.id: r.language for r in language_id.identify(tie, "id", col("text"), col("label"), col("declared"), col("host"), col("suffix")).collect()}
    assert out[0] == "aa"


def test_junk_is_rejected_whatever_is_declared(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = ["123 | 4711 || 0815 | " * 30, "a8f3kq2z9x7b1c4d " * 80, "xqzvkjw qqxz wvkz " * 20]
    extra = spark.createDataFrame([(-1 - i, t, "en", "src1", 0) for i, t in enumerate(junk)] + [(-1, df.first().text, "en", "src1", 0)], COLUMNS)
    docs = df.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    got = language_id.keep_identified(docs)
    # the good row that has a rejected row's doc_id stays
    assert got.columns == docs.columns and got.count() == df.count() + 1 and [r.text for r in got.where("doc_id < 0").collect()] == [df.first().text]


def test_fitting_sample_is_exact(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_FIT", 50)
    rows = [("en", f"text {i}") for i in range(1000)] + [("en", "one copy of many")] * 600 + [("de", f"wort {i}") for i in range(20)] * 3
    labelled = spark.createDataFrame(rows, "lang string, text string").select("lang", F.col("text").cast("binary").alias("text"))
    got = [(r.lang, bytes(r.text)) for r in language_id.fitting_sample(labelled).collect()]
    assert len(got) == len(set(got)) and Counter(lang for lang, _ in got) == {"en": 50, "de": 20}


# ---- 2: lines ----


def brute_lines(texts):
    first, gone = {}, defaultdict(set)
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(w):
                if w in first:
                    gone[i] |= {k, k + 1, k + 2}
                else:
                    first[w] = (i, k)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, t in texts.items()}


def test_line_dedup(spark, real, awkward):
    df, texts = real
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == brute_lines(texts)
    made = {0: "a\nb\nc\nd", 1: "x\na\nb\nc\nd\ny", 2: "a\nb\nc\na\nb\nc", 3: "\n\n\n\n", 4: "\n\n\n\n", 5: None, 6: "a\nb"}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, list(made.values()))).collect()}
    assert got == brute_lines(made) and got[1] == "x\ny" and got[3] == "\n\n\n\n"
    assert line_dedup.dedup_lines(awkward).count() == awkward.count()
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# ---- 3: quality rules ----


def brute_counts(t):
    w, seen, dup = words(t), set(), 0
    for line in (t or "").split("\n"):
        dup += bool(words(line)) and line in seen
        seen.add(line)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_quality_counts(spark, real, awkward, labels):
    df, texts = real
    got = quality_rules.quality_rules(df, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()
    for r in got:
        n = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    out = quality_rules.quality_rules(awkward, labels).collect()
    assert len(out) == awkward.count() and all(r.base_failed for r in out if r.doc_id in (0, 1, 4, 5))
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0


def test_binomial_bounds(spark):
    exact = sum(np.prod([(20 - j) / (j + 1) for j in range(k)]) * 0.1**k * 0.9 ** (20 - k) for k in range(3))
    assert quality_rules.binomial_cdf(2, 20, 0.1) == pytest.approx(exact)
    assert quality_rules.certified(0, 300, 0.01, 0.05) and not quality_rules.certified(0, 298, 0.01, 0.05) and not quality_rules.certified(0, 0, 0.01, 0.05)
    # good documents never have symbols, bad ones do: a cutoff is found and loses no good one
    good, bad = "plain words are here " * 30, "bad# words* are$ here% " * 30
    n = 4000
    docs = documents(spark, [f"{good} {i} {'x' * (i % 7)} y{i * i}" if i % 2 else bad + str(i) for i in range(n)]).withColumn("text", F.col("text"))
    measured = quality_rules.measure(docs).withColumn("n_repeat_words", F.lit(0).cast("long"))
    lab = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    cut, why = quality_rules.certify(measured, lab)
    assert {b for b, w in why.items() if not w.startswith("none")} == {b for b, _ in cut} and len(why) == len(quality_rules.BANDS)
    assert (1, "symbol_rate") in cut and 0 < cut[1, "symbol_rate"] < 1


def brute_cutoffs(rows, max_false, delta):
    """Paths and certification over plain rows (stratum, good, tuning, signals), with fractions."""
    from fractions import Fraction
    from math import comb

    out = {}
    for band in range(len(quality_rules.BANDS)):
        own = [r for r in rows if r["stratum"] == band]
        tune = lambda good, s, c: sum(r["good"] == good and r[s] > c for r in own if r["tuning"])
        setting, stop = {}, False
        good = [r for r in own if r["good"] and not r["tuning"]]
        while not stop:
            options = []
            for n, (s, grid) in enumerate(quality_rules.CUTOFFS.items()):
                for c in grid:
                    if c < setting.get(s, float("inf")):
                        g = tune(1, s, c) - (tune(1, s, setting[s]) if s in setting else 0)
                        b = tune(0, s, c) - (tune(0, s, setting[s]) if s in setting else 0)
                        if b > quality_rules.COST * g:
                            options.append((g, -b, n, -c, s))
            if not options:
                break
            _, _, _, c, s = min(options)
            setting = setting | {s: -c}
            lost = sum(any(r[x] > y for x, y in setting.items()) for r in good)
            p = Fraction(str(max_false))
            tail = sum(comb(len(good), k) * p**k * (1 - p) ** (len(good) - k) for k in range(lost + 1))
            stop = not good or tail > Fraction(str(delta)) / len(quality_rules.BANDS)
            if not stop:
                out[band, s] = -c
    return out


def test_cutoffs_by_brute_force(spark):
    rng = random.Random(8)
    bits = "the river runs under an old bridge of stone and wood near town".split()
    texts, labels_ = [], []
    for i in range(1500):
        good = rng.random() < 0.6
        n = rng.choice([60, 250, 700])
        w = [rng.choice(bits) + str(rng.randrange(500)) for _ in range(n)]
        noise = 0.02 if good else rng.choice([0.02, 0.3, 0.6])
        kind = rng.choice(["#", "!", "up"])
        w = [x.upper() if rng.random() < noise and kind == "up" else x + kind if rng.random() < noise and kind != "up" else x for x in w]
        texts += [" ".join(w)] * (3 if i % 50 == 0 else 1)
        labels_ += [int(good)] * (3 if i % 50 == 0 else 1)
    docs = documents(spark, texts)
    lab = spark.createDataFrame(list(enumerate(labels_)), "doc_id long, quality int")
    measured = quality_rules.measure(docs)
    rows = quality_rules.labelled_texts(measured, lab).withColumns(quality_rules.signals()).withColumn("stratum", quality_rules.stratum()).collect()
    assert len(rows) == len(set(texts))  # copies count once
    for max_false in (0.02, 0.05):
        cut = quality_rules.choose_cutoffs(measured, lab, max_false)
        assert cut == brute_cutoffs(rows, max_false, 0.05)
    assert len({s for _, s in cut}) > 1
    # certified cutoffs take effect
    out = quality_rules.quality_rules(docs, lab, 0.05).join(lab, "doc_id").collect()
    values = {r.doc_id: r for r in measured.withColumns(quality_rules.signals()).collect()}
    for r in out:
        assert set(r.failed_rules) == {s for (b, s), c in cut.items() if b == r.stratum and values[r.doc_id][s] > c} and r.kept == (not r.base_failed and not r.failed_rules)
    assert sum(not r.kept for r in out if not r.quality) > 100 and sum(not r.kept for r in out if r.quality) <= 0.05 * sum(r.quality for r in out)


def test_a_certificate_says_why_there_is_none(spark):
    least = quality_rules.least_texts(0.02, 0.05 / len(quality_rules.BANDS))
    assert quality_rules.certified(0, least, 0.02, 0.05 / len(quality_rules.BANDS)) and not quality_rules.certified(0, least - 1, 0.02, 0.05 / len(quality_rules.BANDS))
    docs = documents(spark, ["word " + " ".join(f"w{k}x{i}" for k in range(30)) for i in range(8)])
    lab = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    for labels in (lab, lab.where("false")):
        got = quality_rules.quality_rules(docs, labels).collect()
        assert all(r.kept and r.certificate.startswith("none: ") and f"of {least} good" in r.certificate for r in got)


# ---- 4: toxicity ----


def test_toxicity(spark, awkward, labels):
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice("the of and river house green walk table seven open door light".split()) for _ in range(40))
    texts = [plain() + (f". you are a blarg{rng.choice('aeiou')} {plain()}" if i % 5 == 0 else "") for i in range(400)]
    docs = documents(spark, texts)
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, lab).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(300, 400))
    out = toxicity.toxicity(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(empty(spark), no_labels(spark)).count() == 0


def test_grammar_composes():
    g = toxicity.Grammar({"blarg": 6.0, "stem*": 5.0})
    names = lambda t: [[n for n, _ in c] for c in g.clauses(t)]
    assert names("you blarg") == [["targeted"]] and names("a blarg") == [["insult"]] and names("stemming up") == [["insult"]]
    assert names("he is not a blarg") == [["negated"]] and names("not one two three a blarg") == [["insult"]]
    assert names("she said he is a blarg. blarg") == [["reported"], ["insult"]]
    assert names("i will kill you") == [["threat"]] and names("you i will kill") == [["threat"]] and names("nothing here") == []


def test_threats_before_and_after_their_target(spark):
    g = toxicity.Grammar({"blarg": 6.0})
    names = lambda t: [[n for n, _ in c] for c in g.clauses(t)]
    for text in ("i will kill you", "kill him", "you i will kill", "ich werde dich töten"):
        assert names(text) == [["threat"]], text
    assert names("blarg that you are") == [["targeted"]] and names("kill the lights") == [] and names("kill the lights, you") == []
    assert names("i will not kill you") == [] and names("she said i will kill you") == []
    # who acts is no object, and what third persons do is told
    assert names("you can destroy the object and kill the process in one step") == [] and names("they murder him in chapter two of the novel") == []
    assert names("you can run but i will kill you") == [["threat"]] and names("they are blarg") == [["targeted"]] and names("you can be a blarg") == [["targeted"]]
    plain = ["the river and the green table walk over an open door " * 3 + str(i) for i in range(60)]
    docs = documents(spark, [t + (". you are a blarg" if i % 5 == 0 else "") for i, t in enumerate(plain)] + ["i will kill you", plain[1] + ". kill him"])
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    for known in (lab, no_labels(spark)):
        got = {r.doc_id: r.score for r in toxicity.toxicity(docs, known).collect()}
        assert got[60] >= 0.7 and got[61] >= 0.7 and got[1] < 0.7


def brute_patterns(kinds):
    """Patterns of symbols (clauses end at "end"), rule by rule, without any machine."""
    out, any_insult, clauses = [], False, [[]]
    for k in kinds:
        clauses.append([]) if k == "end" else clauses[-1].append(k)
    for c in clauses:
        for i, k in enumerate(c):
            # a reach counts from its last negation
            last = max((j for j in range(i) if c[j] == "negation"), default=-10)
            negated, reported, addressed = i - last <= toxicity.REACH, "report" in c[:i], "target" in c or "third" in c
            acted_on = any(x == "target" and y != "modal" for x, y in zip(c, [*c[1:], "end"]))
            if k == "insult":
                name = "reported" if reported else "negated" if negated else "targeted" if addressed else "again" if any_insult else "insult"
                any_insult |= name in ("insult", "targeted")
                out.append(name)
            elif k == "threat" and acted_on and not negated and not reported and "third" not in c[:i]:
                out.append("threat")
    return out


def test_machine_agrees_with_its_rules():
    word = {"insult": "blarg", "threat": "kill", "target": "you", "third": "they", "modal": "can", "negation": "not", "report": "said", "other": "tree", "end": "."}
    g, rng = toxicity.Grammar({"blarg": 6.0}), random.Random(11)
    for _ in range(3000):
        kinds = [rng.choice(toxicity.KINDS) for _ in range(rng.randrange(14))]
        got = [n for c in g.clauses(" ".join(word[k] for k in kinds)) for n, _ in c]
        assert got == brute_patterns(kinds), kinds


def test_lone_words_stay_below(spark):
    plain = ["what a river and the green table walk over an open door " * 3 + str(i) for i in range(150)]
    docs = documents(spark, [t + (". what a blarg" if i % 5 == 0 else "") for i, t in enumerate(plain)] + ["what a blarg", "what a blarg. blarg", "you are a blarg", "not a blarg", "she said you are a blarg"])
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, lab).collect()}
    assert got[1] < got[150] < 0.7 <= got[151] and got[152] >= 0.7 and got[153] < 0.7 and got[154] < 0.7


# ---- 5: BPE ----


def test_bpe(spark, real, awkward):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    df, texts = real
    for frame in (df, awkward):
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            text = t.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in digests(bpe.bpe(frame, tokenizer_path())).collect()) == want
    assert bpe.bpe(empty(spark), tokenizer_path()).count() == 0


def test_bpe_gives_a_batch_back_by_chunks(spark, monkeypatch):
    """A worker holds what it makes of a chunk, not of all rows of a batch; each piece keeps its own doc_ids."""
    texts = [None if k % 7 == 0 else f"row {k} of many " * (k % 5) for k in range(2500)] + ["long text " * 150_000, "", "end"]
    docs, kept = documents(spark, [""]), []
    monkeypatch.setattr(bpe, "arrow_map", lambda rows, batches, schema: kept.append(batches))
    bpe.bpe(docs, tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts])], ["doc_id", "text"])
    pieces = list(kept[0](iter([batch])))
    assert max(p.num_rows for p in pieces) <= 1000
    assert all(p.num_rows == 1 or sum(map(len, p["decoded"].to_pylist())) <= bpe.CHUNK_CHARS for p in pieces)
    whole = pa.Table.from_batches(pieces)
    assert whole["doc_id"].to_pylist() == list(range(len(texts))) and whole["decoded"].to_pylist() == [t or "" for t in texts]
    own = bpe.coder(open(tokenizer_path(), encoding="utf-8").read())
    assert whole["ids"].slice(0, 2500).to_pylist() == own.encode([t or "" for t in texts[:2500]])


def test_bpe_on_random_strings():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokenizer_path()), bpe.TrieBpe(open(tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(5)
    texts = ["".join(rng.choice("aaabbcthe  n\n'sé1日") for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 3000, "<|endoftext|>" * 3]
    got = own.encode(texts)
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in got] == texts


# ---- 6: exact dedup ----


@pytest.mark.parametrize("block", [4, 8192])
def test_exact_dedup(spark, real, awkward, block):
    df, texts = real
    by = defaultdict(list)
    for i, t in texts.items():
        by[t or ""].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(df, block_bytes=8192 if block == 8192 else 512).collect()}
    for t, ids in by.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    small = documents(spark, ["abcdabcd", "abcdabcd", "abcdabce", "abcd", "abcdabcdabcd", "abcdabcdabcd", "", "é" * 5, "é" * 5])
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(small, block_bytes=block).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 8, 8: 8}
    out = exact_dedup.exact_groups(awkward).collect()
    assert len(out) == awkward.count()
    assert {r.group_size for r in out if r.doc_id == 6} == {3} and {r.keep_id for r in out if r.doc_id in (2, 3)} == {3} and {r.keep_id for r in out if r.doc_id in (0, 1)} == {1}
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(awkward).columns == awkward.columns


def test_many_values_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_BITS", 2)
    docs = documents(spark, ["same"] * 50 + ["other"] * 3 + [f"t{i}" for i in range(10)])
    got = Counter(r.group_size for r in exact_dedup.exact_groups(docs).collect())
    assert got == {50: 50, 3: 3, 1: 10}


# ---- 7: passages ----


def brute_passages(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen[w] = 1
        out[i] = bytes(c for c, g in zip(b, gone) if not g)
    return out


@pytest.mark.parametrize("hot", [2048, 2])
def test_suffix_dedup(spark, real, awkward, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    df, texts = real
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_passages(df).collect()} == brute_passages(texts)
    rng = random.Random(hot)
    base = "".join(rng.choice("abc") for _ in range(500))
    made = [base, base[50:300] + "X" + base[200:450], "z" * 350, base[100:200], base[100:199], "\0" * 260, "", None, "ab" * 200]
    made += ["".join(rng.choice("xyz") for _ in range(40)) + base[150:290] + "".join(rng.choice("xyz") for _ in range(40)) for _ in range(12)]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_passages(documents(spark, made)).collect()}
    assert got == brute_passages(dict(enumerate(made)))


def test_suffix_dedup_awkward(spark, awkward):
    out = suffix_dedup.dedup_passages(awkward).collect()
    assert len(out) == awkward.count() and {r.n_bytes - len(r.kept) for r in out if r.doc_id == 3} == {len(LONG)}
    assert suffix_dedup.dedup_passages(empty(spark)).count() == 0


def test_suffix_dedup_of_equal_and_missing_ids(spark):
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b, shared = own(400), own(400), own(150)
    rows = [(1, a), (1, b), (None, own(300)), (None, own(50) + shared), (5, own(60) + shared + own(60)), (6, a[100:300]), (6, a[100:300]), (7, own(200) + b[200:350])]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], COLUMNS)
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup_passages(docs).collect())
    cut = {4: rows[4][1].replace(shared, ""), 5: "", 6: "", 7: rows[7][1][:200]}
    assert got == Counter((i, len(t), cut.get(k, t).encode()) for k, (i, t) in enumerate(rows))


def test_suffix_dedup_of_texts_longer_than_a_segment(spark, monkeypatch):
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefgh") for _ in range(2000))
    made = {0: base, 1: "x" * 37 + base[:1500], 2: base[700:] + base[:900], 3: "y" * 1200}
    for size in (256, 333, 1 << 24):
        assert [p[: size] for p in suffix_dedup.segments(b"z" * 50)] == [b"z" * 50]
        monkeypatch.setattr(suffix_dedup, "SEGMENT", size)
        parts = suffix_dedup.segments(base.encode())
        assert b"".join(p[:size] for p in parts[:-1]) + parts[-1] == base.encode()
    # workers take the value from the module, so the segments are cut here as they cut them
    for size in (256, 333):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", size)
        batch = [[(i, len(t)) for i, t in made.items()]]
        starts = sorted((i, k * size + int(p)) for i, t in made.items() for k, part in enumerate(suffix_dedup.segments(t.encode())) for _, p, n, _, _ in zip(*suffix_dedup.spans([part])) for p in range(p, p + n))
        assert starts == [(i, p) for i, t in made.items() for p in range(len(t) - 99)] and batch
    monkeypatch.undo()
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_passages(documents(spark, list(made.values()))).collect()}
    assert got == brute_passages(made)


@pytest.mark.parametrize("rows", [1, 3, 50])
def test_settling_streams_through_anchors(rows, monkeypatch):
    """The same spans come out of any batches; no more than HOT different ones of an anchor share a shard."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "arrow_map", lambda df, f, kind: f)
    rng = random.Random(14)
    made = sorted((rng.randrange(6), rng.randrange(9), rng.randrange(30), 0, rng.randrange(5)) for _ in range(160))
    table = [suffix_dedup._batch(**{c: np.array([r[k] for r in made[a : a + rows]], np.int64) for k, c in enumerate(("ah", "sh", "doc", "sub", "pos"))}, n=np.ones(len(made[a : a + rows]), np.int64), kind=np.zeros(len(made[a : a + rows]), np.int64)) for a in range(0, len(made), rows)]
    out = [r for b in suffix_dedup.settle(None)(iter(table)) for r in pa.Table.from_batches([b]).to_pylist()]
    first = {}
    for ah, sh, *place in made:
        first.setdefault((ah, sh), tuple(place))
    gone = Counter((r["doc"], r["sub"], r["pos"]) for r in out if r["kind"] == 1)
    assert gone == Counter(tuple(place) for ah, sh, *place in made if tuple(place) != first[ah, sh])
    shards = defaultdict(list)
    for r in out:
        if r["kind"] == 2:
            shards[r["ah"], r["sh"]].append((r["doc"], r["sub"], r["pos"]))
    by = defaultdict(list)
    for (ah, _), place in first.items():
        by[ah].append(place)
    for ah, places in by.items():
        dealt = [p for (a, _), ps in shards.items() if a == ah for p in ps]
        assert Counter(dealt) == Counter(places if len(places) > 1 else [])
        assert all(len(ps) <= 4 and (s >= 0) == (len(places) > 4) for (a, s), ps in shards.items() if a == ah)


def test_suffix_array():
    rng = random.Random(1)
    for size, letters in ((300, "ab"), (400, "a"), (257, "abcdefgh")):
        s = bytes(ord(rng.choice(letters)) for _ in range(size))
        order, _ = suffix_dedup.suffix_array(np.frombuffer(s, np.uint8), 1 << 12)
        padded = [s[k:] for k in order]
        assert sorted(order.tolist()) == list(range(size)) and padded == sorted(padded)
        reach = suffix_dedup.reaches(np.frombuffer(s, np.uint8), order)
        assert reach.tolist() == [k > 0 and len(padded[k]) >= 100 and padded[k - 1][:100] == padded[k][:100] for k in range(size)]


# ---- 8: mixing ----


def test_mixing(spark, awkward):
    parts = {"a": 5, "b": 3, "c": 1}
    sources = ["a" if i % 3 else "b" if i % 2 else "c" if i % 4 else None for i in range(600)]
    docs = documents(spark, ["t"] * 600, sources)
    rows = sorted(mixing.mix(docs, parts, 1, 4).collect(), key=lambda r: (r.mix_slot, r.mix_offset))
    assert len(rows) == 600 and len({(r.mix_slot, r.mix_offset) for r in rows}) == 600
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    share = parts | {None: 1}
    blocks = {s: len({r.mix_block for r in rows if r.mix_stratum == s}) for s in share}
    end = min((blocks[s] * 10 // w) for s, w in share.items())
    slot = {r.mix_slot: r.mix_stratum for r in rows}
    for t in range(1, end):
        for s, w in share.items():
            assert abs(sum(slot.get(x) == s for x in range(t)) - t * w / 10) < 1
    assert mixing.mix(awkward, parts).count() == awkward.count() and mixing.mix(empty(spark), parts).count() == 0
    places = mixing.placed(awkward, parts)
    assert places.columns == [*awkward.columns, "mix_slot", "mix_offset"] and places.count() == awkward.count()
    with pytest.raises(ValueError):
        mixing.cycle(spark, {"a": 0}, 1)


# ---- 9: classifier ----


def test_byte_cnn(spark, awkward, labels):
    rng = random.Random(2)
    text = lambda good: " ".join(rng.choice("the river runs under an old bridge of stone".split()) + ("" if good else "###") for _ in range(60))
    docs = documents(spark, [text(i % 2) for i in range(300)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in byte_cnn.classify(docs, lab).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200, 300))
    out = byte_cnn.classify(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in byte_cnn.classify(awkward, no_labels(spark)).collect()} == {0.5}
    assert byte_cnn.classify(empty(spark), labels).count() == 0


def test_gradients_and_pooling():
    rng = np.random.default_rng(0)
    texts, y = [b"abc" * 700, b"", b"xyz#" * 20], np.array([1.0, 0.0, 1.0])
    w = byte_cnn.fit(texts, y, epochs=1)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    loss = lambda w: -np.mean([np.log(p if t else 1 - p) for p, t in zip(plain(w, texts), y)])

    def plain(w, texts):
        out = []
        for t in texts:
            b = np.frombuffer(t + b"\0" * byte_cnn.WIDTH, np.uint8)
            act = np.maximum(sum(w["conv"][k][b[k : len(b) - byte_cnn.WIDTH + 1 + k]] for k in range(byte_cnn.WIDTH)) + w["bias"], 0)
            halves = [act[a : a + byte_cnn.HALF] for a in range(0, len(act), byte_cnn.HALF)]
            top = np.array([h.max(0) for h in halves])
            nxt = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
            chunk = np.maximum(top, top[nxt])
            f = np.concatenate([chunk.max(0), chunk.mean(0)])
            out.append(byte_cnn.sigmoid(np.tanh(f @ w["in"] + w["in_bias"]) @ w["out"] + w["out_bias"][0]))
        return np.array(out)

    assert byte_cnn.Network(w).scores(texts) == pytest.approx(plain(w, texts), abs=1e-4)
    alone = [byte_cnn.Network(w).scores([t])[0] for t in texts]
    assert byte_cnn.Network(w).scores(texts) == pytest.approx(alone, abs=1e-6)  # neighbours don't matter
    g = byte_cnn.gradients(w, texts, y, np.ones(3))
    for name in ("in", "out", "in_bias"):
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=1e-3)


def test_gradients_of_filters():
    """Numeric gradients of all weights in double precision, with maxima that two chunks share."""
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefgh #!", np.uint8)
    texts = [letters[rng.integers(0, len(letters), n)].tobytes() for n in (3000, 40, 700, 0, 1100)]
    y, weight = np.array([1.0, 0.0, 1.0, 0.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0, 1.5])
    w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in byte_cnn.fit(texts, y, epochs=1).items()}

    def loss(w):
        buf, starts, stops, first = byte_cnn.layout(texts)
        n = len(buf) - byte_cnn.WIDTH
        act = np.maximum(sum(w["conv"][k][buf[k : n + k]] for k in range(byte_cnn.WIDTH)) + w["bias"], 0)
        feats, _ = byte_cnn.combine(byte_cnn.pooled(act, starts, stops), first)
        p = byte_cnn.sigmoid(np.tanh(feats @ w["in"] + w["in_bias"]) @ w["out"] + w["out_bias"])
        return -np.mean(weight * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    g = byte_cnn.gradients(w, texts, y, weight)
    seen = [(k, b, f) for k in (0, 2, 5) for b in (ord("a"), ord("#"), 0) for f in (0, 7, 15)]
    places = {"conv": seen, "bias": [(f,) for f in range(byte_cnn.FILTERS)], "in": [(0, 0), (20, 3), (30, 5)], "in_bias": [(1,)], "out": [(2,)], "out_bias": [(0,)]}
    for name, where in places.items():
        assert any(g[name][at] for at in where)
        for at in where:
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-3, abs=1e-6), (name, at)


def test_long_labelled_texts_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(byte_cnn, "MAX_FIT_BYTES", 90_000)
    docs = documents(spark, ["x" * 50_000, "y" * 10, "y" * 20, "x" * 30_000]).unionByName(documents(spark, ["x" * 50_000]))
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    texts, y = byte_cnn.fitting_sample(docs, lab, "quality")
    assert sorted(map(len, texts)) == [10, 20, 30_000, 50_000] and len(y) == 4
    monkeypatch.setattr(byte_cnn, "MAX_FIT_BYTES", 60_000)
    assert sum(map(len, byte_cnn.fitting_sample(docs, lab, "quality")[0])) <= 60_000


def test_a_text_beyond_the_bound_is_passed_over(spark, monkeypatch):
    """Whatever comes first in the order, texts of both labels are fitted."""
    monkeypatch.setattr(byte_cnn, "MAX_FIT_BYTES", 4_000)
    first = min(range(60), key=byte_cnn.hash_order)
    docs = documents(spark, ["x" * 5_000 if i == first else "y" * 60 for i in range(60)])
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    texts, y = byte_cnn.fitting_sample(docs, lab, "quality")
    assert len(texts) == 59 and set(y) == {0.0, 1.0}
    monkeypatch.setattr(byte_cnn, "MAX_FIT_BYTES", 50)
    texts, y = byte_cnn.fitting_sample(docs, lab, "quality")
    assert sorted(map(len, texts)) == [60, 60] and set(y) == {0.0, 1.0}


# ---- 10: Jaccard join ----


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    links, root = Counter(), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def test_jaccard_join(spark, real, awkward):
    df, texts = real
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == brute_classes(texts)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    made = {}
    for i in range(150):  # one large group of near copies, with copies among them, and others that share a passage
        if i < 100:
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(200)] = f"n{rng.randrange(50)}"
        else:
            w = base[:30] + [f"x{rng.randrange(100_000)}" for _ in range(150)]
        made[i] = " ".join(w)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(documents(spark, list(made.values()))).collect()}
    assert got == brute_classes(made)
    out = jaccard_join.jaccard_classes(awkward).collect()
    assert len(out) == awkward.count() and {r.n_links for r in out if r.doc_id == 6} == {2} and {r.n_links for r in out if r.doc_id in (0, 1, 4)} == {0}
    assert jaccard_join.jaccard_classes(empty(spark)).count() == 0


def token_rows(texts):
    """The sets of runs of five words as numbers, and which sets hold each number."""
    number, sets = {}, {}
    for i, t in texts.items():
        w = words(t)
        runs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        sets[i] = {number.setdefault(r, len(number)) for r in runs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    return sets, holders


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_against_all_rows(spark, scale):
    """Queries are the rows whose id is divisible by 50; each link of theirs counts."""
    df = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    sets, holders = token_rows(texts)
    want = {}
    for q in texts:
        if q % 50 == 0:
            both = Counter(i for x in sets[q] for i in holders[x] if i != q)
            want[q] = {i for i, n in both.items() if n >= 0.8 * (len(sets[q]) + len(sets[i]) - n)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(df).collect()}
    links = sum(map(len, want.values()))
    found = sum(got[i][0] == got[q][0] for q, others in want.items() for i in others)
    assert links > 0 and found >= 0.999 * links
    assert sum(got[q][1] == len(others) for q, others in want.items()) >= 0.999 * len(want)


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    base = [f"w{i}" for i in range(150)]
    made = {i: " ".join(base[: 60 + i % 7] + [f"v{i}"] + base[60 + i % 7 :]) for i in range(40)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(documents(spark, list(made.values()))).collect()}
    assert got == brute_classes(made)


def test_near_copies_end_at_the_first_level(spark, monkeypatch):
    """The sets of a large group that leaders cover are not dealt out to deeper nodes again; others are, and lose no link."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    made = {}
    for i in range(420):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(150)] = f"n{rng.randrange(50)}"
        if i >= 300:  # these share a passage with the group and are no copies; every second one is a near copy of the one before
            own = random.Random(i // 2)
            w = base[:40] + [f"x{own.randrange(100_000)}" for _ in range(60)] + [f"y{i}"]
        made[i] = " ".join(w)
    given, sized = [], jaccard_join.sized
    monkeypatch.setattr(jaccard_join, "sized", lambda members: given.append(members.count()) or sized(members))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(documents(spark, list(made.values()))).collect()}
    assert got == brute_classes(made)
    assert sum(given[1:]) < 1.5 * given[0]


def test_trees_hold_the_paths():
    seeds = jaccard_join.mix(np.arange(1, 16, dtype=np.uint64))
    sets = [np.unique(jaccard_join.mix(np.arange(a, a + n, dtype=np.uint64))) for a, n in ((0, 1), (5, 40), (9, 400))]
    found = [jaccard_join.paths(s, seeds) for s in sets]
    for s, tree in zip(sets, jaccard_join.trees_of(found).to_pylist()):
        below = np.uint64(min(2**64 - 1, int(2**64 / (jaccard_join.LAMBDA * len(s)))))
        mix = lambda x: int(jaccard_join.mix(np.array([x % 2**64], np.uint64))[0])
        down = lambda at: [(mix(mix(int(x)) + at)) for x in s if mix(int(x) ^ at) < below]
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        want = [{"node": signed(a), "below": [{"node": signed(b), "below": [{"node": signed(c)} for c in down(b)]} for b in down(a)]} for q in seeds for a in down(int(q))]
        assert tree == want


def test_runs_suffice_where_one_set_contains_the_other():
    meet = 1.0
    for _ in range(jaccard_join.DEPTH):
        meet = 1 - np.exp(-jaccard_join.SIMILARITY / jaccard_join.LAMBDA * meet)
    assert 1 - (1 - meet) ** jaccard_join.runs() >= jaccard_join.RECALL


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    base = [f"w{i}" for i in range(120)]
    made = {i: " ".join(base[: 60 + i % 7] + [f"v{i}"] + base[60 + i % 7 :]) for i in range(70)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(documents(spark, list(made.values()))).collect()}
    assert got == brute_classes(made)
    kept = jaccard_join.keep_one(documents(spark, list(made.values()))).collect()
    assert [r.doc_id for r in kept] == [0]


def test_equal_ids_with_other_texts_stay(spark):
    near = " ".join(f"w{i}" for i in range(90))
    rows = [(1, near), (2, near + " more"), (2, "quite another text of a few words"), (2, "quite another text of a few words"), (None, None), (None, near + " less"), (None, "some other text without an id at all")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], COLUMNS)
    got = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect())
    assert got == Counter(rows[2:])  # of the group of three the row without an id is first
