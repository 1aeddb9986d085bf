"""Personal data: seeds against plain expressions, scores against a plain graph, finds in contexts."""

import hashlib
import random
import re
import time

from linkwright.llm.pii import FOUND_LEAST, KINDS, PATTERN_LEAST, ROUNDS, SUPPORT, candidates, luhn, marked, patterns, personal_data, plain, scored_candidates, seeds

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_seeds(text):
    out = []
    for kind, expression in enumerate(PLAIN):
        for m in re.finditer(expression, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), kind == 2 and 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_seeds_are_those_of_the_plain_expressions():
    rng = random.Random(1)
    parts = ["a", "@", "@b.c", ".", "-", "+", "+1 ", "(", ")", " ", "1", "25", "255", "256", "0000300", "é", "\n", "x.y", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "%", "٣", "٤.5"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert seeds(text) == plain_seeds(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "1." * 500_000, "+1" * 500_000, "+1" + "-" * 1_000_000, "(at) " * 200_000, " at x" * 200_000):
        began = time.time()
        candidates(text, seeds(text))
        assert time.time() - began < 20, text[:10]


def graph(texts):
    """The rounds in plain Python."""
    known, ways, every = {}, {}, {}
    sure_norms = set()
    for text in texts:
        spans = seeds(text)
        for k, s, e in spans:
            sure_norms.add((plain(k, text[s:e]), k))
            for p in patterns(text, s, e):
                known.setdefault((p, k), set()).add(plain(k, text[s:e]))
                every.setdefault(p, set()).add(plain(k, text[s:e]))
        for s, e, kinds in candidates(text, spans):
            for p in patterns(text, s, e):
                every.setdefault(p, set()).add(plain(kinds[0], text[s:e]))
                for k in kinds:
                    ways.setdefault((plain(kinds[0], text[s:e]), k), set()).add(p)
    given = {w: 1.0 for w in ways if w in sure_norms}
    scores = dict(given)
    for _ in range(ROUNDS):
        share = {}
        for p, k in {(p, k) for (_, k), ps in ways.items() for p in ps}:
            sure = known.get((p, k), set())
            more = [scores[n, j] for (n, j), ps in ways.items() if j == k and p in ps and n not in sure and (n, j) in scores]
            s = (len(sure) + sum(more)) / (len(every[p]) + 1)
            if len(sure) + sum(x >= FOUND_LEAST for x in more) >= SUPPORT and s >= PATTERN_LEAST:
                share[p, k] = s
        new = dict(given)
        for (n, k), ps in ways.items():
            miss = 1.0
            for p in ps:
                miss *= 1 - share.get((p, k), 0)
            if any((p, k) in share for p in ps):
                new[n, k] = max(new.get((n, k), 0), 1 - miss)
        scores = new
    return scores


def corpus():
    rng = random.Random(2)
    number = lambda: f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"Please call Ann at +1 212 {number()} today." for _ in range(12)] + [f"Please call Ann at 212 {number()} today." for _ in range(4)]
    texts += [f"Her mail is user{k}@mail.example now." for k in range(12)] + ["Her mail is jo (at) mail (dot) example now.", "Her mail is user3 [at] mail.example now."]
    texts += [f"Order number {number()} was sent." for _ in range(9)] + [f"Order number +1 212 {number()} was sent."]
    texts += ["Look at home dot base then.", "", "Nothing here.", f"Please call Ann at +1 212 {number()} today. Then ring Bo on 212 {number()} tonight."]
    return texts + [f"Then ring Bo on +1 212 {number()} tonight." for _ in range(3)]


def test_finds_and_scores(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, None, "x", 1), (3, texts[3], "x", 1)], "doc_id bigint, text string, base string, row int").repartition(4)
    got = {(r["norm"], r["kind"]): round(r["score"], 9) for r in scored_candidates(marked(docs)).collect()}
    assert got == {w: round(s, 9) for w, s in graph(texts).items()}
    rows = personal_data(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "" if r["doc_id"] is None else texts[r["doc_id"]]
        assert [tuple(s) for s in r["base"]] == plain_seeds(text) and {*r["base"]} <= {*r["spans"]}
        more = [KINDS[s["kind"]] for s in r["spans"] if s not in r["base"]]
        want = ["phone"] * (text.startswith("Please call Ann at 212") or "Bo on 212" in text) + ["email"] * ("(at)" in text or "[at]" in text)
        assert more == want, text


def test_query_on_whole_documents(spark, sf_dir):
    """The contract's columns of every document, from plain expressions."""
    from linkwright.llm.q11 import op11_pii

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op11_pii(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain_seeds(texts[r.doc_id])
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == joined and r.n_found == 0
    assert sum(r.n_card + r.n_email for r in got) > 0


def test_numbers_that_fail_their_check_are_no_candidates():
    assert candidates("card 4111 1111 1111 1112 or 4111111111111112", []) == [] and candidates("card 4111.1111.1111.1111", []) == [(5, 24, [2])]


def test_empty_table(spark):
    assert personal_data(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
