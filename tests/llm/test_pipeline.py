"""The pipeline against its stages' brute-force versions."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from test_operators import COLUMNS, brute_classes


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    from linkwright.llm.q05 import tokenizer_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = defaultdict(int)
    for i, t in texts.items():
        last[t] = max(last[t], i)
    left = {i: t for t, i in last.items()}
    left = {i: left[i] for i, (c, _) in brute_classes(left).items() if c == i}
    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, x in left.items():
        ids = t.encode(x, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_columns_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        place = ["mix_slot", "mix_offset"] if name.startswith("mixing") else []
        assert stage(spark, docs, sf_dir).columns == [*docs.columns, *place], name
    none = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def brute_mix(rows, parts, other, block):
    """Places of (doc_id, source), slot by slot: the released block with the earliest deadline runs."""
    share = [*parts.items(), (None, other)]
    q = sum(p for _, p in share)
    due = {s: sorted(i for i, x in rows if (x if x in parts else None) == s) for s, _ in share}
    blocks = {s: [ids[k : k + block] for k in range(0, len(ids), block)] for s, ids in due.items()}
    done, out, t = {s: 0 for s, _ in share}, {}, 0
    while any(done[s] < len(blocks[s]) for s in done):
        _, _, s = min((-(-(done[s] + 1) * q // p), k, s) for k, (s, p) in enumerate(share) if done[s] * q // p <= t)
        if done[s] < len(blocks[s]):
            out |= {i: (t, n) for n, i in enumerate(blocks[s][done[s]])}
        done[s] += 1
        t += 1
    return out


def test_places_in_the_mix_and_a_rejected_document(spark, sf_dir, tmp_path):
    from linkwright.llm.q08 import BLOCK, OTHER, PARTS

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "17 4711 90210", None, None, 13), (900_002, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(extra.columns).unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    got = {r.doc_id: (r.mix_slot, r.mix_offset) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    plain = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    assert set(got) == plain and len(set(got.values())) == len(got)
    assert got == brute_mix([(i, source[i]) for i in plain], PARTS, OTHER, BLOCK)


def test_places_come_from_the_mixing_stage(spark, sf_dir, monkeypatch):
    """Without the stage the documents have no places."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if not s[0].startswith("mixing")])
    assert "mix_slot" not in corpus_pipeline.run(spark, sf_dir).columns


def test_stages_on_awkward_rows(spark):
    """Nulls, repeated ids with equal and other texts, and columns named as the operators' own."""
    near = " ".join(f"w{i}" for i in range(80))
    rows = [(1, near), (1, near), (2, near), (2, "another text of five words"), (None, None), (None, ""), (None, near + " more"), (3, ""), (4, None), (5, "a b"), (6, near + " again")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, "x", 1, 2, "y", 3) for i, t in rows], f"{COLUMNS}, name string, node int, slot int, _id string, mix_slot int").withColumnRenamed("name", "root")
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    least = lambda i: -(2**63) if i is None else i

    identified = stages["language ID"](spark, docs, "")
    assert identified.columns == docs.columns and not seen(identified) - seen(docs)
    assert all(n == seen(docs)[k] for k, n in seen(identified).items())  # repeated rows stay or go together

    deduped = stages["exact dedup"](spark, docs, "")
    top = {}
    for i, t in rows:
        top[t or ""] = max(top.get(t or "", -(2**63)), least(i))
    assert deduped.columns == docs.columns and seen(deduped) == Counter((i, t) for i, t in rows if least(i) == top[t or ""])

    joined = stages["n-gram Jaccard join"](spark, docs, "")
    alike = [(i, t) for i, t in rows if t and t.startswith("w0")]
    assert joined.columns == docs.columns and seen(joined) == Counter([r for r in rows if r not in alike] + [(None, near + " more")])

    placed = stages["mixing sources to target weights"](spark, docs, "")
    assert placed.columns == [*(c for c in docs.columns if c != "mix_slot"), "mix_slot", "mix_offset"] and seen(placed) == seen(docs)

    coded = stages["BPE encoding and decoding"](spark, placed, "").collect()
    assert Counter(r.doc_id for r in coded) == Counter(i for i, _ in rows) and len({(r.mix_slot, r.mix_offset) for r in coded}) == len(rows)
