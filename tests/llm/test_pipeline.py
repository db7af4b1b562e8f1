"""The pipeline, stage by stage, against plain Python."""

import re

import numpy as np
import corpus_pipeline
from test_queries import fingerprint, linked

from tilewright.llm import decontaminate, simhash
from tilewright.llm._common import written


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(rows):
    """The least id reachable over links of two bits or of similarity 0.8."""
    of = linked({i: fingerprint(t) for i, t in rows.items()})
    sets = {i: shingles(t) for i, t in rows.items()}
    for a in rows:
        for b in rows:
            if a < b and of[a] != of[b] and (k := len(sets[a] & sets[b])) and k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                low, high = sorted((of[a], of[b]))
                of = {i: low if r == high else r for i, r in of.items()}
    return of


def test_near_copies_of_many_kinds(spark, make):
    """A text and many edits of it, a chain, and texts that only share a passage."""
    random = np.random.default_rng(9)
    words = [f"z{k}" for k in range(3000)]
    base = random.choice(words, 200).tolist()
    rows = {0: base}
    for i in range(1, 40):
        edit = list(base)
        for k in random.choice(200, 1 + i % 3, replace=False):
            edit[k] = f"edit{i}x{k}"
        rows[i] = edit
    for i in range(100, 130):
        rows[i] = random.choice(words, 150).tolist() + base[:60] + random.choice(words, 60).tolist()
    rows = {i: " ".join(w) for i, w in rows.items()}
    left = {r.doc_id for r in simhash.drop_near_copies(make(*rows.items())).collect()}
    assert left == set(alike(rows).values()) == {0, *range(100, 130)}


def test_near_copies_that_share_a_passage(spark, make):
    """Pairs and families of near copies, most of whose words are a passage that all texts have; and two groups that only one text of each joins."""
    random = np.random.default_rng(4)
    words = [f"y{k}" for k in range(5000)]
    passage, rows, n = random.choice(words, 200).tolist(), {}, 0
    for own, many, edits in ((40, 2, 2), (40, 2, 2), (50, 3, 2), (80, 2, 3), (40, 12, 1)) * 8:
        text = random.choice(words, own).tolist() + passage
        for i in range(many):
            edit = list(text)
            for k in random.choice(len(edit), edits if i else 0, replace=False):
                edit[k] = f"edit{n}x{k}"
            rows[n] = " ".join(edit)
            n += 1
    left = {r.doc_id for r in simhash.drop_near_copies(make(*rows.items())).collect()}
    assert left == set(alike(rows).values()) and len(left) < 60


def test_near_copies_with_far_fingerprints(spark, make):
    """Texts of similarity 0.8 whose five-word fingerprints differ in more than 24 bits: nine words, and the first eight of them."""
    random, rows = np.random.default_rng(2), {}
    while len(rows) < 6:
        texts = [" ".join(f"x{k}" for k in random.integers(0, 10**6, 9)) for _ in range(5000)]
        both = [np.array(simhash.shingle_hashes(t.encode(), 5), np.uint64) for t in texts]
        long, short = (simhash.majorities(np.concatenate(x), np.array(list(map(len, x)))) for x in (both, [b[:-1] for b in both]))
        for k in np.flatnonzero(np.bitwise_count(long ^ short) > 24)[:3]:
            rows |= {len(rows): texts[k], len(rows) + 1: texts[k].rsplit(" ", 1)[0]}
    left = {r.doc_id for r in simhash.drop_near_copies(make(*rows.items())).collect()}
    assert left == set(alike(rows).values()) == set(range(0, len(rows), 2))


def test_wide_rows_are_not_sent_by_way_of_the_driver(spark, make, monkeypatch):
    """Joins whose tables are far smaller than their rows stay merge joins under the broadcast threshold."""
    plans, write = {}, simhash.written

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "written", written)
    words = [f"v{k}" for k in range(60)]
    assert simhash.drop_near_copies(make((1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "another text"))).count() == 2
    for name in ("near-met", "near-candidates"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]


def test_parities_are_a_lower_bound(spark, make):
    """Parities of two texts differ in at most as many bits as their sets of shingles have apart, and in an even number of bits fewer."""
    random = np.random.default_rng(4)
    base = random.choice([f"p{k}" for k in range(500)], 400).tolist()
    texts = [" ".join(random.choice(base, 300).tolist() if k % 4 == 3 else base[: 400 - 9 * k] + base[:k]) for k in range(24)] + ["", "one two", " ".join(base * 40)]
    rows = simhash.sketches(make(*enumerate(texts)), "doc_id", "text", simhash.WORDS, simhash.SAMPLES).collect()
    odd = {r.id: np.array(r.odd, np.int64).view(np.uint8) for r in rows}
    assert {len(x) for x in odd.values()} == {8 * simhash.PARITIES} and not odd[24].any()
    sets = [shingles(t) for t in texts]
    for a in odd:
        for b in odd:
            apart, bits = len(sets[a] ^ sets[b]), int(np.unpackbits(odd[a] ^ odd[b]).sum())
            assert bits <= apart and (apart - bits) % 2 == 0


def test_stages(spark, duck, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = dict(duck.sql("select doc_id, quality from labels").fetchall())
    bench = duck.sql("select item_id, text from benchmark").fetchall()
    for name, stage in list(steps.items())[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality classifier":
            bad = [i for i, q in labels.items() if q == 0]
            assert not set(bad) & set(got) and np.mean([i in got for i, q in labels.items() if q == 1]) > 0.97
            want = got
        elif name == "exact dedup":
            first = {}
            for i in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
            want = {i: rows[i] for i in first.values()}
        elif name == "SimHash near-dedup":
            of = alike(rows)
            want = {i: rows[i] for i in set(of.values())}
        else:
            search = decontaminate.machines(bench)
            want = {i: t for i, t in rows.items() if not decontaminate.find(decontaminate.words(t), search)[0]}
        assert got == want, name
        rows = got
    packed = steps["packing"](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_stages_on_odd_rows(spark, make, odd, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (make(*odd), make(*odd).limit(0)):
            out = stage(spark, docs, sf_dir).collect()
            assert docs.count() or not out, name
