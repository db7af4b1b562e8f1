"""Small and odd inputs, operator by operator."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import chat, decontaminate, exact, language, packing, quality, sharding, simhash, substring, toxicity
from tilewright.llm._text import Letters
from tilewright.llm.components import components

BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def paths():
    import public_tokenizers

    return [public_tokenizers.path(p) for p in BPE]


def clashing(df):
    """df with columns of the names that operators use inside."""
    for c in ("id", "th", "digest", "key", "fp", "n", "lead", "size", "cell", "chunk", "bucket", "y", "g", "words", "spans", "row", "start"):
        df = df.withColumn(c, F.lit("x"))
    return df


# Exact dedup


def test_binary_fuse():
    random = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 20_000):
        keys = random.integers(0, 1 << 63, n).astype(np.uint64)
        made = exact.BinaryFuse.load(exact.BinaryFuse.build(np.concatenate([keys, keys[:3]])).dump())
        assert made.might(keys).all()
        others = random.integers(0, 1 << 63, 20_000).astype(np.uint64)
        assert made.might(others).mean() < 0.02


def test_exact(spark, make, odd):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    groups = {}
    for i, t in odd:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for docs in (make(*odd), clashing(make(*odd))):
        rows = exact.exact_dedup(docs).collect()
        want = sorted((str(i), str(keep[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in odd)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
        assert sum(r.kept for r in rows) == len(groups) and all(r.doc_id == r.keep_id for r in rows if r.kept)
        left = exact.drop_copies(docs)
        assert left.columns == docs.columns and sorted(norm(r.text) for r in left.collect()) == sorted(groups)
    assert exact.exact_dedup(make(*odd).limit(0)).count() == 0 and exact.drop_copies(make(*odd).limit(0)).count() == 0


def test_exact_batches(spark, make):
    """The result is the same however rows are dealt to the snapshot and the batch."""
    docs = make(*((i, f"text {i % 7}  x") for i in range(40)))
    want = None
    for new in (F.lit(True), F.lit(False), F.col("id") % 2 == 0, F.col("id") < 10):
        rows = sorted(map(tuple, exact.exact_dedup(docs, new).collect()))
        want = want or rows
        assert rows == want
    assert sum(r[3] for r in want) == 7


# SimHash


def test_majorities():
    random = np.random.default_rng(2)
    texts = [random.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) for n in (0, 1, 2, 3, 255, 256, 1000)]
    got = simhash.majorities(np.concatenate(texts), np.array([len(t) for t in texts]))
    for t, g in zip(texts, got.tolist(), strict=True):
        assert g == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in t) > len(t))


@pytest.mark.parametrize("segments", [8, 16, 32])
def test_links_are_all_found(spark, segments):
    random = np.random.default_rng(4)
    base = random.integers(-(1 << 62), 1 << 62, 60)
    prints = {int(p) for p in base}
    for p in base[:40]:
        for bits in range(4):
            q = int(p)
            for b in random.choice(63, bits, replace=False):
                q ^= 1 << int(b)
            prints.add(q)
    prints |= {0, -1, 1, 3, 7, -2, int(-(1 << 63))}
    mask = (1 << 64) - 1
    want = {(max(a, b), min(a, b)) for a in prints for b in prints if a != b and ((a ^ b) & mask).bit_count() <= 2}
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    assert {(r.a, r.b) for r in simhash.links(df, 2, segments).collect()} == want


def test_points_are_not_sent_by_way_of_the_driver(spark, tmp_path):
    """A table of prints under the broadcast threshold has 49 times as many points."""
    spark.range(1000).selectExpr("xxhash64(id) as fp").write.parquet(f"{tmp_path}/prints")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    random = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(20, 60)] + [tuple(e) for e in random.integers(200, 260, (50, 2)).tolist()]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near(spark, make, odd):
    from test_queries import fingerprint, linked

    ids = [(k, t) for k, (_, t) in enumerate(odd)]
    got = {r.doc_id: r.component for r in simhash.near_dedup(clashing(make(*ids))).collect()}
    assert got == linked({i: fingerprint(t) for i, t in ids})
    rows = simhash.near_dedup(make(*odd)).collect()
    assert len(rows) == len(odd)
    left = simhash.drop_near_copies(clashing(make(*odd)))
    assert left.count() == len(set(got.values())) and "fp" in left.columns
    assert simhash.near_dedup(make(*odd).limit(0)).count() == 0


# Substrings


def brute_substrings(rows, window=20):
    seen = {}
    order = [(10**18 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, words in order:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            seen[w] = min(seen.get(w, (i, k)), (i, k))
    out = []
    for i, words in order:
        gone = set()
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k : k + window])] < (i, k):
                gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check_substrings(docs, rows):
    got = substring.substring_dedup(docs).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)


def test_substrings(spark, make, odd):
    random = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: random.choice(words, n).tolist()
    passage = text(57)
    rows = [(i, " ".join(text(30 + i) + passage[: 18 + i] + text(25))) for i in range(30)]
    rows += [(100, "x " * 200), (101, "x " * 19), (102, "x " * 20), (103, "a b " * 90), (104, "a b c " * 40), (105, " ".join(passage)), (106, "  ".join(passage[:20])), (107, " ".join(passage[3:22]))]
    rows += odd
    check_substrings(clashing(make(*rows)), rows)
    assert substring.substring_dedup(make(*odd).limit(0)).count() == 0


def test_substring_texts(spark, make):
    a = " ".join(f"p{k}" for k in range(30))
    got = {r.doc_id: r.kept_text for r in substring.substring_dedup(make((1, a), (2, "before " + a + " after")), keep_text=True).collect()}
    assert got == {1: None, 2: "before after"}


def test_windows_that_are_equal_have_equal_interiors():
    """Whatever surrounds a window, each level's symbols inside it are the same, and cover only its own words."""
    random = np.random.default_rng(6)
    for size in (2, 3, 5, 40):
        texts = [random.integers(0, size, int(random.integers(20, 90))) for _ in range(40)]
        names = random.integers(1, 1 << 63, size).astype(np.uint64)[np.concatenate(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        first = np.zeros(len(names), bool)
        first[offsets[:-1]] = True
        starts = np.concatenate([np.arange(a, b - 19) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        seen, deep = {}, 0
        for level in substring.recompress(names, first, starts, 5):
            for k, (a, b) in enumerate(zip(level.low.tolist(), level.high.tolist(), strict=True)):
                inside = tuple(level.names[a:b].tolist())
                seen.setdefault(tuple(names[starts[k] : starts[k] + 20].tolist()), {}).setdefault(id(level), inside)
                assert seen[tuple(names[starts[k] : starts[k] + 20].tolist())][id(level)] == inside
                deep = max(deep, len(inside) and 20 // len(inside))
        assert deep >= 3


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_weak_hashes_confuse(spark, make):
    a = thue_morse(1024)
    rest = " ".join(f"r{k}" for k in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{a.translate(str.maketrans('ab', 'ba'))} {rest}"), (3, f"{a} {rest}"), (2**63 - 1, "z " * 20), (None, "z " * 20)]
    got = {r.doc_id: r.n_removed for r in substring.substring_dedup(make(*rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20, 2**63 - 1: 0, None: 20}


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_windows_whose_hashes_clash(spark, make, bits):
    random = np.random.default_rng(8)
    words = [f"c{k}" for k in range(60)]
    passages = [random.choice(words, 30).tolist() for _ in range(6)]
    rows = [(i, " ".join(random.choice(words, 5).tolist() + passages[i % 6][: 24 + i % 7] + random.choice(words, 12).tolist())) for i in range(24)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    got = substring.substring_dedup(make(*rows), bits=bits).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows)


# Decontamination


def test_wu_manber():
    random = np.random.default_rng(7)
    for m in (1, 2, 3, 10):
        words = [b"a", b"b", b"c"]
        windows = {tuple(random.choice(words, m).tolist()): {k} for k in range(6)}
        machine = decontaminate.Machine(m, windows)
        text = random.choice(words, 500).tolist()
        want = sorted((k, sorted(windows[w])) for k in range(len(text) - m + 1) if (w := tuple(text[k : k + m])) in windows)
        assert sorted((k, sorted(s)) for k, s in machine.search(text)) == want


@pytest.mark.parametrize("block", [1, 12, 100_000])
def test_decontaminate(spark, make, odd, block):
    ten = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(1, ten), (2, "short item"), (3, ""), (4, None), (11, ten), (5, "ONE")], "item_id bigint, text string")
    rows = [*odd, (20, f"x {ten} y"), (21, "A SHORT, item!"), (22, " ".join(ten.split()[:9])), (23, " ".join(ten.split()[2:]))]
    got = {(r.doc_id, r.n_words): ([tuple(s) for s in r.spans], r["items"]) for r in decontaminate.decontaminate(clashing(make(*rows)), bench, block_words=block).collect()}
    assert got[20, 14] == ([(1, 13)], ["1", "11"]) and got[21, 3] == ([(1, 3)], ["2"]) and got[22, 9] == ([], []) and got[23, 10] == ([(0, 10)], ["1", "11"])
    assert got[4, 1] == ([(0, 1)], ["5"]) and got[1, 0] == ([], [])
    assert decontaminate.decontaminate(make(*rows), bench, block_words=block).count() == len(rows)
    left = decontaminate.drop_contaminated(clashing(make(*rows)), bench, block_words=block)
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {4, 20, 21, 23}
    assert decontaminate.decontaminate(make(*rows), bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(make(*rows).limit(0), bench).count() == 0


# Packing


def test_first_fit_decreasing():
    random = np.random.default_rng(8)
    sizes = random.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], np.zeros(300, int)
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(100)
        room[k] -= sizes[i]
        want[i] = k
    assert bins.tolist() == want.tolist()


def test_pack(spark, make, odd):
    rows = packing.pack(clashing(make(*odd)), *paths(), capacity=64, group=16).collect()
    assert sum(r.start == 0 for r in rows) == len(odd)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in held.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(make(*odd).limit(0), *paths()).count() == 0


def test_tokenizer_and_special_strings():
    from tokenizers import Tokenizer

    own, want = packing.Tokenizer(*paths()), Tokenizer.from_file(paths()[0])
    for t in ("", "Hello  wörld\n\n 12 it's", "a<|endoftext|>b", "漢字🙂", "x" * 3000):
        assert own.ids(t).tolist() == want.encode(t, add_special_tokens=False).ids


# Sharding


def test_shard(spark, make, odd):
    rows = sharding.shard(clashing(make(*odd)), 4).collect()
    assert len(rows) == len(odd)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(make(*odd).limit(0)).count() == 0


def test_heavy_group_is_cut(spark, make):
    """A third of all rows are one text; shards stay level."""
    docs = make(*((i, "the same text" if i % 3 == 0 else f"text number {i * 7919 % 10007}") for i in range(3000)))
    rows = sharding.shard(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in rows) < 1.02 * min(r.b for r in rows) and len(rows) == 8


# Chat


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "<\\\\|x", "<|", "<", "|", "", None, "a\nb", "<|im_end|>\n", "%0A%25<|"]
    rows = [(c, k, role, t) for c, role in enumerate(["user", "assistant", "a\nb%25<|", "", None]) for k, t in enumerate(said)]
    rows += [(9, k, ("user", "assistant", "assistant", "user")[k % 4], t) for k, t in enumerate(said * 3)] + [(None, None, None, None), (None, 1, "assistant", "x"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    made = chat.format_chats(df)
    got = made.select("conv_id", chat.turns_column(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").collect()
    for r in got:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: ((x[1] is not None, x[1] or 0), x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.t] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        inner = re.sub(r"<\|im_(start\|>[^\n]*\n|end\|>\n|sep\|>)", "\0", r.formatted)
        assert "<|" not in inner
        assert all(not re.search(r"<\|", r.formatted[s.start : s.end]) for s in r.loss_spans)
    assert len(got) == 8 and chat.format_chats(df.limit(0)).count() == 0
    nodes = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", nodes)


# Classifiers


def test_quality(spark, make, odd):
    good, bad = "the cat sat on a mat and it was fine", "the$$$ cat%%% sat### on&&& a!! mat"
    docs = make(*((i, good if i % 2 else bad) for i in range(60)), *((1000 + k, t) for k, (_, t) in enumerate(odd)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1), (4, 7)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.classify(clashing(docs), labels).collect()}
    assert len(got) == 60 + len(odd) and got[1] > 0.9 > 0.1 > got[0] and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] == got[1002]
    left = quality.keep_good(clashing(docs).where("doc_id < 60"), labels)
    assert {r.doc_id for r in left.collect()} == set(range(1, 60, 2)) and "th" in left.columns
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_features():
    at, of = quality.of_texts(["a b", None, "", "b a a", "  ", "a"])
    assert np.diff(of).tolist() == [3, 0, 0, 5, 0, 1]
    assert set(at[:2].tolist()) & set(at[of[3] :].tolist())


def test_toxicity(spark, make, odd):
    plain = ["what a lovely morning in the garden", "trains leave at noon from the old station", "bread and butter with some cheese"]
    rude = [p + " you stupid moron idiot" for p in plain]
    docs = make(*((i, (rude if i % 3 == 0 else plain)[i % 7 % 3]) for i in range(120)), (500, "you stuupid morron idiott"), (501, plain[1]), *((1000 + k, t) for k, (_, t) in enumerate(odd)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(clashing(docs), labels).collect()}
    assert got[500] > 0.5 > got[501] and got[1000] == got[1001] and len(got) == 122 + len(odd)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_language(spark, make, odd):
    two = {"xx": "bala kuma tiro bala sena", "yy": "wicht schrent zwolf krast wicht"}
    docs = make(*((i, two["xx" if i % 2 else "yy"], "xx" if i % 2 else "yy") for i in range(40)), *((1000 + k, t) for k, (_, t) in enumerate(odd)), (2000, "12 34 !?"), (2001, "bala tiro"))
    names, prototypes = language.learn(clashing(docs), F.lit(True))
    assert names == ["xx", "yy"] and np.allclose(np.linalg.norm(prototypes, axis=1), 1, atol=1e-5)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, names, prototypes).collect()}
    assert got[1][0] == "xx" and got[0][0] == "yy" and got[2001][0] == "xx" and got[2000] == got[1000] == got[1001] == ("und", 0.0)
    names, prototypes = language.learn(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, names, prototypes).collect()} == {"und"}
    assert language.identify(docs.limit(0), ["xx"], prototypes).count() == 0


def test_bundles_are_sums_of_bound_vectors():
    letters = Letters(digits=False)
    vector = lambda c: language.letter_vectors(np.array([c], np.uint32))[0].astype(int)
    want = sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in [(0, 97, 98), (97, 98, 0), (0, 99, 0)])
    assert (language.Bag(["Ab! c"], letters).bundle() == want).all()
    bag = language.Bag(["abc abd", "xyz"], letters)
    prototypes = np.stack([language.Bag(["abc"], letters).bundle(), language.Bag(["xyz"], letters).bundle()]).astype(np.float32)
    dot = np.stack([np.bincount(bag.text, (bag.products(prototypes)[bag.gram] * bag.count[:, None])[:, k], 2) for k in range(2)], 1)
    own = np.stack([language.Bag([t], letters).bundle() for t in ("abc abd", "xyz")])
    assert np.allclose(dot, own @ prototypes.T, rtol=1e-4)


def test_toxicity_where_toxic_labels_are_rare(spark, make):
    """16 toxic texts of 4,000, a sample of 512: the words of toxic texts alone are learnt."""
    random, bad = np.random.default_rng(6), ["grobzik", "vlurpash", "quindrox", "smeltyug"]
    words = [f"{a}{b}{c}" for a in ("mor", "tal", "sen", "pil") for b in ("ado", "ine", "uke") for c in ("ra", "lis", "ton")]
    texts = [" ".join(random.choice(words, 20)) for _ in range(4100)]
    toxic = {*range(0, 4000, 250), *range(4000, 4050)}
    texts = [f"{t} {bad[i % 4]} {bad[i // 4 % 4]}" if i in toxic else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(4000)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(make(*enumerate(texts)), labels, most=512).collect()}
    assert np.mean([got[i] >= 0.5 for i in range(4000, 4050)]) > 0.9 and np.mean([got[i] < 0.5 for i in range(4050, 4100)]) > 0.9


def test_fits_dont_depend_on_the_order_of_rows(spark):
    """The same sample in other orders and partitions gives the same weights."""
    random = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(int(i % 2), " ".join(random.choice(vocabulary[: 200 + 100 * (i % 2)], 30))) for i in range(120)] + [(1, None), (0, ""), (1, "same"), (0, "same")]
    for module in (quality, toxicity):
        made = [module.train(spark.createDataFrame(r, "y int, text string").repartition(n)) for r, n in ((rows, 1), (rows[::-1], 7))]
        assert np.array_equal(*made) and np.abs(made[0]).max() > 0


def test_blocks_of_the_benchmark_are_few_a_stage(spark, make):
    docs = make((1, "a b c d e f g h i j k"), (2, "nothing of it"), (3, None), (4, "q w e r t y u i o p"))
    items = spark.createDataFrame([(i, f"x{i} " * 9 + "end") for i in range(11)] + [(99, "q w e r t y u i o p")], "item_id bigint, text string")
    clean = decontaminate.drop_contaminated(docs, items, block_words=10)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= decontaminate.BLOCKS
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3]


def test_chat_of_very_many_turns(spark):
    import time

    turns = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said "), "id").alias("text"))
    began = time.time()
    r = chat.format_chats(turns).first()
    assert len(r.loss_spans) == 50_000 and time.time() - began < 60
    assert all(r.formatted[s.start : s.end] == f"said {2 * k + 1}" for k, s in enumerate(r.loss_spans))
