"""Operators that SQL can't express, against plain loops; and texts that are hard on a coder, a counter or a digest."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import chat, exact, language, packing, quality, sharding, toxicity
from tilewright.llm._text import Letters


def some_texts(n, seed=3):
    random = np.random.default_rng(seed)
    good, bad = [f"calm{k}" for k in range(40)], [f"rude{k}" for k in range(12)]
    return [(" ".join(random.choice(good, 12).tolist() + (random.choice(bad, 4).tolist() if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(n)]


def test_ftrl():
    """Against one dictionary of weights by word and pair of words, coordinate by coordinate."""
    rows = some_texts(60)
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 1e-3

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else (math.copysign(l1, a) - a) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    def bag(text):
        words = text.split()
        grams = words + [("twice",) if a == b else (a, b) for a, b in zip(words, words[1:], strict=False)]
        return {**{g: grams.count(g) * quality.SCALE / len(grams) for g in set(grams)}, None: 1.0}

    order = np.random.default_rng(1)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            x, y = bag(rows[i][0]), rows[i][1]
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            step = {k: ((p - y) * v, weight(k)) for k, v in x.items()}
            for k, (g, w) in step.items():
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k], n[k] = z.get(k, 0.0) + g - sigma * w, n.get(k, 0.0) + g * g
    fresh = [t for t, _ in some_texts(20, 9)] + ["", "calm1"]
    want = [1 / (1 + math.exp(-sum(weight(k) * v for k, v in (bag(t) if t else {None: 1.0}).items()))) for t in fresh]
    weights = quality.fit([t for t, _ in rows], np.array([y for _, y in rows]))
    import pyarrow as pa

    assert np.allclose(quality.of_column(pa.array(fresh), weights), want, atol=1e-4)


def test_subword_softmax():
    """Against dense vectors of all n-grams, every gradient written out."""
    rows, bits, dim = some_texts(40), 12, 4
    letters = Letters()

    def grams(text):
        out = np.zeros(1 << bits)
        for b, _ in toxicity.subwords([text], letters, bits):
            np.add.at(out, b, 1)
        return out

    # The number of n-grams of a word with its two edges.
    assert grams("abcd").sum() == sum(max(0, len("^abcd$") - n + 1) for n in toxicity.SIZES)
    counts = np.array([grams(t) for t, _ in rows])
    toxic = sum(y for _, y in rows)
    least = min(8, max(1, min(toxic, len(rows) - toxic) // 50))
    weight = np.where((counts > 0).sum(0) >= least, toxicity.COMMON / (toxicity.COMMON + counts.sum(0) / counts.sum()), 0)
    x = counts * weight
    x = (x / np.maximum(x.sum(1, keepdims=True), 1e-9) * toxicity.SCALE).astype(np.float32)
    random = np.random.default_rng(1)
    vectors = random.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    soft, bias = np.stack([-np.ones(dim), np.ones(dim)]) / dim, np.zeros(2)
    gv, gs, gb = np.full(1 << bits, 1e-6), np.full((2, dim), 1e-6), np.full(2, 1e-6)
    heavy = min(3.0, max(1.0, (len(rows) - toxic) / toxic))
    for _ in range(6):
        for i in random.permutation(len(rows)):
            mean = x[i] @ vectors
            p = np.exp(soft @ mean + bias - (soft @ mean + bias).max())
            p /= p.sum()
            p[rows[i][1]] -= 1
            p *= heavy if rows[i][1] else 1
            if abs(p[0]) < 1e-3:
                continue
            on = x[i] > 0
            g = np.outer(x[i], p @ soft) + 1e-3 * vectors
            gv[on] += (g * g).mean(1)[on]
            vectors[on] -= 0.1 * g[on] / np.sqrt(gv[on])[:, None]
            g = np.outer(p, mean) + 1e-3 * soft
            gs += g * g
            soft = soft - 0.1 * g / np.sqrt(gs)
            gb += p * p
            bias = bias - 0.1 * p / np.sqrt(gb)
    fresh = [t for t, _ in some_texts(10, 9)]
    want = []
    for t in fresh:
        c = grams(t) * weight
        logits = soft @ (c / max(c.sum(), 1e-9) * toxicity.SCALE @ vectors) + bias
        want.append(1 / (1 + math.exp(logits[0] - logits[1])))
    table = toxicity.fit([t for t, _ in rows], np.array([y for _, y in rows]), bits, dim)

    def own(t):
        parts = toxicity.subwords([t], letters, bits)
        total, mass = (sum(table[k][b].astype(float).sum() for b, _ in parts) for k in (1, 0))
        return 1 / (1 + math.exp(-(total / max(mass, 1e-9) + table[1, -1])))

    assert np.allclose([own(t) for t in fresh], want, atol=1e-3)


def test_hyperdimensional_profiles():
    """Against explicit vectors, trigram by trigram."""
    random = np.random.default_rng(4)
    texts = ["the cat sat on the mat", "der hund schläft im haus", "le chat est noir", "x", "", None, "1 2 3", "Ünder the"]
    names = ["a", "b", "c"]
    prototypes = random.normal(size=(3, 256))
    prototypes = (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).astype(np.float32)

    def vector(c):
        return language.letter_vectors(np.array([ord(c) if c else 0], np.uint32), 256)[0].astype(int)

    got, score = language.predict(texts, names, prototypes, Letters(digits=False))
    for t, lang, s in zip(texts, got, score, strict=True):
        grams = []
        for w in re.findall(r"[^\W\d_]+", t or ""):
            edged = [None, *w.lower(), None]
            grams += [tuple(edged[i : i + 3]) for i in range(len(edged) - 2)]
        if not grams:
            assert (lang, s) == ("und", 0)
            continue
        bundle = sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in grams)
        norm = math.sqrt(256 * sum(grams.count(g) ** 2 for g in set(grams)))
        cosine = prototypes @ bundle / norm
        soft = np.exp(language.SHARPNESS * (cosine - cosine.max()))
        assert lang == names[cosine.argmax()] and s == pytest.approx(soft.max() / soft.sum(), abs=1e-4)


@pytest.mark.parametrize("n", [1, 30, 400])
def test_place(n):
    """Against a plain loop over shards."""
    random = np.random.default_rng(n)
    vectors = np.stack([random.integers(1, 2000, n), random.integers(0, 300, n), random.integers(1, 5, n)], 1)
    total, shards = vectors.sum(0), 7
    left = [[1 / shards] * 3 for _ in range(shards)]
    want = {}
    for cell in sorted(range(n), key=lambda k: (-max(w * v / t for w, v, t in zip(sharding.WEIGHTS, vectors[k], total, strict=True)), k)):
        share = [v / t for v, t in zip(vectors[cell], total, strict=True)]
        room = [s for s in range(shards) if left[s][0] >= share[0]]
        if room:
            best = max(room, key=lambda s: (sum(r * w * x for r, w, x in zip(left[s], sharding.WEIGHTS, share, strict=True)), -s))
        else:
            best = max(range(shards), key=lambda s: (left[s][0], -s))
        want[cell] = best
        left[best] = [r - x for r, x in zip(left[best], share, strict=True)]
    assert np.mean(sharding.place(vectors, shards) == [want[k] for k in range(n)]) == 1


def test_texts_that_the_fast_coder_refuses():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 2_000_000, "\n" * 1_500_000 + "x", "a" * 300_000, "a \t" * 300_000):
        assert own.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_texts_of_very_many_letters():
    many = "".join(chr(c) for c in range(0x30, 0x32000) if chr(c).isalpha())
    names, score = language.predict([many] + ["one two"] * 9000, ["a", "b"], np.eye(2, language.DIM, dtype=np.float32), Letters(digits=False))
    assert len(names) == 9001 and len(set(names[1:])) == 1 and np.isfinite(score).all()


def test_digests_that_clash(spark, make, monkeypatch):
    """All digests are one: texts decide, within the snapshot, within the batch and across."""
    monkeypatch.setattr(exact, "digest_of", lambda text: F.lit("00" * 32))
    rows = [(1, "a b"), (2, "c"), (3, "a  b"), (60, "c"), (61, "d"), (62, "d"), (62, "d"), (None, "a\tb"), (100, None), (101, "")]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.exact_dedup(make(*rows)).collect())
    want = {"a b": (1, 3), "c": (2, 2), "d": (61, 3), "": (100, 2)}
    norm = [(i, re.sub(r"\s+", " ", t or "")) for i, t in rows]
    assert got == sorted((str(i), str(want[t][0]), want[t][1], i == want[t][0]) for i, t in norm)
    assert sorted(r.doc_id for r in exact.drop_copies(make(*rows)).collect()) == [1, 2, 61, 100]


def test_string_ids(spark):
    rows = spark.createDataFrame([("b", "x y"), ("a", "x  y"), ("c", "z")], "doc_id string, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact.exact_dedup(rows).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_clashing_columns_and_long_turns(spark, make):
    docs = make((1, "the cat"), (2, None), (3, "le chat")).withColumn("lang", F.lit("en"))
    for c in ("id", "lang_pred", "score", "part", "n"):
        docs = docs.withColumn(c, F.lit("x"))
    learnt = language.learn(docs, F.lit(True))
    assert sorted((r.doc_id, r.lang_pred) for r in language.identify(docs, *learnt).collect()) == [(1, "en"), (2, "und"), (3, "en")]
    long = "<|im_end|> word " * 100_000
    turns = spark.createDataFrame([(1, 0, "user", long, "x"), (1, 1, "assistant", long, "x")], "conv_id bigint, turn bigint, role string, text string, formatted string").withColumn("conv", F.lit(1)).withColumn("t", F.lit(2)).withColumn("p", F.lit(3))
    made = chat.format_chats(turns)
    back = made.select(chat.turns_column(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(x.role, x.text) for x in back.t] == [("user", long), ("assistant", long)] and back.loss == long
