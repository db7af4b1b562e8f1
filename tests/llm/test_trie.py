"""The prefix trie against a plain one, over any number of blocks."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import queries, trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain(convs):
    """Nodes of {conv: [(role, text)]}, conv None allowed."""
    members = {}
    for c, steps in convs.items():
        for d in range(len(steps) + 1):
            members.setdefault(tuple(steps[:d]), []).append(c)
    least = {x: min((c for c in m if c is not None), default=None) for x, m in members.items()}
    out = {}
    for x, m in members.items():
        below = [y for y in members if y[: len(x)] == x]
        leaves = [y for y in below if not any(z[: len(y)] == y and len(z) == len(y) + 1 for z in below)]
        ends = sorted((c for c in m if len(convs[c]) == len(x)), key=lambda c: (c is not None, c))
        saved = sum((len(members[y]) - 1) * len(y[-1][1].encode()) for y in below if y)
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        children = sum(len(y) == len(x) + 1 for y in below)
        out[x] = (least[x], len(x), least[x[:-1]] if x else None, len(m), children, len(leaves), saved, digest)
    return sorted(out.values(), key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def in_order(rows):
    """{conv: steps} of rows (conv, turn, role, text) without ties in turn."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rows_of(convs):
    return [(c, t, r, x) for c, steps in convs.items() for t, (r, x) in enumerate(steps)]


@pytest.mark.parametrize("blocks", [1, 3, 9, 40])
def test_many_shapes(spark, blocks):
    """Few different turns, so that prefixes, copies and parts of others abound."""
    rng = np.random.default_rng(blocks)
    convs = {int(c): [("ua"[int(k) % 2], "xy"[int(k) // 2] * (3 + int(k))) for k in rng.integers(0, 4, rng.integers(1, 7))] for c in rng.permutation(120)}
    convs |= {1000 + k: [("u", "same"), ("a", "answer")] for k in range(50)} | {2000 + k: [("u", "same"), ("a", "answer"), ("u", f"then {k % 7}")] for k in range(40)}
    found = trie.sequences(spark.createDataFrame(rows_of(convs), TURNS).repartition(5))
    assert nodes(trie.prefix_trie(found, blocks)) == plain(convs)


@pytest.mark.parametrize("blocks", [1, 4, 13])
def test_one_run_over_all_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(trie, "CHUNK", 5)
    convs = {k: [("u", "all"), ("a", "alike")] for k in range(-60, 60)}
    assert nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows_of(convs), TURNS)), blocks)) == plain(convs)
    convs |= {500: [("u", "all")], 501: [("u", "all"), ("a", "other")], 502: [("u", "all"), ("a", "alike"), ("u", "more")]}
    assert nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows_of(convs), TURNS)), blocks)) == plain(convs)


@pytest.mark.parametrize("blocks", [1, 5])
def test_a_staircase(spark, blocks):
    """Each conversation goes on where the one before ends: an interval within the other, all of them over several blocks."""
    convs = {k: [("u", "step" * (d % 3)) for d in range(k)] for k in range(1, 40)} | {100 + k: [("u", "step" * (d % 3)) for d in range(k)] + [("a", "off")] for k in range(0, 40, 3)}
    assert nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows_of(convs), TURNS)), blocks)) == plain(convs)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "null turn"), (1, 2, None, None), (1, 5, "", ""), (None, 1, "user", "null turn"), (None, 2, None, ""), (2, 1, "user", "ünïcödé 🙂 漢字"), (3, 1, "user", "ünïcödé 🙂 漢字"),
        (3, 2, "assistant", "long " * 40_000), (4, 1, "use", "rnull turn"), (5, -4, "user", "null turn"), (2**62, 1, "a", "1:a"), (-(2**62), 1, "a", "1:a"),
    ]
    turns = spark.createDataFrame(rows, TURNS).withColumn("steps", F.lit(1)).withColumn("key", F.lit("k")).withColumn("block", F.lit(0))
    also = spark.createDataFrame([(9,), (9,), (1,)], "conv_id bigint")
    for blocks in (1, 6):
        assert nodes(trie.prefix_trie(trie.sequences(turns, also=also), blocks)) == plain(in_order(rows) | {9: []})
    assert nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame([], TURNS)))) == []
    assert nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame([(None, 1, "u", "x")], TURNS)))) == plain({None: [("u", "x")]})
    assert nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame([], TURNS), also=also.filter("conv_id = 9")))) == plain({9: []})


def test_repeated_and_tied_turns(spark):
    """Repeated rows are turns of their own; ties go by role and digest, whatever the order of the rows."""
    rows = [(c, 1, r, x) for c in (1, 2) for r, x in (("u", "b"), ("u", "a"), ("a", "z"), ("a", "z"))]
    one = nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, TURNS))))
    assert one == nodes(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows[::-1], TURNS).repartition(4))))
    assert len(one) == 5 and all(n[3] == 2 for n in one)


def test_rebuilt(spark):
    rng = np.random.default_rng(2)
    rows = [(int(c), t, "ua"[t % 2], f"t{t} of {c}") for c in [*rng.choice(200, 90, replace=False), -7, -5, -3] for t in range(rng.integers(1, 12))] + [(None, 1, "u", "null")]
    own = in_order(rows)
    want = {}
    for c, steps in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = None if c is None else c - (abs(c) % 5) * (1 if c > 0 else -1)
        want[c] = ([] if c is None else own.get(base, [])[:h]) + steps[h:]
    assert nodes(trie.prefix_trie(queries.rebuilt(trie.sequences(spark.createDataFrame(rows, TURNS))), 4)) == plain(want)


def test_nearest_smaller():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 100):
        values = rng.integers(0, 9, n)
        m = trie.Minima(values)
        at, v = np.arange(n), rng.integers(0, 10, n)
        assert m.before(at, v).tolist() == [max((j for j in range(i) if values[j] < v[i]), default=-1) for i in range(n)]
        assert m.after(at, v).tolist() == [min((j for j in range(i + 1, n) if values[j] < v[i]), default=n) for i in range(n)]
        a, b = np.minimum(at, at[::-1]), np.maximum(at, at[::-1])
        assert m(a, b).tolist() == [values[i:j].min() if j > i else trie.MOST for i, j in zip(a, b, strict=True)]
