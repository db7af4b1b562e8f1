"""Repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tilewright.llm import queries, repair

TURNS = "conv_id bigint, turn bigint, role string, text string"


def searched(signature):
    """Cheapest (cost, audit) by a plain search: edits in order, roles' initials so far."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if i == len(signature) and re.fullmatch(r"(s?(ua)+)?", made):
            return cost, audit
        # What is left depends on where the roles stand, not on all of them.
        state = (i, made[-1:], bool(made))
        if state in seen or not re.fullmatch(r"(s?(ua)*u?)?", made):
            continue
        seen.add(state)
        for c in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", i, made + c))
        if i < len(signature):
            turn = signature[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if turn != "x":
                cut = 5 if turn.isupper() else 0
                heapq.heappush(heap, (cost + cut, audit + "K", i + 1, made + turn.lower()))
                for c in "ua":
                    heapq.heappush(heap, (cost + 1 + cut, audit + "R", i + 1, made + c))
    return None


def test_every_short_signature():
    for n in range(6):
        for letters in itertools.product("suaUAx" if n > 3 else "suaoSUAOx", repeat=n):
            assert repair.Solver("".join(letters)).solve() == searched(letters), letters


def test_long_signature():
    cost, audit = repair.Solver("ua" * 20_000).solve()
    assert (cost, audit) == (0, "K" * 40_000)
    cost, audit = repair.Solver("uaaux" * 3000).solve()
    assert audit.count("K") + audit.count("R") + audit.count("D") == 15_000 and cost == searched("uaaux" * 3000)[0]


def brute(rows, also=()):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, lines)} of (conv, turn, role, text)."""
    out = {c: (0, 0, 0, 0, 0, 0, "", []) for c in also}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        real = [t for known, t, _, _ in own if known]
        faults, signature, seen = [], "", set()
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = searched(signature)
        made, left, lines = 0, list(own), []
        odd = len(audit.replace("D", "")) % 2
        for edit in audit:
            row = left.pop(0) if edit != "I" else None
            if edit == "D":
                continue
            made += 1
            role = row[2] if edit == "K" else "user" if (made - odd) % 2 else "assistant"
            lines.append(f"{role}:{row[3] if row else ''}")
        gaps = max(real) - min(real) + 1 - len(set(real)) if real else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines)
    return out


def found(df):
    rows = repair.digested(df).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def wanted(rows, also=()):
    return {c: (*v[:-1], hashlib.sha256("\n".join(v[-1]).encode()).hexdigest()) for c, v in brute(rows, also).items()}


ODD = [
    (1, None, "user", "first."), (1, None, None, None), (1, 3, "assistant", "then"), (1, 3, "assistant", "then"), (1, 9, "tool", "what?"), (1, 9, "", "x."),
    (None, 1, "user", "a."), (None, 2, "assistant", "b. \n"), (2, 1, "system", " \t"), (3, 5, "assistant", "only me!"), (4, 1, "user", "ünïcödé 漢字"), (4, 2, "user", "long " * 30_000 + "."),
    (5, -7, "system", "s."), (5, -3, "user", "a\n."), (5, -3, "user", "a\n."), (5, 2, "assistant", " "), (7, 1, "s", "."), (7, 2, "u", "."), (7, 2, "a", "."), (8, None, "user", "q?"), (8, None, "assistant", "a."),
]


def test_odd_rows(spark):
    turns = spark.createDataFrame(ODD, TURNS).withColumn("live", F.lit(7)).withColumn("audit", F.lit("K")).withColumn("nth", F.lit(1)).repartition(5)
    also = spark.createDataFrame([(6,), (1,), (6,)], "conv_id bigint")
    assert found(repair.repair(turns, also=also)) == wanted(ODD, [6])


def test_repaired_turns(spark):
    made = repair.repair(spark.createDataFrame(ODD, TURNS)).collect()
    for conv, v in brute(ODD).items():
        assert [f"{r.role}:{r.text}" for r in sorted((r for r in made if r.conv_id == conv and r.nth), key=lambda r: r.nth)] == v[-1]


def test_empty_table(spark):
    assert found(repair.repair(spark.createDataFrame([], TURNS))) == {}
    assert repair.repair(spark.createDataFrame([], TURNS), also=spark.createDataFrame([(3,)], "conv_id bigint")).collect()[0].audit == ""


@pytest.mark.parametrize("records", [1, 7])
def test_conversations_over_many_batches(spark, records):
    """Heads, turns and inserts may lie on either side of a batch's end."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        rows = [(c, t, ("user", "assistant", "user", "tool", "system")[(c * t + c) % 5], (f"said {c} {t}" + ".!? x"[(c + t) % 5]) * ((t * 7 + c) % 6 > 0)) for c in range(40) for t in range(c % 12)]
        assert found(repair.repair(spark.createDataFrame(rows, TURNS).repartition(3))) == wanted(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in (1, 2, None)] + [(None, 1, None, None)]
    got = sorted(tuple(r) for r in queries.damaged(spark.createDataFrame(rows, TURNS)).select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv_id", "turn", "role", "text", "dropped"))).collect())
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else " " if text is None else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        row = ("-" if c is None else str(c), "-" if t is None else str(t), "user" if kind == 4 else role or " ", text, str(kind == 0).lower())
        want += [row] * (2 if kind == 3 else 1)
    assert got == sorted(want)


def test_one_shuffle_serves_the_windows(spark):
    turns = repair._turns(spark.createDataFrame(ODD, TURNS), "conv_id", "turn", "role", "text", None)
    plan = repair.signatures(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
