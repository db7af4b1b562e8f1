"""Repair of conversations' structure by signatures.

Each conversation's turns, in order, become a compact string, one letter a turn: the kind of its role (``s``, ``u``, ``a``, ``o`` for any other; capital where the text is truncated), or ``x`` where
the turn is blank or a duplicate and must go. Conversations of one signature have one cheapest repair, so each distinct signature is solved once, by a memoised recursion over (turn, what may follow), and its
audit is joined back. The edits are replayed as the turns stream by, sorted within their partition.

Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty turn of user or assistant) 5; a truncated turn that isn't deleted costs 5 more. The repaired roles' initials match
``(s?(ua)+)?``. Of audits that cost the same the one least in ASCII is taken. An audit says all: the roles follow from how many turns are left.

How it scales: turns meet by conversation twice, once for their faults (sorted windows) and once for the replay, which keeps the audit and a batch of rows, never a conversation's texts; a conversation is one task's
stream, as its repaired form is one sequence. What is solved is distinct signatures; the join back is salted, as one signature may be that of most conversations.

Defined results: turns go by turn (nulls first), then role, then text; a null role or text is empty; an empty role's initial, like any other, is none of s, u and a; null conv_ids are one conversation; rows that repeat are turns of their own, and all but the first are duplicates.
A conversation named in `also` alone has zeros and an empty audit. Gaps beyond a long are null. An empty table gives no rows. Texts of any length are carried whole. Other columns, whatever their names, don't matter and aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm._common import column, written

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Copies of an audit in the join with conversations.
SALTS = 16
#: What a repaired conversation may be in: nothing yet, after its system turn, after a user's, after an assistant's.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
NEVER = 1 << 40
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal"]


class Solver:
    """The cheapest audit of a signature."""

    #: Where a user's or assistant's turn leads from each state.
    NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
    #: How many turns the recursion goes ahead at once.
    STEP = 128

    def __init__(self, signature: str) -> None:
        self.turns = signature
        self.memo = np.full((len(signature) + 1, 4, 3), -1, np.int64)

    def edits(self, i: int, state: int, inserts: int) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
        """Edits that may come next, in ASCII order: (letter, cost, what follows). No cheapest audit inserts more than two turns in a row."""
        if i < len(self.turns):
            turn = self.turns[i]
            yield "D", DELETE, (i + 1, state, 2)
        if inserts:
            yield "I", INSERT, (i, self.NEXT[state], inserts - 1)
        if i < len(self.turns) and turn != "x":
            cut = CUT if turn.isupper() else 0
            wanted = "sus" if state == START else "a" if state == AFTER_USER else "u"
            if turn.lower() in wanted:
                yield "K", KEEP + cut, (i + 1, AFTER_SYSTEM if turn.lower() == "s" else self.NEXT[state], 2)
            yield "R", REROLE + cut, (i + 1, self.NEXT[state], 2)

    def cost(self, i: int, state: int, inserts: int) -> int:
        """The least cost of the turns from i on."""
        if (known := self.memo[i, state, inserts]) >= 0:
            return int(known)
        best = 0 if i == len(self.turns) and state in (START, AFTER_ASSISTANT) else NEVER
        for _, price, then in self.edits(i, state, inserts):
            best = min(best, price + self.cost(*then))
        self.memo[i, state, inserts] = best
        return best

    def solve(self) -> tuple[int, str]:
        # From the end in steps, so that the recursion stays shallow however long the conversation is.
        for i in range(len(self.turns), 0, -self.STEP):
            for state in range(4):
                self.cost(i, state, 2)
        total = left = self.cost(0, START, 2)
        at, audit = (0, START, 2), []
        while at[0] < len(self.turns) or left:
            for letter, price, then in self.edits(*at):
                if price + self.cost(*then) == left:
                    break
            audit.append(letter)
            left -= price
            at = then
        return total, "".join(audit)


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, also: DataFrame | None) -> DataFrame:
    """(conv, live, turn, role, text); rows that aren't live only name a conversation."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.lit(True).alias("live"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    if also is None:
        return rows
    return rows.unionByName(also.select(F.col(conv_col).alias("conv"), F.lit(False).alias("live"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")))


def signatures(turns: DataFrame) -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal) of rows as _turns gives them. One shuffle, by conversation, serves both windows and the aggregate."""
    order = Window.partitionBy("conv", "live").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag(initial(F.col("role"))).over(order)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = turns.select(
        "conv", "live", "turn", "role", "text",
        F.row_number().over(order).alias("nth"),
        (before.isNotNull() & ~F.concat(before, initial(F.col("role"))).isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    same = Window.partitionBy("conv", "live", "role", "text").orderBy("nth")
    fault = F.when(F.col("blank"), "blank").when(F.row_number().over(same) > 1, "duplicate").when(F.col("cut"), "truncated")
    first = initial(F.col("role"))
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    rows = marked.select("conv", "live", "turn", "nth", "illegal", "new_turn", fault.alias("fault"), kind.alias("kind"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind"))

    def many(flag: Column) -> Column:
        return F.count(F.when(F.col("live") & flag, 1))

    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count(F.when(F.col("new_turn"), 1))
    return rows.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("nth", letter.alias("letter"))))), lambda t: t["letter"]), "").alias("signature"),
        F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"),
        *(many(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        many(F.col("illegal")).alias("illegal"),
    )


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Solver(s).solve() for s in column(batch, 0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in rows], pa.int64()), pa.array([a for _, a in rows], pa.string())], names=["signature", "cost", "audit"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select("signature").distinct().repartition(parts, "signature").mapInArrow(run, "signature string, cost bigint, audit string")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, head, role, text, audit, ...) with each conversation's head before its turns -> its head (nth 0), and then its repaired turns."""
    audit, at, made, odd, started = "", 0, 0, 0, False

    for batch in batches:
        roles, texts, audits = (column(batch, i).to_pylist() for i in (2, 3, 4))
        heads = batch.column(1).to_pylist()
        src, nth, role, text, own = [], [], [], [], []

        def put(row: int, r: str, t: str) -> None:
            nonlocal made
            made += 1
            for out, value in ((src, row), (nth, made), (role, r), (text, t), (own, None)):
                out.append(value)

        def wanted() -> str:
            return ("user", "assistant")[(made - odd) % 2]

        def inserts(row: int) -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(row, wanted(), "")
                at += 1

        for k, head in enumerate(heads):
            if head:
                # What the last audit still inserts belongs to the conversation before; its id is that of the row before.
                if started:
                    inserts(k - 1)
                audit, at, made, started = audits[k], 0, 0, True
                odd = (len(audit) - audit.count("D")) % 2
                for out, value in ((src, k), (nth, 0), (role, None), (text, None), (own, k)):
                    out.append(value)
                continue
            inserts(k)
            if audit[at] != "D":
                put(k, roles[k] if audit[at] == "K" else wanted(), texts[k])
            at += 1
        # A conversation's turns may go on in the next batch, but inserts after its last turn may as well be made where they come next.
        inserts(len(heads) - 1)
        index, kept = pa.array(src, pa.int64()), pa.array(own, pa.int64())
        columns = [batch.column(0).take(index), pa.array(nth, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string()), *(batch.column(i).take(kept) for i in range(4, batch.num_columns))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "nth", "role", "text", *batch.schema.names[4:]])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", also: DataFrame | None = None) -> DataFrame:
    """For each conversation a row with nth 0 and its report (gaps, blank, duplicate, truncated, illegal, cost, audit), and a row a repaired turn (nth from 1, role, text; no report). A conversation's
    rows are in one partition, one after the other in that order. also: conv_col of conversations that may have no turns."""
    rows = _turns(turns, conv_col, turn_col, role_col, text_col, also)
    found = written(signatures(rows), "signatures")
    salt = F.pmod(F.hash("conv"), F.lit(SALTS))
    audits = solved(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    report = found.withColumn("salt", salt).join(audits, ["signature", "salt"])
    empty = F.lit(None)
    heads = report.select("conv", F.lit(True).alias("head"), empty.cast("string").alias("role"), empty.cast("string").alias("text"), "audit", "cost", *REPORT, empty.cast("long").alias("turn"))
    live = rows.filter("live").select(
        "conv", F.lit(False).alias("head"), "role", "text", empty.cast("string").alias("audit"), *(empty.cast("long").alias(c) for c in ("cost", *REPORT)), "turn"
    )
    ordered = heads.unionByName(live).repartition("conv").sortWithinPartitions("conv", F.desc("head"), F.asc_nulls_first("turn"), "role", "text").drop("turn")
    kind = ordered.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, nth bigint, role string, text string, audit string, cost bigint, " + ", ".join(f"{c} bigint" for c in REPORT)
    return ordered.mapInArrow(_replay, schema).withColumnRenamed("conv", conv_col)


def digested(repaired: DataFrame) -> DataFrame:
    """Of repair()'s rows, as they come: each report, and the SHA-256 of its repaired turns as role:text, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        head, running = None, hashlib.sha256()
        for batch in batches:
            nth, roles, texts, ends, digests = batch.column(1).to_pylist(), column(batch, 2).to_pylist(), column(batch, 3).to_pylist(), [], []
            for k, n in enumerate(nth):
                if n == 0:
                    digests.append(running.hexdigest())
                    ends.append(k)
                    running = hashlib.sha256()
                else:
                    running.update(f"{chr(10) if n > 1 else ''}{roles[k]}:{texts[k]}".encode("utf-8", "surrogatepass"))
            now = batch.take(pa.array(ends, pa.int64()))
            # Each digest belongs to the head before it: the first to one of an earlier batch.
            whole = now if head is None else pa.Table.from_batches([head, now]).combine_chunks()
            digests = digests if head is not None else digests[1:]
            whole = whole if isinstance(whole, pa.Table) else pa.Table.from_batches([whole])
            if len(digests):
                yield from whole.slice(0, len(digests)).append_column("repaired_sha256", pa.array(digests, pa.string())).combine_chunks().to_batches()
            if len(whole) > len(digests):
                head = whole.slice(len(digests)).combine_chunks().to_batches()[0]
        if head is not None:
            yield from pa.Table.from_batches([head]).append_column("repaired_sha256", pa.array([running.hexdigest()], pa.string())).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in repaired.schema.fields)
    return repaired.mapInArrow(run, f"{fields}, repaired_sha256 string").drop("nth", "role", "text")
