"""Prefix trie of conversations: a Cartesian tree over the longest common prefixes of sorted conversations.

A turn becomes a digest (128 bits of the SHA-256 of its role and text) and its text's size; texts go no further. Conversations are sorted by their digests in range partitions, the blocks; L[i] is the number of turns that
conversation i shares with the one before it. Two conversations meet at a node of depth d just where no L between them is below d, so the intervals between the nearest smaller values on both sides of each L, those of equal L taken as one, are the
nodes where conversations part or end; a node's depths down from its parent's are expanded, and so is what of a conversation no neighbour shares.

Nearest smaller values are found in parallel: within a block by a stack; those beyond it by the blocks' minima, which say which block holds them, and by that block's few suffix or prefix minima, which say where (an as-of window). What a node
sums up is a difference of running sums over its interval, and its least id is the least of a block's end, of whole blocks and of a block's beginning. With S the running sum of the sizes of the first L[i] turns, members p..q-1
save S[q-1] - S[p] - (q-1-p) x (the size of the d-1 turns before the node), and leaves are positions whose next L is below their length.

How it scales: rows of 60 bytes a turn are shuffled four times, texts never. The driver gets seven numbers a block (some 2^16 conversations); equal conversations are split over blocks by id, and the digest of their ids is made
from strings of 4,096 ids. A conversation's digests are one row.

Defined results: ids are integers; a null id is one conversation, after others as smallest member and before them, as an empty text, in `ends_sha256`. Turns go by turn (nulls first), then role, then their digests; a null role or text is empty. Rows
that repeat are turns of their own. A conversation named in `also` alone has no turns and is a member of the root. An empty table gives no rows. Texts of any length count whole. Other columns, whatever their names, don't matter and aren't returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm._common import buckets, column, written

#: Hexadecimal digits of a turn's digest, conversations of a block (about), and ids that are joined to one string.
DIGEST, BLOCK, CHUNK = 32, 1 << 16, 4096
MOST = np.iinfo(np.int64).max
NOTHING = hashlib.sha256(b"").hexdigest()
STEPS = "array<struct<digest string, size bigint>>"


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", also: DataFrame | None = None) -> DataFrame:
    """(conv, steps): each conversation's turns in order, as digests and sizes."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, DIGEST)
    step = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), step.alias("step"))
    if also is not None:
        rows = rows.unionByName(also.select(F.col(conv_col).cast("long").alias("conv")), allowMissingColumns=True)
    ordered = F.transform(F.sort_array(F.collect_list("step")), lambda s: F.struct(s["digest"], s["size"]))
    return rows.groupBy("conv").agg(ordered.cast(STEPS).alias("steps"))


def _shared(a: str, b: str) -> int:
    """How many digests two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid - 1)
    return low


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv, size array) -> (block, at, conv, len, lcp, cum, key): what each shares with the one before. The key is kept for a block's first row, and in a row more (len -1) for its last."""
    from pyspark import TaskContext

    block, at, before = TaskContext.get().partitionId(), 0, None
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    names = ["block", "at", "conv", "len", "lcp", "cum", "key"]
    for batch in batches:
        if not len(batch):
            continue
        keys = column(batch, 0).to_pylist()
        shared = [_shared(a, b) for a, b in zip([before if before is not None else "", *keys[:-1]], keys, strict=True)]
        sizes = batch.column(2)
        lens = np.array([len(k) // DIGEST for k in keys], np.int64)
        flat = np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False)) if lens.sum() else np.empty(0, np.int64)
        ends = np.cumsum(lens)
        base = np.concatenate([[0], flat])[ends - lens]
        cum = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat - np.repeat(base, lens), pa.int64()))
        n = len(keys)
        kept = [keys[0] if before is None else None, *[None] * (n - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(at + np.arange(n)), batch.column(1), pa.array(lens), pa.array(shared, pa.int64()), cum, pa.array(kept, pa.string())], names=names)
        at, before = at + n, keys[-1]
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([block, at, None, -1, None, None, before], kinds, strict=True)], names=names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' first and last keys in order -> (block, lcp, same): what each block's first conversation shares with the last of the block before, -1 for the first block, and whether they are equal."""
    last = None
    for batch in batches:
        out = []
        for block, length, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if length < 0:
                last = key
            else:
                out.append((block, -1 if last is None else _shared(last, key), last == key))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["block", "lcp", "same"])


class Minima:
    """Least values of ranges of an array, and the nearest smaller ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            half, low = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first:last]; MOST where that is empty."""
        out, size = np.full(len(first), MOST), last - first
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for k, low in enumerate(self.levels):
            rows = np.flatnonzero((size > 0) & (level == k))
            out[rows] = np.minimum(low[first[rows]], low[last[rows] - (1 << k)])
        return out

    def before(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The last place before at with less than value; -1 for none."""
        at = at.copy()
        for k, low in reversed(list(enumerate(self.levels))):
            start = at - (1 << k)
            rows = np.flatnonzero(start >= 0)
            rows = rows[low[start[rows]] >= value[rows]]
            at[rows] = start[rows]
        return at - 1

    def after(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first place after at with less than value; as many as there are for none."""
        at = at + 1
        for k, low in reversed(list(enumerate(self.levels))):
            rows = np.flatnonzero(at < len(low))
            rows = rows[low[at[rows]] >= value[rows]]
            at[rows] += 1 << k
        return at


class Block:
    """A block's conversations, and the intervals of its L: each is known by the first place of its L in the block (rep)."""

    def __init__(self, rows: pa.Table, lcp: int, next_lcp: int) -> None:
        rows = rows.take(pa.array(np.argsort(rows.column("at").to_numpy())))
        conv = rows.column("conv")
        self.null = conv.is_null().to_numpy()
        self.ids, self.len = conv.fill_null(MOST).to_numpy(), rows.column("len").to_numpy()
        self.l = rows.column("lcp").to_numpy().copy()
        self.l[0] = lcp
        self.n, self.next = len(self.ids), next_lcp
        cum = rows.column("cum").combine_chunks()
        self.sums = np.append(0, cum.flatten().to_numpy())
        self.first = np.cumsum(self.len) - self.len
        self.s = np.cumsum(self.size(np.arange(self.n), self.l))
        self.f = np.cumsum(np.append(self.l[1:], next_lcp) < self.len)
        self.low = Minima(self.ids)
        self._nest()

    def size(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The size of the first depth turns of conversations i; 0 for none."""
        return np.where(depth > 0, self.sums[self.first[i] + np.maximum(depth, 0)], 0)

    def _nest(self) -> None:
        """For each rep: the nearest smaller places within the block (-1 for none), and how many children begin at its Ls."""
        n, values, lens = self.n, self.l.tolist(), self.len.tolist()
        rep, p, q, last, kids, open_ = list(range(n)), [-1] * n, [-1] * n, list(range(n)), [0] * n, []
        for i, v in enumerate(values):
            while open_ and values[open_[-1]] > v:
                q[open_.pop()] = i
            if open_ and values[open_[-1]] == v:
                r = rep[i] = open_[-1]
                last[r] = i
            else:
                r = i
                if open_:
                    p[i] = last[open_[-1]]
                open_.append(i)
            kids[r] += lens[i] > v
        self.rep, self.p, self.q, self.kids = (np.array(x, np.int64) for x in (rep, p, q, kids))
        self.tails = np.array([last[r] for r in open_], np.int64)
        self.heads = np.flatnonzero((self.p < 0) & (self.rep == np.arange(n)))
        self.open = np.flatnonzero((self.rep == np.arange(n)) & ((self.p < 0) | (self.q < 0)) & (self.l >= 0))
        self.shut = np.flatnonzero((self.rep == np.arange(n)) & (self.p >= 0) & (self.q >= 0))

    def runs(self) -> np.ndarray:
        """Where runs of equal conversations begin in the block, and n."""
        same = (self.l[1:] == self.len[1:]) & (self.len[:-1] == self.len[1:])
        return np.concatenate([[0], np.flatnonzero(~same) + 1, [self.n]])

    def names(self, first: int, last: int) -> str:
        return ",".join("" if gone else str(i) for i, gone in zip(self.ids[first:last].tolist(), self.null[first:last].tolist(), strict=True))


#: Rows of the blocks' outline, by kind: 0 the block, 1 a suffix minimum, 2 a prefix minimum, 3 an interval that leaves the block, 4 ids of a run that does.
OUTLINE = "block bigint, kind int, v bigint, pos bigint, s bigint, f bigint, m bigint, len bigint, rep bigint, kids bigint, left boolean, right boolean, txt string"


def _outline(block: int, b: Block, same: bool, next_same: bool) -> pa.Table:
    runs = b.runs()
    rows = [{"kind": 0, "v": b.l.min(), "pos": b.n, "s": b.s[-1], "f": b.f[-1], "m": b.ids.min(), "len": runs[1], "rep": runs[-2]}]
    ends = dict(zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True))
    low = b.low(b.tails, np.full(len(b.tails), b.n))
    for i, m in zip(b.tails.tolist(), low.tolist(), strict=True):
        done = i in ends and not (ends[i] == b.n and next_same)
        digest = hashlib.sha256(b.names(i, ends[i]).encode()).hexdigest() if done else None
        rows.append({"kind": 1, "v": b.l[i], "pos": i, "s": b.s[i], "f": b.f[i - 1] if i else 0, "m": m, "len": b.len[i], "rep": b.rep[i], "txt": digest})
    low = b.low(np.zeros(len(b.heads), np.int64), b.heads)
    for i, m in zip(b.heads.tolist(), low.tolist(), strict=True):
        rows.append({"kind": 2, "v": b.l[i], "pos": i, "s": b.s[i - 1] if i else 0, "f": b.f[i - 1] if i else 0, "m": m, "rep": i})
    rows += [{"kind": 3, "v": b.l[i], "rep": i, "kids": b.kids[i], "left": bool(b.p[i] >= 0), "right": bool(b.q[i] >= 0)} for i in b.open]
    spans = ([(0, int(runs[1]), 0)] if same else []) + ([(int(runs[-2]), b.n, 1)] if next_same and not (same and runs[-2] == 0) else [])
    for first, last, which in spans:
        rows += [{"kind": 4, "rep": which, "pos": k, "txt": b.names(k, min(k + CHUNK, last))} for k in range(first, last, CHUNK)]
    return pa.Table.from_pylist([r | {"block": block} for r in rows], schema=_arrow(OUTLINE))


NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: What becomes of intervals that leave a block: places count over all blocks, base is S[q-1] - S[p], up the parent's L.
ANSWERS = "block bigint, rep bigint, own boolean, low bigint, n bigint, base bigint, leaves bigint, kids bigint, ends string, up bigint, up_low bigint"


def _nodes(b: Block, answers: pd.DataFrame) -> pa.Table:
    """The trie's nodes that this block answers for."""
    known = answers.set_index("rep")
    low = np.zeros(b.n, np.int64)
    low[b.shut] = b.low(b.p[b.shut], b.q[b.shut])
    away = known[known.index >= 0]
    low[away.index.to_numpy(np.int64)] = away["low"].to_numpy(np.int64)
    next_low = int(known["low"].get(-1, 0))

    def parent(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """L and least id of the interval that holds what lies between places i and j: that of the larger L. j may be n, the next block's first."""
        at_j = np.append(b.l, b.next)[j]
        up, mine = np.maximum(b.l[i], at_j), b.l[i] >= at_j
        return up, np.where(mine, low[b.rep[i]], np.where(j < b.n, low[b.rep[np.minimum(j, b.n - 1)]], next_low))

    empty = np.empty(0, np.int64)
    # Intervals: those within the block, and those that leave it and begin in it.
    p, q = b.p[b.shut], b.q[b.shut]
    up, up_low = parent(p, q)
    ended = b.len[p] == b.l[b.shut]
    runs = b.runs()
    ends_at = dict(zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True))
    digests = [hashlib.sha256(b.names(i, ends_at[i]).encode()).hexdigest() if e else NOTHING for i, e in zip(p.tolist(), ended.tolist(), strict=True)]
    mine = away[away["own"].astype(bool)]
    at = mine.index.to_numpy(np.int64)

    def both(here: np.ndarray, name: str) -> np.ndarray:
        return np.concatenate([here, mine[name].to_numpy(np.int64)])

    node = np.concatenate([b.shut, at])
    bottom, top = b.l[node], both(up, "up") + 1
    # What of a conversation no neighbour shares.
    i = np.arange(b.n)
    tail_up, tail_low = parent(i, i + 1)
    tail = np.flatnonzero(b.len > tail_up)
    whole = {
        "member": np.concatenate([node, tail]),
        "low": np.concatenate([both(low[b.shut], "low"), b.ids[tail]]),
        "n": np.concatenate([both(q - p, "n"), np.ones(len(tail), np.int64)]),
        "base": np.concatenate([both(b.s[q - 1] - b.s[p], "base"), np.zeros(len(tail), np.int64)]),
        "leaves": np.concatenate([both(b.f[q - 1] - np.where(p > 0, b.f[p - 1], 0), "leaves"), np.ones(len(tail), np.int64)]),
        "kids": np.concatenate([both(b.kids[b.shut] + ~ended, "kids"), np.zeros(len(tail), np.int64)]),
        "up_low": np.concatenate([both(up_low, "up_low"), tail_low[tail]]),
        "top": np.concatenate([top, tail_up[tail] + 1]),
        "bottom": np.concatenate([bottom, b.len[tail]]),
        "null": np.concatenate([np.zeros(len(node), bool), b.null[tail]]),
    }
    ends = np.array([*digests, *mine["ends"], *(hashlib.sha256(b.names(k, k + 1).encode()).hexdigest() for k in tail.tolist())], object)
    # Depths from below the parent's to the own.
    many = whole["bottom"] - whole["top"] + 1
    of = np.repeat(np.arange(len(many)), many)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + whole["top"][of]
    first, last = depth == whole["top"][of], depth == whole["bottom"][of]
    saved = whole["base"][of] - (whole["n"][of] - 1) * b.size(whole["member"][of], depth - 1)
    own_null = whole["null"][of]
    columns = [
        pa.array(whole["low"][of], mask=own_null),
        pa.array(depth),
        pa.array(np.where(first, whole["up_low"][of], whole["low"][of]), mask=(depth == 0) | (~first & own_null)),
        pa.array(whole["n"][of]),
        pa.array(np.where(last, whole["kids"][of], 1)),
        pa.array(whole["leaves"][of]),
        pa.array(saved),
        pa.array(np.where(last, ends[of], NOTHING) if len(of) else empty.astype(object), pa.string()),
    ]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in NODES.split(", ")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start_block, start_pos, txt) sorted by run -> (start_block, start_pos, digest) a run."""
    now, running = None, hashlib.sha256()
    for batch in batches:
        out = []
        for block, pos, txt in zip(*(column(batch, i).to_pylist() for i in range(3)), strict=True):
            if (block, pos) == now:
                running.update(b"," + txt.encode())
            else:
                if now is not None:
                    out.append((*now, running.hexdigest()))
                now, running = (block, pos), hashlib.sha256(txt.encode())
        yield _runs(out)
    if now is not None:
        yield _runs([(*now, running.hexdigest())])


def _runs(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["tl", "p_pos", "digest"])


def _as_of(asked: DataFrame, targets: DataFrame, where: str, name: str) -> DataFrame:
    """asked, with the target of the greatest v below its own in the block that its column `where` names, as a struct."""
    fields = F.struct(*targets.columns)
    rows = asked.withColumn("_at", F.col(where)).withColumn("_v", F.col("v")).withColumn("_kind", F.lit(0)).withColumn(name, F.lit(None).cast(targets.select(fields.alias("t")).schema["t"].dataType))
    held = targets.select(F.col("block").alias("_at"), F.col("v").alias("_v"), F.lit(1).alias("_kind"), fields.alias(name))
    order = Window.partitionBy("_at").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(held, allowMissingColumns=True)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(order)).filter("_kind = 0").drop("_at", "_v", "_kind")


def prefix_trie(found: DataFrame, blocks: int | None = None) -> DataFrame:
    """The nodes of the trie of (conv, steps) as sequences() gives them: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). blocks: how many, by default as many as hold BLOCK conversations each."""
    spark = found.sparkSession
    keys = written(found.select(F.array_join("steps.digest", "").alias("key"), "conv", F.col("steps.size").alias("size")), "keys")
    blocks = blocks or buckets(spark, keys.count(), BLOCK)
    schema = "block bigint, at bigint, conv bigint, len bigint, lcp bigint, cum array<bigint>, key string"
    ordered = written(keys.repartitionByRange(blocks, "key", F.asc_nulls_first("conv")).sortWithinPartitions("key", F.asc_nulls_first("conv")).mapInArrow(_linked, schema), "ordered")
    # Two keys a block, in order.
    edge = ordered.filter("key is not null").select("block", "len", "key", "at").repartition(1).sortWithinPartitions("block", "at")
    edges = sorted(tuple(r) for r in edge.mapInArrow(_edges, "block bigint, lcp bigint, same boolean").collect())
    if not edges:
        return spark.createDataFrame([], NODES)
    number = {e[0]: k for k, e in enumerate(edges)}
    firsts = [(lcp, same) for _, lcp, same in edges] + [(-1, False)]

    def block_of(rows: pa.Table) -> tuple[int, Block]:
        k = number[rows.column("block")[0].as_py()]
        return k, Block(rows, firsts[k][0], firsts[k + 1][0])

    def outline(rows: pa.Table) -> pa.Table:
        k, b = block_of(rows)
        return _outline(k, b, firsts[k][1], firsts[k + 1][1])

    members = ordered.filter("len >= 0").drop("key")
    sketch = written(members.groupBy("block").applyInArrow(outline, OUTLINE), "outline")
    about = sorted(tuple(r) for r in sketch.filter("kind = 0").select("block", "v", "pos", "s", "f", "m", "len", "rep").collect())
    least, ns, ss, fs, ids, first_run, last_run = (np.array([a[i] for a in about], np.int64) for i in range(1, 8))
    answers = _answers(sketch, least, ns, ss, fs, ids, _starts(firsts, ns, first_run, last_run))

    def nodes(rows: pa.Table, answered: pa.Table) -> pa.Table:
        return _nodes(block_of(rows)[1], answered.to_pandas())

    numbered = members.join(spark.createDataFrame(list(number.items()), "block bigint, k bigint"), "block")
    return numbered.groupBy("k").cogroup(answers.groupBy("block")).applyInArrow(nodes, NODES)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _starts(firsts: list[tuple[int, bool]], ns: np.ndarray, first_run: np.ndarray, last_run: np.ndarray) -> list[tuple[int, int]]:
    """Where the run begins that a block's first conversation belongs to: (block, place)."""
    out: list[tuple[int, int]] = []
    for k in range(len(ns)):
        if not firsts[k][1]:
            out.append((k, 0))
        elif first_run[k - 1] == ns[k - 1]:
            out.append(out[k - 1])
        else:
            out.append((k - 1, int(last_run[k - 1])))
    return out


def _answers(sketch: DataFrame, least: np.ndarray, ns: np.ndarray, ss: np.ndarray, fs: np.ndarray, ids: np.ndarray, starts: list[tuple[int, int]]) -> DataFrame:
    """ANSWERS for each interval that leaves a block, in each block that it is in; those of a block's first place also for the block before, as its place -1."""
    minima, low = Minima(least), Minima(ids)
    n_at, s_at, f_at = (np.concatenate([[0], np.cumsum(x)]) for x in (ns, ss, fs))
    blocks = len(ns)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at, v = rows["block"].to_numpy(np.int64), rows["v"].to_numpy(np.int64)
            yield rows[["block", "rep", "v", "kids"]].assign(
                tl=np.where(rows["left"].to_numpy(bool), at, minima.before(at, v)), tr=np.where(rows["right"].to_numpy(bool), at, minima.after(at, v))
            )

    asked = sketch.filter("kind = 3").select("block", "rep", "v", "kids", "left", "right").mapInPandas(find, "block bigint, rep bigint, v bigint, kids bigint, tl bigint, tr bigint")
    fields = ("block", "v", "pos", "s", "f", "m", "len", "rep", "txt")
    placed = _as_of(_as_of(asked, sketch.filter("kind = 1").select(*fields), "tl", "p"), sketch.filter("kind = 2").select(*fields), "tr", "q")
    flat = placed.select("block", "rep", "v", "kids", "tl", "tr", *(F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in "pq" for f in ("v", "pos", "s", "f", "m", "len", "rep", "txt")))
    flat = flat.na.fill(0, [f"q_{f}" for f in ("v", "pos", "s", "f", "m", "rep")])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in batches:
            tl, tr = r["tl"].to_numpy(np.int64), r["tr"].to_numpy(np.int64)
            none = tr >= blocks

            def q(name: str, at: np.ndarray | None, last: int) -> np.ndarray:
                """A sum up to the interval's end; last where that is the end of all."""
                own = r[f"q_{name}"].to_numpy(np.int64)
                return np.where(none, last, own + (at[np.minimum(tr, blocks - 1)] if at is not None else 0))

            def p(name: str, at: np.ndarray) -> np.ndarray:
                return r[f"p_{name}"].to_numpy(np.int64) + at[tl]

            middle = low(tl + 1, np.where(none, blocks, tr))
            yield r[["block", "rep", "v", "kids", "tl", "p_pos", "p_len", "p_txt"]].assign(
                n=q("pos", n_at, n_at[-1]) - p("pos", n_at),
                base=q("s", s_at, s_at[-1]) - p("s", s_at),
                leaves=q("f", f_at, f_at[-1]) - p("f", f_at),
                low=np.minimum(middle, np.minimum(r["p_m"].to_numpy(np.int64), q("m", None, MOST))),
                up=np.maximum(r["p_v"].to_numpy(np.int64), q("v", None, -1)),
                up_block=np.where(r["p_v"].to_numpy(np.int64) >= q("v", None, -1), tl, tr),
                up_rep=np.where(r["p_v"].to_numpy(np.int64) >= q("v", None, -1), r["p_rep"].to_numpy(np.int64), q("rep", None, 0)),
            )

    summed = flat.mapInPandas(sums, "block bigint, rep bigint, v bigint, kids bigint, tl bigint, p_pos bigint, p_len bigint, p_txt string, n bigint, base bigint, leaves bigint, low bigint, up bigint, up_block bigint, up_rep bigint")
    spark = sketch.sparkSession
    # Runs of equal conversations that go over blocks: their ids, string by string, make one digest.
    begins = spark.createDataFrame([(k, *s) for k, s in enumerate(starts)], "block bigint, b bigint, p bigint")
    pieces = sketch.filter("kind = 4").join(begins, "block").select(
        F.when(F.col("rep") == 0, F.col("b")).otherwise(F.col("block")).alias("tl"),
        F.when(F.col("rep") == 0, F.col("p")).otherwise(F.min("pos").over(Window.partitionBy("block", "rep"))).alias("p_pos"),
        "txt", "block", "pos",
    )
    runs = pieces.repartition("tl", "p_pos").sortWithinPartitions("tl", "p_pos", "block", "pos").select("tl", "p_pos", "txt").mapInArrow(_digests, "tl bigint, p_pos bigint, digest string")
    whole = Window.partitionBy("tl", "p_pos", "v")
    ended = F.col("p_len") == F.col("v")
    merged = written(
        summed.join(runs, ["tl", "p_pos"], "left")
        .withColumn("own", F.struct("block", "rep") == F.min(F.struct("block", "rep")).over(whole))
        .withColumn("kids", F.sum("kids").over(whole) + F.when(ended, 0).otherwise(1))
        .withColumn("ends", F.when(ended, F.coalesce("p_txt", "digest")).otherwise(NOTHING)),
        "intervals",
    )
    above = merged.select(F.col("block").alias("up_block"), F.col("rep").alias("up_rep"), F.col("low").alias("up_low"))
    full = merged.join(above, ["up_block", "up_rep"], "left").withColumn("up_low", F.coalesce("up_low", F.lit(0)))
    columns = [c.split()[0] for c in ANSWERS.split(", ")]
    full = full.select(*columns)
    before = full.filter((F.col("rep") == 0) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1).withColumn("rep", F.lit(-1).cast("long")).withColumn("own", F.lit(False))
    return full.unionByName(before)
