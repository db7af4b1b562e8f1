"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, under the law ``bytes`` (sizes near equal).

Rows of equal text are a group and stay together unless the group is heavy: what outgrows a small part of a shard is cut by a hash of the id into
chunks below it. Groups and chunks are hashed into cells (at most ``cells`` of them, so what the driver places is bounded at any input size), a
partial aggregate gives each cell's vector (bytes, tokens, rows), and the driver deals the cells out, the heaviest first, each to the
shard where the weighted dot product of its vector with the shard's residual capacity is highest, among those with room for its bytes. Small cells come last and level the rest. Slots are
gapless: a cell's rows are numbered within the cell, behind those of the cells before it in its shard.

Defined results: a row's size is its text's UTF-8 bytes plus 8, a null text has none (crc32 0); repeated rows are rows of their own, and get slots
of their own; null ids hash like any other; an empty table gives no rows. Tokens are counted as runs of characters outside ASCII white space.
Fewer rows than shards leave shards empty. Cells of equal weight are dealt by number, and the shard of the lowest number wins a tie. A text of any length is one row, so that a
shard can't be below the largest. Other columns of the input, whatever their names, don't matter and aren't returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm._common import written

#: Cells that the driver places at most: a documented bound on what it collects (5 numbers a cell).
CELLS = 1 << 15
#: What bytes, tokens and rows count in the dot product: the law is on bytes.
WEIGHTS = np.array([10.0, 1.0, 1.0])


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each cell. vectors: bytes, tokens and rows a cell, in the order of the cells."""
    total = np.maximum(vectors.sum(0), 1).astype(float)
    share = vectors / total
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    largest = (share * WEIGHTS).max(1) if len(share) else np.empty(0)
    for cell in np.lexsort((np.arange(len(vectors)), -largest)):
        # Shards that have room for its bytes come first; where none has, the one with the most.
        room = residual[:, 0] >= share[cell, 0]
        best = int(np.argmax(np.where(room, residual @ (share[cell] * WEIGHTS), -np.inf) if room.any() else residual[:, 0]))
        out[cell] = best
        residual[best] -= share[cell]
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, heavy: float = 0.01) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) a row. heavy: the part of a shard's bytes or rows beyond which a group is cut."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(raw) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("crc"),
            F.xxhash64(raw).alias("text"),
            F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    parts = F.ceil(F.greatest(F.sum("size") / F.lit(max(1.0, (total or 0) * heavy / shards)), F.count(F.lit(1)) / F.lit(max(1.0, count * heavy / shards))))
    # A heavy group has more than that part of a shard's bytes or rows, in more than one row; at most 2 * shards / heavy exist, so their table is bounded.
    groups = rows.groupBy("text").agg(parts.cast("long").alias("chunks"), F.count(F.lit(1)).alias("n")).where("chunks > 1 and n > 1").drop("n")
    groups = written(groups, "shard-heavy")
    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce("chunks", F.lit(1).cast("long")))
    cell = F.pmod(F.xxhash64("text", salt), F.lit(cells)).cast("int")
    dealt = rows.join(F.broadcast(groups), "text", "left").select("id", "size", "crc", "tokens", cell.alias("cell"))
    sums = dealt.groupBy("cell").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")).orderBy("cell").collect()
    vectors = np.array([(r.b, r.t, r.r) for r in sums], dtype=np.int64).reshape(-1, 3)
    home = place(vectors, shards)
    before = np.zeros(shards, np.int64)
    plan = []
    for r, s in zip(sums, home, strict=True):
        plan.append((r.cell, int(s), int(before[s])))
        before[s] += r.r
    plan = spark.createDataFrame(plan, "cell int, shard int, first long")
    within = F.row_number().over(Window.partitionBy("cell").orderBy("id", "crc", "size")) - 1
    return dealt.join(F.broadcast(plan), "cell").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + within).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
