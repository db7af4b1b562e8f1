"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

A document is its token ids followed by an end id. It is cut into full sequences and a rest; a full piece is a sequence of its own. Rests are
dealt at random (by a hash of the id) into groups of some thousands, and in each group, longest first, each goes into the first bin with room; the
tree holds the largest capacity below each node, so that the first such bin is found in a logarithmic number of steps. Tokens
never leave the scan: a piece carries its checksum.

Defined results: a null text is empty and is its end id alone; each of the rows that repeat a doc_id is a document of its own (their pieces look
alike, each in a place of its own); null ids are packed like any other; an empty table gives no rows. A text of any length is coded whole; one whose white space or
other runs are too long for the faster coder goes to the reference coder. Among rests of equal length the earlier in its group goes first, so ties depend on the order in which a task
meets its rows, and only the numbers of sequences with them. Other columns of the input, whatever their names, don't matter and aren't returned.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import column, written

SEQUENCE = 2048
END_ID = 1
#: Documents of a group, about: far above what first-fit decreasing needs to leave little room, and small for one task.
GROUP = 8192


class Tokenizer:
    """Ids of a byte-level BPE vocabulary. The fast coder of the same vocabulary gives the same ids where no special token's string occurs; with one, or where the fast coder gives up (its pattern has a bounded stack), the reference coder is asked."""

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow = json_path, None

    def ids(self, text: str) -> np.ndarray:
        if "<|endoftext|>" not in text:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
            except ValueError:  # a run too long for its pattern
                pass
        if self.slow is None:
            from tokenizers import Tokenizer as Own

            self.slow = Own.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class TournamentTree:
    """Capacities of up to n bins; the first bin with room for a size, in O(log n)."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room, and what it held before."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        left, bin_ = best[node], node - self.leaves
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return bin_, left


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    tree = TournamentTree(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        bin_, left = tree.put(int(sizes[i]))
        bins[i], offsets[i] = bin_, capacity - left - sizes[i]
    return bins, offsets


def pieces(docs: DataFrame, id_col: str, text_col: str, json_path: str, ranks_path: str, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, salt): the pieces of each document. salt: the row's number in its task, so that rows that are alike part ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Tokenizer(json_path, ranks_path), 0
        for batch in batches:
            row, start, length, crc, total, salt = [], [], [], [], [], []
            for k, text in enumerate(column(batch, 1)):
                ids = np.append(own.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    salt.append(seen + k)
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, salt))], names=["id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, salt bigint")


def pack(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) a piece. A sequence's id is its group's number times 2**40 plus its number in the group."""
    cut = written(pieces(docs, id_col, text_col, json_path, ranks_path, capacity, end_id), "pieces")
    groups = max(1, -(-cut.count() // group))
    cut = cut.withColumn("g", F.pmod(F.xxhash64("id", "start", "ids_crc32", "salt"), F.lit(groups)).cast("long"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy(np.int64)
        bins, offsets = first_fit_decreasing(sizes, capacity)
        return rows.drop(columns=["g", "salt"]).assign(sequence_id=(rows["g"].to_numpy(np.int64) << 40) + bins, offset=offsets)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return cut.groupBy("g").applyInPandas(place, schema).withColumnRenamed("id", id_col)
