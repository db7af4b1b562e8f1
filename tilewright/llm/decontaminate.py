"""Benchmark decontamination: Wu-Manber search for windows of benchmark items, over words.

Words are lower-cased (A-Z) runs of ASCII letters and digits and of non-ASCII characters. A window is ten consecutive words of an item (a
shorter item is one window). The machine for windows of m words looks at the block of two words at the end of a span of m: a shift table
says how far the span can move before that block could stand in a window; where the shift is zero the block's hash bucket lists windows, whose
other words are compared directly. Items of fewer than ten words have machines of their own, by length, so that they don't shorten the shifts.

The windows sent to the executors are bounded: the benchmark is cut into blocks of at most ``BLOCK_WORDS`` words by a running sum over its items. Rows pass from
block to block and gather spans and items on the way, without a shuffle; ``BLOCKS`` blocks are searched in one scan, and the rows are written between scans.

Defined results: a null text has no words (n_words 0, no item), and neither an item of none nor one without words occurs anywhere;
items of equal text all count; items are listed once, sorted as strings; repeated rows are returned as often as they come; an empty
benchmark hits nothing; an empty table gives no rows. Null item ids are left out of the list, but their words hit. Texts of any length are searched whole; overlapping and
touching windows are one span, so ties between them don't matter; a row's other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import column, filtered, written

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 10
#: Words of the benchmark that one pass holds: about 100 MB of tables in a Python worker.
BLOCK_WORDS = 200_000
#: Blocks that one scan of the documents searches.
BLOCKS = 4


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Machine:
    """Wu-Manber tables for windows of m words. Each window is a tuple of words with the set of its items' ids."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set]) -> None:
        self.m, self.block = m, min(2, m)
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        b = self.block
        for w, items in windows.items():
            for end in range(b, m + 1):
                key = w[end - b : end] if b > 1 else w[end - 1]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.bucket[w[m - b :] if b > 1 else w[-1]].append((w, items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, ids) for each occurrence."""
        m, b, n = self.m, self.block, len(text)
        shift, most = self.shift.get, m - b + 1
        at = m
        while at <= n:
            key = (text[at - 2], text[at - 1]) if b > 1 else text[at - 1]
            step = shift(key, most)
            if step:
                at += step
                continue
            seen = tuple(text[at - m : at])
            for w, items in self.bucket[key]:
                if seen == w:
                    yield at - m, items
            at += 1


def machines(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Machine]:
    by_length: dict[int, dict] = defaultdict(dict)
    for item, text in items:
        ws = words(text)
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            by_length[m].setdefault(tuple(ws[i : i + m]), set()).add(item)
    return [Machine(m, w) for m, w in sorted(by_length.items())]


def find(text: list[bytes], search: list[Machine]) -> tuple[list[tuple[int, int]], set]:
    """Merged spans [start, end) of hit words, and the ids of the items that occur."""
    spans, found = [], set()
    for machine in search:
        for start, items in machine.search(text):
            spans.append((start, start + machine.m))
            found |= items
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most so many words (one item alone may hold more); the driver holds one block at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        n = len(words(text))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _scan(rows: DataFrame, block: list[tuple[object, str | None]], window: int) -> DataFrame:
    """rows (id, text, n_words, spans, items) with one more block's spans and items."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    spans_type, names = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = machines(sent.value, window)
        for batch in batches:
            n, spans, items = [], [], []
            for text, old, had in zip(column(batch, 1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                ws = words(text)
                hit, found = find(ws, search)
                hit = merged(hit + [(s["start"], s["end"]) for s in old]) if old else hit
                n.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted({str(x) for x in found if x is not None}.union(had)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))], names=names)

    return rows.mapInArrow(run, rows.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id_col, n_words, spans, items): the merged spans of hit words, and the items with an occurring window, a row of docs."""
    none = F.expr("array_repeat(cast(null as struct<start:bigint,end:bigint>), 0)"), F.expr("cast(array() as array<string>)")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), none[0].cast(_SPANS).alias("spans"), none[1].alias("items"))
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_words)):
        # Each block of a stage has a Python worker of its own, with its own tables; between stages the rows are written.
        rows = _scan(written(rows, "hits") if k and k % BLOCKS == 0 else rows, block, window)
    return rows.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all its columns, without the rows that hold a window of an item. Blocks of the benchmark filter one after the other; as in decontaminate(), rows are written between stages of BLOCKS blocks."""
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_words)):
        docs = written(docs, "clean") if k and k % BLOCKS == 0 else docs
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(sent: object = sent) -> object:
            search = machines(sent.value, window)
            return lambda col: [not any(next(m.search(ws), None) for m in search) for ws in map(words, col.to_pylist())]

        docs = filtered(docs, text_col, keep)
    return docs
