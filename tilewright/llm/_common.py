"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that numpy works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and driver and executors are one process (as in tests), one under the warehouse; on a cluster that is an error, as each machine would write a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. It cuts the lineage, survives the loss of executors, and has a known size, so that Spark broadcasts it only under spark.sql.autoBroadcastJoinThreshold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more, and lets Spark's cleaner find the shuffle files of the jobs that did."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        jvm.System.gc()


def buckets(spark: SparkSession, size: int, most: int) -> int:
    """How many hash buckets hold so much with at most so much each, on average; as many as a shuffle has partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def column(batch: pa.RecordBatch, i: int) -> pa.Array:
    col = batch.column(i)
    return col.cast(pa.string()) if pa.types.is_string_view(col.type) else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 offsets of its texts in them; nulls are empty."""
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        width = np.int32
    else:
        width = np.int64
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of texts that hold at most so many bytes, or one text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd base, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class SpanHash:
    """Hashes any spans of a sequence of 64-bit values: equal spans get equal values wherever they stand."""

    def __init__(self, values: np.ndarray, base: int = BASE) -> None:
        n = len(values)
        inverse = pow(base, -1, 1 << 64) if base != BASE else _INVERSE
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * powers(base, n), out=self.total[1:])
        self.back = powers(inverse, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts in raw (maximal runs of bytes outside space, never across texts), and the n + 1 offsets of each text's words."""
    n = len(raw)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~space[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values[offsets[i]:offsets[i+1]] for each i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def raw_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame, again: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, all its columns, without the rows that gone names as (id, th), and with one of those that again names. th is the raw text's hash."""
    own, th = docs[id_col], raw_hash(docs[text_col])

    def named(rows: DataFrame) -> tuple[DataFrame, Column]:
        # A merge join at every size: what it shuffles then grows with the input, without a jump where the rows named outgrow a broadcast.
        rows = rows.select(F.col("id").alias("_gone_id"), F.col("th").alias("_gone_th")).hint("merge")
        return rows, own.eqNullSafe(rows["_gone_id"]) & (th == rows["_gone_th"])

    rows, same = named(gone)
    left = docs.join(rows, same, "left_anti")
    if again.isEmpty():
        return left
    rows, same = named(again)
    one = docs.join(rows, same, "left_semi").withColumn("_gone_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return left.join(rows, same, "left_anti").unionByName(one.dropDuplicates([id_col, "_gone_th"]).drop("_gone_th"))


def filtered(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """docs, all its columns, with the rows for which keep says so. keep: makes, once a task, a function from a column of texts to booleans."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = keep()
        for batch in batches:
            yield batch.filter(pa.array(ask(column(batch, at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
