"""Exact dedup: static binary-fuse filters screen incoming digests against an immutable snapshot.

A text's class is its sequence of bytes after each run of ASCII white space has become one space; null counts as empty. The digests of
the snapshot are split into buckets by hash; each bucket gets one binary-fuse filter, a row of a small table. Incoming digests are grouped
on their own first (which deals with copies within the batch, however many), and each distinct one meets its bucket's filter. What passes
joins the snapshot's exact digests; what doesn't pass is new. Then bytes are checked: the texts of every digest that has more than one row, be they of the snapshot, of the batch
or of both, are compared by their least and their largest, which partial aggregates find. Where these differ the digest clashes, and its rows are grouped by their texts themselves.

Defined results: null and empty texts are one class (that of ""), a text of white space alone is the class of " "; of equal texts the
smallest doc_id stays; of rows that repeat that doc_id too, exactly one stays; a null doc_id is larger than any other, and a class of null
ids alone keeps one row and has keep_id null. An empty table gives no rows. Texts of any length are read whole. Ids may be of any type that sorts; where they aren't
numbers, snapshot and batch are dealt by a hash. Other columns of the input, whatever their names, don't matter and aren't returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tilewright.llm._common import buckets, mix, raw_hash, without, written

#: Rows for each bucket of the snapshot's filters, about: so many keys are built into one filter in one task.
BUCKET_ROWS = 1 << 17


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class BinaryFuse:
    """A static filter of 8-bit fingerprints in three neighbouring segments (Graf and Lemire 2022): no false negative, about 1 in 256 false positives, about 9 bits a key."""

    def __init__(self, seed: int, segment: int, table: np.ndarray) -> None:
        self.seed, self.segment, self.table = seed, segment, table

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        window = (size // segment) - 2
        first = ((h >> np.uint64(32)) * np.uint64(window * segment)) >> np.uint64(32)
        first = first.astype(np.int64)
        mask = segment - 1
        second = (first + segment) ^ ((h >> np.uint64(18)).astype(np.int64) & mask)
        third = (first + 2 * segment) ^ (h.astype(np.int64) & mask)
        return np.stack([first, second, third]), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        size = (max(1, -(-int(n * factor) // segment) - 2) + 2) * segment
        for seed in range(1, 200):
            if seed % 20 == 0:  # a few sets of keys need more room
                size += segment * max(1, size // segment // 10)
            slots, prints = cls._slots(keys, seed, segment, size)
            flat, owner = slots.ravel(), np.tile(np.arange(n), 3)
            count = np.bincount(flat, minlength=size)
            crossed = np.zeros(size, np.int64)
            np.bitwise_xor.at(crossed, flat, owner)
            # Peel all slots of one key at once, wave after wave.
            order: list[tuple[np.ndarray, np.ndarray]] = []
            gone, ready = np.zeros(n, bool), np.flatnonzero(count == 1)
            while len(ready):
                who, at = np.unique(crossed[ready], return_index=True)
                where = ready[at]
                gone[who] = True
                order.append((who, where))
                touched = slots[:, who].ravel()
                np.subtract.at(count, touched, 1)
                np.bitwise_xor.at(crossed, touched, np.tile(who, 3))
                ready = np.unique(touched)
                ready = ready[count[ready] == 1]
            if gone.all():
                table = np.zeros(size, np.uint8)
                for who, where in reversed(order):
                    a, b, c = slots[:, who]
                    table[where] = prints[who] ^ table[a] ^ table[b] ^ table[c] ^ table[where]
                return cls(seed, segment, table)
        raise RuntimeError("no seed gives a filter")

    def __contains__(self, key: int) -> bool:
        return bool(self.might(np.array([key], np.uint64))[0])

    def might(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, len(self.table))
        return (prints ^ self.table[a] ^ self.table[b] ^ self.table[c]) == 0

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> BinaryFuse:
        seed, segment = np.frombuffer(raw, "<i8", 2)
        return cls(int(seed), int(segment), np.frombuffer(raw, np.uint8, offset=16))


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, in hexadecimal digits."""
    return F.sha2(normalised(text).cast("binary"), 256)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, digest, n): how often each triple of id, hash of the raw text, and digest occurs."""
    return (
        docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("th"), F.unhex(digest_of(F.col(text_col))).alias("digest"))
        .groupBy("id", "th", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: The row that leads a class is the least by id, nulls last.
def _least() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))


def _classes(rows: DataFrame, n_buckets: int) -> DataFrame:
    # The filters' key is 64 bits of the digest; a bucket is another function of it.
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    out = rows.groupBy("digest").agg(_least().alias("lead"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int"))


def filters(classes: DataFrame) -> DataFrame:
    """One binary-fuse filter a bucket of an immutable snapshot's classes: (bucket, filter)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(rows["key"].to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy(), "filter": [made.dump()]})

    return classes.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(incoming: DataFrame, snapshot_filters: DataFrame) -> DataFrame:
    """incoming with the column maybe: false means that the snapshot surely lacks the digest."""
    names = incoming.columns

    def ask(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = rows[names].copy()
        out["maybe"] = BinaryFuse.load(own["filter"].iloc[0]).might(rows["key"].to_numpy().astype(np.int64).view(np.uint64)) if len(own) else False
        return out

    schema = ", ".join(f"{n} {t}" for n, t in incoming.dtypes) + ", maybe boolean"
    return incoming.groupBy("bucket").cogroup(snapshot_filters.groupBy("bucket")).applyInPandas(ask, schema)


def classes(docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, digest, n, lead, size): the rows, with what leads their class and how many rows it has. incoming: a condition on id, true for rows of the new batch, false for those of the snapshot."""
    rows = written(keyed(docs, id_col, text_col).withColumn("new", F.coalesce(incoming, F.lit(True))), "exact-rows")
    n_buckets = buckets(docs.sparkSession, rows.count(), BUCKET_ROWS)
    old = written(_classes(rows.where("not new"), n_buckets), "exact-snapshot")
    made = written(filters(old), "exact-filters")
    new = written(_classes(rows.where("new"), n_buckets), "exact-new")
    maybe = written(screen(new.select("digest", "key", "bucket"), made).where("maybe").select("digest"), "exact-positives")
    hits = written(new.join(maybe, "digest").select("digest").join(old.select("digest"), "digest"), "exact-hits")
    # A digest is in one class of the snapshot and one of the batch at most.
    each = old.select("digest", "lead", "size", "rows").unionByName(new.select("digest", "lead", "size", "rows"))
    groups = each.join(hits, "digest", "left_anti").unionByName(each.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("lead").alias("lead"), F.sum("size").alias("size"), F.sum("rows").alias("rows")))
    groups = written(groups, "exact-groups")
    many = groups.where("rows > 1").select("digest")
    ends = rows.select("id", "th", "digest").join(many, "digest").select("digest", F.col("id").alias("i"), F.col("th").alias("h"))
    texts = docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    bytes_ = normalised(F.col("text")).cast("binary")
    # A merge join at every size, which Spark may split where keys are heavy; then each task has at most two texts a digest.
    seen = texts.join(ends.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).groupBy("digest").agg((F.min(bytes_) == F.max(bytes_)).alias("same"))
    clashed = written(seen.where("not same").select("digest"), "exact-clashed")
    found = rows.select("id", "th", "digest", "n").join(groups.select("digest", "lead", "size"), "digest")
    if clashed.isEmpty():
        return found
    # Digests that stand for several texts: the texts themselves are the classes there.
    own = docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("th"), F.unhex(digest_of(F.col(text_col))).alias("digest"), normalised(F.col(text_col)).alias("norm")).join(clashed, "digest", "left_semi")
    own = written(own.groupBy("id", "th", "digest", "norm").agg(F.count(F.lit(1)).alias("n")), "exact-texts")
    apart = own.groupBy("norm").agg(_least().alias("lead"), F.sum("n").alias("size"))
    apart = own.join(apart, "norm").select("id", "th", "digest", "n", "lead", "size")
    return found.join(clashed, "digest", "left_anti").select(*apart.columns).unionByName(apart)


def _middle(docs: DataFrame, id_col: str) -> Column:
    if not isinstance(docs.schema[id_col].dataType, NumericType):
        return F.xxhash64("id") > 0
    low, high = docs.agg(F.min(id_col).cast("double"), F.max(id_col).cast("double")).first()
    return F.col("id").cast("double") > ((low or 0) + (high or 0)) / 2


def _leads() -> Column:
    return F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("th") == F.col("lead.th"))


def exact_dedup(docs: DataFrame, incoming: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: (id_col, keep_id, group_size, kept, text_sha256). incoming: a condition on ``id``, true for rows of the new batch; by default ids above the middle of their range are the new batch. The result doesn't depend on it."""
    found = classes(docs, _middle(docs, id_col) if incoming is None else incoming, id_col, text_col)
    each = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")
    return found.select("id", "lead", "size", "digest", _leads().alias("first"), each).select(
        F.col("id").alias(id_col),
        F.col("lead.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("first") & (F.col("k") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, incoming: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all its columns, with one row of each class."""
    found = classes(docs, _middle(docs, id_col) if incoming is None else incoming, id_col, text_col)
    gone = written(found.where(~_leads()).select("id", "th"), "exact-gone")
    again = written(found.where(_leads() & (F.col("n") > 1)).select("id", "th"), "exact-again")
    return without(docs, gone, again, id_col, text_col)
