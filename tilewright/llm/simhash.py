"""SimHash near-dedup: fingerprints that differ in few bits are linked, by a segment-popcount embedding.

A fingerprint has one bit a position, set if more than half of the 64-bit hashes of the text's word shingles (repeats included) set it. It is embedded as the
counts of set bits in each of its segments. A differing bit changes one count by one, so the Manhattan distance of two embeddings is never above the
Hamming distance of their fingerprints: for links of up to two bits only fingerprints whose embeddings are within two matter, and such two have a common
grid point within one of both. So each distinct fingerprint is put at its own grid point and at those one step away, fingerprints meet at
grid points in one join, and the Hamming distance decides. As copies share a fingerprint, and a fingerprint has a bounded number of neighbours within two
bits (2,080), the links are linear in the documents; connected components are found over fingerprints.

Defined results: a text of fewer words than a shingle is one shingle; null texts and those without a word have fingerprint zero, linked like any other; the
component's id is the smallest doc_id in it; rows that repeat a doc_id are each returned; a null doc_id is larger than any other. An empty table
gives no rows. A text of any length is read whole; a bit that exactly half the hashes set is 0. Other columns of the input, whatever their names, don't matter; the filter keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm._common import buckets, column, mix, raw_hash, without, written
from tilewright.llm.components import components

SHINGLE = 3
#: Segments of two bits: a grid of 32 dimensions with counts from 0 to 2. Finer segments meet fewer strangers and cost more steps.
SEGMENTS = 32
DISTANCE = 2
#: What a filtering stage takes for near copies: shingles of so many words, and their Jaccard similarity; and parts of a set whose least hashes are compared.
WORDS, SIMILARITY, SAMPLES = 5, 0.8, 8
#: Shingles before one that a text carries along, so that two texts meet at the first that they share; what that misses meets twice.
EARLIER = 64
#: Longs of a text's parities: each shingle turns one of their bits over, so that two texts' parities differ in no more bits than their sets have shingles apart.
PARITIES = 16
#: Bits of the table that tells shingles of one text from others (2**BITMAP bits, sent to all tasks), and of its pages.
BITMAP, PAGE = 27, 19
#: Shingles counted in one hash bucket, about.
BUCKET = 1 << 22


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each shingle of size words, lower-cased (A-Z)."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)), repeat(42)))


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; hashes of all texts, one text after the other. Bits are added up in eight lanes a word, in runs short enough for a lane."""
    n = len(counts)
    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    ends = np.cumsum(counts)
    starts = ends - counts
    runs = -(-counts // 255)
    owner = np.repeat(np.arange(n), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    run_starts = starts[owner] + nth * 255
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        part = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, run_starts)
        for lane in range(8):
            total = np.bincount(owner, (part >> np.uint64(8 * lane)) & np.uint64(255), n)
            out |= (2 * total > counts).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, th, fp): fp as a signed long, th the raw text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, hashes, counts, held = [], [], [], 0
            for text in column(batch, 2):
                own = np.array(shingle_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), size), np.uint64)
                hashes.append(own)
                counts.append(len(own))
                held += len(own)
                if held > 1 << 19:
                    out.append(majorities(np.concatenate(hashes), np.array(counts)))
                    hashes, counts, held = [], [], 0
            if counts:
                out.append(majorities(np.concatenate(hashes), np.array(counts)))
            found = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["id", "th", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, th bigint, fp bigint")


def grid_points(fp: Column, segments: int = SEGMENTS) -> Column:
    """The grid points within one step of a fingerprint's embedding, as an array of longs: one field a segment holds its count of set bits."""
    width = 64 // segments
    if width == 2:
        # The count of two bits, in place: its high bit is their product, its low one their difference.
        m = F.lit(0x5555555555555555)
        a, b = fp.bitwiseAND(m), F.shiftrightunsigned(fp, 1).bitwiseAND(m)
        point = F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))
        top, field = 2, 2
    else:
        field = max(1, width.bit_length())
        if field * segments > 64:
            raise ValueError("the counts of so many segments don't fit a grid point")
        parts = [F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, width * s).bitwiseAND(F.lit((1 << width) - 1))).cast("long"), field * s) for s in range(segments)]
        point = parts[0]
        for p in parts[1:]:
            point = point.bitwiseOR(p)
        top = width

    def steps(k: Column) -> Column:
        count = F.call_function("shiftrightunsigned", point, k * field).bitwiseAND(F.lit((1 << field) - 1))
        up = F.when(count < top, point.bitwiseXOR(F.call_function("shiftleft", count.bitwiseXOR(count + 1), k * field)))
        down = F.when(count > 0, point.bitwiseXOR(F.call_function("shiftleft", count.bitwiseXOR(count - 1), k * field)))
        return F.array(up, down)

    around = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), steps))
    return F.array_compact(F.concat(F.array(point), around))


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(a, b), a > b: the distinct fingerprints of prints (fp) that differ in at most so many bits (two at most)."""
    if distance > 2:
        raise ValueError("grid points one step away serve distances of two at most")
    at = prints.select("fp", F.explode(grid_points(F.col("fp"), segments)).alias("point"))
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    # A merge join at every size: Spark estimates the rows of points as those of prints, and would send them to all tasks by way of the driver.
    met = at.alias("x").hint("merge").join(at.alias("y"), (F.col("x.point") == F.col("y.point")) & (F.col("x.fp") > F.col("y.fp")) & near)
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, samples: int) -> DataFrame:
    """(id, th, fp, wide, n, mins, odd): the fingerprint over shingles of three words; for the set of shingles of so many words its fingerprint, size, the least hash of each of so many parts of it (by hash; null where a part is empty), and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, wide, sizes, mins, odd = [], [], [], [], []
            for text in column(batch, 2):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                short.append(np.array(shingle_hashes(raw), np.uint64))
                own = np.unique(np.array(shingle_hashes(raw, words), np.uint64))
                mixed = mix(own)
                part = (mixed % np.uint64(samples)).astype(np.int64)
                # own ascends, so the first of a part is its least.
                found, first = np.unique(part, return_index=True)
                least: list[int | None] = [None] * samples
                for k, i in zip(found.tolist(), first.tolist(), strict=True):
                    least[k] = int(own[i].astype(np.int64))
                wide.append(own)
                sizes.append(len(own))
                mins.append(least)
                turned = np.bincount(((mixed >> np.uint64(32)) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
                odd.append(np.packbits(turned.astype(np.uint8)).view(np.int64))
            prints = [pa.array(_in_runs(x).view(np.int64), pa.int64()) for x in (short, wide)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *prints, pa.array(sizes, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["id", "th", "fp", "wide", "n", "mins", "odd"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, th bigint, fp bigint, wide bigint, n bigint, mins array<bigint>, odd array<bigint>"
    return docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _in_runs(hashes: list[np.ndarray], most: int = 1 << 19) -> np.ndarray:
    out, first, held = [], 0, 0
    for i, h in enumerate(hashes):
        held += len(h)
        if held > most or i == len(hashes) - 1:
            part = hashes[first : i + 1]
            out.append(majorities(np.concatenate(part), np.array([len(x) for x in part])))
            first, held = i + 1, 0
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similar(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b): fingerprints of texts whose sets of shingles have at least that Jaccard similarity. rows: sketches.

    A first round, that finds most; rest() finds the others. Texts as alike as that share the least hash of most parts of their sets. Of the texts that share one, the one whose wide fingerprint is nearest to the majority of all of them is their centre, and each is compared with the centre of
    each of its parts: pairs are linear in the texts, however many share a hash. Sizes rule some out, and the sets decide."""
    each = rows.select("id", "th", "fp", "wide", "n", F.posexplode("mins").alias("t", "m")).where("m is not null")
    shared = written(each.groupBy("t", "m").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("t", "m"), "near-shared")
    members = written(each.join(shared, ["t", "m"]), "near-members")
    bits = [F.sum(F.shiftrightunsigned("wide", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    votes = members.groupBy("t", "m").agg(F.count(F.lit(1)).alias("votes"), *bits)
    middle = F.lit(0).cast("long")
    for b in range(64):
        middle = middle.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("votes"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    middles = written(votes.select("t", "m", middle.alias("middle")), "near-middles")
    # Written between, so that Spark may split this join's heavy keys, and the aggregate below has a partial step.
    members = written(members.join(middles, ["t", "m"]).withColumn("d", _differ(F.col("wide"), F.col("middle"))).drop("middle"), "near-distances")
    centres = written(members.groupBy("t", "m").agg(F.min(F.struct("d", "fp", "n", "id", "th")).alias("c")), "near-centres")
    met = members.join(centres, ["t", "m"]).where(F.col("fp") != F.col("c.fp"))
    met = met.where(F.least("n", "c.n") >= similarity * F.greatest("n", "c.n"))
    pairs = met.select("id", "th", F.col("fp").alias("a"), F.col("c.id").alias("other_id"), F.col("c.th").alias("other_th"), F.col("c.fp").alias("b"))
    pairs = written(pairs.dropDuplicates(["id", "th", "other_id", "other_th"]), "near-pairs")
    return _alike(docs, pairs, id_col, text_col, words, similarity)


def _alike(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b) of pairs (id, th, a, other_id, other_th, b) whose texts' sets of shingles are as similar as asked."""
    texts = docs.select(F.col(id_col).alias("i"), raw_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    left = pairs.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("a", "b", "other_id", "other_th", F.col("text").alias("left"))
    both = left.join(texts, F.col("other_id").eqNullSafe(F.col("i")) & (F.col("other_th") == F.col("h"))).select("a", "b", "left", F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (set(shingle_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"), words)) for t in (x, y))
                common = len(p & q)
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def counted(docs: DataFrame, text_col: str, words: int, total: int) -> DataFrame:
    """(h, df), arrays, a row a run of ascending hashes: the shingles of two rows or more, and the number of rows. total: the shingles of all rows. They are counted in hash buckets, after a count within each task, so that a common shingle is no hot key."""
    n = buckets(docs.sparkSession, total, BUCKET)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(((h >> np.uint64(48)) * np.uint64(n)) >> np.uint64(16), np.arange(n + 1))
        arrays = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int64())) for x in (h.view(np.int64), c)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), *arrays], names=["k", "h", "c"]).filter(pa.array(np.diff(edges) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in column(batch, 0):
                held.append(_set(text, words))
                size += len(held[-1])
                if size > 1 << 21:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def add(table: pa.Table) -> pa.Table:
        h, c = (pc.list_flatten(table[x]).to_numpy() for x in "hc")
        h, at = np.unique(h.view(np.uint64), return_inverse=True)
        df = np.bincount(at, c, len(h)).astype(np.int64)
        h, df = h[df > 1], df[df > 1]
        edges = pa.array(np.append(np.arange(0, len(h), 1 << 12), len(h)), pa.int32())
        return pa.table({k: pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for k, x in (("h", h.view(np.int64)), ("df", df))})

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "k int, h array<bigint>, c array<bigint>")
    return each.groupBy("k").applyInArrow(add, "h array<bigint>, df array<bigint>")


def _set(text: pa.Scalar, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), words), np.uint64))


def _bitmap(counts: DataFrame) -> np.ndarray:
    """A table of fixed size with a bit set for each hash of counts, by its first BITMAP bits; it is put together by pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP)).astype(np.int64)
            for page in np.unique(at >> PAGE).tolist():
                own = at[at >> PAGE == page] & ((1 << PAGE) - 1)
                np.bitwise_or.at(pages.setdefault(page, np.zeros(1 << PAGE - 3, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([p.tobytes() for p in pages.values()], pa.binary())], names=["page", "bits"])

    def both(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()])
        return pa.table({"page": table["page"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((1 << BITMAP - PAGE, 1 << PAGE - 3), np.uint8)
    schema = "page int, bits binary"
    for r in counts.select("h").mapInArrow(run, schema).groupBy("page").applyInArrow(both, schema).toLocalIterator():
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _prefix(n: Column, part: float) -> Column:
    """How many of n shingles come before the last ceil(part * n) - 1 of them; rounded up where floats leave a doubt."""
    return (n - F.ceil(n * F.lit(part) - F.lit(1e-6)) + 1).cast("int")


def rest(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b): every link of fingerprints of texts as similar as asked that groups (node, root) doesn't hold together yet. rows: sketches.

    A prefix-filter join: each set of shingles is put in one order, rare ones first. Of two sets x and y of that similarity s, ceil(s / (1 + s) * (|x| + |y|)) shingles at least are common, so the first common one
    has that many behind it (itself included) in both: it is among the first |x| - ceil(s * |x|) + 1 of each, and among the first |x| - ceil(2s / (1 + s) * |x|) + 1 of the smaller. Shingles of one text alone come first and meet nothing, so a
    text with enough of them is left out early, by a bitmap that may only err towards keeping it. Texts meet at a shingle only across groups: those outside the shingle's main group meet all that have it, and at the first shingle that
    they share there: where the bounds hold at a later one they hold at the first, which has more behind it. Sets x and y as similar as that are at most (1 - s) / (1 + s) * (|x| + |y|) shingles apart, and their parities differ in no more bits:
    most pairs that aren't links are told so without their texts."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    counts = written(counted(docs, text_col, words, total), "near-counts")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at, sizes, found, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                many = [len(x) for x in found]
                where = pa.array(np.repeat(at, many))
                return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(np.repeat(sizes, many), pa.int64()), pa.array(np.concatenate(found).view(np.int64))], names=["id", "th", "n", "h"])

            for i, text in enumerate(column(batch, 2)):
                own = _set(text, words)
                bit = (own >> np.uint64(64 - BITMAP)).astype(np.int64)
                some = own[bits[bit >> 3] >> (bit & 7) & 1 == 1]
                # Shingles without a bit are this text's alone; where they fill its prefix, no other text is as similar.
                if len(own) - len(some) < len(own) - np.ceil(similarity * len(own) - 1e-6) + 1 and len(some):
                    at.append(i)
                    sizes.append(len(own))
                    found.append(some)
                    held += len(some)
                    if held > 1 << 18:
                        yield out()
                        at, sizes, found, held = [], [], [], 0
            if held:
                yield out()

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    met = texts.mapInArrow(run, f"id {kind}, th bigint, n bigint, h bigint").join(counts.selectExpr("inline(arrays_zip(h, df))").hint("merge"), "h")
    # A set, as rows may repeat.
    each = written(met, "near-met").groupBy("id", "th", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("at"))
    each = each.withColumn("alone", (F.col("n") - F.size("at")).cast("int")).withColumn("most", _prefix(F.col("n"), similarity) - F.col("alone")).where("most > 0")
    each = each.select(F.col("id").alias("i"), F.col("th").alias("t"), "n", "alone", F.slice("at.h", F.lit(1), F.col("most")).alias("at"))
    own = rows.select("id", "th", "fp").distinct().join(groups, F.col("fp") == F.col("node"), "left").select("id", "th", "fp", F.coalesce("root", "fp").alias("root"))
    each = own.join(each, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("id", "th", "fp", "root", "n", "alone", F.posexplode("at").alias("k", "h"))
    each = each.select("id", "th", "fp", "root", "n", "h", (F.col("alone") + F.col("k")).alias("before"))
    each = written(each.withColumn("low", F.col("before") < _prefix(F.col("n"), 2 * similarity / (1 + similarity))), "near-prefixes")
    mixed = each.groupBy("h", "root").agg(F.count(F.lit(1)).alias("many"), F.max("low").alias("low")).groupBy("h")
    mixed = mixed.agg(F.max(F.struct("many", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.max("low").alias("low")).where("roots > 1 and low").select("h", "main.root")
    each = each.join(written(mixed.withColumnRenamed("root", "main"), "near-mixed"), "h")
    before = Window.partitionBy("id", "th").orderBy("before").rowsBetween(-EARLIER, -1)
    odd = rows.select(F.col("id").alias("i"), F.col("th").alias("t"), "odd").distinct()
    each = each.withColumn("earlier", F.collect_list("h").over(before)).join(odd, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).drop("i", "t")
    each = written(each, "near-across")
    x, y = each.where("root <> main").alias("x"), each.alias("y")
    across = (F.col("x.root") < F.col("y.root")) | ((F.col("y.root") == F.col("y.main")) & (F.col("x.root") != F.col("y.root")))
    sizes = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6
    behind = F.least(F.col("x.n") - F.col("x.before"), F.col("y.n") - F.col("y.before")) >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
    apart = sum((_differ(F.col("x.odd")[k], F.col("y.odd")[k]) for k in range(PARITIES)), F.lit(0))
    few = apart <= (1 - similarity) / (1 + similarity) * (F.col("x.n") + F.col("y.n")) + 1e-6
    # Rows of a text repeat its parities and most of its earlier shingles, so their table is far smaller than they are: a merge join at every size.
    pairs = x.hint("merge").join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.low") | F.col("y.low")) & across & sizes & behind & few & ~F.arrays_overlap("x.earlier", "y.earlier"))
    pairs = written(pairs.select("x.id", "x.th", F.col("x.fp").alias("a"), F.col("y.id").alias("other_id"), F.col("y.th").alias("other_th"), F.col("y.fp").alias("b")), "near-candidates")
    pairs = written(pairs.dropDuplicates(["id", "th", "other_id", "other_th"]), "near-pairs")
    return _alike(docs, pairs, id_col, text_col, words, similarity)


def grouped(rows: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, groups: DataFrame | None = None) -> DataFrame:
    """(fp, lead) for each fingerprint of rows (id, th, fp): lead is the least (none, id, th) among the rows reachable by links, null ids last. groups: components (node, root), where they are known."""
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    prints = written(rows.groupBy("fp").agg(lead.alias("lead")), "prints")
    if groups is None:
        groups = written(components(links(prints, distance, segments)), "components")
    rooted = prints.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("lead").alias("lead"))
    return rooted.select("fp", "root").join(lowest, "root").select("fp", "lead")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(id_col, fp, component): component is the smallest id among the texts reachable by links."""
    rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    return rows.join(grouped(rows, distance, segments), "fp").select(F.col("id").alias(id_col), "fp", F.col("lead.id").alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all its columns, with one row of each group of near copies: that of the smallest id. Texts are linked if their fingerprints differ in at most two bits, or their sets of shingles of so many words are as similar as asked."""
    rows = written(sketches(docs, id_col, text_col, words, SAMPLES), "sketches")
    more = written(similar(docs, rows, id_col, text_col, words, similarity), "near-similar")
    groups = written(components(links(rows.select("fp").distinct()).unionByName(more)), "near-groups")
    groups = _merged(groups, written(rest(docs, rows, groups, id_col, text_col, words, similarity), "near-rest"))
    found = rows.groupBy("id", "th", "fp").agg(F.count(F.lit(1)).alias("n")).join(grouped(rows, groups=groups), "fp")
    leads = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("th") == F.col("lead.th"))
    gone = written(found.where(~leads).select("id", "th"), "near-gone")
    again = written(found.where(leads & (F.col("n") > 1)).select("id", "th"), "near-again")
    return without(docs, gone, again, id_col, text_col)


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, root) with what links (a, b) join; only the groups that they touch are worked on."""
    root = lambda c: groups.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}"))
    ends = links.join(root("a"), F.col("a") == F.col("na"), "left").join(root("b"), F.col("b") == F.col("nb"), "left")
    ends = written(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), "near-joined")
    if ends.isEmpty():
        return groups
    moved = written(components(ends), "near-moved").withColumnsRenamed({"node": "from", "root": "to"})
    old = groups.join(moved, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
    new = moved.join(groups, F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("to").alias("root"))
    return written(old.unionByName(new), "near-groups")
