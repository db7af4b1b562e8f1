"""Substring dedup by recompression: words covered by a window of 20 words that also starts earlier are found, over all documents.

Every document is a sequence of symbols, at first its words. Level 1 names maximal runs of one word by unit and length; each level above gives every symbol a coin
from its name, and a symbol of coin 0 followed by one of coin 1 becomes a pair, named by both. A name depends on what it stands for alone, so it is global. What
a window's symbols at a level are depends on the window alone but for its edges: its first and last run may go on outside, and at each pairing a first symbol of coin 1
or a last one of coin 0 may have its partner outside. What is left without these is the window's interior: consistent symbols, the same wherever the window stands.

Spark rounds, each for two levels, join what all documents know of names: a round's dictionary, split into hash buckets, tells each chunk of documents which of the names in its windows'
interiors are met more than once anywhere. A window with a name that isn't can't repeat and goes, and with it what only it needed; so the windows left have shared symbols up to the highest level, of about six
words. These decide where repeats may be; windows that share all are then matched by a hash of their words, and verified: equal hashes are arranged as a tree of at
most ``FAN`` children a window, the words of each parent travel to its children, a stretch of consecutive windows at once, and are compared. A window whose
words equal those of a parent that starts earlier is a repeat. Where they differ the hash clashes, and all windows of that hash are grouped by their words themselves. So a hash never decides.

Documents are read once, into chunks of bounded size that hold each distinct word once; the passes move these, packed. In a chunk equal windows meet first, so that a
passage that is everywhere costs one record a chunk and window. Names, windows and their buckets are dealt to as many buckets as the number of words asks for.

Defined results: ids are integers; a null text has no words, and texts of fewer than 20 words lose none; only doc_id and start order windows, so that of rows that
repeat both id and text none is earlier, and a null id is later than any other. A text of any length is one chunk's at most, whole. An empty table gives no rows. The digest of no words is
that of the empty string. Other columns of the input, whatever their names, don't matter and aren't returned.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import SpanHash, buckets, column, discard, mix, slices, utf8, written

WINDOW = 20
#: The levels of names that each Spark round asks for: words and runs, then pairs.
ROUNDS = ((0, 1), (2, 3), (4, 5))
#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 6 << 20
#: Words of the corpus for each bucket of names or windows.
BUCKET_WORDS = 1 << 20
#: The bits of a name: 48, so that questions are short. Names that clash only add windows to be compared.
KEPT = ~np.uint64(0xFFFF)
#: Windows that one window's words are sent to at most, for each chunk that repeats a row.
FAN = 8


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a, "<u4").tobytes() for a in arrays)


def unpack(raw: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(raw, "<u4").reshape(n, -1).astype(np.int64))


def pack_small(values: np.ndarray) -> bytes:
    """Numbers in two bytes each if all fit, else in four; the first byte says which."""
    kind = "<u2" if not len(values) or values.max() < 1 << 16 else "<u4"
    return kind[-1].encode() + np.ascontiguousarray(values, kind).tobytes()


def unpack_small(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u" + chr(raw[0]), offset=1).astype(np.int64)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def squeeze_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed by place of their bytes."""
    return squeeze(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze_numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_names(names: np.ndarray) -> bytes:
    """The first 48 bits of names."""
    return (names >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_names(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() << np.uint64(16)


@lru_cache
def _edges(n: int) -> np.ndarray:
    """The least names of buckets 1 to n - 1: equal ranges of values."""
    return np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)


def by_bucket(names: np.ndarray, n: int) -> np.ndarray:
    """The n + 1 offsets of the buckets of sorted names."""
    return np.concatenate([[0], np.searchsorted(names, _edges(n)), [len(names)]])


def groups(ordered: np.ndarray) -> np.ndarray:
    """The number, from 0, of each member's group of equal neighbours."""
    return np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) - 1 if len(ordered) else np.empty(0, np.int64)


@dataclass
class Level:
    """The symbols of one level: names, whether the level made them, each window's interior [low, high), and of words their numbers."""

    names: np.ndarray
    fresh: np.ndarray
    low: np.ndarray
    high: np.ndarray
    of: np.ndarray | None = None

    def asked(self) -> np.ndarray:
        """Whether the level made the symbol and it is in some window's interior."""
        some, n = self.low < self.high, len(self.names) + 1
        edge = np.bincount(self.low[some], minlength=n) - np.bincount(self.high[some], minlength=n)
        return self.fresh & (np.cumsum(edge)[:-1] > 0)


def recompress(names: np.ndarray, first: np.ndarray, starts: np.ndarray, last: int, window: int = WINDOW) -> Iterator[Level]:
    """Levels 0 to last over words. first: whether a word is its text's first; starts: the windows' first words."""
    low, high = starts.astype(np.int32), (starts + window).astype(np.int32)
    yield Level(names, np.ones(len(names), bool), low, high)
    for level in range(1, last + 1):
        if level == 1:
            new = first.copy()
            new[1:] |= names[1:] != names[:-1]
            at, begin = np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)
            length = np.diff(np.append(begin, len(names)))
            fresh = length > 1
            low, high = at[low] + 1, at[high - 1]
            names, some = names[begin], np.flatnonzero(fresh)
            names[some] = mix(names[some] ^ mix(length[some].astype(np.uint64))) & KEPT
            first = first[begin]
        else:
            coin = mix(names ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63) == 1
            left = np.append(~coin[:-1] & coin[1:] & ~first[1:], False)
            keep = np.ones(len(names), bool)
            keep[1:] = ~left[:-1]
            at, pair = np.cumsum(keep, dtype=np.int32) - 1, np.flatnonzero(left)
            low, high = low + coin[low], high - ~coin[np.maximum(high - 1, 0)]
            some = low < high
            low, high = at[np.where(some, low, 0)] * some, (at[np.where(some, high - 1, 0)] + 1) * some
            names = names.copy()
            names[pair] = mix(names[pair] * np.uint64(3) ^ mix(names[pair + 1] + np.uint64(level))) & KEPT
            names, first, fresh = names[keep], first[keep], left[keep]
        some = low < high
        low, high = low * some, high * some
        yield Level(names, fresh, low, high)


@dataclass
class Chunk:
    """Documents with windows that may repeat, in the order of their ids (null last), over a vocabulary of their own. live: whether such a window starts at a word."""

    number: int
    vocabulary: list[bytes]
    words: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    none: np.ndarray
    rows: list[np.ndarray]
    live: np.ndarray

    @cached_property
    def own(self) -> np.ndarray:
        """The vocabulary's names."""
        return np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary], np.uint64) & KEPT

    def dump(self) -> dict:
        # Words are numbered as they first occur, and a first occurrence travels as zero.
        first = np.zeros(len(self.vocabulary), np.int64)
        first[self.words[::-1]] = np.arange(len(self.words))[::-1]
        order = np.argsort(first)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        words = number[self.words] + 1
        words[first] = 0
        n = np.array([len(r) for r in self.rows])
        packed = [np.concatenate(self.rows) if self.rows else n, n, np.diff(self.offsets)]
        return {"kind": STATE, "chunk": self.number, "a": squeeze(b" ".join([self.vocabulary[k] for k in order.tolist()])), "b": squeeze_numbers(words), "c": self.ids.astype("<i8").tobytes(), "d": self.none.astype("u1").tobytes(), "e": b"".join(map(pack, packed)), "f": np.packbits(self.live).tobytes()}

    @classmethod
    def load(cls, table: pa.Table) -> Chunk:
        r = table.to_pylist()[0]
        words = unsqueeze_numbers(r["b"])
        words[words == 0] = np.arange(1, np.count_nonzero(words == 0) + 1)
        words, ids, none = words - 1, np.frombuffer(r["c"], "<i8"), np.frombuffer(r["d"], "u1").astype(bool)
        e = unpack(r["e"], 1)[0]
        n, lengths = e[-2 * len(ids) : len(e) - len(ids)], e[len(e) - len(ids) :]
        rows = np.split(e[: -2 * len(ids)], np.cumsum(n)[:-1])
        return cls(r["chunk"], unsqueeze(r["a"]).split(b" "), words, np.concatenate([[0], np.cumsum(lengths)]), ids, none, rows, np.unpackbits(np.frombuffer(r["f"], np.uint8), count=len(words)).astype(bool))

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the document of each live window."""
        at = np.flatnonzero(self.live)
        return at, np.searchsorted(self.offsets, at, "right") - 1

    def names(self) -> np.ndarray:
        return self.own[self.words]

    def first(self) -> np.ndarray:
        out = np.zeros(len(self.words), bool)
        out[self.offsets[:-1]] = True
        return out

    def levels(self, which: tuple[int, ...]) -> list[Level]:
        out = [x for k, x in enumerate(recompress(self.names(), self.first(), self.starts()[0], max(which))) if k in which]
        if 0 in which:
            out[0].of = self.words
        return out

    def text(self, first: int, last: int) -> bytes:
        return b" ".join([self.vocabulary[w] for w in self.words[first:last].tolist()])

    def needed(self) -> np.ndarray:
        """Whether a word is of a document that has a live window."""
        return np.repeat(np.add.reduceat(self.live, self.offsets[:-1]) > 0, np.diff(self.offsets))

    def compact(self) -> Chunk | None:
        """Without documents that have no live window."""
        inner = self.needed()
        keep = inner[self.offsets[:-1]]
        if not keep.any():
            return None
        if keep.all():
            return self
        words = self.words[inner]
        used = np.flatnonzero(np.bincount(words, minlength=len(self.vocabulary)))
        renamed = np.zeros(len(self.vocabulary), np.int64)
        renamed[used] = np.arange(len(used))
        words = renamed[words]
        offsets = np.concatenate([[0], np.cumsum(np.diff(self.offsets)[keep])])
        out = Chunk(self.number, [self.vocabulary[w] for w in used.tolist()], words, offsets, self.ids[keep], self.none[keep], [r for r, k in zip(self.rows, keep.tolist(), strict=True) if k], self.live[inner])
        out.own = self.own[used]
        return out


#: Kinds of rows between passes: a document, a chunk, a chunk's question to a bucket of names or of windows, a hash that clashes, the windows of a chunk that may repeat.
DOCUMENT, STATE, QUESTION, CLASH, LIVE = range(5)
_WAY = "kind int, chunk bigint, bucket int, idx int, id bigint, n_words bigint, sha string, a binary, b binary, c binary, d binary, e binary, f binary"
_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("idx", pa.int32()), ("id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), *((c, pa.binary()) for c in "abcdef")])


def _rows(rows: list[dict], schema: pa.Schema = _ARROW) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Pass 0: documents, chunks, and the chunks' first questions."""
    base, seq, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
    for batch in batches:
        _, offsets = utf8(column(batch, 1))
        for a, b in slices(offsets, CHUNK_BYTES):
            held += zip(batch.column(0)[a:b].to_pylist(), column(batch, 1)[a:b].to_pylist(), strict=True)
            size += int(offsets[b] - offsets[a])
            if size >= CHUNK_BYTES:
                yield from _rows(_chunk(base + seq, held, n)).to_batches()
                held, size, seq = [], 0, seq + 1
    if held:
        yield from _rows(_chunk(base + seq, held, n)).to_batches()


def _chunk(number: int, docs: list[tuple[int | None, str | None]], n: int) -> list[dict]:
    index: dict[bytes, int] = defaultdict(count().__next__)
    out, own = [], {}
    for idx, (id_, text) in enumerate(docs):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        whole = b" ".join(words)
        out.append({"kind": DOCUMENT, "chunk": number, "idx": idx, "id": id_, "n_words": len(words), "sha": hashlib.sha256(whole).hexdigest()})
        if len(words) >= WINDOW:
            # Rows that repeat id and words are one document here.
            key = (id_ is None, id_ or 0, whole)
            if key in own:
                own[key][1].append(idx)
            else:
                own[key] = (np.fromiter(map(index.__getitem__, words), np.int64, len(words)), [idx])
    if own:
        order = sorted(own)
        words = [own[k][0] for k in order]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        live = np.ones(offsets[-1], bool)
        for k in range(1, WINDOW):
            live[offsets[1:] - k] = False
        made = Chunk(number, list(index), np.concatenate(words), offsets, np.array([k[1] for k in order], np.int64), np.array([k[0] for k in order], bool), [np.array(own[k][1]) for k in order], live)
        out += [made.dump(), *_names_asked(made, ROUNDS[0], n)]
    return out


def _named(chunk: Chunk, which: tuple[int, ...]) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray]:
    """The levels, which symbols they ask for, and the sorted names asked for that the chunk has once, and more often."""
    levels = chunk.levels(which)
    asked = [x.asked() for x in levels]
    found = [x.names[a] for x, a in zip(levels, asked, strict=True)]
    if 0 in which:  # words are counted by their numbers
        times = np.bincount(chunk.words[asked[0]], minlength=len(chunk.own))
        found[0] = np.concatenate([chunk.own[times > 0], chunk.own[times > 1]])
    names, times = np.unique(np.concatenate(found), return_counts=True)
    return levels, asked, names[times == 1], names[times > 1]


def _names_asked(chunk: Chunk, which: tuple[int, ...], n: int) -> list[dict]:
    _, _, once, often = _named(chunk, which)
    x, y = by_bucket(once, n), by_bucket(often, n)
    some = np.flatnonzero((np.diff(x) > 0) | (np.diff(y) > 0)).tolist()
    return [{"kind": QUESTION, "chunk": chunk.number, "bucket": k, "a": pack_names(once[x[k] : x[k + 1]]), "b": pack_names(often[y[k] : y[k + 1]])} for k in some]


_SHARED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _shared(asked: pa.Table) -> pa.Table:
    """A bucket of a round's dictionary: for each chunk, which of the names that it has once are met elsewhere too. Chunks without any get no answer."""
    once, often = ([unpack_names(x) for x in asked.column(c).to_pylist()] for c in "ab")
    everything = np.concatenate(once)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    shared = np.zeros(len(ordered), bool)
    same = ordered[1:] == ordered[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    many = np.unique(np.concatenate(often))
    if len(many):
        at = np.minimum(np.searchsorted(many, ordered), len(many) - 1)
        shared |= many[at] == ordered
    mine = np.empty(len(ordered), bool)
    mine[order] = shared
    parts = np.split(mine, np.cumsum([len(x) for x in once])[:-1])
    chunks, bucket = asked.column("chunk").to_pylist(), asked.column("bucket")[0].as_py()
    return _rows([{"chunk": c, "bucket": bucket, "bits": np.packbits(p).tobytes()} for c, p in zip(chunks, parts, strict=True) if p.any()], _SHARED)


def _in(names: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, names), len(ordered) - 1)] == names


def _next(n: int, k: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        """After a round's answers, the windows of a chunk that may repeat and its next questions; after the last round what is needed of the chunk, and its windows."""
        of_bucket = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        live = of_bucket.pop(-1, None)
        if not len(state) or (k and live is None):
            return _ARROW.empty_table()
        whole = Chunk.load(state)
        if live is not None:
            whole.live = np.unpackbits(np.frombuffer(live, np.uint8), count=len(whole.words)).astype(bool)
        inner, chunk = whole.needed(), whole.compact()
        _answered(chunk, of_bucket, ROUNDS[k], n)
        whole.live[inner] = chunk.live
        chunk = chunk.compact()
        if chunk is None:
            return _ARROW.empty_table()
        if k + 1 == len(ROUNDS):
            return _rows([chunk.dump(), *_windows_asked(chunk, n, bits)])
        return _rows([{"kind": LIVE, "chunk": chunk.number, "f": np.packbits(whole.live).tobytes()}, *_names_asked(chunk, ROUNDS[k + 1], n)])

    return run


def _answered(chunk: Chunk, answers: dict[int, bytes], which: tuple[int, ...], n: int) -> None:
    """Takes from a chunk the windows that hold a name met nowhere else."""
    levels, asked, once, _ = _named(chunk, which)
    shared, at = np.zeros(len(once), bool), by_bucket(once, n)
    for k, bits in answers.items():
        shared[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[k + 1] - at[k])
    alone, start = once[~shared], chunk.starts()[0]
    gone = np.zeros(len(start), bool)
    if len(alone):
        for x, a in zip(levels, asked, strict=True):
            dead = np.zeros(len(x.names) + 1, np.int32)
            if x.of is not None:
                dead[1:] = _in(chunk.own, alone)[x.of] & a
            else:
                mine = np.flatnonzero(a)
                dead[mine + 1] = _in(x.names[mine], alone)
            total = np.cumsum(dead, dtype=np.int32)
            gone |= total[x.high] > total[x.low]
        chunk.live[start[gone]] = False


class Windows:
    """A chunk's live windows: first word, document, place in the document, hash; and of those that equal an earlier one of the chunk, that they do."""

    def __init__(self, chunk: Chunk, bits: int) -> None:
        self.at, self.doc = chunk.starts()
        self.start = self.at - chunk.offsets[:-1][self.doc]
        self.hash = SpanHash(mix(chunk.names()))(self.at, self.at + WINDOW) >> np.uint64(64 - bits)
        order = np.argsort(self.hash, kind="stable")
        of = groups(self.hash[order])
        lead = order[np.flatnonzero(np.append(True, of[1:] != of[:-1]))][of] if len(order) else order
        rest = order != lead
        own, lead = order[rest], lead[rest]
        same = np.ones(len(own), bool)
        for k in range(WINDOW):
            same &= chunk.words[self.at[own] + k] == chunk.words[self.at[lead] + k]
        # Documents are in the order of their ids; those of one id (of other texts) have no order among them.
        rank = np.cumsum(np.append(False, (chunk.ids[1:] != chunk.ids[:-1]) | (chunk.none[1:] != chunk.none[:-1])))
        d, e = rank[self.doc[own]], rank[self.doc[lead]]
        self.known = np.zeros(len(self.at), bool)
        self.known[own[same & ((d > e) | (self.start[own] > self.start[lead]))]] = True


def _windows_asked(chunk: Chunk, n: int, bits: int) -> list[dict]:
    """Each distinct window's hash and place, by bucket, then in the order of documents and starts, so that steps between starts are small."""
    w = Windows(chunk, bits)
    sent = np.flatnonzero(~w.known)
    bucket = np.searchsorted(_edges(n), w.hash[sent] << np.uint64(64 - bits), "right")
    order = np.argsort(bucket, kind="stable")
    sent, at = sent[order], np.searchsorted(bucket[order], np.arange(n + 1))
    out = []
    for k in np.flatnonzero(np.diff(at)).tolist():
        mine = sent[at[k] : at[k + 1]]
        doc, start = w.doc[mine], w.start[mine]
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        step = np.diff(start, prepend=0)
        step[begin] = start[begin]
        who = doc[begin]
        out.append({"kind": QUESTION, "chunk": chunk.number, "bucket": k, "a": w.hash[mine].tobytes(), "b": pack_small(step), "c": chunk.ids[who].astype("<i8").tobytes(), "d": chunk.none[who].astype("u1").tobytes(), "e": pack(who, np.diff(np.append(begin, len(mine))))})
    return out


class Met:
    """A bucket's windows, ordered by hash, id (null last) and start."""

    def __init__(self, asked: pa.Table) -> None:
        parts = []
        for chunk, a, b, c, d, e in zip(*(asked.column(x).to_pylist() for x in ("chunk", *"abcde")), strict=True):
            (who, times), step = unpack(e, 2), unpack_small(b)
            total, begin = np.cumsum(step), np.cumsum(times) - times
            number = np.repeat(np.arange(len(who)), times)
            start = total - (total[begin] - step[begin])[number]
            parts.append((np.frombuffer(a, np.uint64), np.frombuffer(d, "u1")[number], np.frombuffer(c, "<i8")[number], start, np.full(len(step), chunk), who[number]))
        self.hash, self.none, self.id, self.start, self.chunk, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Windows alone with their hash go before the rest is sorted.
        order = np.argsort(self.hash, kind="stable")
        same = self.hash[order][1:] == self.hash[order][:-1]
        order = order[np.append(False, same) | np.append(same, False)]
        self.take(order[np.lexsort((self.start[order], self.id[order], self.none[order], self.hash[order]))])

    def take(self, at: np.ndarray) -> None:
        for c in ("hash", "none", "id", "start", "chunk", "doc"):
            setattr(self, c, getattr(self, c)[at])


_MET = pa.schema([("chunk", pa.int64()), ("own", pa.binary()), ("places", pa.binary())])


def _met(asked: pa.Table) -> pa.Table:
    """A bucket of windows: to the chunk of each parent, its children's chunks and places. A parent starts earlier than its children."""
    m = Met(asked)
    if not len(m.hash):
        return _MET.empty_table()
    group = groups(m.hash)
    new = np.append(True, (group[1:] != group[:-1]) | (m.none[1:] != m.none[:-1]) | (m.id[1:] != m.id[:-1]) | (m.start[1:] != m.start[:-1]))
    # Of windows with one hash, id and start (rows that repeat an id) the first stands for all.
    key, stands = np.cumsum(new) - 1, np.flatnonzero(new)
    lead = key[np.flatnonzero(np.append(True, group[1:] != group[:-1]))][group]
    child = np.flatnonzero(key > lead)
    parent = stands[lead[child] + (key[child] - lead[child] - 1) // FAN]
    order = np.argsort(m.chunk[parent], kind="stable")
    child, parent = child[order], parent[order]
    at = np.append(np.flatnonzero(np.append(True, np.diff(m.chunk[parent]) != 0)), len(child)) if len(child) else [0]
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        c, p = child[a:b], parent[a:b]
        out.append({"chunk": int(m.chunk[p[0]]), "own": m.chunk[c].astype("<i8").tobytes(), "places": pack(m.doc[c], m.start[c], m.doc[p], m.start[p])})
    return _rows(out, _MET)


#: A stretch of windows, and the words of its parents; null: the windows are repeats, without a look.
_STRETCH = pa.schema([("chunk", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("times", pa.int64()), ("words", pa.binary())])
_STRETCHES = "chunk bigint, doc bigint, start bigint, times bigint, words binary"


def _replies(state: pa.Table, asked: pa.Table) -> pa.Table:
    """A chunk of parents: their words to their children, a stretch of windows at once."""
    if not len(state) or not len(asked):
        return _STRETCH.empty_table()
    chunk = Chunk.load(state)
    to = np.concatenate([np.frombuffer(x, "<i8") for x in asked.column("own").to_pylist()])
    doc, start, own, place = (np.concatenate(x) for x in zip(*(unpack(x, 4) for x in asked.column("places").to_pylist()), strict=True))
    order = np.lexsort((start, place - start, own, doc, to))
    to, doc, start, own, place = (x[order] for x in (to, doc, start, own, place))
    new = np.append(True, (to[1:] != to[:-1]) | (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1] + 1))
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(new)))
    first = chunk.offsets[:-1][own[begin]] + place[begin]
    words = [chunk.text(a, a + n + WINDOW - 1) for a, n in zip(first.tolist(), times.tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (to[begin], doc[begin], start[begin], times)] + [pa.array(words, pa.binary())], schema=_STRETCH)


_CUT = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("idx", pa.int32()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("hash", pa.int64())])


def _cut(bits: int, keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(state: pa.Table, stretches: pa.Table) -> pa.Table:
        """What a chunk's documents keep, where that isn't all; and hashes of windows whose words aren't their parents'."""
        if not len(state):
            return _CUT.empty_table()
        chunk, clashed = Chunk.load(state), []
        w = Windows(chunk, bits)
        repeat = np.zeros(len(chunk.words), bool)
        repeat[w.at[w.known]] = True
        for doc, start, times, words in zip(*(stretches.column(c).to_pylist() for c in ("doc", "start", "times", "words")), strict=True):
            first = int(chunk.offsets[doc]) + start
            if words is None or words == chunk.text(first, first + times + WINDOW - 1):
                repeat[first : first + times] = True
                continue
            other = np.append(0, np.cumsum([chunk.vocabulary[a] != b for a, b in zip(chunk.words[first : first + times + WINDOW - 1].tolist(), words.split(b" "), strict=True)]))
            same = other[WINDOW:] == other[:-WINDOW]
            repeat[first : first + times] |= same
            clashed.append(first + np.flatnonzero(~same))
        out = []
        if clashed:
            found = np.unique(w.hash[np.searchsorted(w.at, np.concatenate(clashed))])
            out = [{"kind": CLASH, "chunk": chunk.number, "hash": h} for h in found.view(np.int64).tolist()]
        edge = np.zeros(len(repeat) + 1, np.int64)
        at = np.flatnonzero(repeat)
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + WINDOW, 1)
        gone = np.cumsum(edge)[:-1] > 0
        n = np.add.reduceat(gone, chunk.offsets[:-1], dtype=np.int64)
        for doc in np.flatnonzero(n).tolist():
            a, b = chunk.offsets[doc : doc + 2]
            kept = b" ".join([chunk.vocabulary[x] for x in chunk.words[a:b][~gone[a:b]].tolist()])
            row = {"kind": DOCUMENT, "chunk": chunk.number, "n_removed": int(n[doc]), "kept_text": kept.decode("utf-8", "surrogatepass") if keep_text else None, "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out += [{**row, "idx": int(i)} for i in chunk.rows[doc]]
        return _rows(out, _CUT)

    return run


_SUSPECT = pa.schema([("chunk", pa.int64()), ("doc", pa.int64()), ("start", pa.int64())])
_WHOLE = pa.schema([("words", pa.binary()), ("none", pa.bool_()), ("id", pa.int64()), ("start", pa.int64()), ("chunk", pa.int64()), ("doc", pa.int64())])


def _suspects(asked: pa.Table, clashes: pa.Table) -> pa.Table:
    """A bucket of windows: those whose hash clashes."""
    if not len(asked) or not len(clashes):
        return _SUSPECT.empty_table()
    m = Met(asked)
    m.take(np.flatnonzero(np.isin(m.hash, clashes.column("hash").to_numpy().view(np.uint64))))
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (m.chunk, m.doc, m.start)], schema=_SUSPECT)


def _whole(state: pa.Table, suspects: pa.Table) -> pa.Table:
    """A chunk's windows of such hashes, with all their words."""
    if not len(state) or not len(suspects):
        return _WHOLE.empty_table()
    chunk, doc, start = Chunk.load(state), suspects.column("doc").to_numpy(), suspects.column("start").to_numpy()
    first = chunk.offsets[:-1][doc] + start
    words = [chunk.text(a, a + WINDOW) for a in first.tolist()]
    return pa.table([pa.array(words, pa.binary()), pa.array(chunk.none[doc]), pa.array(chunk.ids[doc]), pa.array(start), pa.array(np.full(len(doc), chunk.number)), pa.array(doc)], schema=_WHOLE)


def _settled(questions: DataFrame, state: DataFrame, clashes: DataFrame, n: int, bits: int) -> DataFrame:
    """Stretches of the windows of clashing hashes that equal an earlier one, by their words themselves."""
    # A hash's bucket is the range of values that its first bits are in; hashes travel as signed numbers.
    top = F.shiftleft("hash", 64 - bits) if bits < 64 else F.col("hash")
    edges = F.array(*(F.lit(int(x)) for x in (_edges(n) ^ np.uint64(1 << 63)).view(np.int64))) if n > 1 else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(edges, lambda x: x <= top.bitwiseXOR(F.lit(-(1 << 63))))).alias("bucket")
    found = questions.groupBy("bucket").cogroup(clashes.select("hash", bucket).groupBy("bucket")).applyInArrow(_suspects, "chunk bigint, doc bigint, start bigint")
    whole = state.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_whole, "words binary, none boolean, id bigint, start bigint, chunk bigint, doc bigint")
    whole = written(whole, "substring-clashes")
    least = whole.groupBy("words").agg(F.min(F.struct("none", "id", "start")).alias("lead"))
    later = whole.join(least, "words").where(F.struct("none", "id", "start") > F.col("lead"))
    return later.select("chunk", "doc", "start", F.lit(1).cast("long").alias("times"), F.lit(None).cast("binary").alias("words"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, bits: int = 64) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) a row of docs. keep_text: the column kept_text too, null where nothing was removed. bits: those of a window's hash."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = buckets(spark, size // 6, BUCKET_WORDS)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = written(keyed.mapInArrow(lambda batches: _chunks(batches, n), _WAY), "substring-chunks")
    base = written(made.where(F.col("kind") == DOCUMENT).select("chunk", "idx", "id", "n_words", "sha"), "substring-documents")
    last = made
    for k in range(len(ROUNDS)):
        answers = _questions(last, n).groupBy("bucket").applyInArrow(_shared, "chunk bigint, bucket int, bits binary")
        live = last.where(F.col("kind") == LIVE).select("chunk", F.lit(-1).alias("bucket"), F.col("f").alias("bits"))
        found = written(_state(made).groupBy("chunk").cogroup(answers.unionByName(live).groupBy("chunk")).applyInArrow(_next(n, k, bits), _WAY), f"substring-round-{k}")
        if last is not made:
            discard(last)
        last = found
    discard(made)
    state, questions = _state(last), _questions(last, n)
    met = questions.groupBy("bucket").applyInArrow(_met, "chunk bigint, own binary, places binary")
    stretches = state.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_replies, _STRETCHES)
    fields = "kind int, chunk bigint, idx int, n_removed bigint, kept_text string, kept_sha256 string, hash bigint"
    cut = written(state.groupBy("chunk").cogroup(stretches.groupBy("chunk")).applyInArrow(_cut(bits, keep_text), fields), "substring-cut")
    clashes = cut.where(F.col("kind") == CLASH).select("hash").distinct()
    if not clashes.isEmpty():
        stretches = stretches.unionByName(_settled(questions, state, clashes, n, bits))
        cut = written(state.groupBy("chunk").cogroup(stretches.groupBy("chunk")).applyInArrow(_cut(bits, keep_text), fields), "substring-cut")
    discard(last)
    cut = cut.where(F.col("kind") == DOCUMENT).select("chunk", "idx", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else []))
    out = base.join(cut, ["chunk", "idx"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *(["kept_text"] if keep_text else []),
    )


def _state(made: DataFrame) -> DataFrame:
    return made.where(F.col("kind") == STATE).select("chunk", *"abcdef")


def _questions(made: DataFrame, n: int) -> DataFrame:
    """A pass's questions, by bucket."""
    return made.where(F.col("kind") == QUESTION).select("bucket", "chunk", *"abcde").repartition(n, "bucket")
