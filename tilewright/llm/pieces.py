"""SentencePiece coding (BPE with byte fallback) by vectorised merge rounds.

A text becomes one flat numpy array of symbols, cut into words where no piece of the vocabulary spans two neighbouring characters (before each white-space
mark, for one), so that no merge ever crosses a cut. Words that are alike are coded once. In a round each word's least pair rank is found by a segmented
minimum, the leftmost of its pairs of that rank that don't overlap are merged at once, and the arrays are compacted; words without a pair
leave. Merging at once is right only where no merge makes a pair of the same or a lower rank; a piece that is part of one ranked before it is therefore merged one at a time, leftmost first.

Characters outside the vocabulary become their UTF-8 bytes' pieces. The tables (pairs, ranks, pieces' bytes; their size is the vocabulary's) are made on the driver from
the model at the path given, and travel with the tasks.

Defined results: a null text is empty; an empty text is the begin and the end id alone; rows are coded one by one, so repeated rows, null ids and ties don't matter; an empty table gives no
rows. A text of any length is coded whole, its words apart. Other columns, whatever their names, don't matter and aren't returned. Decoding follows the library: control ids
are nothing, the first white-space mark is dropped, bytes that aren't UTF-8 become U+FFFD each, a null is an empty list of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import SpanHash, column, slices, utf8

#: The mark that stands for a space.
MARK = "▁"
#: Rank of a pair that no piece is made of.
NONE = np.int32(np.iinfo(np.int32).max)
#: Bytes of text that are worked on at once, and code points of words that a task keeps with their ids.
SLICE, KEPT = 1 << 20, 1 << 21


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1, one run after the other."""
    if not len(sizes):
        return np.empty(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class PairTable:
    """(left, right) -> merged symbol, by open addressing; looked up for arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (4 * max(1, len(pairs))).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for (a, b), merged in pairs.items():
            key, step = a << 32 | b, 0
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at, step = (at + 1) % len(self.keys), step + 1
            self.keys[at], self.values[at] = key, merged
            self.probes = max(self.probes, step + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbols, -1 where there is none. Negative symbols are of no pair."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        found, open_ = np.full(len(keys), -1, np.int32), np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[open_])
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (held >= 0)
            open_, slot = open_[more], (slot[more] + 1) % len(self.keys)
            if not len(open_):
                break
        return found


class Coder:
    """The tables of a model, and coding of arrays of texts with them."""

    def __init__(self, path: str, hash_mask: int = (1 << 64) - 1) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._check(model)
        n = model.get_piece_size()
        self.bos, self.eos, self.mask = model.bos_id(), model.eos_id(), np.uint64(hash_mask)
        pieces, scores, surface, byte_ids = {}, {}, [b""] * n, np.full(256, model.unk_id(), np.int32)
        self.opens = np.zeros(n, bool)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surface[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                pieces[piece], scores[piece] = i, model.get_score(i)
                surface[i], self.opens[i] = piece.replace(MARK, " ").encode(), piece.startswith(MARK)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[byte_ids] = True
        self.control = np.array([model.is_control(i) for i in range(n)])
        self.surface, self.surface_at, self.byte_ids, self.unknown = np.frombuffer(b"".join(surface), np.uint8), _ends(np.array([len(s) for s in surface])), byte_ids, model.unk_id()
        # Symbols are pieces' ids; characters that occur in pieces only as parts come after them.
        symbols = dict(pieces)
        for piece in pieces:
            for c in piece:
                symbols.setdefault(c, n + len(symbols) - len(pieces))
        self.pieces = n
        distinct = sorted(set(scores.values()), reverse=True)
        rank_of = {s: k for k, s in enumerate(distinct)}
        self.rank = np.full(n + len(symbols) - len(pieces) + 1, NONE, np.int32)
        alone = np.zeros(len(distinct), bool)
        pairs = {}
        for piece, i in pieces.items():
            self.rank[i] = rank = rank_of[scores[piece]]
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in symbols and right in symbols:
                    pairs[symbols[left], symbols[right]] = i
                for part in (left, right):
                    if len(part) > 1 and part in pieces and rank_of[scores[part]] >= rank:
                        alone[rank_of[scores[part]]] = True
        self.alone, self.pairs = alone, PairTable(pairs)
        single = [c for c in symbols if len(c) == 1]
        self.points = np.array(sorted(map(ord, single)), np.int64)
        self.point_symbol = np.array([symbols[chr(p)] for p in self.points], np.int32)
        # Which characters follow each other within a piece: a grid over those that do.
        spans = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        joined = sorted({ord(c) for s in spans for c in s})
        self.joined = np.array(joined, np.int64)
        self.grid = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        at = {p: k + 1 for k, p in enumerate(joined)}
        for a, b in spans:
            self.grid[at[ord(a)], at[ord(b)]] = True
        self._forget()

    @staticmethod
    def _check(model: Any) -> None:
        """Only BPE models that leave characters as they are, mark spaces and prefix a mark are coded here."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
        kinds = {p.type for p in proto.pieces}
        piece = sentencepiece_model_pb2.ModelProto.SentencePiece
        if trained.model_type != trained.BPE or trained.treat_whitespace_as_suffix or not plain or kinds & {piece.USER_DEFINED, piece.UNUSED}:
            raise ValueError("not a BPE model with identity normalisation, a prefixed mark and neither user-defined nor unused pieces")

    def _forget(self) -> None:
        """No words are known."""
        self.known = np.empty(0, np.uint64)
        self.known_word = np.empty(0, np.int64)
        self.word_points, self.word_at = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.word_ids, self.ids_at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _lookup(self, sorted_: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Each point's place in sorted_, -1 where it isn't in it. By a table for the first 65,536 points."""
        table = np.full(65536, -1, np.int64)
        small = sorted_ < 65536
        table[sorted_[small]] = np.flatnonzero(small)
        at = table[np.minimum(points, 65535)]
        far = np.flatnonzero(points >= 65536)
        if len(far):
            place = np.minimum(np.searchsorted(sorted_, points[far]), max(0, len(sorted_) - 1))
            at[far] = np.where(sorted_[place] == points[far], place, -1) if len(sorted_) else -1
        return at

    def merged(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the n + 1 offsets of each word's, of words given as code points and n + 1 offsets."""
        place = self._lookup(self.points, points)
        sym = np.where(place >= 0, self.point_symbol[place], -1 - points.astype(np.int64))
        word = np.repeat(np.arange(len(at) - 1), np.diff(at))
        pair, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NONE, np.int32)

        def look(i: np.ndarray) -> None:
            """Pairs that begin at these positions, none of them a word's last."""
            pair[i] = self.pairs(sym[i], sym[i + 1])
            rank[i] = np.where(pair[i] >= 0, self.rank[pair[i]], NONE)

        if len(sym):
            look(np.flatnonzero(word[:-1] == word[1:]))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            if (over := least == NONE).any():
                out = np.repeat(over, sizes)
                done.append((word[out], sym[out]))
                sym, word, pair, rank = sym[~out], word[~out], pair[~out], rank[~out]
                first, sizes, least = (np.cumsum(sizes[~over]) - sizes[~over]), sizes[~over], least[~over]
                if not len(sym):
                    break
            low = np.repeat(least, sizes)
            hit = np.flatnonzero(rank == low)
            # Of a run of hits that overlap, every second one; of ranks that go alone, a word's first.
            opens = np.concatenate([[True], np.diff(hit) > 1])
            run = np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run) % 2 == 0
            leads = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            hit = hit[take & (leads | ~self.alone[rank[hit]])]
            sym[hit] = pair[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, word, pair, rank = sym[stay], word[stay], pair[stay], rank[stay]
            around = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            last = np.append(word[1:] != word[:-1], True)
            shut = around[last[around]]
            pair[shut], rank[shut] = -1, NONE
            look(around[~last[around]])
        if not done:
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        words, syms = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(words, kind="stable")
        return self._ids(words[order], syms[order], len(at) - 1)

    def _ids(self, words: np.ndarray, syms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids: those that aren't pieces become their bytes'."""
        sizes = np.ones(len(syms), np.int64)
        odd = np.flatnonzero((syms < 0) | (syms >= self.pieces))
        made = []
        if len(odd):
            parts = {self.pieces + k: c for k, c in enumerate(self._parts())}
            for i in odd:
                c = chr(-1 - int(syms[i])) if syms[i] < 0 else parts[int(syms[i])]
                ids = self.byte_ids[list(c.encode())]
                ids = ids if (ids != self.unknown).all() else np.array([self.unknown], np.int32)
                made.append(ids)
                sizes[i] = len(ids)
        at = _ends(sizes)
        out = np.repeat(syms, sizes).astype(np.int32)
        if made:
            out[_spread(at[odd], sizes[odd])] = np.concatenate(made)
        return out, _ends(np.bincount(words, weights=sizes, minlength=n).astype(np.int64))

    def _parts(self) -> list[str]:
        """Characters that aren't pieces but occur in some, by symbol."""
        own = self.point_symbol >= self.pieces
        return [chr(p) for _, p in sorted(zip(self.point_symbol[own].tolist(), self.points[own].tolist(), strict=True))]

    def points_of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points with marks for spaces and one before each text that isn't empty, and the texts' n + 1 offsets."""
        at = _ends((raw & 0xC0) != 0x80)[offsets]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.dtype("<u4"))
        sizes = np.diff(at)
        full = sizes + (sizes > 0)
        new = _ends(full)
        out = np.full(int(new[-1]), ord(MARK), np.uint32)
        out[_spread(new[:-1] + (sizes > 0), sizes)] = np.where(points == 32, ord(MARK), points)
        return out, new

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as bytes and n + 1 offsets, without begin and end ids, and the n + 1 offsets of each text's."""
        points, at = self.points_of(raw, offsets)
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        # Words: cut at the texts' starts, and where no piece holds both neighbours.
        place = self._lookup(self.joined, points) + 1
        cut = np.concatenate([[True], ~self.grid[place[:-1], place[1:]]])
        cut[at[:-1][at[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        word = self._words(points, starts, ends)
        sizes = np.diff(self.ids_at)[word]
        ids = self.word_ids[_spread(self.ids_at[word], sizes)]
        return ids, _ends(sizes)[np.searchsorted(starts, at)]

    def _words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number among those known, which new ones join. A hash finds a word, its code points decide."""
        if len(self.word_points) > KEPT:
            self._forget()
        hashes = SpanHash(points)(starts, ends) & self.mask
        distinct, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        have = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~have)
        number = np.empty(len(distinct), np.int64)
        number[have] = self.known_word[place[have]]
        number[new] = len(self.word_at) - 1 + np.arange(len(new))
        self._learn(points, starts[lead[new]], ends[lead[new]])
        if len(new):
            hashes_now = np.concatenate([self.known, distinct[new]])
            order = np.argsort(hashes_now, kind="stable")
            self.known, self.known_word = hashes_now[order], np.concatenate([self.known_word, number[new]])[order]
        word = number[which]
        sizes, held = ends - starts, np.diff(self.word_at)[word]
        same = sizes == held
        rows = np.flatnonzero(same)
        differs = points[_spread(starts[rows], sizes[rows])] != self.word_points[_spread(self.word_at[word[rows]], sizes[rows])]
        if differs.any():
            same[rows] = np.add.reduceat(differs, _ends(sizes[rows])[:-1]) == 0
        if len(clash := np.flatnonzero(~same)):
            word[clash] = len(self.word_at) - 1 + np.arange(len(clash))
            self._learn(points, starts[clash], ends[clash])
        return word

    def _learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        own = points[_spread(starts, ends - starts)]
        ids, at = self.merged(own, _ends(ends - starts))
        self.word_at = np.concatenate([self.word_at, self.word_at[-1] + _ends(ends - starts)[1:]])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + at[1:]])
        self.word_points, self.word_ids = np.concatenate([self.word_points, own]), np.concatenate([self.word_ids, ids])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts that ids stand for, and the n + 1 offsets of each."""
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        real = ~self.control[ids]
        ids, text = ids[real], text[real]
        start, sizes = self.surface_at[ids], np.diff(self.surface_at)[ids]
        lead = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.empty(0, bool)
        lead &= self.opens[ids]
        start, sizes = start + lead, sizes - lead
        raw = self.surface[_spread(start, sizes)]
        at = _ends(np.bincount(text, weights=sizes, minlength=len(offsets) - 1).astype(np.int64))
        if not self.is_byte[ids].any() or self._valid(raw, at):
            return raw, at
        made = []
        first = _ends(np.bincount(text, minlength=len(offsets) - 1))
        byte_at = _ends(sizes)
        for i in range(len(offsets) - 1):
            span = raw[at[i] : at[i + 1]]
            if self._valid(span, np.array([0, len(span)])):
                made.append(span.tobytes())
                continue
            rows = np.arange(first[i], first[i + 1])
            byte = self.is_byte[ids[rows]]
            edges = np.concatenate([[0], np.flatnonzero(byte[1:] != byte[:-1]) + 1, [len(rows)]])
            runs = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = raw[byte_at[rows[a]] : byte_at[rows[b - 1] + 1]].tobytes()
                runs.append(_repaired(part) if byte[a] else part)
            made.append(b"".join(runs))
        return np.frombuffer(b"".join(made), np.uint8), _ends(np.array([len(m) for m in made]))

    @staticmethod
    def _valid(raw: np.ndarray, at: np.ndarray) -> bool:
        """Whether all is UTF-8 and each text begins with a character."""
        inner = at[:-1][at[:-1] < len(raw)]
        if ((raw[inner] & 0xC0) == 0x80).any():
            return False
        try:
            raw.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True


def _repaired(raw: bytes) -> bytes:
    """Bytes, each that begins no character replaced by U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[i : i + n].decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append(raw[i : i + n])
            i += n
            break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def _binary(data: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """(id_col, ids binary, decoded string): each text's ids as little-endian unsigned 32-bit integers, as a token file holds them, and the text that they decode to."""
    coder = Coder(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(column(batch, 1))
            for first, last in slices(offsets, SLICE):
                at = offsets[first : last + 1]
                ids, own = coder.encode(raw[at[0] : at[-1]], at - at[0])
                back, back_at = coder.decode(ids, own)
                sizes = np.diff(own)
                full = _ends(sizes + begin + end)
                out = np.empty(int(full[-1]), np.dtype("<u4"))
                if begin:
                    out[full[:-1]] = coder.bos
                if end:
                    out[full[1:] - 1] = coder.eos
                out[_spread(full[:-1] + begin, sizes)] = ids
                columns = [batch.column(0).slice(first, last - first), _binary(out, full * 4, pa.large_binary()), _binary(back, back_at, pa.large_string())]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.binary()), columns[2].cast(pa.string())], names=["id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text string) of ids as encode() gives them."""
    coder = Coder(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [r or b"" for r in batch.column(1).to_pylist()]
            at = _ends(np.array([len(r) // 4 for r in raws], np.int64))
            back, back_at = coder.decode(np.frombuffer(b"".join(raws), "<u4").astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(back, back_at, pa.large_string()).cast(pa.string())], names=["id", "text"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
