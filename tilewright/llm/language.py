"""Language identification by hyperdimensional profiles.

Each letter has a random vector of ``DIM`` signs, drawn from its code point. A trigram's vector binds those of its letters, permuted by place (the first
rolled by two, the second by one), as their product. A language's prototype bundles (adds) the vectors of all trigrams of its sample; a text bundles its own, and
the language whose prototype has the largest cosine with it wins. As bundling is a sum, a text's product with a prototype is the sum of its trigrams' products,
which are worked out once a batch for each distinct trigram. Trigrams are of letters within words, edges included, lower case.

A language's sample is ``SAMPLE`` rows in expectation, chosen by a hash of the id, or all it has if fewer; prototypes are added up by part in parallel, and
``DIM`` numbers a language come to the driver.

Defined results: null texts and those without a letter are ``und`` with score 0, as is every text when no row has a language; a tie goes to the language that sorts
first; rows that repeat a doc_id are each predicted (and learnt from); an empty table gives no rows. A text of any length, and of any number of distinct letters, is read whole; a row's other columns, whatever their names, don't matter. The score is the softmax of the cosines times a sharpness. A
text's norm takes distinct trigrams as orthogonal, which random vectors are but for noise; it is the same for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import column, mix, written
from tilewright.llm._text import Letters, chunks

DIM = 2048
SAMPLE = 2000
PARTS = 16
SHARPNESS = 20.0
UNKNOWN = "und"


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    lanes = np.arange(dim // 64, dtype=np.uint64)
    bits = mix((codes.astype(np.uint64)[:, None] << np.uint64(32)) + lanes[None] + np.uint64(1))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(codes), dim)


class Bag:
    """The distinct trigrams of some texts: letters a trigram, and (text, trigram, count) rows in the order of the texts."""

    def __init__(self, texts: list[str | None], letters: Letters) -> None:
        codes, offsets = letters([t or "" for t in texts])
        self.codes, place = np.unique(codes, return_inverse=True)
        n = len(self.codes)
        at = np.flatnonzero(codes[1:-1] != 0) if len(codes) > 2 else np.empty(0, np.int64)
        # A trigram of up to 1.1 million letters fits 63 bits; with a text's number it need not, so that trigrams are numbered first.
        gram = (place[at] * n + place[at + 1]) * n + place[at + 2]
        self.grams, gram = np.unique(gram, return_inverse=True)
        text, many = np.searchsorted(offsets, at, "right") - 1, max(1, len(self.grams))
        key = np.sort(text * many + gram)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.count = np.diff(np.append(new, len(key)))
        self.text, self.gram = np.divmod(key[new], many)
        self.n_texts = len(texts)

    def vectors(self, first: int, last: int, dim: int) -> np.ndarray:
        """The vectors of some distinct trigrams. Only their own letters' vectors are made, however many the texts have."""
        n, g = len(self.codes), self.grams[first:last]
        letters, at = np.unique(np.stack([g // (n * n), g // n % n, g % n]), return_inverse=True)
        own = letter_vectors(self.codes[letters], dim)
        a, b, c = at.reshape(3, -1)
        return (np.roll(own, 2, 1)[a] * np.roll(own, 1, 1)[b] * own[c]).astype(np.float32)

    def products(self, prototypes: np.ndarray) -> np.ndarray:
        """Each distinct trigram's product with each prototype."""
        out = np.empty((len(self.grams), len(prototypes)), np.float32)
        for k in range(0, len(self.grams), 2048):
            out[k : k + 2048] = self.vectors(k, k + 2048, prototypes.shape[1]) @ prototypes.T
        return out

    def bundle(self, dim: int = DIM) -> np.ndarray:
        """The sum of the vectors of all trigrams of all texts."""
        times, out = np.bincount(self.gram, self.count, len(self.grams)).astype(np.float32), np.zeros(dim)
        for k in range(0, len(self.grams), 2048):
            out += times[k : k + 2048] @ self.vectors(k, k + 2048, dim)
        return out


def predict(texts: list[str | None], names: list[str], prototypes: np.ndarray, letters: Letters) -> tuple[list[str], np.ndarray]:
    """prototypes: of length 1, a row a language."""
    bag = Bag(texts, letters)
    if not len(bag.grams) or not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    each = bag.products(prototypes)[bag.gram] * bag.count[:, None]
    dot = np.stack([np.bincount(bag.text, each[:, k], len(texts)) for k in range(len(names))], 1)
    norm = np.sqrt(prototypes.shape[1] * np.bincount(bag.text, bag.count.astype(float) ** 2, len(texts)))
    cosine = dot / np.maximum(norm, 1e-9)[:, None]
    best = cosine.argmax(1)
    soft = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
    score = np.where(norm > 0, (soft / soft.sum(1, keepdims=True))[np.arange(len(texts)), best], 0)
    return [names[k] if x else UNKNOWN for k, x in zip(best, norm > 0, strict=True)], score


def learn(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and their prototypes of length 1. learn_from: a condition on ``id``."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & learn_from)
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    draw = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).cast("double")
    chosen = known.join(counts, "lang").where(draw < F.lit(float(most)) / F.col("n")).select("id", "lang").distinct()
    chosen = written(chosen, "language-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(chosen, ["id", "lang"])

    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        letters, total = Letters(digits=False), np.zeros(DIM)
        own = rows["text"].tolist()
        for a, b in chunks(own):
            total += Bag(own[a:b], letters).bundle()
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "v": [total.astype("<f8").tobytes()]})

    part = F.pmod(F.xxhash64("text"), F.lit(PARTS)).alias("part")
    total: dict[str, np.ndarray] = {}
    for r in texts.select("lang", "text", part).groupBy("lang", "part").applyInPandas(bundle, "lang string, v binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.v, "<f8")
    names = sorted(k for k, v in total.items() if v.any())
    rows = [total[k] / np.linalg.norm(total[k]) for k in names]
    return names, np.array(rows, np.float32).reshape(len(names), DIM)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) a row."""
    sent = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, (own, vectors) = Letters(digits=False), sent.value
        for batch in batches:
            texts = column(batch, 1).to_pylist()
            langs, score = [], []
            for a, b in chunks(texts, 1 << 20):
                found, s = predict(texts[a:b], own, vectors, letters)
                langs += found
                score += s.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
