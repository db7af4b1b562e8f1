"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII bytes, or runs of other printable bytes, case kept; unigrams and bigrams are hashed into ``2**BITS``
weights. All bigrams of a word and itself are one feature, so that repetition is seen in words that the sample lacks. A text's features are its n-gram counts over their sum, times a fixed scale. The model is fitted in one task on a bounded sample of labelled texts
(``SAMPLE`` rows, those with the smallest hashes of their ids); its weights, a table of fixed size, are sent to the executors, where a
score is a sparse dot product over the whole text.

Defined results: null and empty texts, and those of white space alone, have no n-gram, and score by the intercept alone; rows that repeat a doc_id are
each scored; labels other than 0 and 1 are left out, and a doc_id with several labels counts with each; with no label at all every score is
0.5. An empty table gives no rows. A text of any length is read whole, in a batch of its own if it is long; scores have no ties to break (0.5 counts as 1). Other columns, whatever
their names, don't matter and aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import SpanHash, column, filtered, mix, slices, sums, utf8, written
from tilewright.llm._text import KINDS

BITS = 20
SCALE = 24.0
#: The hash of every bigram of a word and itself.
TWICE = np.uint64(0x5851F42D4C957F2D)
#: Labelled rows that a fit reads at most.
SAMPLE = 8192


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of each text, and the n + 1 offsets of each text's."""
    n_texts = len(offsets) - 1
    if not len(raw):
        return np.empty(0, np.int64), np.zeros(n_texts + 1, np.int64)
    kind = KINDS[raw]
    first = np.ones(len(raw), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(raw))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    of = np.searchsorted(starts, offsets)
    one = SpanHash(raw.astype(np.uint64) + np.uint64(1))(starts, ends)
    # A bigram ends where its second word does; the first word of a text has none.
    two = np.where(one[:-1] == one[1:], TWICE, mix(one[:-1] * np.uint64(3) ^ one[1:])) if len(one) > 1 else np.empty(0, np.uint64)
    pair = np.ones(max(0, len(one) - 1), bool)
    inner = of[1:-1]
    pair[inner[(inner > 0) & (inner < len(one))] - 1] = False
    owner = np.repeat(np.arange(n_texts), np.diff(of))
    both = np.concatenate([one, two[pair]]) >> np.uint64(64 - bits)
    whose = np.concatenate([owner, owner[1:][pair] if len(owner) else owner])
    order = np.argsort(whose, kind="stable")
    return both[order].astype(np.int64), np.searchsorted(whose[order], np.arange(n_texts + 1))


def of_texts(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    return features(*utf8(pa.array(texts, pa.string())), bits)


class Ftrl:
    """FTRL-Proximal (McMahan et al. 2013) for logistic loss; weight 0 is the intercept's, the others' indices are shifted by one."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at + 1, 0), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(texts: list[str | None], labels: np.ndarray, bits: int = BITS, scale: float = SCALE, epochs: int = 3) -> np.ndarray:
    model = Ftrl(1 << bits)
    each = []
    for text, y in zip(texts, labels, strict=True):
        at, times = np.unique(of_texts([text], bits)[0], return_counts=True)
        each.append((at, times * (scale / max(1, times.sum())), int(y)))
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(each)):
            model.learn(*each[i])
    return model.weights().astype(np.float32)


def scores(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int = BITS, scale: float = SCALE) -> np.ndarray:
    at, of = features(raw, offsets, bits)
    dot = sums(weights[1:][at].astype(np.float64), of) * scale / np.maximum(1, np.diff(of))
    return 1 / (1 + np.exp(-np.clip(dot + weights[0], -35, 35)))


def of_column(col: pa.Array, weights: np.ndarray) -> np.ndarray:
    raw, offsets = utf8(col)
    out = [scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weights) for a, b in slices(offsets)]
    return np.concatenate(out) if out else np.empty(0)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, id_col: str, text_col: str, most: int, by_class: bool = False) -> DataFrame:
    """(y, text) of at most so many labelled rows, as a table. The ids chosen are bounded by that, and so may be broadcast. by_class: all rows of the rarer class are drawn, up to half of the sample."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & learn_from)
    chosen = written(_drawn(chosen, [F.xxhash64("id"), "id", "y"], most, by_class), "sample-ids")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return written(_drawn(found.select("y", "text"), [F.xxhash64("text"), "y"], most, by_class), "sample")


def _drawn(rows: DataFrame, order: list[Column | str], most: int, by_class: bool) -> DataFrame:
    """The first so many rows in that order."""
    if not by_class:
        return rows.orderBy(*order).limit(most)
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    rare = min((0, 1), key=lambda y: counts.get(y, 0))
    few = min(counts.get(rare, 0), most // 2)
    return rows.where(F.col("y") == rare).orderBy(*order).limit(few).unionByName(rows.where(F.col("y") != rare).orderBy(*order).limit(most - few))


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Labelled rows in an order of their own, whatever the order in which a shuffle brought them, so that a fit can be repeated."""
    return rows.sort_values(["text", "y"], na_position="first", kind="stable", ignore_index=True)


def train(rows: DataFrame) -> np.ndarray:
    """The weights, fitted in one task; they alone come to the driver."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = in_order(rows)
        return pd.DataFrame({"w": [fit(rows["text"].tolist(), rows["y"].to_numpy()).tobytes()]})

    made = rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "w binary").first()
    return np.frombuffer(made.w, np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): between 0 and 1, higher where label 1 is likelier."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of_column(column(batch, 1), sent.value), pa.float64())], names=["id", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows that learn_from (a condition on ``id``) admits, and score every row."""
    rows = sample(docs, labels, label, F.lit(True) if learn_from is None else learn_from, id_col, text_col, most)
    return score(docs, train(rows), id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """docs, all its columns, with the rows that score at least so much."""
    rows = sample(docs, labels, label, F.lit(True) if learn_from is None else learn_from, id_col, text_col, most)
    sent = docs.sparkSession.sparkContext.broadcast(train(rows))
    return filtered(docs, text_col, lambda: lambda col: of_column(col, sent.value) >= least)
