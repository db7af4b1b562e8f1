"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word's character n-grams (3 to 5 letters, edges of the word included, lower case) are hashed into ``2**BITS`` vectors. A text is the mean of the vectors of
all its n-grams, weighted by a smooth inverse of their frequency, and a linear softmax over two classes reads the mean; vectors and softmax are trained together by AdaGrad in numpy, on a bounded sample of
labelled texts (``SAMPLE`` rows, the rarer class whole up to half of them) in one task. As the softmax is linear, each vector's share in the difference of the two logits is one number;
the executors get that table, of fixed size, and a score is its mean over the whole text.

Defined results: null texts and those without a letter or digit have the mean zero and score by the intercepts alone; rows that repeat a doc_id are
each scored; labels other than 0 and 1 are left out, and a doc_id with several labels counts with each; with no label at all every score is
0.5, and with a handful of labels scores are near it. An empty table gives no rows. A text of any length is read whole; scores have no ties to break (0.5 counts as 1). Other columns, whatever
their names, don't matter and aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm._common import column, sums
from tilewright.llm._text import Letters, chunks, ngrams
from tilewright.llm.quality import in_order, sample

BITS = 17
DIM = 8
SIZES = (3, 4, 5)
SAMPLE = 8192
#: The mean is taken times this, so that one word in a hundred moves the logits.
SCALE = 50.0
#: The share of all n-grams at which an n-gram weighs half.
COMMON = 1e-4


def subwords(texts: list[str | None], letters: Letters, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram: the bucket of each, and the n + 1 offsets of each text's."""
    codes, offsets = letters([t or "" for t in texts])
    out = []
    for n in SIZES:
        at, h = ngrams(codes, n)
        out.append(((h >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(at, offsets)))
    return out


def fit(texts: list[str | None], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = 6, rate: float = 0.1, decay: float = 1e-3, least: int = 8) -> np.ndarray:
    """A table of two rows: each bucket's weight in a mean, and its share in the difference of the logits; last, the intercepts' difference."""
    random, letters, each = np.random.default_rng(1), Letters(), []
    in_texts, in_all = np.zeros(1 << bits), np.zeros(1 << bits)
    for text, y in zip(texts, labels, strict=True):
        at, times = np.unique(np.concatenate([b for b, _ in subwords([text], letters, bits)]), return_counts=True)
        in_texts[at] += 1
        in_all[at] += times
        each.append((at.astype(np.int32), times.astype(np.float32), int(y)))
    # Frequent n-grams weigh less (a smooth inverse frequency), and those of few texts have no vector: they would only tell these texts apart. Where the rarer class has few texts itself, fewer are asked for.
    toxic = sum(y for *_, y in each)
    least = min(least, max(1, min(toxic, len(each) - toxic) // 50))
    weight = np.where(in_texts >= least, COMMON / (COMMON + in_all / max(1.0, in_all.sum())), 0)
    bags = []
    for at, times, y in each:
        x = times * weight[at]
        at, x = at[x > 0], x[x > 0]
        bags.append((at, x * (SCALE / max(x.sum(), 1e-9)), y))
    vectors = random.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    softmax, bias = np.stack([-np.ones(dim), np.ones(dim)]) / dim, np.zeros(2)
    g_vectors, g_softmax, g_bias = np.full(1 << bits, 1e-6), np.full((2, dim), 1e-6), np.full(2, 1e-6)
    # The rarer class weighs up to three times as much, so that it is learnt.
    ones = max(1, int(sum(y for *_, y in bags)))
    heavy = min(3.0, max(1.0, (len(bags) - ones) / ones))
    for _ in range(epochs):
        for i in random.permutation(len(bags)):
            at, x, y = bags[i]
            v = vectors[at]
            mean = x @ v
            logits = softmax @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            p *= heavy if y else 1.0
            if abs(p[0]) < 1e-3:  # learnt: a step would hardly move
                continue
            grad = x[:, None] * (p @ softmax)[None] + decay * v
            g_vectors[at] += (grad * grad).mean(1)
            vectors[at] = v - rate * grad / np.sqrt(g_vectors[at])[:, None]
            g = np.outer(p, mean) + decay * softmax
            g_softmax += g * g
            softmax -= rate * g / np.sqrt(g_softmax)
            g_bias += p * p
            bias -= rate * p / np.sqrt(g_bias)
    share = np.where(weight > 0, vectors @ (softmax[1] - softmax[0]), 0) * SCALE
    return np.stack([np.append(weight, 0), np.append(share * weight, bias[1] - bias[0])]).astype(np.float32)


def scores(texts: list[str | None], table: np.ndarray, letters: Letters) -> np.ndarray:
    total, weight = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, of in subwords(texts, letters):
        weight += sums(table[0][buckets], of)
        total += sums(table[1][buckets], of)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(weight, 1e-9) + table[1, -1], -35, 35)))


def train(rows: DataFrame) -> np.ndarray:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = in_order(rows)
        return pd.DataFrame({"w": [fit(rows["text"].tolist(), rows["y"].to_numpy()).tobytes()]})

    made = rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "w binary").first()
    return np.frombuffer(made.w, np.float32).reshape(2, -1) if made else np.zeros((2, (1 << BITS) + 1), np.float32)


def score(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): between 0 and 1, higher where label 1 is likelier."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, own = Letters(), sent.value
        for batch in batches:
            texts = column(batch, 1).to_pylist()
            out = [scores(texts[a:b], own, letters) for a, b in chunks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["id", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows that learn_from (a condition on ``id``) admits, and score every row."""
    rows = sample(docs, labels, label, F.lit(True) if learn_from is None else learn_from, id_col, text_col, most, by_class=True)
    return score(docs, train(rows), id_col, text_col)
