"""Fitted models: reduction, scaling, clusters, visual words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tilewright.functions import orientation
from tilewright.functions.pixels import word_histograms
from tilewright.functions.vectors import dot
from tilewright.operators import minibatch


def fit_reduction(rows: DataFrame, variance: float = 0.9, components: int | None = None, vector: str = "features") -> DataFrame:
    """(component, weights, shift, scale): principal components up to the least number that explains so much variance, or so many of them, with the mean and population deviation of rows along each. A table, to be saved and applied to other rows; it has a row a dimension at most."""
    have = rows.select(array_to_vector(vector).alias("_v"))
    stats = have.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")).first().s
    size = len(stats["mean"])
    model = PCA(k=size, inputCol="_v", outputCol="_p").fit(have)
    share, axes, mean = model.explainedVariance.toArray(), model.pc.toArray(), stats["mean"].toArray()
    k = min(size, components or int(np.searchsorted(np.cumsum(share), variance - 1e-12)) + 1)
    n = stats["count"]
    spread = np.sqrt(np.maximum(share, 0) * stats["variance"].toArray().sum() * (n - 1) / max(1, n))
    made = [(i, axes[:, i].tolist(), float(mean @ axes[:, i]), float(spread[i])) for i in range(k)]
    return rows.sparkSession.createDataFrame(made, "component int, weights array<double>, shift double, scale double")


def apply_reduction(rows: DataFrame, model: DataFrame, vector: str = "features") -> DataFrame:
    """rows with reduced: their place along each component, standardised as the model's own rows were. The model is one row, which each task gets."""
    one = model.agg(F.array_sort(F.collect_list(F.struct("component", "weights", "shift", "scale"))).alias("_m"))
    place = F.element_at(F.transform(F.array(vector), lambda f: F.transform("_m", lambda m: F.coalesce(F.try_divide(dot(f, m["weights"]) - m["shift"], m["scale"]), F.lit(0.0)))), 1)
    return rows.crossJoin(F.broadcast(one)).withColumn("reduced", place).drop("_m")


def reduced(rows: DataFrame, variance: float = 0.9, vector: str = "features", components: int | None = None) -> DataFrame:
    """rows with reduced: principal components up to the least number that explains so much variance (or so many), each to mean 0 and population variance 1."""
    return apply_reduction(rows, fit_reduction(rows, variance, components, vector), vector)


#: A clusterer: rows (with features), a number of clusters and a seed, to the rows with label.
Clusterer = Callable[[DataFrame, int, int], DataFrame]


def kmeans(rows: DataFrame, k: int, seed: int) -> DataFrame:
    return clustered(rows, k, seed)[0]


def weighted_kmeans(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """As kmeans(), of rows that stand for as many as their column weight says."""
    return clustered(rows, k, seed, weight="weight")[0]


def minibatch_kmeans(rows: DataFrame, k: int, seed: int, batches: int = 10, vector: str = "features") -> DataFrame:
    """rows with label, by mini-batch k-means over so many batches, to which a hash of the vector deals the rows."""
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(batches)))
    state = minibatch.fit(dealt, minibatch.initial(rows, k, seed, vector=vector), "_b", vector)
    return minibatch.predict(rows, state, vector).withColumn("label", F.col("label").cast("int")).drop("d")


def best_k(stability: DataFrame) -> DataFrame:
    """stability (k, mean_ari) with best: the k whose runs agree most, the least of equals."""
    top = stability.agg(F.max_by("k", F.struct("mean_ari", -F.col("k"))).alias("_best"))
    return stability.crossJoin(F.broadcast(top)).withColumn("best", F.col("k") == F.col("_best")).drop("_best")


def encoded(images: DataFrame, encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: list[int], pixels: str = "pixels", batch: int = 1000) -> DataFrame:
    """images with features, by an encoder made once a worker, which takes batches of pixel arrays of that shape."""
    ask = predict_batch_udf(encoder, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[shape])
    return images.withColumn("features", ask(F.col(pixels)))


def features(images: DataFrame, method: str, **given: object) -> DataFrame:
    """images with their features, by the method's name: words (a histogram of visual words; words=, size=, compat=), orientation (the same of orientation descriptors) or encoder (encoder=, shape=)."""
    methods = {"words": word_counts, "orientation": partial(word_counts, cut=descriptor_rows()), "encoder": encoded}
    if method not in methods:
        raise ValueError(f"unknown method {method}; there are {', '.join(methods)}")
    return methods[method](images, **given)


def clustered(rows: DataFrame, k: int, seed: int = 7, vector: str = "features", bisecting: bool = False, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with label, centroids (id, features)) of k-means, or of repeated splits in two. weight: a column that says how many rows each one stands for."""
    have = rows.withColumn("_v", array_to_vector(vector))
    kind = BisectingKMeans if bisecting else KMeans
    model = kind(k=k, seed=seed, featuresCol="_v", predictionCol="label", **({"weightCol": weight} if weight else {})).fit(have)
    centres = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "id int, features array<double>")
    return model.transform(have).drop("_v"), centres


def runs(rows: DataFrame, keys: list[str], counts: list[int], times: int = 5, clusterer: Clusterer = kmeans) -> DataFrame:
    """(k, run, keys, label): a clustering for each number of clusters, with a seed of its own each time."""
    out = None
    for k in counts:
        for run in range(times):
            own = clusterer(rows, k, 1000 * k + run).select(F.lit(k).alias("k"), F.lit(run).alias("run"), *keys, "label")
            out = own if out is None else out.unionByName(own)
    return out


def windows(image: np.ndarray, size: int = 8) -> np.ndarray:
    """All size x size windows of an image, a row each."""
    view = np.lib.stride_tricks.sliding_window_view(image, (size, size), axis=(0, 1))
    return np.moveaxis(view, 2, -1).reshape(-1, size * size * image.shape[2]) if image.ndim == 3 else view.reshape(-1, size * size)


#: What an image (height, width, channels, from -1 to 1) is cut into: arrays of rows, some at a time.
Cut = Callable[[np.ndarray], Iterator[np.ndarray]]


def window_rows(size: int) -> Cut:
    """All windows, 4,096 at a time."""

    def cut(image: np.ndarray) -> Iterator[np.ndarray]:
        rows = windows(image, size)
        return (rows[at : at + 4096] for at in range(0, len(rows), 4096))

    return cut


def descriptor_rows(**given: int) -> Cut:
    """Orientation descriptors of all places (see functions.orientation)."""
    return lambda image: orientation.strips(image, **given)


def _image(r: object) -> np.ndarray:
    """A row's pixels from -1 to 1."""
    flat = np.array(r.pixels, float) / 127.5 - 1
    channels = max(1, flat.size // max(1, r.height * r.width))
    return flat.reshape(r.height, r.width, channels) if channels > 1 else flat.reshape(r.height, r.width)


def visual_words(images: DataFrame, n_words: int, size: int = 8, seed: int = 7, every: int = 50, batches: int | None = None, cut: Cut | None = None) -> DataFrame:
    """(id, features): words from all windows (or what cut makes) of every so many-th image (by a hash of id); with batches, by mini-batch k-means over so many batches of those images, the windows of an image all in one."""
    sampled = images.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(every)) == 0).withColumn("batch", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(batches or 1)))

    own = cut or window_rows(size)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                for rows in own(_image(r)):
                    yield pd.DataFrame({"batch": r.batch, "features": rows.tolist()})

    rows = sampled.select("batch", "height", "width", "pixels").mapInPandas(run, "batch bigint, features array<double>")
    if batches is None:
        return clustered(rows.select("features"), n_words, seed)[1]
    return minibatch.fit(rows, minibatch.initial(rows, n_words, seed), "batch").select(F.col("id").cast("int").alias("id"), "features")


def word_counts(images: DataFrame, words: DataFrame, size: int = 8, compat: bool = False, cut: Cut | None = None) -> DataFrame:
    """(id, histogram) of each image (id, height, width, pixels): the nearest words of its windows (or of what cut makes), counted. The words are few and are sent to all."""
    table = np.array([r.features for r in words.orderBy("id").collect()], float)
    sent, own = images.sparkSession.sparkContext.broadcast(table), cut or window_rows(size)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        bound = (known * known).sum(1)
        for batch in batches:
            of = []
            for r in batch.itertuples():
                near = [nearest_words(rows, known, bound) for rows in own(_image(r))]
                of.append(np.concatenate(near).tolist() if near else [])
            yield pd.DataFrame({"id": batch["id"], "words": of})

    found = images.select("id", "height", "width", "pixels").mapInPandas(count, f"id {dict(images.dtypes)['id']}, words array<int>")
    return word_histograms(found.select("id", F.explode("words").alias("word")), "id", n_words=len(table), compat=compat)


def nearest_words(rows: np.ndarray, words: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Each row's nearest word, the first of equals: a product finds those that may be, and where several are as near as rounding can tell, distances decide."""
    near = bound - 2 * (rows @ words.T)
    edge = near.min(1) + 16 * (rows.shape[1] + 8) * np.finfo(float).eps * ((rows * rows).sum(1) + bound.max())
    close = near <= edge[:, None]
    at = close.argmax(1)
    for i in np.flatnonzero(close.sum(1) > 1):
        few = np.flatnonzero(close[i])
        at[i] = few[((rows[i] - words[few]) ** 2).sum(1).argmin()]
    return at
