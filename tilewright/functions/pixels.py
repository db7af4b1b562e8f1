"""Colour and stain expressions over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stain vectors of haematoxylin, eosin and DAB (Ruifrok and Johnston 2001), a row each, over red, green and blue.
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
#: The stain filter's first counted bin of 256 over [-1, 1], and the count that must be exceeded.
STAIN_BIN, STAIN_COUNT = 85, 10


def _inverse(m: tuple[tuple[float, ...], ...]) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(m)).tolist()


def stain(red: Column, green: Column, blue: Column, which: int) -> Column:
    """Density of one stain (0 haematoxylin, 1 eosin, 2 DAB) of 0..255 channels, by -log(c / 255 + 2): the scale on which the filter's bin holds."""
    inverse = _inverse(STAINS)
    return sum((-F.log(c / 255.0 + 2.0) * inverse[k][which] for k, c in enumerate((red, green, blue))), F.lit(0.0))


def grey(red: Column, green: Column, blue: Column) -> Column:
    return 0.2125 * red + 0.7154 * green + 0.0721 * blue


def scaled(value: Column) -> Column:
    """0..255 to -1..1."""
    return value / 127.5 - 1


def stained(values: Column, first_bin: int = STAIN_BIN, more_than: int = STAIN_COUNT) -> Column:
    """Whether more than so many values lie in the bins from first_bin up, of 256 over [-1, 1]."""
    low = -1 + 2 * first_bin / 256
    return F.size(F.filter(values, lambda v: (v >= low) & (v <= 1))) > more_than


#: Words whose counts are one row.
RUN = 16


def _runs(rows: DataFrame, key: str, n: Column) -> DataFrame:
    """(key, run, counts, a, b) of rows (key, w): how often (n a row) each of RUN consecutive words is there, and the least and largest. A row for RUN words, so that what tasks hold is a small part of a row a word."""
    counts = F.array(*(F.coalesce(F.sum(F.when(F.pmod("w", F.lit(RUN)) == i, n)), F.lit(0).cast("long")) for i in range(RUN)))
    return rows.groupBy(key, F.floor(F.col("w") / RUN).alias("run")).agg(counts.alias("counts"), F.min("w").alias("a"), F.max("w").alias("b"))


def word_histograms(words: DataFrame, key: str, word: str = "word", n_words: int = 256, compat: bool = False) -> DataFrame:
    """(key, histogram) from a row a visual word, a whole number. One bin a word from 0; with compat, n_words - 1 equal bins between a key's own least and largest word, edges as numpy has them. Words beyond the bins, and null, aren't counted. Words are counted by partial aggregates, RUN of them a row, so a key of any size is at most n_words / RUN rows."""
    runs = _runs(words.select(key, F.col(word).cast("long").alias("w")), key, F.lit(1))
    bins = n_words - 1 if compat else n_words
    if compat:
        ends = runs.groupBy(key).agg(F.min("a").cast("double").alias("a"), F.max("b").cast("double").alias("b"))
        ends = ends.selectExpr(key, "if(a = b, a - 0.5, a) as lo", "if(a = b, b + 0.5, b) as hi").selectExpr("*", f"(hi - lo) / {bins} as step")
        held = F.filter(F.transform("counts", lambda n, i: F.struct((F.col("run") * RUN + i).alias("w"), n.alias("n"))), lambda x: x["n"] > 0)
        counts = runs.join(ends, key).select(key, "lo", "hi", "step", F.explode_outer(held).alias("x")).select(key, "lo", "hi", "step", "x.w", "x.n")
        guess = counts.selectExpr("*", f"least(cast(floor((w - lo) / (hi - lo) * {bins}) as int), {bins - 1}) as i")
        down = guess.selectExpr("*", "i - if(w < i * step + lo, 1, 0) as j")
        runs = _runs(down.selectExpr(key, f"j + if(j < {bins - 1} and w >= (j + 1) * step + lo, 1, 0) as w", "n"), key, F.col("n"))
    own = F.when(F.col("run").between(0, (bins - 1) // RUN), F.struct("run", "counts"))
    whole = runs.groupBy(key).agg(F.map_from_entries(F.collect_list(own)).alias("m"))
    none = F.array(*[F.lit(0).cast("long")] * RUN)
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit((bins - 1) // RUN).cast("long")), lambda r: F.coalesce(F.try_element_at("m", r), none)))
    return whole.select(key, F.slice(every, 1, bins).alias("histogram"))
