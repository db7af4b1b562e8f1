"""Sinks. What exists is kept unless asked otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_features(rows: DataFrame, size: int, name: str = "feature") -> DataFrame:
    """rows with the array features as columns {name}_0 to {name}_{size - 1}."""
    rest = [c for c in rows.columns if c != "features"]
    return rows.select(*rest, *(F.get("features", F.lit(k)).alias(f"{name}_{k}") for k in range(size)))


def feature_table(rows: DataFrame, size: int) -> DataFrame:
    """The feature CSV's columns from (slide, n, x, y, features)."""
    named = rows.select(F.col("slide").alias("Slidename"), F.col("n").alias("Number"), F.col("x").alias("X"), F.col("y").alias("Y"), "features")
    return spread_features(named, size)


def description_table(rows: DataFrame, size: int, architecture: str) -> DataFrame:
    """The description CSV's columns from (slide, x, y, features)."""
    named = rows.select(F.col("slide").alias("Slidename"), F.col("x").alias("XPosition"), F.col("y").alias("YPosition"), "features")
    return spread_features(named, size, f"{architecture}_feature")


def segmentation_table(tiles: DataFrame, labels: DataFrame, size: int, architecture: str) -> DataFrame:
    """The segmentation CSV's columns, and slide, from tiles (slide, n, x, y, features) and their segments (slide, n, label); tiles without a segment are left out."""
    met = tiles.select("slide", "n", "x", "y", "features").join(labels.select("slide", "n", F.col("label").alias("Label")), ["slide", "n"])
    return spread_features(met.select(F.col("x").alias("XPosition"), F.col("y").alias("YPosition"), "Label", "slide", "features"), size, f"{architecture}_feature")


def cluster_table(rows: DataFrame) -> DataFrame:
    """The cluster CSV's columns from (slide, n, x, y, positive, c1), negatives included."""
    return rows.select("slide", F.col("n").alias("Patch_number"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("positive").alias("Positive"), F.col("c1").alias("Cluster"))


def write_csv(rows: DataFrame, path: str, by: str | None = None, rewrite: bool = False) -> None:
    """A CSV table with a header, in a folder for each value of a column if by names one; skipped where path exists, unless rewrite."""
    out = rows.write.mode("overwrite" if rewrite else "ignore").option("header", True)
    (out.partitionBy(by) if by else out).csv(path)


def write_table(rows: DataFrame, path: str, by: str | None = None, rewrite: bool = False) -> None:
    out = rows.write.mode("overwrite" if rewrite else "ignore")
    (out.partitionBy(by) if by else out).parquet(path)


def cluster_manifest(rows: DataFrame, level: int = 16) -> DataFrame:
    """(cluster, path) of each tile with a cluster; rewritten codes below 0 have no folder."""
    from tilewright.functions.names import tile_name

    path = tile_name(F.col("slide"), F.col("n"), F.lit(level), F.col("x"), F.col("y"))
    return rows.where("positive = 1 and c1 >= 0").select(F.col("c1").alias("cluster"), path.alias("path"))
