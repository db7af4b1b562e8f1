"""Readers: CSV tables with their schemas, slides and tile images by file name, tables of earlier stages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.names import level_xy, parsed

COLOURS = "code int, r double, g double, b double"
LABELS = "id int, patch_path string, name string, r double, g double, b double"
CLUSTERS = "Patch_number int, X int, Y int, Positive int, Cluster int"


def slides(spark: SparkSession, path: str, pattern: str = "*.PDL1.mrxs") -> DataFrame:
    """(slide, path) of the files whose name fits; contents aren't read, and hidden files don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("slide"), "path").where(~F.col("slide").startswith("."))


def tile_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, slide, n, level, x, y, content) of tile images; names outside the grammar have nulls."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", parsed(F.col("path")).alias("t"), "content").select("path", "t.*", "content")


def level_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, content) of png images named by their place."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", level_xy(F.col("path")).alias("t"), "content").select("path", "t.*", "content")


def classes(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(class, path) of the images in a folder for each class."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("class"), "path")


def largest_class(found: DataFrame) -> DataFrame:
    return found.groupBy("class").count().agg(F.max("count").alias("most"))


def table(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """A CSV file of known columns."""
    return spark.read.csv(path, schema=schema, header=header)


def feature_columns(columns: list[str]) -> tuple[str, list[str]]:
    """The architecture named by feature columns ({architecture}_feature_{k}), and these in the order of k."""
    matches = [(re.fullmatch(r"(?:(.+)_)?feature_(\d+)", c), c) for c in columns]
    found = sorted((int(m[2]), c, m[1] or "") for m, c in matches if m)
    return (found[0][2] if found else ""), [c for _, c, _ in found]


def vectors(rows: DataFrame) -> DataFrame:
    """rows with their feature columns as one array, features, and the architecture's name."""
    name, columns = feature_columns(rows.columns)
    rest = [c for c in rows.columns if c not in set(columns)]
    return rows.select(*rest, F.lit(name).alias("architecture"), F.array(*(F.col(f"`{c}`").cast("double") for c in columns)).alias("features"))


def described(spark: SparkSession, path: str) -> DataFrame:
    """Description, segmentation or segment-stack CSVs: all files, hidden ones left out, with features as an array."""
    return vectors(spark.read.option("pathGlobFilter", "*.csv").csv(path, header=True))


def segmentation(spark: SparkSession, path: str) -> DataFrame:
    """(label, x, y) of segmentation CSVs, as numbers."""
    rows = spark.read.option("pathGlobFilter", "*.csv").csv(path, header=True)
    return rows.select(*(F.col(c).cast("int").alias(to) for c, to in (("Label", "label"), ("XPosition", "x"), ("YPosition", "y"))))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(slide, in_slide_id, global_id, architecture, features) of a segment stack's CSVs."""
    rows = described(spark, path)
    return rows.select(F.col("Slidename").alias("slide"), F.col("InSlideId").cast("int").alias("in_slide_id"), F.col("GlobalId").cast("long").alias("global_id"), "architecture", "features")


def pixels(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "tif", "jpg")) -> DataFrame:
    """(path, height, width, channels, pixels) of the images in a folder, hidden ones left out: red, green, blue by row, as numbers from 0 to 255."""
    files = spark.read.format("image").option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").option("dropInvalid", True).load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = [np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[:, :, ::-1].ravel().tolist() for r in batch.itertuples()]
            yield batch.drop(columns="data").assign(pixels=flat)

    found = files.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return found.mapInPandas(read, "path string, height int, width int, channels int, pixels array<int>")
