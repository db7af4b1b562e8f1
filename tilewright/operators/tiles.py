"""Tiles of slides: the grid, its numbering, filters and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import names
from tilewright.operators._numbering import numbered


def tile_grid(slides: DataFrame) -> DataFrame:
    """All (slide, x, y) of slides (slide, nx, ny). A level without tiles gives none."""
    real = slides.where("nx > 0 and ny > 0")
    columns = real.select("slide", "ny", F.explode(F.expr("sequence(0, nx - 1)")).alias("x"))
    return columns.select("slide", "x", F.explode(F.expr("sequence(0, ny - 1)")).alias("y"))


def with_tissue(tiles: DataFrame, ratio: float = 0.25, area: str = "area", tissue: str = "tissue") -> DataFrame:
    """Tiles of which more than the ratio is tissue."""
    return tiles.where(F.col(tissue) > ratio * F.col(area))


def of_shape(images: DataFrame, height: int, width: int | None = None, channels: int | None = None) -> DataFrame:
    """Images (height, width, channels) of that shape; without a width square ones."""
    same = (F.col("height") == height) & (F.col("width") == (height if width is None else width))
    return images.where(same if channels is None else same & (F.col("channels") == channels))


def number_tiles(tiles: DataFrame) -> DataFrame:
    """tiles with n: gapless from 0 in each slide, by x, then y."""
    return tiles.withColumn("n", F.row_number().over(Window.partitionBy("slide").orderBy("x", "y")) - 1)


def named(tiles: DataFrame, level: int = 16) -> DataFrame:
    return tiles.withColumn("path", names.tile_name(F.col("slide"), F.col("n"), F.lit(level), F.col("x"), F.col("y")))


def systematic_sample(rows: DataFrame, order: list[str], every: int = 50) -> DataFrame:
    """Every so many-th row, the first included."""
    return numbered(rows, order, "_at").where(F.col("_at") % every == 0).drop("_at")


def first_of_each(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The first so many rows of each group."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= limit).drop("_at")


def on_slides(rows: DataFrame, slides: DataFrame) -> DataFrame:
    return rows.join(slides.select("slide").distinct(), "slide", "left_semi")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
