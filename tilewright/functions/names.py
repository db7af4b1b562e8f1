"""The grammar of tile names: {slide}#{n}-level{L}-{x}-{y}.jpg."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(.+)#(\d+)-level(\d+)-(\d+)-(\d+)\.jpg$"


def tile_name(slide: Column, n: Column, level: Column, x: Column, y: Column) -> Column:
    return F.format_string("%s#%d-level%d-%d-%d.jpg", slide, n, level, x, y)


def parsed(path: Column) -> Column:
    """struct<slide, n, level, x, y> of a path's last part (%23 is read as #); null where it isn't a tile's name."""
    last = F.replace(F.element_at(F.split(path, "/"), -1), F.lit("%23"), F.lit("#"))

    def part(k: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract(last, PATTERN, k), F.lit("")).cast(kind)

    fields = F.struct(part(1, "string").alias("slide"), part(2, "int").alias("n"), part(3, "int").alias("level"), part(4, "int").alias("x"), part(5, "int").alias("y"))
    return F.when(last.rlike(PATTERN), fields)


def level_xy(path: Column) -> Column:
    """struct<x, y> of a name that ends in _x_y.png."""
    pattern = r"_(\d+)_(\d+)\.png$"
    return F.when(path.rlike(pattern), F.struct(F.regexp_extract(path, pattern, 1).cast("int").alias("x"), F.regexp_extract(path, pattern, 2).cast("int").alias("y")))


def binary_code(cluster: Column, levels: int) -> Column:
    return F.lpad(F.bin(cluster), levels, "0")
