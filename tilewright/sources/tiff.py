"""Tiles of tiled TIFF images (classic and big, with levels), read by byte range.

A partition is a range of tiles of one file; filters on slide, level, x and y that Spark pushes down are answered from the files' directories, so tiles that they rule out aren't read. Files are found and read through a file system that their path names (local, HDFS,
S3, GCS), directories of files while the read is planned, some at a time. Tiles may be stored plain or deflated, with or without horizontal differences, eight bits a sample, samples side by side; other files are an error that names what they have.

A tile at the right or lower edge is cut to the image. A level without tiles, or a folder without files, gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, slide string, level int, x int, y int, height int, width int, channels int, data binary"
#: Tiles of a partition, and files whose directories are read at once.
TILES, AT_ONCE = 256, 16
#: Tags and codes of the format.
WIDTH, LENGTH, BITS, COMPRESSION, SAMPLES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, OFFSETS, COUNTS = 256, 257, 258, 259, 277, 284, 317, 322, 323, 324, 325
SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 13: ("I", 4), 16: ("Q", 8), 18: ("Q", 8)}
PLAIN, DEFLATED = (1,), (8, 32946)


@dataclass
class Level:
    """A level's size, and the place of each of its tiles in the file."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    channels: int
    compression: int
    predictor: int
    offsets: list[int] = field(repr=False, default_factory=list)
    counts: list[int] = field(repr=False, default_factory=list)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    def decoded(self, raw: bytes, x: int, y: int) -> np.ndarray:
        """A tile's samples, cut to the image."""
        flat = np.frombuffer(zlib.decompress(raw) if self.compression in DEFLATED else raw, np.uint8)
        tile = flat[: self.tile_height * self.tile_width * self.channels].reshape(self.tile_height, self.tile_width, self.channels)
        if self.predictor == 2:
            tile = np.cumsum(tile, axis=1, dtype=np.uint8)
        return tile[: self.height - y * self.tile_height, : self.width - x * self.tile_width]


def levels(file: object) -> list[Level]:
    """The tiled levels of an open file, the first the largest as a rule."""
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    entry, many, link = (20, "Q", "Q") if big else (12, "H", "I")
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        size = struct.calcsize(many)
        n = struct.unpack(f"{order}{many}", file.read_at(size, at))[0]
        body = file.read_at(n * entry + struct.calcsize(link), at + size)
        tags = {}
        for k in range(n):
            tag, code, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", body[k * entry : k * entry + (12 if big else 8)])
            if code in SIZES:
                letter, width = SIZES[code]
                room = body[k * entry + (12 if big else 8) : (k + 1) * entry]
                if count * width > len(room):
                    room = file.read_at(count * width, struct.unpack(f"{order}{'Q' if big else 'I'}", room)[0])
                tags[tag] = struct.unpack(f"{order}{count}{letter}", room[: count * width])
        at = struct.unpack(f"{order}{link}", body[n * entry :])[0]
        if TILE_WIDTH in tags:
            out.append(_level(tags))
    return out


def _level(tags: dict[int, tuple[int, ...]]) -> Level:
    one = {t: v[0] for t, v in tags.items()}
    made = Level(one[WIDTH], one[LENGTH], one[TILE_WIDTH], one[TILE_LENGTH], one.get(SAMPLES, 1), one.get(COMPRESSION, 1), one.get(PREDICTOR, 1), list(tags[OFFSETS]), list(tags[COUNTS]))
    if made.compression not in (*PLAIN, *DEFLATED) or set(tags.get(BITS, (8,))) != {8} or (one.get(PLANAR, 1) != 1 and made.channels > 1) or made.predictor not in (1, 2):
        raise ValueError(f"can't decode tiles of compression {made.compression}, bits {tags.get(BITS)}, planes {one.get(PLANAR, 1)}, predictor {made.predictor}")
    return made


@dataclass
class Tiles(InputPartition):
    """A range of tiles of one level: (x, y, offset, bytes) each."""

    path: str
    number: int
    level: Level
    tiles: list[tuple[int, int, int, int]]

    @property
    def size(self) -> int:
        return sum(t[3] for t in self.tiles)


def opened(path: str) -> object:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def found(path: str, suffixes: Sequence[str]) -> list[str]:
    """The files below a path, or that path itself; hidden ones left out."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    start = path[: len(path) - len(inner)] if path.endswith(inner) else path[: path.index("://") + 3]
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    files = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted(f"{start}{f.path}" for f in files if f.type == fs.FileType.File and not f.base_name.startswith(".") and f.base_name.lower().endswith(tuple(suffixes)))


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffixes = options["path"], [s.strip().lower() for s in options.get("suffixes", ".tif,.tiff,.svs").split(",")]
        self.many, self.only = int(options.get("tiles", TILES)), options.get("level")
        self.asks: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in kinds and name in ("slide", "level", "x", "y") and f.value is not None:
                self.asks.append((name, kinds[type(f)], f.value))
            else:
                yield f

    def wants(self, **place: object) -> bool:
        tests = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}
        return all(tests[how](place[name], value) for name, how, value in self.asks if name in place)

    def partitions(self) -> list[Tiles]:
        files = [f for f in found(self.path, self.suffixes) if self.wants(slide=f.rsplit("/", 1)[-1])]

        def planned(path: str) -> list[Tiles]:
            out = []
            with opened(path) as file:
                own = levels(file)
            for number, level in enumerate(own):
                if (self.only is not None and int(self.only) != number) or not self.wants(level=number):
                    continue
                tiles = [(i % level.across, i // level.across, o, n) for i, (o, n) in enumerate(zip(level.offsets, level.counts, strict=True))]
                # A tile of no bytes is one that the file leaves out.
                tiles = [t for t in tiles if t[3] and self.wants(x=t[0], y=t[1])]
                level.offsets, level.counts = [], []
                out += [Tiles(path, number, level, tiles[k : k + self.many]) for k in range(0, len(tiles), self.many)]
            return out

        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [p for made in pool.map(planned, files) for p in made]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        p, schema = partition, pa.schema([("path", pa.string()), ("slide", pa.string()), *((c, pa.int32()) for c in ("level", "x", "y", "height", "width", "channels")), ("data", pa.binary())])
        with opened(p.path) as file:
            # Tiles that lie one after the other in the file are one read.
            ordered, ends = sorted(p.tiles, key=lambda t: t[2]), {}
            for k, t in enumerate(ordered):
                ends[k] = ends[k - 1] if k and ordered[k - 1][2] + ordered[k - 1][3] == t[2] else k
            for _, run in groupby(enumerate(ordered), key=lambda kt: ends[kt[0]]):
                tiles = [t for _, t in run]
                raw = file.read_at(sum(t[3] for t in tiles), tiles[0][2])
                rows, at = [], 0
                for x, y, _, n in tiles:
                    tile = p.level.decoded(raw[at : at + n], x, y)
                    at += n
                    rows.append((p.path, p.path.rsplit("/", 1)[-1], p.number, x, y, *tile.shape, tile.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class TiledTiff(DataSource):
    """spark.read.format("tiled_tiff").load(path). Options: level (one level alone), suffixes, tiles (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "tiled_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TileReader:
        return TileReader(self.options)


def tiles(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, slide, level, x, y, height, width, channels, data) of tiled images; data: samples by row, a byte each."""
    spark.dataSource.register(TiledTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tiled_tiff").options(**{k: str(v) for k, v in options.items()}).load(path)


def pixels(found: DataFrame) -> DataFrame:
    """found with its data as pixels, numbers from 0 to 255, as readers.pixels has them."""

    at = found.columns.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(d, np.uint8).astype(np.int32) for d in batch.column(at).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(raw) if raw else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), flat], names=[*(n for n in batch.schema.names if n != "data"), "pixels"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "data")
    return found.mapInArrow(run, f"{fields}, pixels array<int>")


REGION = "slide string, roi string, height int, width int, channels int, data binary"


def regions(found: DataFrame, wanted: DataFrame, tile: int) -> DataFrame:
    """(slide, roi, height, width, channels, data): the samples of regions wanted (slide, roi, left, top, width, height) of one level's tiles, so many pixels wide and high; 0 where no tile is. Regions meet just the tiles that they touch; a region is put together in one task."""
    cell = lambda start, size: F.sequence(F.floor(F.col(start) / tile).cast("int"), F.floor((F.col(start) + F.col(size) - 1) / tile).cast("int"))
    asked = wanted.where("width > 0 and height > 0").select("slide", "roi", "left", "top", F.col("width").alias("w"), F.col("height").alias("h"), F.explode(cell("left", "width")).alias("x"), "height", F.col("top").alias("_t"))
    asked = asked.withColumn("y", F.explode(F.sequence(F.floor(F.col("_t") / tile).cast("int"), F.floor((F.col("_t") + F.col("h") - 1) / tile).cast("int")))).drop("height", "_t")
    met = asked.join(found.select("slide", "x", "y", "height", "width", "channels", "data"), ["slide", "x", "y"], "left")

    def paste(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        channels = int(rows["channels"].max()) if rows["channels"].notna().any() else 0
        out = np.zeros((int(first.h), int(first.w), channels), np.uint8)
        for r in rows[rows["data"].notna()].itertuples():
            part = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
            top, left = int(r.y * tile - r.top), int(r.x * tile - r.left)
            y0, x0 = max(0, top), max(0, left)
            y1, x1 = min(out.shape[0], top + part.shape[0]), min(out.shape[1], left + part.shape[1])
            if y1 > y0 and x1 > x0:
                out[y0:y1, x0:x1] = part[y0 - top : y1 - top, x0 - left : x1 - left]
        return pd.DataFrame({"slide": [first.slide], "roi": [first.roi], "height": [out.shape[0]], "width": [out.shape[1]], "channels": [channels], "data": [out.tobytes()]})

    return met.groupBy("slide", "roi").applyInPandas(paste, REGION)


def thumbnails(spark: SparkSession, path: str, level: int, tile: int, **options: object) -> DataFrame:
    """(slide, roi, height, width, channels, data): each slide's whole level, a small one, left and right changed over, as a preview shows it."""
    own = tiles(spark, path, level=level, **options)
    sizes = own.groupBy("slide").agg(F.max(F.col("x") * tile + F.col("width")).alias("width"), F.max(F.col("y") * tile + F.col("height")).alias("height"))
    whole = regions(own, sizes.select("slide", F.lit("preview").alias("roi"), F.lit(0).alias("left"), F.lit(0).alias("top"), "width", "height"), tile)

    def mirror(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[:, ::-1].tobytes() for r in batch.itertuples()])

    return whole.mapInPandas(mirror, REGION)
