"""Pictures as PNG files: a sink that shows a file only when its job is done, and sheets of tiles for it.

A task writes its pictures aside, under names of its own; when all tasks are done the driver moves them to their places, and when the job fails it deletes them. So no picture is ever half written, and a task that is tried again leaves nothing twice.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

IMAGE = "name string, height int, width int, channels int, data binary"


def png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of samples by row: grey, red-green-blue, or with a fourth, opacity."""
    kind = {1: 0, 3: 2, 4: 6}.get(channels)
    if kind is None or height < 1 or width < 1 or len(data) != height * width * channels:
        raise ValueError(f"no picture: {height} x {width} x {channels} of {len(data)} bytes")
    rows = np.frombuffer(data, np.uint8).reshape(height, width * channels)
    flat = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)), (b"IDAT", zlib.compress(flat)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body)) for tag, body in parts)


@dataclass
class Written(WriterCommitMessage):
    """(where a picture lies aside, its place) of a task."""

    moves: list[tuple[str, str]]


class PictureWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"].rstrip("/")
        self.uri, self.job = path if "://" in path or path.startswith("file:") else f"file://{path}", uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[object]) -> Written:
        system, top = self._system()
        aside, moves = f"{top}/_writing-{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(aside, recursive=True)
        for k, row in enumerate(iterator):
            if row["name"] is None or ".." in row["name"].split("/"):
                raise ValueError(f"no name for a picture: {row['name']}")
            with system.open_output_stream(f"{aside}/{k}.png") as out:
                out.write(png(bytes(row["data"]), row["height"], row["width"], row["channels"]))
            moves.append((f"{aside}/{k}.png", f"{top}/{row['name'].lstrip('/')}.png"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = self._system()
        made: set[str] = set()
        for source, target in (m for message in messages if message for m in message.moves):
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            system.move(source, target)
        self._clear(system, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._system())

    def _clear(self, system: fs.FileSystem, top: str) -> None:
        if system.get_file_info(f"{top}/_writing-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/_writing-{self.job}")


class Pictures(DataSource):
    """df.write.format("pictures").mode("append").save(path), of rows (name, height, width, channels, data): each is path/name.png."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def writer(self, schema: object, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options)


def write_pictures(images: DataFrame, path: str) -> None:
    """Writes images (name, height, width, channels, data) as PNG files. A picture of that name that is there is replaced."""
    images.sparkSession.dataSource.register(Pictures)
    images.select("name", "height", "width", "channels", "data").write.format("pictures").mode("append").save(path)


def sheets(placed: DataFrame, size: int, columns: int, gap: int = 4) -> DataFrame:
    """One picture (name, height, width, channels, data) a sheet of tiles placed (sheet, row, col, height, width, channels, data), as samples.contact_sheet places them: squares of that size with a white gap between, tiles cut to them, red-green-blue. A sheet is put together in one task, tile by tile; it has as many tiles as were drawn for it."""

    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        step = size + gap
        out = np.full((int(rows["row"].max() + 1) * step + gap, columns * step + gap, 3), 255, np.uint8)
        for r in rows.sort_values(["row", "col"]).itertuples():
            tile = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))[:size, :size]
            tile = np.repeat(tile, 3, axis=2) if tile.shape[2] == 1 else tile[:, :, :3]
            top, left = int(r.row) * step + gap, int(r.col) * step + gap
            out[top : top + tile.shape[0], left : left + tile.shape[1]] = tile
        return pd.DataFrame({"name": [str(rows["sheet"].iloc[0])], "height": [out.shape[0]], "width": [out.shape[1]], "channels": [3], "data": [out.tobytes()]})

    return placed.where("data is not null").select("sheet", "row", "col", "height", "width", "channels", "data").groupBy("sheet").applyInPandas(lay, IMAGE)


def exported(plan: DataFrame, tiles: DataFrame) -> DataFrame:
    """The pictures of an export plan (node, slide, x, y; see samples.export_plan): node/slide_x_y, from tiles (slide, x, y, height, width, channels, data). Positions without a tile have none."""
    name = F.concat_ws("/", F.col("node").cast("string"), F.concat_ws("_", "slide", F.col("x").cast("string"), F.col("y").cast("string")))
    return plan.select("node", "slide", "x", "y").distinct().join(tiles, ["slide", "x", "y"]).select(name.alias("name"), "height", "width", "channels", "data")
