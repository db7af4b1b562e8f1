"""Tiled images read by byte range, and pictures written whole."""

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from tilewright.sources import pictures, tiff


def tiff_file(path, images, tile=16, big=False, order="<", deflated=False, predictor=False, compression=None):
    """A tiled TIFF of images, a level each, written here."""
    out = bytearray(struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 0) if big else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 8 if big else 4
    for image in images:
        h, w, c = image.shape
        offsets, counts = [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                part = np.zeros((tile, tile, c), np.uint8)
                cut = image[y : y + tile, x : x + tile]
                part[: cut.shape[0], : cut.shape[1]] = cut
                if predictor:
                    part = np.diff(part, axis=1, prepend=np.uint8(0)).astype(np.uint8)
                raw = zlib.compress(part.tobytes()) if deflated else part.tobytes()
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        long = (16, "Q") if big else (4, "I")
        tags = [(256, 4, "I", [w]), (257, 4, "I", [h]), (258, 3, "H", [8] * c), (259, 3, "H", [compression or (8 if deflated else 1)]), (277, 3, "H", [c]), (317, 3, "H", [2 if predictor else 1]), (322, 3, "H", [tile]), (323, 3, "H", [tile]), (324, *long, offsets), (325, *long, counts)]
        entries = b""
        for tag, code, letter, values in tags:
            body = struct.pack(f"{order}{len(values)}{letter}", *values)
            room = 8 if big else 4
            if len(body) > room:
                at = len(out)
                out += body
                body = struct.pack(f"{order}{'Q' if big else 'I'}", at)
            entries += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, code, len(values)) + body.ljust(room, b"\0")
        struct.pack_into(f"{order}{'Q' if big else 'I'}", out, link, len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries
        link = len(out)
        out += struct.pack(f"{order}{'Q' if big else 'I'}", 0)
    Path(path).write_bytes(out)


def picture(seed, h, w, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)


@pytest.mark.parametrize("given", [{}, {"big": True}, {"order": ">", "deflated": True}, {"big": True, "deflated": True, "predictor": True}])
def test_tiles_read_back(spark, tmp_path, given):
    first, small = picture(1, 50, 70), picture(2, 20, 33, 1)
    tiff_file(tmp_path / "A.tif", [first, small], **given)
    tiff_file(tmp_path / ".hidden.tif", [small])
    rows = tiff.tiles(spark, str(tmp_path), tiles=3).collect()
    assert len(rows) == 4 * 5 + 2 * 3 and {r.slide for r in rows} == {"A.tif"}
    for r in rows:
        image = (first, small)[r.level]
        want = image[r.y * 16 : (r.y + 1) * 16, r.x * 16 : (r.x + 1) * 16]
        assert (r.height, r.width, r.channels) == want.shape and bytes(r.data) == want.tobytes()
    one = tiff.pixels(tiff.tiles(spark, str(tmp_path), level=1).where("x = 2 and y = 1")).collect()
    assert [r.pixels for r in one] == [small[16:, 32:].ravel().tolist()]


def test_filters_read_fewer_bytes(spark, tmp_path):
    for name in "AB":
        tiff_file(tmp_path / f"{name}.tif", [picture(3, 64, 160)])

    def planned(*filters):
        reader = tiff.TiledTiff({"path": str(tmp_path), "tiles": "7"}).reader(None)
        left = list(reader.pushFilters(list(filters)))
        return sum(p.size for p in reader.partitions()), left

    whole = planned()[0]
    assert whole == 2 * 64 * 160 * 3
    assert planned(EqualTo(("x",), 3)) == (whole // 10, []) and planned(GreaterThan(("x",), 7), In(("y",), (0, 2)))[0] == whole * 2 // 10 // 2
    other = StringStartsWith(("slide",), "A")
    assert planned(EqualTo(("slide",), "A.tif"), other) == (whole // 2, [other]) and planned(EqualTo(("level",), 1))[0] == 0
    read = tiff.tiles(spark, str(tmp_path)).where("x > 7 and slide = 'B.tif'")
    assert read.count() == 4 * 2


def test_what_cant_be_read(spark, tmp_path):
    assert tiff.tiles(spark, str(tmp_path)).count() == 0
    tiff_file(tmp_path / "J.tif", [picture(1, 8, 8)], compression=7)
    with pytest.raises(Exception, match="compression 7"):
        tiff.tiles(spark, str(tmp_path)).count()


def test_regions_and_thumbnails(spark, tmp_path):
    image, small = picture(4, 50, 70), picture(5, 25, 35)
    tiff_file(tmp_path / "A.tif", [image, small])
    wanted = spark.createDataFrame([("A.tif", "in", 10, 5, 40, 30), ("A.tif", "edge", 60, 40, 20, 20), ("A.tif", "off", 500, 0, 4, 4), ("A.tif", "none", 0, 0, 0, 5), ("B.tif", "no", 0, 0, 4, 4)], "slide string, roi string, left int, top int, width int, height int")
    got = {(r.slide, r.roi): r for r in tiff.regions(tiff.tiles(spark, str(tmp_path), level=0), wanted, 16).collect()}
    padded = np.zeros((60, 80, 3), np.uint8)
    padded[:50, :70] = image
    assert bytes(got["A.tif", "in"].data) == image[5:35, 10:50].tobytes() and bytes(got["A.tif", "edge"].data) == padded[40:60, 60:80].tobytes()
    assert got["A.tif", "off"].channels == 0 and got["B.tif", "no"].channels == 0 and len(got) == 4
    preview = tiff.thumbnails(spark, str(tmp_path), 1, 16).collect()
    assert [(r.slide, bytes(r.data)) for r in preview] == [("A.tif", small[:, ::-1].tobytes())]


def read_back(spark, path):
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(str(path)).select("image.*").collect()
    return {r.origin.split(str(path))[-1].lstrip("/"): np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, ::-1] for r in rows}


def test_sheets_are_written_whole(spark, tmp_path):
    tiles = [(s, k // 3, k % 3, 8, 8, 3, bytes(picture(10 * s + k, 8, 8).tobytes())) for s in range(2) for k in range(5)]
    df = spark.createDataFrame(tiles, "sheet int, row int, col int, height int, width int, channels int, data binary").repartition(4)
    pictures.write_pictures(pictures.sheets(df, 8, 3, gap=2), str(tmp_path / "out"))
    back = read_back(spark, tmp_path / "out")
    assert sorted(back) == ["0.png", "1.png"]
    for s, image in ((0, back["0.png"]), (1, back["1.png"])):
        assert image.shape == (22, 32, 3) and (image[:2] == 255).all()
        for k in range(5):
            top, left = k // 3 * 10 + 2, k % 3 * 10 + 2
            assert (image[top : top + 8, left : left + 8] == picture(10 * s + k, 8, 8)).all()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    good = [(f"p{k}", 4, 4, 3, bytes(48)) for k in range(6)]
    df = spark.createDataFrame([*good, ("bad", 4, 4, 3, bytes(7))], pictures.IMAGE).repartition(3)
    with pytest.raises(Exception, match="no picture"):
        pictures.write_pictures(df, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    pictures.write_pictures(df.where("name <> 'bad'"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == [f"p{k}.png" for k in range(6)]


def test_exported_concepts(spark, tmp_path):
    image = picture(6, 32, 48)
    tiff_file(tmp_path / "S1.tif", [image])
    plan = spark.createDataFrame([(7, 1, "S1.tif", 0, 1), (7, 2, "S1.tif", 2, 0), (9, 1, "S1.tif", 0, 1), (9, 1, "S1.tif", 5, 5)], "node int, leaf int, slide string, x int, y int")
    pictures.write_pictures(pictures.exported(plan, tiff.tiles(spark, str(tmp_path), level=0)), str(tmp_path / "out"))
    back = read_back(spark, tmp_path / "out")
    assert sorted(back) == ["7/S1.tif_0_1.png", "7/S1.tif_2_0.png", "9/S1.tif_0_1.png"] and (back["7/S1.tif_2_0.png"] == image[:16, 32:]).all()
