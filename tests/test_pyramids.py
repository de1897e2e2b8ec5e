"""Pyramid files written by many tasks against pyramids made in memory."""

import os
import struct

import numpy as np
import pytest

from lumenframe.operators import images
from lumenframe.sources import pyramids, tiff


def table(spark, pictures, tile):
    rows = [(name, ty, tx, bytearray(np.ascontiguousarray(p).tobytes())) for name, x in pictures.items() for ty, tx, p in images.tiles(x, tile)]
    sizes = [(name, x.shape[0], x.shape[1], "k") for name, x in pictures.items()]
    return spark.createDataFrame(rows, "image string, ty int, tx int, pixels binary").repartition(3), spark.createDataFrame(sizes, "image string, height int, width int, h0 string")


def whole(rows, path, level, channels):
    mine = [r for r in rows if r.path.endswith(path) and r.level == level]
    h, w, side = mine[0].height, mine[0].width, mine[0].tile_width
    out = np.zeros((-(-h // side) * side, -(-w // side) * side, channels), np.uint8)
    for r in mine:
        out[r.ty * side : (r.ty + 1) * side, r.tx * side : (r.tx + 1) * side] = np.frombuffer(r.pixels, np.uint8).reshape(side, side, channels)
    return out[:h, :w]


@pytest.mark.parametrize("channels", [1, 3])
def test_pyramids_are_read_back(spark, tmp_path, channels):
    rng = np.random.default_rng(0)
    pictures = {n: rng.integers(0, 256, (*s, channels)).astype(np.uint8) for n, s in {"a b": (75, 101), "one": (9, 16), "two+": (33, 5)}.items()}
    tiles, sizes = table(spark, pictures, 16)
    out = {r.image: r for r in pyramids.write_pyramids(tiles.unionAll(tiles.limit(3)), sizes, f"{tmp_path}/p", 16, channels, 0.5).collect()}
    assert sorted(os.listdir(tmp_path)) == ["p"] and {n: r.levels for n, r in out.items()} == {"a b": 4, "one": 2, "two+": 3}
    assert all(r.bytes == os.path.getsize(f"{tmp_path}/p/{n}.tif") for n, r in out.items())
    rows = pyramids.read_tiles(spark, f"{tmp_path}/p").collect()
    for name, picture in pictures.items():
        path = f"/{name}.tif"
        want = picture
        for level in range(out[name].levels):
            assert np.array_equal(whole(rows, path, level, channels), want)
            want = images.halved(want)
        with open(f"{tmp_path}/p/{name}.tif", "rb") as file:
            head = tiff.header(file.read())
        assert (head["height"], head["width"]) == picture.shape[:2] and head["um_per_px"] == pytest.approx(0.5)


def test_missing_tiles_and_bad_images(spark, tmp_path):
    tiles, sizes = table(spark, {"a": np.full((40, 40), 9, np.uint8)}, 16)
    some = tiles.where("ty < 2").unionAll(spark.createDataFrame([("a", 7, 0, bytearray(256)), ("gone", 0, 0, bytearray(256)), ("a", 2, 2, None)], tiles.schema))
    pyramids.write_pyramids(some, sizes, f"{tmp_path}/p", 16)
    rows = {(r.level, r.ty, r.tx): r.pixels for r in pyramids.read_tiles(spark, f"{tmp_path}/p").collect()}
    assert rows[0, 2, 2] is None and set(rows[0, 1, 2]) == {9} and rows[1, 1, 0] is None and len(rows) == 9 + 4 + 1
    assert sorted(set(rows[2, 0, 0])) == [0, 9]
    make = lambda *rows: spark.createDataFrame(list(rows), "image string, height int, width int")
    for bad in (make((None, 4, 4)), make(("a", 4, 4), ("a", 4, 4)), make(("x/y", 4, 4)), make(("a", 0, 4)), make(("a", None, 4))):
        with pytest.raises(ValueError):
            pyramids.write_pyramids(tiles, bad, f"{tmp_path}/q", 16)
    with pytest.raises(ValueError, match="already"):
        pyramids.write_pyramids(tiles, sizes, f"{tmp_path}/p", 16)
    assert pyramids.write_pyramids(tiles, sizes.where("false"), f"{tmp_path}/none", 16).count() == 0 and os.listdir(tmp_path) == ["p", "none"] or sorted(os.listdir(tmp_path)) == ["none", "p"]


def test_the_tiles_of_an_image_are_written_at_once():
    rows = [{"image": i, "h0": 64, "b0": 48, "level": 0, "ty": ty, "tx": tx, "start": 5 * (3 * ty + tx), "data": b"%d-%d-" % (ty, tx) + i} for i in (b"a", b"b") for ty in range(4) for tx in range(3)]
    found = [(image, list(pieces)) for image, pieces in pyramids._placed(rows, 16, 1, None, {})]
    _, lists, first = pyramids.layout(64, 48, 16, 1, None)
    offsets, lengths = lists[0]
    assert [image for image, _ in found] == [b"a", b"b"]
    for image, pieces in found:
        whole = {at + i: x for at, piece in pieces for i, x in enumerate(piece)}
        held = lambda at, n: bytes(whole[at + i] for i in range(n))  # noqa: B023, E731
        assert len(pieces) == 2  # both lists, and tiles
        assert held(first, 60) == b"".join(b"%d-%d-" % (ty, tx) + image for ty in range(4) for tx in range(3))
        assert struct.unpack("<12Q", held(offsets, 96)) == tuple(first + 5 * n for n in range(12)) and struct.unpack("<12Q", held(lengths, 96)) == (5,) * 12
