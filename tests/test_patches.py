"""Patches from tiles against crops of the whole image."""

import numpy as np
import pytest

from lumenframe.operators import images, patches


def tables(spark, pictures, tile):
    rows = [(name, ty, tx, bytearray(np.ascontiguousarray(p).tobytes())) for name, x in pictures.items() for ty, tx, p in images.tiles(x, tile)]
    sizes = [(name, x.shape[0], x.shape[1]) for name, x in pictures.items()]
    return spark.createDataFrame(rows, "image string, ty int, tx int, pixels binary").repartition(3), spark.createDataFrame(sizes, "image string, height int, width int")


@pytest.mark.parametrize(("patch", "upsample", "channels", "anchored"), [(9, 1, 1, False), (24, 2, 3, False), (9, 1, 1, True), (40, 1, 3, False)])
def test_patches_are_crops(spark, monkeypatch, patch, upsample, channels, anchored):
    monkeypatch.setattr(patches, "CUTS", 5)  # crowded tiles are dealt
    rng = np.random.default_rng(0)
    pictures = {"a": rng.integers(1, 256, (37, 50, channels)).astype(np.uint8), "b": rng.integers(1, 256, (8, 8, channels)).astype(np.uint8)}
    tiles, sizes = tables(spark, pictures, 16)
    cells = [(i, "a", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 55, (60, 2)))] + [(100 + i, "b", i - 0.5, 2.5) for i in range(12)]
    cells += [(200, "a", 500.0, 3.0), (5, "a", 20.0, 20.0), (201, "a", 10.0, 10.0)] + [(300 + i, "a", 20.0, 20.0) for i in range(20)]
    df = spark.createDataFrame([(*c, "k", 0) for c in cells], "id long, image string, x_px double, y_px double, r string, side int").repartition(4)
    out = patches.cut_patches(df, tiles, sizes, 16, patch, upsample, channels, anchored=anchored).collect()
    assert len(out) == len(cells) and set(out[0].asDict()) == {"id", "image", "x_px", "y_px", "r", "side", "patch"}
    side = max(8, round(patch / upsample))
    for r in out:
        want = images.crop(pictures[r.image], round(r.x_px) - side // 2, round(r.y_px) - side // 2, side, anchored)
        want = want if side == patch else images.resized(want, patch)
        assert np.array_equal(np.frombuffer(r.patch, np.uint8).reshape(patch, patch, channels), want)


def test_odd_cells_and_missing_tiles(spark):
    picture = {"a": np.full((20, 20), 7, np.uint8)}
    tiles, sizes = tables(spark, picture, 10)
    df = spark.createDataFrame([(1, None, 1.0, 1.0), (2, "a", None, 1.0), (3, "gone", 1.0, 1.0), (4, "a", 10.0, 10.0)], "id long, image string, x_px double, y_px double")
    out = {r.id: r.patch for r in patches.cut_patches(df, tiles.where("ty = 0").unionAll(tiles), sizes, 10, 8).collect()}
    assert out[1] is None and out[2] is None and out[3] is None and set(out[4]) == {7}
    half = {r.id: r.patch for r in patches.cut_patches(df, tiles.where("ty = 0"), sizes, 10, 8).collect()}
    assert np.frombuffer(half[4], np.uint8).reshape(8, 8).tolist() == [[7] * 8] * 4 + [[0] * 8] * 4
    assert patches.cut_patches(df.where("false"), tiles, sizes, 10, 8).count() == 0
