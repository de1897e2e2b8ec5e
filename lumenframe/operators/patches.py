"""Patches of cells cut from tiled images: a join of windows with the tiles they overlap, and the parts put together by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.arrow import map_arrow
from ..functions.storage import Workspace, free_name
from .images import resized

#: Windows that are cut from one copy of a tile.
CUTS = 4096


def _over(first: Column, side: Column, most: Column, tile: int) -> Column:
    """The tiles that places first, first + 1, ... of a window lie in, of those inside the image; none if they are all outside."""
    low, high = F.greatest(first, F.lit(0)), F.least(first + side, most) - 1
    at = lambda c: F.floor(c / F.lit(tile)).cast("long")
    return F.when(high >= low, F.sequence(at(low), at(high))).otherwise(F.array().cast("array<long>"))


def cut_patches(cells: DataFrame, tiles: DataFrame, sizes: DataFrame, tile: int, patch: int, upsample: int = 1, channels: int = 1, x: str = "x_px", y: str = "y_px", image: str = "image", anchored: bool = False, name: str = "patch") -> DataFrame:
    """``cells`` with ``name``: 8-bit pixels, row by row, of a square of ``patch`` around each cell: a window of about patch / upsample pixels, resized
    by Lanczos's kernel where that is another size. tiles: (image, ty, tx, pixels), squares of ``tile`` pixels; sizes: (image, height, width), a row
    for each image.

    What lies outside the image, or in a tile that isn't given, is 0; with ``anchored`` the part inside is at the top left instead of in its place. A cell
    with a null image or place, or of an image without a size, has a null patch; repeated cells have a patch each; tiles that repeat a place
    must be equal, and one of them is used.

    A window meets its tiles by an equi-join on their places, a tile's windows being packed so that its pixels are sent once for each ``CUTS`` of
    them; only the parts inside windows are shuffled again. No image is in one place."""
    work = Workspace(cells.sparkSession, "patches")
    row = free_name("the_row", cells)
    names = [c for c in cells.columns if c.lower() != name.lower()]
    rows = work.save(cells.select(*names).withColumn(row, F.monotonically_increasing_id()))
    window = S.patch_window(rows[x].cast("double"), rows[y].cast("double"), patch, upsample)
    placed = rows.select(F.col(row).alias("r"), rows[image].alias("image"), window.alias("w")).where("image is not null and w.x0 is not null and w.y0 is not null")
    shape = sizes.select(F.col(image).alias("image"), F.col("height").cast("long").alias("h"), F.col("width").cast("long").alias("b"))
    placed = work.save(placed.join(shape, "image").select("r", "image", "h", "b", F.col("w.x0").alias("x0"), F.col("w.y0").alias("y0"), F.col("w.side").cast("long").alias("side")))
    asked = placed.withColumn("ty", F.explode(_over(F.col("y0"), F.col("side"), F.col("h"), tile))).withColumn("tx", F.explode(_over(F.col("x0"), F.col("side"), F.col("b"), tile)))
    place = ["image", "ty", "tx"]
    crowded = asked.groupBy(*place).agg(F.ceil(F.count("*") / CUTS).cast("int").alias("parts")).where("parts > 1")
    dealt = asked.join(crowded, place, "left").withColumn("part", F.pmod(F.xxhash64("r"), F.coalesce("parts", F.lit(1))))
    packed = dealt.groupBy(*place, "part").agg(F.collect_list(F.struct("r", "x0", "y0", "side", "h", "b")).alias("them"))
    given = tiles.select(F.col(image).alias("image"), F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), "pixels").groupBy(*place).agg(F.max("pixels").alias("pixels"))
    both = packed.join(given, place).select("ty", "tx", "pixels", "them")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                top, left = (batch.column(c)[i].as_py() * tile for c in ("ty", "tx"))
                pixels = np.frombuffer(batch.column("pixels")[i].as_buffer(), np.uint8).reshape(tile, tile, channels)
                them = batch.column("them")[i].values
                r, x0, y0, side, h, b = (them.field(c).to_numpy() for c in ("r", "x0", "y0", "side", "h", "b"))
                y1, y2 = np.maximum(y0, top), np.minimum(np.minimum(y0 + side, h), top + tile)
                x1, x2 = np.maximum(x0, left), np.minimum(np.minimum(x0 + side, b), left + tile)
                parts = [pixels[a - top : c - top, d - left : e - left].tobytes() for a, c, d, e in zip(y1.tolist(), y2.tolist(), x1.tolist(), x2.tolist(), strict=True)]
                down, right = (y1 - np.maximum(y0, 0), x1 - np.maximum(x0, 0)) if anchored else (y1 - y0, x1 - x0)
                yield pa.RecordBatch.from_arrays([pa.array(r), *(pa.array(v.astype(np.int32)) for v in (down, right, y2 - y1, x2 - x1)), pa.array(parts, pa.binary())], ["r", "down", "right", "high", "wide", "part"])

    parts = map_arrow(both, cut, "r long, down int, right int, high int, wide int, part binary")
    whole = parts.groupBy("r").agg(F.collect_list(F.struct("down", "right", "high", "wide", "part")).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for side, parts in zip(batch.column("side").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                square = np.zeros((side, side, channels), np.uint8)
                for p in parts or []:
                    square[p["down"] : p["down"] + p["high"], p["right"] : p["right"] + p["wide"]] = np.frombuffer(p["part"], np.uint8).reshape(p["high"], p["wide"], channels)
                out.append((square if side == patch else resized(square, patch)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(out, pa.binary())], ["r", "square"])

    made = map_arrow(placed.select("r", "side").join(whole, "r", "left"), assemble, "r long, square binary")
    joined = rows.join(made.withColumnsRenamed({"r": row, "square": free_name("square", rows)}), row, "left")
    return joined.select(*(joined[c] for c in names), joined[joined.columns[-1]].alias(name))
