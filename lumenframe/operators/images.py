"""Image arithmetic on arrays and tile tables. Decoding and registration stay outside: tiles come in as rows of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.arrow import map_arrow


def crop(image: np.ndarray, x0: int, y0: int, side: int, anchored: bool = False) -> np.ndarray:
    """A square window, zeros beyond the borders; ``anchored`` puts what there is at the top left instead of in its place."""
    out = np.zeros((side, side, *image.shape[2:]), image.dtype)
    ys, xs = slice(max(0, y0), max(0, min(image.shape[0], y0 + side))), slice(max(0, x0), max(0, min(image.shape[1], x0 + side)))
    part = image[ys, xs]
    dy, dx = (0, 0) if anchored else (ys.start - y0, xs.start - x0)
    if part.size:
        out[dy : dy + part.shape[0], dx : dx + part.shape[1]] = part
    return out


def as_rgb(image: np.ndarray) -> np.ndarray:
    """Three 8-bit channels from grey, channel-first or deeper images: fractions up to 1 count as shares of 255, other numbers are held to 0 to 255."""
    if image.ndim == 2:
        image = np.repeat(image[:, :, None], 3, axis=2)
    elif image.shape[0] in (3, 4) and image.shape[-1] not in (3, 4):
        image = np.moveaxis(image, 0, -1)
    image = image[:, :, :3]
    if image.dtype == np.uint8:
        return image
    values = image.astype(float)
    if np.issubdtype(image.dtype, np.floating) and values.size and values.max() <= 1.0:
        values = values * 255.0
    return np.clip(values, 0, 255).astype(np.uint8)


def stretched(image: np.ndarray, low: float = 1, high: float = 99) -> np.ndarray:
    """Intensities between two percentiles spread over 0 to 1, each channel by its own; a flat channel is 0."""
    out = np.zeros(image.shape)
    for c in np.ndindex(image.shape[2:]):
        part = image[(slice(None), slice(None), *c)]
        if part.size:
            a, b = np.percentile(part, [low, high])
            if b > a:
                out[(slice(None), slice(None), *c)] = np.clip((part.astype(float) - a) / (b - a), 0, 1)
    return out


def overlay(base: np.ndarray, top: np.ndarray, weight: float | None = None) -> np.ndarray:
    """Two images of one size together: the larger value, or a weighted mean with ``weight`` on the base."""
    return np.maximum(base, top) if weight is None else weight * base + (1 - weight) * top


def pyramid(height: int, width: int, tile: int) -> list[tuple[int, int]]:
    """Sizes of the levels: the image's own, then halved, odd sizes upwards, until one tile holds the image; at least one is halved."""
    out = [(height, width)]
    while len(out) == 1 or max(out[-1]) > tile:
        out.append((max(1, -(-out[-1][0] // 2)), max(1, -(-out[-1][1] // 2))))
    return out


def level_for(sizes: list[tuple[int, int]], most: int) -> int:
    """The first level whose longer side is at most ``most``, else the last."""
    return next((i for i, s in enumerate(sizes) if max(s) <= most), len(sizes) - 1)


def halved(image: np.ndarray) -> np.ndarray:
    """Means of squares of four pixels; the last row or column of an odd side is repeated."""
    pad = [(0, image.shape[0] % 2), (0, image.shape[1] % 2)] + [(0, 0)] * (image.ndim - 2)
    part = np.pad(image, pad, mode="edge").astype(float)
    return ((part[::2, ::2] + part[1::2, ::2] + part[::2, 1::2] + part[1::2, 1::2]) / 4).astype(image.dtype)


def tiles(image: np.ndarray, tile: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, column and pixels of tiles, the last ones padded by their edge pixels."""
    for ty in range(0, image.shape[0], tile):
        for tx in range(0, image.shape[1], tile):
            part = image[ty : ty + tile, tx : tx + tile]
            pad = [(0, tile - part.shape[0]), (0, tile - part.shape[1])] + [(0, 0)] * (image.ndim - 2)
            yield ty // tile, tx // tile, np.pad(part, pad, mode="edge")


def _lanczos(size: int, side: int, lobes: int) -> np.ndarray:
    """Weights (side, size) that resample ``size`` samples: a windowed sinc, widened when the image shrinks so that all samples count."""
    scale = max(size / side, 1.0)
    centre = (np.arange(side) + 0.5) * size / side
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    weight = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, side: int, lobes: int = 3) -> np.ndarray:
    """An image as a square of another size, by Lanczos's kernel along either side; 8-bit images are rounded and stay 8-bit."""
    x = np.tensordot(_lanczos(image.shape[0], side, lobes), image.astype(float), axes=(1, 0))
    x = np.moveaxis(np.tensordot(_lanczos(image.shape[1], side, lobes), x, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else x


def model_input(patch: np.ndarray, side: int, mean: list[float], std: list[float]) -> np.ndarray:
    """A patch as an encoder takes it: resized, over 255, each channel less its mean and over its deviation, channels first."""
    x = resized(as_rgb(patch), side).astype(np.float32) / 255.0
    return np.moveaxis((x - np.asarray(mean, np.float32)) / np.asarray(std, np.float32), -1, 0)


def tile_positions(height: int, width: int, side: int, n: int, seed: int = 42) -> list[tuple[int, int]]:
    """Random places of tiles that lie within an image, for a visual check; the corner alone if it is smaller than a tile, none for n < 1."""
    if n < 1:
        return []
    if height <= side or width <= side:
        return [(0, 0)]
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, height - side + 1)), int(rng.integers(0, width - side + 1))) for _ in range(n)]


def tile_table(images: DataFrame, tile: int) -> DataFrame:
    """(image, ty, tx, pixels) of rows (image, height, width, pixels), 8-bit grey: an image is cut where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                array = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])
                found = [(row["image"], ty, tx, p.tobytes()) for ty, tx, p in tiles(array, tile)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["image", "ty", "tx", "pixels"])

    return map_arrow(images.select("image", "height", "width", "pixels"), run, "image string, ty long, tx long, pixels binary")


def encoded(patches: DataFrame, key: str, pixels: str, encode, width: int) -> DataFrame:
    """(key, embedding): a model's output for patches in batches; ``encode`` maps a list of bytes to an array of rows by ``width``, or of
    rows by tokens by width, whose mean over tokens is taken. It must be picklable; weights belong in a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                out = np.asarray(encode(batch.column(pixels).to_pylist()), np.float32)
                out = out.mean(axis=1) if out.ndim == 3 else out
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), width).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "embedding"])

    kind = patches.schema[key].dataType.simpleString()
    return map_arrow(patches.select(key, pixels), run, f"{key} {kind}, embedding array<float>")
