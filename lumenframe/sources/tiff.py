"""Sizes and resolutions from TIFF headers, classic and big; pixels are not decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.arrow import map_arrow

#: Fixed values of the TIFF format: tags, and the sizes of the value types.
WIDTH, HEIGHT, DESCRIPTION, X_RESOLUTION, RESOLUTION_UNIT = 256, 257, 270, 282, 296
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
MICROMETRES = {2: 25400.0, 3: 10000.0}


def header(data: bytes) -> dict:
    """width, height, um_per_px (None without a unit) and description of the first image of a TIFF file."""
    end = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    version = struct.unpack_from(f"{end}H", data, 2)[0] if end else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, size = ("Q", 8) if version == 43 else ("I", 4)
    at = struct.unpack_from(f"{end}{word}", data, 8 if version == 43 else 4)[0]
    count = struct.unpack_from(f"{end}{'Q' if version == 43 else 'H'}", data, at)[0]
    at += 8 if version == 43 else 2
    found: dict = {}
    for _ in range(count):
        tag, kind = struct.unpack_from(f"{end}HH", data, at)
        n = struct.unpack_from(f"{end}{word}", data, at + 4)[0]
        place = at + 4 + size
        if n * TYPE_SIZE.get(kind, 1) > size:
            place = struct.unpack_from(f"{end}{word}", data, place)[0]
        if tag in (WIDTH, HEIGHT, RESOLUTION_UNIT):
            found[tag] = struct.unpack_from(end + {3: "H", 4: "I", 16: "Q"}[kind], data, place)[0]
        elif tag == X_RESOLUTION:
            found[tag] = struct.unpack_from(f"{end}II", data, place)
        elif tag == DESCRIPTION:
            found[tag] = bytes(data[place : place + n]).rstrip(b"\0").decode(errors="replace")
        at += 4 + 2 * size
    top, bottom = found.get(X_RESOLUTION, (0, 0))
    unit = MICROMETRES.get(found.get(RESOLUTION_UNIT, 0))
    return {"width": found[WIDTH], "height": found[HEIGHT], "um_per_px": unit / (top / bottom) if unit and top and bottom else None, "description": found.get(DESCRIPTION)}


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, um_per_px, description) of TIFF files; a description in OME XML suits ``readers.ome_pixel_size``."""
    names = ["path", "width", "height", "um_per_px", "description"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p, **header(memoryview(c.as_buffer()))} for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)]
            types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, run, "path string, width long, height long, um_per_px double, description string")
