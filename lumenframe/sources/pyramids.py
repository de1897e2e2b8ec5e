"""Tiled pyramid TIFF files from tile tables, and tile tables from such files; tiles are encoded, written and decoded in tasks."""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow
from ..functions.storage import Workspace
from ..operators.images import halved, pyramid
from . import shared_files

#: Fixed values of the TIFF format: tags by what they hold, value types as struct letters, and codes of compression and colour.
TAGS = {
    "reduced": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "colour": 262, "samples": 277, "x_resolution": 282, "y_resolution": 283,
    "planes": 284, "unit": 296, "tile_width": 322, "tile_height": 323, "offsets": 324, "sizes": 325, "predictor": 317, "levels": 330,
}
LETTERS = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
SHORT, LONG, RATIONAL, LONG8 = 3, 4, 5, 16
#: Bytes of pixels in one batch on the way to the JVM, about.
HELD = 4_000_000
PLAIN, DEFLATE, OLD_DEFLATE, GREY, RGB, CENTIMETRE = 1, 8, 32946, 1, 2, 3


def layout(height: int, width: int, tile: int, channels: int, um_per_px: float | None) -> tuple[list[tuple[int, bytes]], list[tuple[int, int]], int]:
    """What of a file its size alone decides: pieces of header and directories, for each level where its tiles' offsets and sizes are
    listed, and where the first tile can begin. The lists themselves belong to the tiles."""
    levels = pyramid(height, width, tile)
    counts = [-(-h // tile) * -(-w // tile) for h, w in levels]
    n_fields = lambda level: 12 + (3 if um_per_px else 0) + (level == 0)
    at, places = 16, []
    for level in range(len(levels)):
        places.append(at)
        at += 8 + 20 * n_fields(level) + 8
    sub, at = at, at + 8 * (len(levels) - 1)
    lists = []
    for n in counts:
        lists.append((at, at + 8 * n))
        at += 16 * n
    out = bytearray(at)
    struct.pack_into("<2sHHHQ", out, 0, b"II", 43, 8, 0, 16)
    holes = []
    for level, (h, w) in enumerate(levels):
        fields = {
            "width": (LONG, 1, struct.pack("<I", w)),
            "height": (LONG, 1, struct.pack("<I", h)),
            "bits": (SHORT, channels, struct.pack(f"<{channels}H", *[8] * channels)),
            "compression": (SHORT, 1, struct.pack("<H", DEFLATE)),
            "colour": (SHORT, 1, struct.pack("<H", RGB if channels == 3 else GREY)),
            "samples": (SHORT, 1, struct.pack("<H", channels)),
            "planes": (SHORT, 1, struct.pack("<H", 1)),
            "tile_width": (LONG, 1, struct.pack("<I", tile)),
            "tile_height": (LONG, 1, struct.pack("<I", tile)),
            "offsets": (LONG8, counts[level], b"" if counts[level] == 1 else struct.pack("<Q", lists[level][0])),
            "sizes": (LONG8, counts[level], b"" if counts[level] == 1 else struct.pack("<Q", lists[level][1])),
        }
        fields["reduced"] = (LONG, 1, struct.pack("<I", int(level > 0)))
        if level == 0:
            fields["levels"] = (LONG8, len(levels) - 1, struct.pack("<Q", places[1] if len(levels) == 2 else sub))
        if um_per_px:
            per_cm = struct.pack("<II", round(10_000 / (um_per_px * 2**level) * 1000), 1000)
            fields |= {"x_resolution": (RATIONAL, 1, per_cm), "y_resolution": (RATIONAL, 1, per_cm), "unit": (SHORT, 1, struct.pack("<H", CENTIMETRE))}
        ordered = sorted(fields.items(), key=lambda f: TAGS[f[0]])
        struct.pack_into("<Q", out, places[level], len(ordered))
        for j, (name, (kind, n, value)) in enumerate(ordered):
            place = places[level] + 8 + 20 * j
            struct.pack_into("<HHQ8s", out, place, TAGS[name], kind, n, value)
            if not value:  # one tile: its offset or size stands in the directory
                holes.append(place + 12)
                lists[level] = (place + 12, lists[level][1]) if name == "offsets" else (lists[level][0], place + 12)
    struct.pack_into(f"<{len(levels) - 1}Q", out, sub, *places[1:])
    cuts = sorted(holes)
    end = min([low for (low, _), n in zip(lists, counts, strict=True) if n > 1], default=at)
    pieces = [(a, bytes(out[a:b])) for a, b in zip([0, *(c + 8 for c in cuts)], [*cuts, end], strict=True)]
    return pieces, lists, at


def _edges(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    """A tile whose image ends after ``high`` rows and ``wide`` columns, its last ones repeated beyond."""
    out = pixels.copy()
    out[high:] = out[high - 1]
    out[:, wide:] = out[:, wide - 1 : wide]
    return out


def _placed(rows: list[dict], tile: int, channels: int, um_per_px: float | None, plans: dict) -> Iterator[tuple[str, Iterator[tuple[int, bytes]]]]:
    """Of encoded tiles by image: for each image all that is written of them, tiles and list entries, what is adjacent in one piece. ``plans``
    keeps the last image's layout."""
    for image, mine in itertools.groupby(rows, lambda r: r["image"]):
        pieces = []
        for row in mine:
            if image not in plans:
                plans.clear()
                plans[image] = layout(row["h0"], row["b0"], tile, channels, um_per_px)[1:], pyramid(row["h0"], row["b0"], tile)
            (lists, first), shapes = plans[image]
            n = row["ty"] * -(-shapes[row["level"]][1] // tile) + row["tx"]
            offsets, lengths = lists[row["level"]]
            at = first + row["start"]
            pieces += [(at, row["data"]), (offsets + 8 * n, struct.pack("<Q", at)), (lengths + 8 * n, struct.pack("<Q", len(row["data"])))]
        yield image, shared_files.runs(sorted(pieces))


def _together(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about ``size`` bytes each."""
    rows, step = iter(rows), max(1, HELD // size)
    while held := list(itertools.islice(rows, step)):
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def write_pyramids(tiles: DataFrame, sizes: DataFrame, path: str, tile: int, channels: int = 1, um_per_px: float | None = None) -> DataFrame:
    """A folder with a tiled pyramid ``<image>.tif`` (64-bit TIFF, deflated 8-bit tiles, reduced levels as sub-directories) for each row of sizes
    (image, height, width); tiles: (image, ty, tx, pixels), squares of ``tile`` pixels. Returns sizes with ``levels`` and ``bytes``.

    A level's tile is made of the four below it, halved; the last rows and columns of an image are repeated at its edges. Encoded tiles are saved, sums
    over their sizes give offsets - within a row of tiles, then over rows - and every task writes its tiles and their list entries into
    the files, so no image is in one place. ``path``, which must be new, lies in a folder that all executors see and gets its name last.

    ``tile`` is a multiple of 16. Tiles outside the image, of unknown images or with null pixels are left out; places without a tile have size 0 and count as 0
    in higher levels; tiles that repeat a place must be equal, one is used. Null or repeated image names, names with a slash and empty images are errors.
    No images: an empty folder."""
    if tile % 16 or channels not in (1, 3):
        raise ValueError("tiles have a multiple of 16 pixels and 1 or 3 channels")
    spark = tiles.sparkSession
    work = Workspace(spark, "pyramids")
    shape = sizes.select("image", F.col("height").cast("long").alias("h0"), F.col("width").cast("long").alias("b0"))
    bad = F.coalesce(F.col("image").contains("/") | (F.col("h0") < 1) | (F.col("b0") < 1), F.lit(True))
    if wrong := shape.where(bad).limit(5).collect() + shape.groupBy("image").count().where("count > 1").limit(5).collect():
        raise ValueError(f"images without a name or size of their own: {[r[0] for r in wrong]}")

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [len(pyramid(h, b, tile)) - 1 for h, b in zip(batch.column("h0").to_pylist(), batch.column("b0").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.int32())], [*batch.schema.names, "left"])

    kind = shape.schema["image"].dataType.simpleString()
    shape = work.save(map_arrow(shape, depths, f"image {kind}, h0 long, b0 long, left int"))
    most = shape.agg(F.max("left")).first()[0]
    given = tiles.select("image", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), "pixels").where("pixels is not null")
    level = given.groupBy("image", "ty", "tx").agg(F.max("pixels").alias("pixels")).join(shape, "image").where(f"ty between 0 and (h0 - 1) div {tile} and tx between 0 and (b0 - 1) div {tile}")
    known = ["image", "h0", "b0", "left"]
    level = level.select(*known, F.lit(0).alias("level"), "ty", "tx", F.col("h0").alias("h"), F.col("b0").alias("b"), "pixels")
    schema = level.schema

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = np.zeros((2 * tile, 2 * tile, channels), np.uint8)
                for down, right, pixels in ((c["down"], c["right"], c["pixels"]) for c in row["them"]):
                    part = np.frombuffer(pixels, np.uint8).reshape(tile, tile, channels)
                    whole[down * tile : (down + 1) * tile, right * tile : (right + 1) * tile] = part
                high, wide = (min(2 * tile, row[s] - 2 * tile * row[t]) for s, t in (("h", "ty"), ("b", "tx")))
                small = halved(_edges(whole, high, wide))
                yield {**{c: row[c] for c in (*known, "ty", "tx")}, "level": row["level"] + 1, "h": -(-row["h"] // 2), "b": -(-row["b"] // 2), "pixels": small.tobytes()}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                pixels = np.frombuffer(row["pixels"], np.uint8).reshape(tile, tile, channels)
                pixels = _edges(pixels, min(tile, row["h"] - tile * row["ty"]), min(tile, row["b"] - tile * row["tx"]))
                data = zlib.compress(pixels.tobytes(), 6)
                yield {**{c: row[c] for c in ("image", "h0", "b0", "level", "ty", "tx")}, "data": data, "size": len(data)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(reduced(batches), arrow, tile * tile * channels)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(encoded(batches), coded_arrow, tile * tile * channels)

    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in schema])
    coded_arrow = pa.schema([(c, arrow.field(c).type) for c in ("image", "h0", "b0", "level", "ty", "tx")] + [("data", pa.binary()), ("size", pa.int64())])
    coded_schema = f"image {kind}, h0 long, b0 long, level int, ty long, tx long, data binary, size long"
    levels, coded = [work.save(level)], []
    for _ in range(most or 0):
        below = levels[-1].where(f"left > {len(levels) - 1}")
        quad = F.collect_list(F.struct((F.col("ty") % 2).alias("down"), (F.col("tx") % 2).alias("right"), "pixels")).alias("them")
        four = below.groupBy(*known, "level", "h", "b", F.floor(F.col("ty") / 2).alias("ty"), F.floor(F.col("tx") / 2).alias("tx")).agg(quad)
        levels.append(work.save(map_arrow(four, reduce, schema)))
    for table in levels:
        coded.append(work.save(map_arrow(table, encode, coded_schema)))
        work.drop(table)
    everything = coded[0]
    for table in coded[1:]:
        everything = everything.unionAll(table)
    before = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = ["image", "level", "ty"]
    bands = everything.groupBy(*place).agg(F.sum("size").alias("band")).withColumn("above", F.coalesce(F.sum("band").over(before(["image"], "level", "ty")), F.lit(0)))
    starts = everything.select(*place, "tx", "size").join(bands.select(*place, "above"), place)
    starts = starts.select(*place, "tx", (F.col("above") + F.coalesce(F.sum("size").over(before(place, "tx")), F.lit(0))).alias("start"))
    ready = everything.join(starts, [*place, "tx"]).select("image", "h0", "b0", "level", "ty", "tx", "start", "data")

    with shared_files.committed(path) as folder:

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    pieces, _, end = layout(row["h0"], row["b0"], tile, channels, um_per_px)
                    file = os.open(f"{folder}/{row['image']}.tif", os.O_CREAT | os.O_RDWR)
                    if os.fstat(file).st_size < end:
                        os.ftruncate(file, end)
                    os.close(file)
                    shared_files.write_at(f"{folder}/{row['image']}.tif", pieces)
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

        def place_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plans: dict = {}
            for batch in batches:
                for image, pieces in _placed(batch.to_pylist(), tile, channels, um_per_px, plans):
                    shared_files.write_at(f"{folder}/{image}.tif", pieces)
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

        os.makedirs(folder)
        map_arrow(shape, heads, "n long").agg(F.sum("n")).collect()
        map_arrow(ready.sortWithinPartitions("image"), place_tiles, "n long").agg(F.sum("n")).collect()
    work.drop(*coded)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.tif$", 1).alias("f"), F.col("length").alias("bytes")) if most is not None else spark.createDataFrame([], "f string, bytes long")
    return shape.join(files, F.col("image").cast("string") == F.col("f")).select("image", F.col("h0").alias("height"), F.col("b0").alias("width"), (F.col("left") + 1).alias("levels"), "bytes")


def directory(file, end: str, big: bool, at: int) -> dict[int, tuple[int, ...]]:
    """Whole-number fields of one directory, by tag."""
    word, size = ("Q", 8) if big else ("I", 4)
    file.seek(at)
    (count,) = struct.unpack(f"{end}{'Q' if big else 'H'}", file.read(8 if big else 2))
    entries, out = file.read(count * (4 + 2 * size)), {}
    for j in range(count):
        tag, kind, n = struct.unpack_from(f"{end}HH{word}", entries, j * (4 + 2 * size))
        if kind not in LETTERS:
            continue
        form = f"{end}{n}{LETTERS[kind]}"
        held = entries[j * (4 + 2 * size) + 4 + size :][:size]
        if struct.calcsize(form) > size:
            file.seek(struct.unpack(f"{end}{word}", held)[0])
            held = file.read(struct.calcsize(form))
        out[tag] = struct.unpack_from(form, held)
    return out


def read_tiles(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(path, level, height, width, tile_height, tile_width, samples, ty, tx, pixels) of tiled 8-bit TIFF files, classic or 64-bit, plain or deflated.

    Directories are read first, one file a task; the places of tiles are then dealt over ``parts`` tasks (shuffle partitions by default), each of which reads
    its ranges of the files, so one large file is read by all. Files lie in a folder that all executors see. ``level`` counts the first directory and its
    sub-directories. Places of size 0 have null pixels. Striped files, other codecs, predictors and depths are errors."""
    places = "path string, level int, height long, width long, tile_height int, tile_width int, samples int, ty long, tx long, start long, size long, codec int"
    names = [p.split()[0] for p in places.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with open(shared_files.local_path(name), "rb") as file:
                    start = file.read(16)
                    end = {b"II": "<", b"MM": ">"}.get(start[:2])
                    version = struct.unpack_from(f"{end}H", start, 2)[0] if end else 0
                    if version not in (42, 43):
                        raise ValueError(f"{name} is not a TIFF file")
                    big = version == 43
                    first = directory(file, end, big, struct.unpack_from(f"{end}{'Q' if big else 'I'}", start, 8 if big else 4)[0])
                    for level, tags in enumerate([first, *(directory(file, end, big, at) for at in first.get(TAGS["levels"], ()))]):
                        codec, samples = tags.get(TAGS["compression"], (PLAIN,))[0], tags.get(TAGS["samples"], (1,))[0]
                        if TAGS["offsets"] not in tags or codec not in (PLAIN, DEFLATE, OLD_DEFLATE) or set(tags[TAGS["bits"]]) != {8} or tags.get(TAGS["planes"], (1,))[0] != 1 or tags.get(TAGS["predictor"], (1,))[0] != 1:
                            raise ValueError(f"{name} isn't made of plain or deflated 8-bit tiles")
                        h, w, th, tw = (tags[TAGS[t]][0] for t in ("height", "width", "tile_height", "tile_width"))
                        n, across = len(tags[TAGS["offsets"]]), -(-w // tw)
                        same = lambda v, t, n=n: pa.array(np.full(n, v), t)
                        at = np.arange(n)
                        columns = [pa.array([name] * n), same(level, pa.int32()), same(h, pa.int64()), same(w, pa.int64()), same(th, pa.int32()), same(tw, pa.int32()), same(samples, pa.int32())]
                        columns += [pa.array(at // across), pa.array(at % across), pa.array(tags[TAGS["offsets"]], pa.int64()), pa.array(tags[TAGS["sizes"]], pa.int64()), same(codec, pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, size = 0, [], 0
            for i, row in enumerate(batch.select(["path", "start", "size", "codec"]).to_pylist()):
                data = None
                if row["size"]:
                    with open(shared_files.local_path(row["path"]), "rb") as file:
                        file.seek(row["start"])
                        data = file.read(row["size"])
                    data = data if row["codec"] == PLAIN else zlib.decompress(data)
                held.append(data)
                size += len(data or b"")
                if size >= HELD or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, len(held)).columns[:9], pa.array(held, pa.binary())], [*names[:9], "pixels"])
                    low, held, size = i + 1, [], 0

    files = spark.read.format("binaryFile").load(path).select("path")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(map_arrow(files, index, places).repartition(parts, "path", "level", "ty", "tx"), decode, ", ".join(places.split(", ")[:9]) + ", pixels binary")
