"""NPY and compressed-row NPZ files written by all tasks at once: each writes its rows at their place in one shared file."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow
from ..functions.storage import Workspace
from . import shared_files

#: Rows of an index whose starts are made in one task.
BLOCK = 65_536
#: Fixed values of the ZIP format: signatures, the version that knows 64-bit sizes, the date 1980-01-01, and the number of the 64-bit field.
LOCAL, CENTRAL, END64, LOCATOR64, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x06\x06", b"PK\x06\x07", b"PK\x05\x06"
VERSION, DATE, FIELD64, ALL16, ALL32 = 45, 33, 1, 0xFFFF, 0xFFFFFFFF


def array_header(shape: tuple[int, ...], dtype: np.dtype) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return out.getvalue()


def write_dense(df: DataFrame, path: str, index: str = "row_index", vector: str = "e", dtype: str = "float32") -> tuple[int, int]:
    """A two-dimensional NPY file of vectors in the order of ``index``; returns its shape.

    Rows are dealt by ranges of the index, sorted within tasks and written at the offset that the index says, so a lost executor costs its
    own ranges only and no task holds more than a batch. The file gets its name when all is written; a failed job leaves nothing.
    ``path`` lies in a folder that all executors see and must be new. The index counts from 0 without gaps or repeats, else ValueError; null vectors
    and vectors of different lengths are errors as well; null components become NaN, in whole-number types an error. No rows: shape (0, 0)."""
    kind = np.dtype(dtype).newbyteorder("<")
    rows = df.select(F.col(index).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    size = F.size("v")
    some_null = F.exists("v", lambda x: x.isNull() | F.isnan(x))
    n, low, high, lost, short, wide, holes = rows.agg(
        F.count("*"), F.min("i"), F.max("i"), F.count(F.when(F.col("i").isNull() | F.col("v").isNull(), 1)), F.min(size), F.max(size), F.count(F.when(some_null, 1))
    ).first()
    if lost or (n and (low != 0 or high != n - 1)):
        raise ValueError(f"{index} of {n} rows goes from {low} to {high}, {lost} rows have no index or vector")
    if short != wide:
        raise ValueError(f"vectors differ in length: {short} to {wide}")
    if holes and kind.kind != "f":
        raise ValueError(f"{holes} vectors have components that {dtype} can't hold")
    width = wide or 0
    head = array_header((n, width), kind)

    with shared_files.committed(path) as target:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = -1

            def pieces() -> Iterator[tuple[int, bytes]]:
                nonlocal last
                for batch in batches:
                    if not len(batch):
                        continue
                    at = batch.column("i").to_numpy()
                    if at[0] == last or (np.diff(at) == 0).any():
                        raise ValueError("an index stands in two rows")
                    last = at[-1]
                    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind)
                    cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        yield len(head) + int(at[a]) * width * kind.itemsize, flat[a * width : b * width].tobytes()

            yield pa.RecordBatch.from_arrays([pa.array([shared_files.write_at(target, pieces())])], ["written"])

        with open(target, "wb") as out:
            out.write(head)
            out.truncate(len(head) + n * width * kind.itemsize)
        if n and width:
            dealt = rows.repartitionByRange("i").sortWithinPartitions("i")
            written = map_arrow(dealt, run, "written long").agg(F.sum("written")).first()[0]
            if written != n * width * kind.itemsize:  # repeats meet in one range, so this can't be
                raise ValueError("an index stands in two rows")
    return n, width


def write_sparse(df: DataFrame, path: str, shape: tuple[int, int], index: str = "row_index", column: str = "gene_idx", value: str = "n", dtype: str = "float64") -> int:
    """A compressed-row NPZ file (data, indices, indptr, shape, format; not deflated) of entries; returns how many it holds.

    Entries of one place are added up and zeros left out. They are dealt by ranges of (row, column) and saved in order with their place in the
    range; with the sizes of the ranges, one number a task, each task knows where its entries go. Row starts come from counts in blocks
    of rows. A member's checksum is put together from its parts' checksums. A row may hold any share of the entries.
    ``path`` as in ``write_dense``. Nulls and places outside ``shape`` are errors; no entries give a matrix of zeros."""
    height, width = shape
    kind = np.dtype(dtype).newbyteorder("<")
    rows = df.select(F.col(index).cast("long").alias("r"), F.col(column).cast("long").alias("c"), F.col(value).cast("double").alias("x"))
    work = Workspace(df.sparkSession, "npz")
    summed = rows.groupBy("r", "c").agg(F.sum("x").alias("x"), F.count("*").alias("all"), F.count("x").alias("known"))
    placed = summed.repartitionByRange("r", "c").sortWithinPartitions("r", "c").where("x is null or x != 0 or all != known or r is null or c is null")
    saved = work.save(placed.withColumn("id", F.monotonically_increasing_id()))
    bad = (F.col("all") != F.col("known")) | F.coalesce(~F.col("r").between(0, height - 1) | ~F.col("c").between(0, width - 1), F.lit(True))
    wrong = saved.where(bad).count()
    if wrong:
        work.drop(saved)
        raise ValueError(f"{wrong} places have nulls or lie outside {shape}")
    part = F.shiftright("id", 33)
    sizes = sorted(tuple(r) for r in saved.groupBy(part.alias("part")).count().collect())  # one number for each task that wrote
    before, nnz = {}, 0
    for p, size in sizes:
        before[p], nnz = nnz, nnz + size

    wide_index = np.dtype("<i8" if max(nnz, width) > np.iinfo(np.int32).max else "<i4")
    arrays = {"indices": ((nnz,), wide_index), "indptr": ((height + 1,), wide_index), "data": ((nnz,), kind)}
    small = {"format": np.array(b"csr"), "shape": np.array(shape, "<i8")}
    heads = {name: array_header(*what) for name, what in arrays.items()}
    lengths = {name: len(heads[name]) + int(what[0][0]) * what[1].itemsize for name, what in arrays.items()}
    contents = {}
    for name, array in small.items():
        out = io.BytesIO()
        np.lib.format.write_array(out, array, version=(1, 0))
        contents[name] = out.getvalue()
        lengths[name] = len(contents[name])
    starts, at = {}, 0
    for name in lengths:
        starts[name] = at
        at += 30 + len(f"{name}.npy") + 20 + lengths[name]
    body = {name: starts[name] + 30 + len(f"{name}.npy") + 20 for name in lengths}
    first = {name: body[name] + len(heads[name]) for name in arrays}
    schema = "name string, start long, size long, crc long"

    def made(found: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate(types)], ["name", "start", "size", "crc"])

    with shared_files.committed(path) as target:

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[tuple[str, int, int, int]] = []
            for batch in batches:
                if not len(batch):
                    continue
                ids = batch.column("id").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
                pieces = []
                for name, col, t in (("indices", "c", wide_index), ("data", "x", kind)):
                    numbers = batch.column(col).to_numpy().astype(t)
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        place = before[int(ids[a]) >> 33] + (int(ids[a]) & (1 << 33) - 1)
                        piece = numbers[a:b].tobytes()
                        pieces.append((first[name] + place * t.itemsize, piece))
                        found.append((name, place, len(piece), zlib.crc32(piece)))
                shared_files.write_at(target, pieces)
            yield made(_merged(found, {"indices": wide_index.itemsize, "data": kind.itemsize}))

        def pointers(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            block = key[0].as_py()
            low, high = block * BLOCK, min((block + 1) * BLOCK, height)
            counts = np.zeros(high - low, np.int64)
            known = group.filter(pyarrow.compute.is_valid(group.column("k")))
            counts[known.column("r").to_numpy() - low] = known.column("k").to_numpy()
            piece = (group.column("above")[0].as_py() + np.cumsum(counts)).astype(wide_index).tobytes()
            shared_files.write_at(target, [(first["indptr"] + (low + 1) * wide_index.itemsize, piece)])
            return pa.Table.from_batches([made([("indptr", low + 1, len(piece), zlib.crc32(piece))])])

        with open(target, "wb") as out:
            out.truncate(at)
        found = [("indptr", 0, wide_index.itemsize, zlib.crc32(bytes(wide_index.itemsize)))]
        shared_files.write_at(target, [(first["indptr"], bytes(wide_index.itemsize))])
        if nnz:
            found += [tuple(r) for r in map_arrow(saved.select("c", "x", "id"), entries, schema).collect()]
        if height:
            block = F.floor(F.col("r") / BLOCK).cast("long")
            counts = saved.groupBy("r").agg(F.count("*").alias("k"))
            totals = counts.groupBy(block.alias("block")).agg(F.sum("k").alias("k"))
            totals = {r["block"]: r["k"] for r in totals.collect()}  # one number for BLOCK rows
            above, running = [], 0
            for b in range(-(-height // BLOCK)):
                above.append((b, running))
                running += totals.get(b, 0)
            blocks = df.sparkSession.createDataFrame(above, "block long, above long")
            groups = blocks.join(counts.withColumn("block", block), "block", "left").groupBy("block")
            found += [tuple(r) for r in groups.applyInArrow(pointers, schema).collect()]
        ends = []
        for name in lengths:
            if name in arrays:
                parts = sorted((start, size, crc) for n, start, size, crc in found if n == name)
                crc, size = shared_files.joined_crc([(zlib.crc32(heads[name]), len(heads[name])), *((c, s) for _, s, c in parts)])
                shared_files.write_at(target, [(body[name], heads[name])])
            else:
                crc, size = zlib.crc32(contents[name]), lengths[name]
                shared_files.write_at(target, [(body[name], contents[name])])
            if size != lengths[name]:
                raise ValueError(f"{name} has {size} bytes of {lengths[name]}")
            label = f"{name}.npy".encode()
            sizes64 = struct.pack("<HHQQ", FIELD64, 16, size, size)
            shared_files.write_at(target, [(starts[name], LOCAL + struct.pack("<HHHHHIIIHH", VERSION, 0, 0, 0, DATE, crc, ALL32, ALL32, len(label), 20) + label + sizes64)])
            field = struct.pack("<HHQQQ", FIELD64, 24, size, size, starts[name])
            ends.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", VERSION, VERSION, 0, 0, 0, DATE, crc, ALL32, ALL32, len(label), 28, 0, 0, 0, 0, ALL32) + label + field)
        directory = b"".join(ends)
        end64 = END64 + struct.pack("<QHHIIQQQQ", 44, VERSION, VERSION, 0, 0, len(ends), len(ends), len(directory), at)
        locator = LOCATOR64 + struct.pack("<IQI", 0, at + len(directory), 1)
        end = END + struct.pack("<HHHHIIH", ALL16, ALL16, ALL16, ALL16, ALL32, ALL32, 0)
        shared_files.write_at(target, [(at, directory + end64 + locator + end)])
    work.drop(saved)
    return nnz


def _merged(found: list[tuple[str, int, int, int]], width: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """Parts that follow each other as one, so that a task reports a few however many batches it wrote."""
    out: list[tuple[str, int, int, int]] = []
    for name, start, size, crc in sorted(found):
        if out and out[-1][0] == name and out[-1][1] + out[-1][2] // width[name] == start:
            _, a, s, c = out[-1]
            out[-1] = (name, a, s + size, shared_files.joined_crc([(c, s), (crc, size)])[0])
        else:
            out.append((name, start, size, crc))
    return out
