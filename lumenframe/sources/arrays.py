"""Array files as keyed tables: NPY and CSR NPZ by numpy, HDF5 where h5py is installed. Files are read where they lie, by the executors."""

from __future__ import annotations

import bisect
import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.arrow import map_arrow
from . import shared_files

#: Rows of an array or entries of a matrix in one batch on the way to the JVM.
CHUNK = 65_536
#: Rows or entries of a file that are read by one task.
RANGE = 1 << 20


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _ranges(spark: SparkSession, path: str, size: Callable[[str], int]) -> DataFrame | None:
    """(path, low, high): ranges of at most ``RANGE`` items of the files, dealt over tasks; size(local path) says how many items can be read from
    anywhere. None if the files lie where executors can't open them."""
    files = spark.read.format("binaryFile").load(path).select("path")
    first = files.first()
    if not first or not first.path.startswith("file:"):
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                n = size(shared_files.local_path(name))
                low = np.arange(0, n, RANGE) if n >= 0 else np.array([-1])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(low), pa.string()), pa.array(low), pa.array(np.minimum(low + RANGE, n))], ["path", "low", "high"])

    found = map_arrow(files, cut, "path string, low long, high long")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "low")


def dense(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_index, e) of two-dimensional NPY files. Ranges of rows are read by many tasks; a file that executors can't open by its path is one task."""

    def rows(name: str, x: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
        for a in range(low, high, CHUNK):
            part = np.ascontiguousarray(x[a : min(a + CHUNK, high)], np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(part.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(a, a + len(part))), lists], ["path", "row_index", "e"])

    def checked(name: str, x: np.ndarray) -> np.ndarray:
        if x.ndim != 2:
            raise ValueError(f"{name} has {x.ndim} dimensions, not 2")
        return x

    def opened(name: str) -> np.ndarray:
        with open(name, "rb") as file:
            shape, _, kind, _ = _header(file)
        if 0 in shape:  # nothing to map
            return checked(name, np.zeros(shape, kind))
        return checked(name, np.load(name, mmap_mode="r", allow_pickle=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, low, high in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high")), strict=True):
                yield from rows(name, opened(shared_files.local_path(name)), low, high)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                x = checked(name, np.load(io.BytesIO(content.as_buffer()), allow_pickle=False))
                yield from rows(name, x, 0, len(x))

    schema = "path string, row_index long, e array<float>"
    cut = _ranges(spark, path, lambda name: len(opened(name)))
    return map_arrow(cut, run, schema) if cut is not None else map_arrow(_contents(spark, path), run_whole, schema)


def _header(file: BinaryIO) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Of an array in NPY format: its shape, whether it lies by columns, its type, and where its numbers begin."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return *read(file), file.tell()


def _members(name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a matrix in an NPZ file, mapped; None if one is deflated."""
    out = {}
    with zipfile.ZipFile(name) as archive, open(name, "rb") as file:
        for member in ("data", "indices", "indptr"):
            info = archive.getinfo(f"{member}.npy")
            if info.compress_type != zipfile.ZIP_STORED:
                return None
            file.seek(info.header_offset + 26)
            file.seek(info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4))))
            (n,), _, kind, at = _header(file)
            out[member] = np.memmap(name, kind, "r", at, (n,)) if n else np.zeros(0, kind)
    return out


def sparse(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_index, gene_idx, n) of compressed-row matrices in NPZ files (data, indices, indptr, shape), without explicit zeros.

    Ranges of entries are read by many tasks, which find their rows in the index where it lies. A deflated file, or one that executors can't open by its path, is one task."""

    def rows(name: str, data: np.ndarray, indices: np.ndarray, start: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
        for a in range(low, high, CHUNK):
            b = min(a + CHUNK, high)
            first, last = bisect.bisect_right(start, a) - 1, bisect.bisect_right(start, b - 1)
            row = first + np.searchsorted(np.array(start[first : last + 1], np.int64), np.arange(a, b), "right") - 1
            numbers = np.array(data[a:b], np.float64)
            keep = np.flatnonzero(numbers)
            columns = [pa.array([name] * len(keep), pa.string()), pa.array(row[keep]), pa.array(np.array(indices[a:b], np.int32)[keep]), pa.array(numbers[keep])]
            yield pa.RecordBatch.from_arrays(columns, ["path", "row_index", "gene_idx", "n"])

    def loaded(name: str, source: str | io.BytesIO) -> Iterator[pa.RecordBatch]:
        with np.load(source, allow_pickle=False) as file:
            data, indices, start = file["data"], file["indices"], file["indptr"]
        yield from rows(name, data, indices, start, 0, len(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, low, high in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high")), strict=True):
                local = shared_files.local_path(name)
                if low < 0:
                    yield from loaded(name, local)
                else:
                    found = _members(local)
                    yield from rows(name, found["data"], found["indices"], found["indptr"], low, high)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from loaded(name, io.BytesIO(content.as_buffer()))

    def size(name: str) -> int:
        found = _members(name)
        return -1 if found is None else len(found["data"])

    schema = "path string, row_index long, gene_idx int, n double"
    cut = _ranges(spark, path, size)
    return map_arrow(cut, run, schema) if cut is not None else map_arrow(_contents(spark, path), run_whole, schema)


def feature_matrix(spark: SparkSession, path: str, kind: str | None = "Gene Expression") -> DataFrame:
    """(cell_id, gene, n) of HDF5 feature matrices stored by cell (matrix/data, indices, indptr, barcodes, features); features of one kind.

    Needs h5py on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for content in batch.column("content"):
                with h5py.File(io.BytesIO(content.as_buffer()), "r") as file:
                    m = file["matrix"]
                    names, kinds = m["features/name"].asstr()[:], m["features/feature_type"].asstr()[:]
                    cells, start = m["barcodes"].asstr()[:], m["indptr"][:]
                    wanted = np.ones(len(names), bool) if kind is None else kinds == kind
                    for low in range(0, len(cells), 1024):
                        high = min(low + 1024, len(cells))
                        gene, n = m["indices"][start[low] : start[high]], m["data"][start[low] : start[high]]
                        cell = np.repeat(np.arange(low, high), np.diff(start[low : high + 1]))
                        keep = wanted[gene] & (n != 0)
                        yield pa.RecordBatch.from_arrays([pa.array(cells[cell[keep]]), pa.array(names[gene[keep]]), pa.array(n[keep].astype(np.float64))], ["cell_id", "gene", "n"])

    return map_arrow(_contents(spark, path), run, "cell_id string, gene string, n double")
