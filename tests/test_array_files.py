"""Array files written by many tasks, read back by numpy and by the engine's readers."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import array_files, arrays, shared_files


def test_checksums_of_parts():
    rng = np.random.default_rng(0)
    parts = [rng.bytes(n) for n in (0, 1, 5, 1000, 70_000)]
    assert shared_files.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == (zlib.crc32(b"".join(parts)), sum(map(len, parts)))


def test_dense_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 7)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)], "row_index long, e array<float>, i string").repartition(5, "e")
    path = f"{tmp_path}/x.npy"
    assert array_files.write_dense(df, path) == (3000, 7) and os.listdir(tmp_path) == ["x.npy"]
    assert np.array_equal(np.load(path), x)
    back = arrays.dense(spark, path).orderBy("row_index").collect()
    assert np.array_equal(np.array([r.e for r in back], np.float32), x)
    with pytest.raises(ValueError, match="already"):
        array_files.write_dense(df, path)


def test_dense_odd_rows(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "row_index long, e array<double>")
    for rows in ([(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, None)], [(None, [1.0])]):
        with pytest.raises(ValueError):
            array_files.write_dense(make(rows), f"{tmp_path}/bad.npy")
    with pytest.raises(Exception, match="two rows"):
        array_files.write_dense(make([(0, [1.0]), (1, [1.0]), (1, [2.0]), (3, [1.0])]), f"{tmp_path}/bad.npy")
    assert os.listdir(tmp_path) == []  # a failed job leaves nothing
    assert array_files.write_dense(make([]), f"{tmp_path}/none.npy") == (0, 0) and np.load(f"{tmp_path}/none.npy").shape == (0, 0)
    array_files.write_dense(make([(0, [1.0, None]), (1, [3.0, 4.0])]), f"{tmp_path}/nan.npy", dtype="float64")
    assert np.isnan(np.load(f"{tmp_path}/nan.npy")[0, 1])
    with pytest.raises(ValueError, match="hold"):
        array_files.write_dense(make([(0, [None])]), f"{tmp_path}/whole.npy", dtype="int32")


@pytest.mark.parametrize("block", [65_536, 7])
def test_sparse_round_trip(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(array_files, "BLOCK", block)
    rng = np.random.default_rng(2)
    want = np.where(rng.random((40, 30)) < 0.2, rng.integers(1, 9, (40, 30)), 0).astype(float)
    want[5], want[-1], want[9] = 0, 0, 3  # empty rows and a full one
    rows = [(int(r), int(c), float(want[r, c])) for r, c in zip(*np.nonzero(want), strict=True)]
    rows += [(5, 3, 0.0), (0, 0, 2.0), (0, 0, -2.0)]  # zeros of either kind aren't kept; repeats are added
    df = spark.createDataFrame(rows, "row_index long, gene_idx int, n double").repartition(5)
    path = f"{tmp_path}/m.npz"
    assert array_files.write_sparse(df, path, want.shape) == np.count_nonzero(want)
    with np.load(path) as file:
        assert file["format"].item() == b"csr" and file["shape"].tolist() == [40, 30]
        start, indices, data = file["indptr"], file["indices"], file["data"]
    got = np.zeros_like(want)
    for r in range(40):
        assert (np.diff(indices[start[r] : start[r + 1]]) > 0).all()
        got[r, indices[start[r] : start[r + 1]]] = data[start[r] : start[r + 1]]
    assert np.array_equal(got, want)
    assert {(r.row_index, r.gene_idx, r.n) for r in arrays.sparse(spark, path).collect()} == {(int(r), int(c), want[r, c]) for r, c in zip(*np.nonzero(want), strict=True)}


def test_sparse_odd_entries(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "row_index long, gene_idx int, n double")
    for rows in ([(4, 0, 1.0)], [(0, -1, 1.0)], [(None, 0, 1.0)], [(0, 0, None)]):
        with pytest.raises(ValueError):
            array_files.write_sparse(make(rows), f"{tmp_path}/bad.npz", (4, 4))
    assert os.listdir(tmp_path) == []
    assert array_files.write_sparse(make([]), f"{tmp_path}/zero.npz", (4, 4)) == 0
    assert arrays.sparse(spark, f"{tmp_path}/zero.npz").count() == 0


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch, save):
    monkeypatch.setattr(arrays, "RANGE", 50)
    monkeypatch.setattr(arrays, "CHUNK", 20)
    rng = np.random.default_rng(3)
    want = np.where(rng.random((60, 30)) < 0.3, rng.integers(0, 9, (60, 30)), 0)
    want[0], want[20:40], want[-1] = 0, 0, 0
    held = want + 0.5 * (rng.random(want.shape) < 0.1)  # as many entries, some of them zeros below
    row, column = np.nonzero(held)
    start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=60))]).astype(np.int32)
    save(f"{tmp_path}/m.npz", data=want[row, column], indices=column.astype(np.int32), indptr=start, shape=np.array(want.shape), format=np.array(b"csr"))
    back = arrays.sparse(spark, f"{tmp_path}/m.npz")
    assert sorted((r.row_index, r.gene_idx, r.n) for r in back.collect()) == [(int(r), int(c), want[r, c]) for r, c in zip(*np.nonzero(want), strict=True)]
    x = np.asfortranarray(rng.normal(size=(310, 3)))
    np.save(f"{tmp_path}/x.npy", x)
    dense = arrays.dense(spark, f"{tmp_path}/x.npy")
    assert np.array_equal(np.array([r.e for r in dense.orderBy("row_index").collect()], np.float32), x.astype(np.float32))
    parts = [df.select(F.spark_partition_id()).distinct().count() for df in (back, dense)]
    assert parts[1] > 1 and (parts[0] > 1) == (save is np.savez)
