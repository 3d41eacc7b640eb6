"""Vectors of .npy files, against NumPy."""

import numpy as np

from quillspark.sources import readers


def test_rows_equal_numpy_and_others_are_reported(spark, tmp_path):
    r = np.random.default_rng(1)
    kept = {
        "a": r.normal(size=(3, 4)).astype(np.float32), "b.v1": r.normal(size=(2, 4)), "big": r.normal(size=(5, 4)).astype(">f4"),
        "fortran": np.asfortranarray(r.normal(size=(4, 3)).astype(np.float16)), "whole": np.arange(6).reshape(3, 2), "none": np.zeros((0, 4), np.float32),
    }
    broken = {"line": np.zeros(3), "complex": np.zeros((2, 2), complex), "texts": np.array([["a", "b"]]), "few": np.zeros((2, 4)), "alone": np.zeros((1, 4))}
    for name, matrix in (kept | broken).items():
        np.save(tmp_path / f"{name}.npy", matrix)
    np.save(tmp_path / "objects.npy", np.array([[None]]), allow_pickle=True)
    (tmp_path / "cut.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-5])
    (tmp_path / "empty.npy").write_bytes(b"")
    (tmp_path / "other.txt").write_text("no matrix")
    sizes = {k: len(v) for k, v in kept.items()} | {"line": 3, "complex": 2, "texts": 1, "few": 3, "objects": 1, "cut": 3, "empty": 1, "lost": 2}
    rows = [(p, f"{p}::{i}", i * 10) for p, n in sizes.items() for i in range(n)]
    chunks = spark.createDataFrame(rows[::-1], "paper_id string, chunk_id string, idx int")
    files = readers.npy_files(spark, str(tmp_path))
    got = {x["chunk_id"]: x["embedding"] for x in readers.vectors_by_place(chunks, files).collect()}
    assert got == {f"{p}::{i}": row.astype(np.float32).tolist() for p, m in kept.items() for i, row in enumerate(m)}
    problems = {x["paper_id"]: x["problem"] for x in readers.unmatched(chunks, files).collect()}
    assert set(problems) == {"line", "complex", "texts", "few", "alone", "objects", "cut", "empty", "lost"}
    assert problems["few"] == "2 vectors for 3 chunks" and problems["alone"] == "1 vectors for 0 chunks" and problems["lost"] == "no file"
