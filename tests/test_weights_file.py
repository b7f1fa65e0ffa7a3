"""Weight files, written by hand, read in ranges."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.sources import weights_file as W

RNG = np.random.default_rng(23)


def write(path, tensors, meta=True):
    """tensors: name -> (dtype, shape, bytes)."""
    head, data = ({"__metadata__": {"format": "pt"}} if meta else {}), b""
    for name, (dtype, shape, raw) in tensors.items():
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    head = json.dumps(head).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)


@pytest.fixture
def folder(tmp_path):
    big = RNG.normal(size=(50, 6))
    half = RNG.normal(size=(4, 3)).astype("<f2")
    short = RNG.normal(size=8).astype("<f4")
    write(tmp_path / "one.safetensors", {"b.weight": ("F64", [50, 6], big.tobytes()), "a.bias": ("F32", [8], short.tobytes()), "c": ("F16", [2, 2, 3], half.tobytes())})
    bf = (short.view("<u4") >> 16).astype("<u2")
    write(
        tmp_path / "two.safetensors",
        {"bf": ("BF16", [2, 4], bf.tobytes()), "n": ("I8", [3], bytes([1, 255, 128])), "none": ("F32", [0, 4], b""), "one": ("I64", [], struct.pack("<q", -7)), "flag": ("BOOL", [2], b"\1\0")},
        meta=False,
    )
    (tmp_path / "readme.txt").write_text("no weights")
    want = {("b.weight", i): list(r) for i, r in enumerate(big)}
    want |= {("a.bias", i): [float(v)] for i, v in enumerate(short)}
    want |= {("c", i): [float(v) for v in r] for i, r in enumerate(half.reshape(2, 6))}
    rounded = (bf.astype("<u4") << 16).view("<f4").reshape(2, 4)
    want |= {("bf", i): [float(v) for v in r] for i, r in enumerate(rounded)}
    want |= {("n", 0): [1.0], ("n", 1): [-1.0], ("n", 2): [-128.0], ("one", 0): [-7.0], ("flag", 0): [1.0], ("flag", 1): [0.0]}
    return tmp_path, want


@pytest.mark.parametrize("range_bytes", [1, 100, 480, 1 << 20])
def test_rows_in_ranges(spark, folder, range_bytes):
    path, want = folder
    table = W.read_weights(spark, str(path), range_bytes)
    rows = table.collect()
    assert {(r.tensor, r.row_id): r.w for r in rows} == want and len(rows) == len(want)
    assert {r.tensor: r["shape"] for r in rows}["c"] == [2, 2, 3]
    parts = W.ranges(str(path), range_bytes)
    assert table.rdd.getNumPartitions() == len(parts)
    assert len(parts) == {1: len(want), 1 << 20: 1}.get(range_bytes, len(parts)) and (range_bytes > 480 or len(parts) > 5)
    assert all(sum(p.count * p.row_bytes for p in part.pieces) <= max(range_bytes, 48) for part in parts)


def test_one_file_and_pushed_down_work(spark, folder):
    path, _ = folder
    table = W.read_weights(spark, str(path / "one.safetensors"))
    assert table.where("tensor = 'b.weight'").agg(F.count("*").alias("n"), F.max(F.size("w")).alias("d")).first() == (50, 6)


def test_small_floats():
    codes = bytes([0x00, 0x01, 0x08, 0x38, 0x7E, 0x80 | 0x38, 0x7F])
    assert W.as_doubles(codes, "F8_E4M3")[:6].tolist() == [0.0, 2.0**-9, 2.0**-6, 1.0, 448.0, -1.0] and np.isnan(W.as_doubles(codes, "F8_E4M3")[6])
    assert W.as_doubles(bytes([0x01, 0x3C, 0x7B, 0x7C, 0xFC]), "F8_E5M2").tolist() == [2.0**-16, 1.0, 57344.0, np.inf, -np.inf]


@pytest.mark.parametrize(
    "raw",
    [
        b"",
        struct.pack("<Q", 1 << 40) + b"{}",
        struct.pack("<Q", 58) + b'{"a":{"dtype":"F32","shape":[2],"data_offsets":[0,8]}}    ' + b"\0" * 4,
        struct.pack("<Q", 58) + b'{"a":{"dtype":"F99","shape":[2],"data_offsets":[0,8]}}    ' + b"\0" * 8,
        struct.pack("<Q", 58) + b'{"a":{"dtype":"F32","shape":[3],"data_offsets":[0,8]}}    ' + b"\0" * 8,
    ],
)
def test_broken_files_are_refused(tmp_path, raw):
    (tmp_path / "bad.safetensors").write_bytes(raw)
    with pytest.raises(ValueError):
        W.ranges(str(tmp_path), 100)


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(t, i, [float(i), -1.5, float("nan")]) for t in ("x", "y") for i in range(7)], "tensor string, row_id long, w array<double>").repartition(5)
    written = W.write_weights(rows, str(tmp_path / "out")).collect()
    assert sorted(r.tensor for r in written) == ["x", "y"]
    back = W.read_weights(spark, str(tmp_path / "out"), 40)
    assert sorted((r.tensor, r.row_id, str(r.w)) for r in back.collect()) == sorted((r.tensor, r.row_id, str(r.w)) for r in rows.collect())
    with pytest.raises(FileNotFoundError):
        W.weight_files(str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    assert W.read_weights(spark, str(tmp_path / "empty")).count() == 0
