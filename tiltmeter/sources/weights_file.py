"""Weight files: a length, a JSON head with the dtype, shape and bytes of every tensor, then the bytes (``.safetensors``).

Read by a data source of its own: the heads are read first and cut into ranges of whole matrix rows, which tasks then read
by themselves, so a file of any size is spread and nothing is loaded as a whole. A row of the table is a row of a tensor.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "weights_file"
SUFFIX = ".safetensors"
SCHEMA = "tensor string, shape array<long>, row_id long, w array<double>"
#: Bytes that a task reads; a longer matrix row makes a range of its own.
RANGE_BYTES = 64 << 20
#: A head is refused beyond this, as the format has it.
MOST_HEAD_BYTES = 100_000_000
BATCH_BYTES = 4 << 20

# Element types as the format names them, with the numpy type of their bytes (fixed values).
DTYPES = {
    "F64": "<f8",
    "F32": "<f4",
    "F16": "<f2",
    "BF16": "<u2",
    "F8_E4M3": "u1",
    "F8_E5M2": "u1",
    "I64": "<i8",
    "I32": "<i4",
    "I16": "<i2",
    "I8": "i1",
    "U8": "u1",
    "BOOL": "?",
}


def as_doubles(raw: bytes, dtype: str) -> np.ndarray:
    values = np.frombuffer(raw, dtype=DTYPES[dtype])
    if dtype == "BF16":
        return (values.astype("<u4") << 16).view("<f4").astype("float64")
    if dtype == "F8_E4M3":
        return _small_floats(values, 4, 3, finite=True)
    if dtype == "F8_E5M2":
        return _small_floats(values, 5, 2, finite=False)
    return values.astype("float64")


def _small_floats(codes: np.ndarray, exponent_bits: int, mantissa_bits: int, finite: bool) -> np.ndarray:
    """One-byte floats; ``finite`` ones have a single NaN per sign in place of the infinities."""
    bias = (1 << (exponent_bits - 1)) - 1
    exponent = ((codes >> mantissa_bits) & ((1 << exponent_bits) - 1)).astype("int64")
    share = (codes & ((1 << mantissa_bits) - 1)) / float(1 << mantissa_bits)
    size = np.where(exponent == 0, share * 2.0 ** (1 - bias), (1 + share) * 2.0 ** (exponent - bias))
    top = (1 << exponent_bits) - 1
    if finite:
        size = np.where((codes & 0x7F) == 0x7F, np.nan, size)
    else:
        size = np.where(exponent == top, np.where(share == 0, np.inf, np.nan), size)
    return np.where(codes & 0x80, -size, size)


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def weight_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the weight files of a folder, or of the one file."""
    from pyarrow.fs import FileSelector, FileType

    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == FileType.File else system.get_file_info(FileSelector(inner))
    return sorted((f.path, f.size) for f in found if f.type == FileType.File and (f is info or f.path.endswith(SUFFIX)))


def read_head(source, size: int) -> tuple[dict, int]:
    """(entries by tensor, where the data start). Whatever does not fit the file is refused."""
    source.seek(0)
    length = int.from_bytes(source.read(8), "little")
    if size < 8 or length > min(MOST_HEAD_BYTES, size - 8):
        raise ValueError("the head of a weight file is longer than the file allows")
    head = json.loads(source.read(length))
    head.pop("__metadata__", None)
    for name, entry in head.items():
        if entry["dtype"] not in DTYPES:
            raise ValueError(f"tensor {name!r} has the unknown type {entry['dtype']!r}")
        first, last = entry["data_offsets"]
        wanted = np.dtype(DTYPES[entry["dtype"]]).itemsize * int(np.prod(entry["shape"], dtype=np.int64))
        if last - first != wanted or first < 0 or 8 + length + last > size:
            raise ValueError(f"tensor {name!r} does not have the bytes of its shape")
    return head, 8 + length


@dataclass(frozen=True)
class Rows:
    """Consecutive rows of one tensor of one file."""

    path: str
    tensor: str
    dtype: str
    shape: tuple[int, ...]
    first: int
    count: int
    at: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(DTYPES[self.dtype]).itemsize


@dataclass
class Range(InputPartition):
    pieces: list[Rows] = field(default_factory=list)

    def __init__(self, pieces: list[Rows]) -> None:
        super().__init__(None)
        self.pieces = pieces


def ranges(path: str, range_bytes: int) -> list[Range]:
    """The rows of all tensors, about ``range_bytes`` together; small tensors share a range."""
    out, held, room = [], [], range_bytes
    for name, size in weight_files(path):
        system, _ = _open(path)
        with system.open_input_file(name) as source:
            head, start = read_head(source, size)
        for tensor, entry in sorted(head.items(), key=lambda e: e[1]["data_offsets"]):
            shape = tuple(entry["shape"])
            whole = Rows(name, tensor, entry["dtype"], shape or (1,), 0, (shape or (1,))[0], start + entry["data_offsets"][0])
            done = 0
            while done < whole.count:
                fits = max(1, room // max(whole.row_bytes, 1)) if not held or room >= whole.row_bytes else 0
                take = min(fits, whole.count - done)
                if take:
                    held.append(Rows(name, tensor, whole.dtype, whole.shape, done, take, whole.at + done * whole.row_bytes))
                    room -= take * whole.row_bytes
                    done += take
                if room < whole.row_bytes or not take:
                    out.append(Range(held))
                    held, room = [], range_bytes
    return out + ([Range(held)] if held else [])


class WeightsReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.range_bytes) or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for piece in partition.pieces:
            step = max(1, BATCH_BYTES // max(8 * piece.width, 1))
            with system.open_input_file(piece.path) as source:
                for done in range(0, piece.count, step):
                    count = min(step, piece.count - done)
                    source.seek(piece.at + done * piece.row_bytes)
                    values = as_doubles(source.read(count * piece.row_bytes), piece.dtype)
                    bounds = np.arange(count + 1, dtype=np.int32) * piece.width
                    columns = [pa.array([piece.tensor] * count), pa.array([list(piece.shape)] * count, pa.list_(pa.int64()))]
                    columns.append(pa.array(np.arange(piece.first + done, piece.first + done + count)))
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)))
                    yield pa.RecordBatch.from_arrays(columns, names=["tensor", "shape", "row_id", "w"])


class WeightsFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WeightsReader:
        return WeightsReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_weights(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """tensor, shape, row_id, w: the tensors of a weight file or a folder of them, row by row along the first dimension.

    The other dimensions of a tensor are laid end to end. A tensor without dimensions is one row of one value; one with an
    empty dimension has no rows. All element types become doubles.
    """
    spark.dataSource.register(WeightsFile)
    return spark.read.format(FORMAT).option("path", path).option("range_bytes", str(range_bytes)).load()


def write_weights(rows: DataFrame, folder: str) -> DataFrame:
    """Write tensor, row_id, w (rows of equal width, numbered from 0) as one file of doubles per tensor; returns path, tensor.

    A tensor is one task's work. A file appears under its own new name, so a task that runs twice leaves no half file
    that would be read as whole: only the paths in the result count, and they are moved into place when written.
    """

    def write(table: pa.Table) -> pa.Table:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        table = table.sort_by("row_id")
        name = table.column("tensor")[0].as_py()
        values = table.column("w").combine_chunks()
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        width = len(values[0])
        entry = {"dtype": "F64", "shape": [table.num_rows, width], "data_offsets": [0, 8 * table.num_rows * width]}
        head = json.dumps({name: entry}).encode()
        head += b" " * (-len(head) % 8)
        path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        with system.open_output_stream(path) as sink:
            sink.write(len(head).to_bytes(8, "little") + head)
            sink.write(values.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
        system.move(path, path + SUFFIX)
        return pa.table({"path": [path + SUFFIX], "tensor": [name]})

    return rows.select("tensor", F.col("row_id").cast("long").alias("row_id"), "w").groupBy("tensor").applyInArrow(write, "path string, tensor string")
