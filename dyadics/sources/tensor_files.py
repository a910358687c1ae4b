"""Tensor files as a Spark data source: a length of eight bytes, a JSON head, then the tensors' raw numbers.

Reading plans one partition a slice of a tensor, by byte range, from heads that are read once; no task holds a whole file. A
filter on the names leaves out the others' partitions, and numbers are read only if the schema asks for them. Writing puts
the tensors of each task into files of bounded size, which appear under their names when all tasks have succeeded.

    spark.dataSource.register(TensorFiles)
    spark.read.format("tensors").option("sliceBytes", 8 << 20).load(path)
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

#: The format's names of number types, and how numpy reads them; BF16 is the upper half of a float.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}
SCHEMA = "file string, name string, dtype string, shape array<long>, start long, values array<float>"
SLICE_BYTES, ROW_VALUES, FILE_BYTES = 8 << 20, 1 << 16, 256 << 20


def located(path: str):
    """The file system of a path or URI and the path in it; what executors and the driver both reach."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def files_below(path: str) -> list[str]:
    """The files of a path: itself, or those below a folder that Spark would not skip, in order."""
    from pyarrow import fs

    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not any(p[:1] in "_." for p in f.path[len(inner) :].strip("/").split("/")))


def head(path: str) -> tuple[int, dict[str, dict]]:
    """Where the numbers begin, and dtype, shape and data_offsets of each tensor; a damaged head is named with its file."""
    system, inner = located(path)
    with system.open_input_file(inner) as f:
        whole = f.size()
        n = int.from_bytes(f.read(8), "little")
        if whole < 8 or n > whole - 8:
            raise ValueError(f"{path}: a head of {n} bytes in a file of {whole}")
        found = json.loads(f.read(n))
    found.pop("__metadata__", None)
    for name, t in found.items():
        if t["dtype"] not in KINDS:
            raise ValueError(f"{path}: {name} has the unknown type {t['dtype']}")
        a, b = t["data_offsets"]
        if not 0 <= a <= b <= whole - 8 - n or b - a != math.prod(t["shape"]) * np.dtype(KINDS[t["dtype"]]).itemsize:
            raise ValueError(f"{path}: the bytes {a} to {b} of {name} do not fit its shape or the file")
    return 8 + n, found


def numbers(raw: bytes, dtype: str) -> np.ndarray:
    x = np.frombuffer(raw, KINDS[dtype])
    return (x.astype(np.uint32) << 16).view(np.float32) if dtype == "BF16" else x


@dataclass
class Slice(InputPartition):
    """Values ``start`` to ``start + count`` of a tensor, and where its numbers begin in the file."""

    file: str
    name: str
    dtype: str
    shape: list[int]
    offset: int
    start: int
    count: int

    def __post_init__(self):
        self.value = None


class TensorReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.path = schema, options["path"]
        self.slice_bytes, self.row_values = int(options.get("sliceBytes", SLICE_BYTES)), int(options.get("rowValues", ROW_VALUES))
        self.wanted: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("name",):
                self.wanted.append(f)
            else:
                yield f

    def _asked(self, name: str) -> bool:
        def holds(f) -> bool:
            if isinstance(f, In):
                return name in f.value
            return name.startswith(f.value) if isinstance(f, StringStartsWith) else name == f.value

        return all(map(holds, self.wanted))

    def partitions(self) -> list[Slice]:
        out = []
        for file in files_below(self.path):
            begins, found = head(file)
            for name, t in sorted(found.items(), key=lambda x: x[1]["data_offsets"]):
                if self._asked(name):
                    item = np.dtype(KINDS[t["dtype"]]).itemsize
                    row = t["shape"][-1] if len(t["shape"]) > 1 and t["shape"][-1] else 1
                    step = max(row, self.slice_bytes // item // row * row)  # whole rows of a matrix
                    n = math.prod(t["shape"])
                    out += [Slice(file, name, t["dtype"], t["shape"], begins + t["data_offsets"][0], a, min(step, n - a)) for a in range(0, max(n, 1), step)]
        return out

    def read(self, part: Slice | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no slices
            return
        kinds = {"file": pa.string(), "name": pa.string(), "dtype": pa.string(), "shape": pa.list_(pa.int64()), "start": pa.int64()}
        names = self.columns.names
        item = np.dtype(KINDS[part.dtype]).itemsize
        row = part.shape[-1] if len(part.shape) > 1 and part.shape[-1] else 1
        step = max(row, self.row_values // row * row)
        system, inner = located(part.file)
        with system.open_input_file(inner) as f:
            for a in range(0, max(part.count, 1), step):
                n = min(step, part.count - a)
                made = {"file": part.file, "name": part.name, "dtype": part.dtype, "shape": part.shape, "start": part.start + a}
                columns = []
                for c in names:
                    if c == "values":
                        kind = pa.float64() if "double" in self.columns[c].dataType.simpleString() else pa.float32()
                        x = numbers(f.read_at(n * item, part.offset + (part.start + a) * item), part.dtype)
                        columns.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(kind.to_pandas_dtype()))))
                    else:
                        columns.append(pa.array([made[c]], kinds[c]))
                yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TensorWriter(DataSourceArrowWriter):
    """Writes rows (name, dtype, shape, values) of whole tensors. Files wait in a folder of their own until the commit."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.most = options["path"], overwrite, int(options.get("fileBytes", FILE_BYTES))
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = located(self.path)
        system.create_dir(f"{inner}/{self.job}", recursive=True)
        files, waiting, size = [], [], 0

        def flush() -> None:
            at, info = 0, {}
            for name, dtype, shape, raw in waiting:
                if name in info:
                    raise ValueError(f"two tensors are named {name}")
                info[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
                at += len(raw)
            text = json.dumps(info).encode()
            text += b" " * (-len(text) % 8)  # the numbers begin at a multiple of eight
            files.append(f"{uuid.uuid4().hex}.tensors")
            with system.open_output_stream(f"{inner}/{self.job}/{files[-1]}") as out:
                out.write(len(text).to_bytes(8, "little") + text)
                for *_, raw in waiting:
                    out.write(raw)

        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("name", "dtype", "shape", "values")}
            for i in range(batch.num_rows):
                name, dtype, shape = (columns[c][i].as_py() for c in ("name", "dtype", "shape"))
                x = columns["values"][i].values.to_numpy(zero_copy_only=False)
                if math.prod(shape) != len(x):
                    raise ValueError(f"{name} has {len(x)} values for the shape {shape}")
                raw = (np.ascontiguousarray(x, "<f4").view("<u4") >> 16).astype("<u2") if dtype == "BF16" else x.astype(KINDS[dtype])
                waiting.append((name, dtype, shape, raw.tobytes()))
                size += len(waiting[-1][3])
                if size >= self.most:
                    flush()
                    waiting, size = [], 0
        if waiting:
            flush()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, inner = located(self.path)
        old = [f for f in files_below(self.path)] if self.overwrite and system.get_file_info(inner).type == fs.FileType.Directory else []
        for m in messages:
            for file in m.files if m else []:
                system.move(f"{inner}/{self.job}/{file}", f"{inner}/{file}")
        for file in old:
            system.delete_file(located(file)[1])
        self._clear(system, inner)

    def abort(self, messages) -> None:
        self._clear(*located(self.path))

    def _clear(self, system, inner: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{inner}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.job}")


class TensorFiles(DataSource):
    """Options: ``sliceBytes`` (of a partition), ``rowValues`` (of a row), ``fileBytes`` (of a written file, about)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options, overwrite)


def registered(spark):
    """``spark`` with the source registered and filters handed to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorFiles)
    return spark
