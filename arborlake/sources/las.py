"""LAS point clouds as a Spark data source: ``spark.read.format("las")`` and ``df.write.format("las")``.

Records have a fixed length, so a file is read as ranges of records, one task each, and each task
reads its bytes alone and yields Arrow batches. Writing takes Arrow batches too. Compressed files (LAZ) are refused. Paths are local or
URIs of any file system that Arrow knows; a folder that is written must be one that all executors and the driver share.
"""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, StructType

#: Fixed by the LAS specification: bytes of a record of each point format.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
HEADER_SCHEMA = (
    "path string, version string, point_format int, point_count long, scales array<double>, offsets array<double>, "
    "mins array<double>, maxs array<double>, extra_dims array<string>, record_length int, crs string"
)
BATCH = 500_000


@dataclass(frozen=True)
class Header:
    path: str
    version: str
    point_format: int
    point_count: int
    scales: tuple[float, ...]
    offsets: tuple[float, ...]
    mins: tuple[float, ...]
    maxs: tuple[float, ...]
    extra_dims: tuple[str, ...]
    record_length: int
    data_offset: int
    crs: str | None


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the local one, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs.LocalFileSystem(), os.path.abspath(path)


def read_header(path: str) -> Header:
    """The public header block and what the variable records say of extra dimensions and the CRS."""
    system, place = file_system(path)
    with system.open_input_file(place) as f:
        raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        major, minor = raw[24], raw[25]
        size, data_offset, n_records = struct.unpack_from("<HII", raw, 94)
        kind, length, count = struct.unpack_from("<BHI", raw, 104)
        if kind & 0x80:
            raise ValueError(f"{path} is compressed (LAZ); decompress it to LAS first")
        if minor >= 4:
            count = struct.unpack_from("<Q", raw, 247)[0]
        numbers = struct.unpack_from("<12d", raw, 131)
        f.seek(size)
        extra: list[str] = []
        crs = None
        for _ in range(n_records):
            head = f.read(54)
            user, record, n = head[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", head, 18)
            body = f.read(n)
            if user == b"LASF_Spec" and record == 4:
                extra += [body[i + 4 : i + 36].rstrip(b"\0").decode() for i in range(0, len(body), 192)]
            if user == b"LASF_Projection" and record == 2112:
                crs = body.rstrip(b"\0").decode(errors="replace")
    ends = numbers[6:]
    return Header(path, f"{major}.{minor}", kind, count, numbers[:3], numbers[3:6], ends[1::2], ends[0::2], tuple(extra), length, data_offset, crs)


def las_files(path: str) -> list[str]:
    """A file, or the LAS files of a folder, by name; URIs stay URIs."""
    system, place = file_system(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if n.lower().endswith((".las", ".laz"))]


class HeaderSource(DataSource):
    """One row per file: its header, without touching points."""

    @classmethod
    def name(cls) -> str:
        return "las_header"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(self.options["path"])


class HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in las_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        h = read_header(partition.value)
        yield (
            h.path, h.version, h.point_format, h.point_count, list(h.scales), list(h.offsets), list(h.mins), list(h.maxs), list(h.extra_dims), h.record_length, h.crs,
        )


@dataclass
class PointRange(InputPartition):
    header: Header
    first: int
    last: int
    pid: int


class PointSource(DataSource):
    """Points of LAS files: ``pid`` (place in the files, in order of name), ``x, y, z``.

    Options: ``path``; ``points``, how many a task reads; ``scale`` of what is written, one number or three with commas.
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "pid long, x double, y double, z double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PointReader(self.options["path"], int(self.options.get("points", 4_000_000)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        scales = [float(v) for v in self.options.get("scale", "0.001").split(",")]
        return PointWriter(self.options["path"], schema, overwrite, tuple(scales * (3 // len(scales))))


class PointReader(DataSourceReader):
    def __init__(self, path: str, points: int):
        self.path, self.points = path, points

    def partitions(self) -> list[PointRange]:
        found, pid = [], 0
        for f in las_files(self.path):
            h = read_header(f)
            found += [PointRange(h, a, min(a + self.points, h.point_count), pid + a) for a in range(0, h.point_count, self.points)]
            pid += h.point_count
        return found or [PointRange(Header("", "", 0, 0, (), (), (), (), (), 20, 0, None), 0, 0, 0)]

    def read(self, partition: PointRange) -> Iterator[pa.RecordBatch]:
        h = partition.header
        record = np.dtype({"names": ["x", "y", "z"], "formats": ["<i4"] * 3, "offsets": [0, 4, 8], "itemsize": h.record_length})
        if partition.first == partition.last:
            return
        system, place = file_system(h.path)
        file = system.open_input_file(place)
        for a in range(partition.first, partition.last, BATCH):
            n = min(BATCH, partition.last - a)
            rows = np.frombuffer(file.read_at(n * h.record_length, h.data_offset + a * h.record_length), record)
            xyz = [rows[c] * s + o for c, s, o in zip("xyz", h.scales, h.offsets)]
            pid = np.arange(partition.pid + a - partition.first, partition.pid + a - partition.first + n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pid, *xyz)], names=["pid", "x", "y", "z"])


@dataclass
class Written(WriterCommitMessage):
    path: str


class PointWriter(DataSourceArrowWriter):
    """LAS 1.4 files of point format 6, one per task, with every other column as an extra dimension.

    Whole numbers are written as unsigned 32-bit, other numbers as 32-bit floats. A task spools its records, since the
    header that comes before them counts them, and then writes one file in the folder, which gets its name when the job commits.
    """

    def __init__(self, path: str, schema: StructType, overwrite: bool, scales: tuple[float, ...]):
        self.folder, self.overwrite, self.scales = path.rstrip("/"), overwrite, np.array(scales)
        fields = [f for f in schema.fields if f.name not in ("x", "y", "z")]
        self.extra = [(f.name, isinstance(f.dataType, (DoubleType, FloatType))) for f in fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.folder)
        system.create_dir(folder)
        layout = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("rest", "V18"), *[(f"e{i}", "<f4" if real else "<u4") for i, (_, real) in enumerate(self.extra)]]
        low, high, offset, count = np.full(3, np.inf), np.full(3, -np.inf), None, 0
        with tempfile.TemporaryFile() as spool:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                xyz = np.column_stack([batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in "xyz"])
                offset = np.floor(xyz.min(0)) if offset is None else offset
                out = np.zeros(len(xyz), layout)
                whole = np.rint((xyz - offset) / self.scales)
                if not (np.abs(whole) < 1 << 31).all():
                    raise ValueError(f"coordinates of one task span more than 32 bits at scales {self.scales.tolist()}")
                for k, a in enumerate("xyz"):
                    out[a] = whole[:, k]
                for i, (name, real) in enumerate(self.extra):
                    out[f"e{i}"] = batch.column(name).to_numpy(zero_copy_only=False) if real else self._whole(name, batch.column(name))
                spool.write(out.tobytes())
                stored = whole * self.scales + offset
                low, high, count = np.minimum(low, stored.min(0)), np.maximum(high, stored.max(0)), count + len(xyz)
            spool.seek(0)
            temporary = f"{folder}/_{uuid4().hex}.part"
            with system.open_output_stream(temporary) as f:
                f.write(self._head(count, np.zeros(3) if offset is None else offset, low, high, np.dtype(layout).itemsize))
                shutil.copyfileobj(spool, f, 1 << 24)
        return Written(temporary)

    @staticmethod
    def _whole(name: str, column: pa.Array) -> np.ndarray:
        values = column.cast(pa.int64())
        ends = pc.min_max(values).as_py()
        for value in (None if values.null_count else 0, ends["min"], ends["max"]):
            if value is None or not 0 <= value < 1 << 32:
                raise ValueError(f"{name} holds {value}; a LAS extra dimension holds whole numbers from 0 to 2**32 - 1")
        return values.to_numpy()

    def _data_offset(self) -> int:
        return 375 + (54 + 192 * len(self.extra) if self.extra else 0)

    def _head(self, count: int, offset: np.ndarray, low: np.ndarray, high: np.ndarray, record: int) -> bytes:
        head = bytearray(self._data_offset())
        head[:4], head[24:26] = b"LASF", bytes((1, 4))
        head[26:35], head[58:67] = b"arborlake", b"arborlake"
        struct.pack_into("<HII", head, 94, 375, len(head), 1 if self.extra else 0)
        struct.pack_into("<BH", head, 104, 6, record)
        low, high = (np.where(np.isfinite(v), v, 0.0) for v in (low, high))
        ends = [v for pair in zip(high, low) for v in pair]
        struct.pack_into("<12d", head, 131, *self.scales, *offset, *ends)
        struct.pack_into("<Q", head, 247, count)
        if self.extra:
            struct.pack_into("<16sHH", head, 377, b"LASF_Spec", 4, 192 * len(self.extra))
            for i, (name, real) in enumerate(self.extra):
                at = 429 + 192 * i
                head[at + 2] = 9 if real else 5
                struct.pack_into("<32s", head, at + 4, name.encode()[:32])
        return bytes(head)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        system, folder = file_system(self.folder)
        if self.overwrite:
            for f in las_files(self.folder):
                system.delete_file(file_system(f)[1])
        for i, m in enumerate(done):
            system.move(m.path, f"{folder}/part-{i:05d}-{uuid4().hex[:8]}.las")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.folder)
        for m in messages:
            if m is not None and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


def register(spark: SparkSession) -> None:
    """Make the formats ``las`` and ``las_header`` known to a session."""
    spark.dataSource.register(PointSource)
    spark.dataSource.register(HeaderSource)
