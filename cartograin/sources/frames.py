"""Binary frames as a data source of Spark: a folder of frames, written and read by tasks, committed by the driver.

Register it once with spark.dataSource.register(Frames); then df.write.format("frames").save(path) writes a frame for each
task, and spark.read.format("frames").load(path) reads all committed ones, a partition for each SPLIT bytes of records. Paths are
any that pyarrow can open. A frame that no commit names is not there: tasks that failed or ran twice leave nothing to read,
an aborted write removes what its tasks wrote, and a later write is added to the folder or, with overwrite, takes its place.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .sinks import HEADER, RECORD

SCHEMA = "lat double, lng double, n int"
#: Bytes of records that a reading task takes, and records that it hands on at a time.
SPLIT, BATCH = 64 << 20, 1 << 16
_COMMITS = "_commits"


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


@dataclass
class Part(InputPartition):
    name: str
    first: int
    last: int


def _committed(path: str) -> dict[str, int]:
    """The frames of all commits and their numbers of records, in the order of commits."""
    from pyarrow.fs import FileSelector

    store, folder = _store(path)
    found: dict[str, int] = {}
    for f in sorted(store.get_file_info(FileSelector(f"{folder}/{_COMMITS}", allow_not_found=True)), key=lambda f: f.base_name):
        with store.open_input_stream(f.path) as stream:
            found |= json.loads(stream.read())
    return found


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: tuple, overwrite: bool):
        self.path, self.header, self.overwrite = path, header, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name, records = f"{uuid.uuid4().hex}.frame", 0
        place = f"{folder}/{name}"
        try:
            with store.open_output_stream(place, compression=None) as out:
                out.write(struct.pack(HEADER, *self.header))
                for b in iterator:
                    own = np.empty(b.num_rows, RECORD)
                    for c in ("lat", "lng", "n"):
                        own[c] = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                    out.write(own.tobytes())
                    records += b.num_rows
        except BaseException:
            store.delete_file(place)
            raise
        return Written(name, records)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        store, folder = _store(self.path)
        before = [f.path for f in store.get_file_info(FileSelector(f"{folder}/{_COMMITS}", allow_not_found=True))]
        number = 1 + max((int(p.rsplit("/", 1)[-1].split("-")[0]) for p in before), default=0)
        old = _committed(self.path) if self.overwrite else {}
        store.create_dir(f"{folder}/{_COMMITS}", recursive=True)
        with store.open_output_stream(f"{folder}/{_COMMITS}/{number:09d}-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps({m.name: m.records for m in messages if m is not None}).encode())
        if self.overwrite:
            for p in [*before, *(f"{folder}/{name}" for name in old)]:
                store.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        step = max(1, SPLIT // RECORD.itemsize)
        return [Part(name, k, min(k + step, n)) for name, n in _committed(self.path).items() for k in range(0, n, step)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.name}") as data:
            data.seek(struct.calcsize(HEADER) + partition.first * RECORD.itemsize)
            for k in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - k)
                own = np.frombuffer(data.read(n * RECORD.itemsize), RECORD)
                if len(own) < n:
                    raise ValueError(f"{partition.name} ends before record {k + n}")
                yield pa.RecordBatch.from_arrays([pa.array(own[c].astype(own[c].dtype.newbyteorder("="))) for c in ("lat", "lng", "n")], ["lat", "lng", "n"])


class Frames(DataSource):
    """format("frames"): rows (lat, lng, n) in binary frames. Options of the writer: progress, total, cut, aggregate, for the header."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        header = int(self.options.get("progress", 100)), *(float(self.options.get(c, 0.0)) for c in ("total", "cut", "aggregate"))
        return FrameWriter(self.options["path"], header, overwrite)
