"""Binary block records and raw streams as Spark data sources.

A record is an envelope, ``magic, schema, length, payload, CRC-32C``, of fixed size, so
a file of records can be read in parts and decoded as one array.  Register with
``register(spark)``; then ``df.write.format("block_records").save(folder)`` and
``spark.read.format("block_records").load(folder)``.  Tasks write under names that do
not count; the driver's commit renames them, and an aborted job leaves nothing.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from martingrid.functions.codec import STATS, crc_table

#: Fixed values of the format.
MAGIC, STORAGE = b"MCR2BLK_", 1
_PAYLOAD = [
    ("run_id", "V32"), ("run_hash", "V32"), ("layout_hash", "V32"), ("build", "V32"), ("block_id", "<u8"), ("start_scenario", "<u8"), ("end_scenario", "<u8"), ("incarnation", "<u8"), ("lease_epoch", "<u8"),
    ("rng_version", "<u8"), ("stats_schema", "<u4"), ("worker_id", "<u8"), ("aggregate_size", "<u4"), ("aggregate_tag", "<u4"), ("aggregate_schema", "<u4"), ("n", "<u8"), ("mean", "<f8"), ("m2", "<f8"), ("min", "<f8"), ("max", "<f8"), ("checksum", "V32"),
]
RECORD = np.dtype([("magic", "V8"), ("storage", "<u4"), ("length", "<u8"), *_PAYLOAD, ("crc", "<u4")])
SIZE = RECORD.itemsize
_DIGESTS = ("run_id", "run_hash", "layout_hash", "build", "checksum")
_HIDDEN = ("magic", "storage", "length", "aggregate_size", "aggregate_tag", "aggregate_schema", "crc")
COLUMNS = [c for c in RECORD.names if c not in _HIDDEN]
#: Records that a task decodes at a time, and that one input partition holds.
AT_A_TIME, PER_PARTITION = 1 << 16, 1 << 20


class RecordError(ValueError):
    """Bytes that are not whole, sound records."""


def _kind(c: str) -> str:
    return "string" if c in _DIGESTS else "double" if RECORD[c].kind == "f" else "long"


def crc32c_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes, all rows abreast, a byte of each at a time."""
    table, crc = np.array(crc_table(), dtype=np.uint32), np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = table[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def _digests(records: np.ndarray) -> list[bytes]:
    first, size = RECORD.fields["aggregate_tag"][1], 48
    raw = records.view(np.uint8).reshape(-1, SIZE)[:, first : first + size].tobytes()
    return [hashlib.sha256(raw[i : i + size]).digest() for i in range(0, len(raw), size)]


def encode(b: pa.RecordBatch) -> bytes:
    """The records of a batch that has all of COLUMNS, digests as 64 hexadecimal digits; raises for nulls, and for statistics whose digest is another."""
    out = np.zeros(b.num_rows, dtype=RECORD)
    out["magic"], out["storage"], out["length"] = np.void(MAGIC), STORAGE, SIZE - 24
    out["aggregate_size"], out["aggregate_tag"], out["aggregate_schema"] = 48, 1, STATS
    for c in COLUMNS:
        column = b.column(c)
        if column.null_count:
            raise RecordError(f"{c} is null")
        if c in _DIGESTS:
            values = [bytes.fromhex(x) for x in column.to_pylist()]
            if any(len(x) != 32 for x in values):
                raise RecordError(f"{c} is not a digest")
            out[c] = np.frombuffer(b"".join(values), "V32")
        else:
            values = column.to_numpy(zero_copy_only=False)
            if c != "mean" and RECORD[c].kind == "u" and (values < 0).any():
                raise RecordError(f"{c} is negative")
            out[c] = values
    _check_meaning(out)
    out["crc"] = crc32c_rows(out.view(np.uint8).reshape(-1, SIZE)[:, :-4])
    return out.tobytes()


def _check_meaning(records: np.ndarray) -> None:
    if (records["lease_epoch"] == 0).any():
        raise RecordError("a lease epoch is zero")
    if records["checksum"].tobytes() != b"".join(_digests(records)):
        raise RecordError("statistics and their digest differ")


def decode(data: bytes, columns: list[str] | None = None) -> pa.RecordBatch:
    """Records to columns; raises RecordError unless every byte is as it was written."""
    if len(data) % SIZE:
        raise RecordError("the bytes end within a record")
    records = np.frombuffer(data, dtype=RECORD)
    fixed = {"magic": np.void(MAGIC), "storage": STORAGE, "length": SIZE - 24, "aggregate_size": 48, "aggregate_tag": 1, "aggregate_schema": STATS, "stats_schema": STATS}
    if len(records):
        if not (crc32c_rows(records.view(np.uint8).reshape(-1, SIZE)[:, :-4]) == records["crc"]).all():
            raise RecordError("a record's CRC-32C differs")
        for c, value in fixed.items():
            if not (records[c] == value).all():
                raise RecordError(f"{c} is not that of this format")
        _check_meaning(records)
    out = []
    for c in columns or COLUMNS:
        if c in _DIGESTS:
            text = records[c].tobytes().hex()
            out.append(pa.array([text[i : i + 64] for i in range(0, len(text), 64)], pa.string()))
        else:
            out.append(pa.array(records[c].astype(np.float64 if RECORD[c].kind == "f" else np.int64)))
    return pa.RecordBatch.from_arrays(out, columns or COLUMNS)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its provisional name, and the one that counts."""

    names: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Files under provisional names, renamed by the commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.job, self.overwrite = path, uuid.uuid4().hex, overwrite

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """(name, bytes) in order; equal names follow one another and are one file."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root)
        names, out, last = [], None, None
        try:
            for name, data in self.chunks(iterator):
                if name != last:
                    if out is not None:
                        out.close()
                    names.append((f".{self.job}-{uuid.uuid4().hex}", name))
                    out, last = store.open_output_stream(posixpath.join(root, names[-1][0])), name
                out.write(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root)
        new = {final for m in messages if m for _, final in m.names}
        for m in messages:
            for name, final in m.names if m else ():
                store.move(posixpath.join(root, name), posixpath.join(root, final))
        for info in store.get_file_info(fs.FileSelector(root)):  # what an overwritten table had, and what lost attempts left
            if info.base_name.startswith(f".{self.job}-") or self.overwrite and info.base_name not in new and not info.base_name.startswith("."):
                store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f".{self.job}-"):
                store.delete_file(info.path)


class _RecordWriter(_Writer):
    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        name = f"part-{uuid.uuid4().hex}.records"
        for b in batches:
            yield name, encode(b)


class _StreamWriter(_Writer):
    """Words in order of their position; a file is named by its first one, so that files in name order are the stream."""

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        name, at = "", None
        for b in batches:
            position, words = b.column("position").to_numpy(), np.array([int(x, 16) for x in b.column("raw").to_pylist()], dtype="<u8")
            if not len(position):
                continue
            if (np.diff(position) != 1).any() or at is not None and position[0] != at:
                raise RecordError("the positions of a part are not neighbours in order")
            name, at = name or f"stream-{position[0]:020d}.le64", int(position[-1]) + 1
            yield name, words.tobytes()


@dataclass
class _Slice(InputPartition):
    path: str
    first: int
    count: int


class _RecordReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[_Slice]:
        store, root = _store(self.path)
        out = []
        for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.base_name.startswith(".") or info.type != fs.FileType.File:
                continue
            if info.size % SIZE:
                raise RecordError(f"{info.base_name} ends within a record")
            out += [_Slice(info.path, a, min(PER_PARTITION, info.size // SIZE - a)) for a in range(0, info.size // SIZE, PER_PARTITION)]
        return out or [_Slice("", 0, 0)]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        with _store(self.path)[0].open_input_file(partition.path) as f:
            for a in range(partition.first, partition.first + partition.count, AT_A_TIME):
                n = min(AT_A_TIME, partition.first + partition.count - a)
                data = f.read_at(n * SIZE, a * SIZE)
                if len(data) != n * SIZE:
                    raise RecordError("a file became shorter")
                yield decode(data, self.columns)


class BlockRecords(DataSource):
    """Option ``columns``, a comma-separated list, prunes what is decoded; all bytes are checked whatever is asked for."""

    @classmethod
    def name(cls) -> str:
        return "block_records"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        names = [c.strip() for c in wanted.split(",")] if wanted else COLUMNS
        if bad := [c for c in names if c not in COLUMNS]:
            raise ValueError(f"no such columns: {bad}")
        return ", ".join(f"{c} {_kind(c)}" for c in names)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RecordReader(self.options["path"], [f.name for f in schema.fields])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _RecordWriter(self.options["path"], overwrite)


class RawStream(DataSource):
    """Write only: columns position and raw (16 hexadecimal digits), each partition a stretch of neighbouring positions in order."""

    @classmethod
    def name(cls) -> str:
        return "le64"

    def schema(self) -> str:
        return "position long, raw string"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _StreamWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (BlockRecords, RawStream):
        spark.dataSource.register(source)
