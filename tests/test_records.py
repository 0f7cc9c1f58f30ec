import hashlib
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martingrid.functions import codec, rng
from martingrid.sources import records


def row(i):
    values = (3 + i, 1.5 * i, 0.25, -0.0, 9.0)
    return {"run_id": "11" * 32, "run_hash": "22" * 32, "layout_hash": "33" * 32, "build": "44" * 32, "block_id": i, "start_scenario": 10 * i, "end_scenario": 10 * i + 3, "incarnation": 2, "lease_epoch": 1, "rng_version": 2, "stats_schema": 1, "worker_id": 7,
            "n": values[0], "mean": values[1], "m2": values[2], "min": values[3], "max": values[4], "checksum": hashlib.sha256(codec.aggregate_payload(*values)).hexdigest()}


def plain_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (codec.CASTAGNOLI if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_bytes_of_a_record_and_every_damaged_byte():
    r = row(5)
    data = records.encode(pa.RecordBatch.from_pylist([r]))
    payload = b"".join(bytes.fromhex(r[c]) for c in ("run_id", "run_hash", "layout_hash", "build")) + struct.pack("<6QIQ", 5, 50, 53, 2, 1, 2, 1, 7)
    stats = codec.aggregate_payload(*[r[c] for c in ("n", "mean", "m2", "min", "max")])
    payload += struct.pack("<I", 48) + stats + hashlib.sha256(stats).digest()
    body = b"MCR2BLK_" + struct.pack("<IQ", 1, len(payload)) + payload
    assert data == body + struct.pack("<I", plain_crc(body)) and plain_crc(b"123456789") == 0xE3069283
    assert records.decode(data).to_pylist() == [r] and records.decode(b"").num_rows == 0
    three = records.encode(pa.RecordBatch.from_pylist([row(i) for i in range(3)]))
    for i in range(0, len(three)):
        bad = bytearray(three)
        bad[i] ^= 1 << i % 8
        with pytest.raises(records.RecordError):
            records.decode(bytes(bad))
    with pytest.raises(records.RecordError):
        records.decode(three[:-1])
    for flaw in ({"checksum": "00" * 32}, {"lease_epoch": 0}, {"mean": None}, {"block_id": -1}, {"build": "00"}):
        with pytest.raises((records.RecordError, OverflowError)):
            records.encode(pa.RecordBatch.from_pylist([r | flaw]))


def test_records_through_spark(spark, tmp_path):
    records.register(spark)
    path, rows = str(tmp_path / "records"), [row(i) for i in range(50)]
    df = spark.createDataFrame(rows, records.BlockRecords({}).schema()).select(*records.COLUMNS).repartition(3)
    df.write.format("block_records").mode("append").save(path)
    got = spark.read.format("block_records").load(path)
    assert sorted((r.asDict() for r in got.collect()), key=lambda r: r["block_id"]) == rows
    some = spark.read.format("block_records").option("columns", "n,block_id").load(path)
    assert some.columns == ["n", "block_id"] and some.agg(F.sum("n")).first()[0] == sum(r["n"] for r in rows)
    df.limit(4).write.format("block_records").mode("overwrite").save(path)
    assert spark.read.format("block_records").load(path).count() == 4
    flawed = df.withColumn("lease_epoch", F.when(F.col("block_id") == 49, 0).otherwise(F.col("lease_epoch")))
    with pytest.raises(Exception, match="lease epoch"):
        flawed.write.format("block_records").mode("append").save(path)
    assert spark.read.format("block_records").load(path).count() == 4 and not [p for p in Path(path).iterdir() if p.name.startswith(".")]


def test_stream_files_in_name_order_are_the_stream(spark, tmp_path):
    records.register(spark)
    stream = rng.raw_stream(spark, 77, 5_000, 1)
    path = str(tmp_path / "words")
    stream.select("position", "raw").repartitionByRange(5, "position").sortWithinPartitions("position").write.format("le64").mode("append").save(path)
    joined = b"".join(p.read_bytes() for p in sorted(Path(path).iterdir()) if p.name.startswith("stream-"))
    assert np.frombuffer(joined, "<u8").tolist() == [int(r.raw, 16) for r in stream.orderBy("position").collect()]
