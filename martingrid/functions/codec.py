"""Canonical bytes and digests of specifications, layouts and statistics, and CRC-32C.

All numbers are little-endian; digests are SHA-256.  What names a run is formed on the
driver, one value each; digests of block statistics are formed in the tasks.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martingrid.functions import ieee
from martingrid.operators.simulate import RunSpec

#: Fixed values of the formats: versions, and the numbers of models and payoffs.
SPEC_SCHEMA, ENGINE, RNG, STATS, PARTITION, TREE, DISCRETISATION = 1, 2, 2, 1, 1, 1, 1
MODELS, PAYOFFS = {"gbm": 1, "heston": 2}, {"european_call": 1, "asian_call": 2}
RUN_TAG = b"mc-durable-run-v1"
#: Fixed value: the reversed Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def spec_payload(s: RunSpec) -> bytes:
    head = struct.pack("<IQQIBBBBQQIdddd", SPEC_SCHEMA, ENGINE, RNG, STATS, MODELS[s.model], PAYOFFS[s.payoff], s.antithetic, 0, s.seed, s.scenarios, s.steps, s.maturity, s.spot, s.strike, s.rate)
    if s.model == "gbm":
        return head + struct.pack("<d", s.volatility)
    return head + struct.pack("<Iddddd", DISCRETISATION, s.initial_variance, s.reversion, s.long_variance, s.variance_volatility, s.correlation)


def spec_hash(s: RunSpec) -> bytes:
    return hashlib.sha256(spec_payload(s)).digest()


def layout_hash(s: RunSpec) -> bytes:
    blocks = 1 + (s.scenarios - 1) // s.block_size
    return hashlib.sha256(spec_hash(s) + struct.pack("<IIQQ", PARTITION, TREE, s.block_size, blocks)).digest()


def run_id(s: RunSpec) -> bytes:
    return hashlib.sha256(RUN_TAG + spec_hash(s) + layout_hash(s)).digest()


#: The 48 bytes of a block's statistics.
_AGGREGATE = np.dtype([("tag", "<u4"), ("schema", "<u4"), ("n", "<u8"), ("mean", "<f8"), ("m2", "<f8"), ("min", "<f8"), ("max", "<f8")])


def aggregate_payload(n: int, mean: float, m2: float, low: float, high: float) -> bytes:
    return np.array([(1, STATS, n, mean, m2, low, high)], dtype=_AGGREGATE).tobytes()


def with_checksum(stats: DataFrame, name: str = "checksum") -> DataFrame:
    """``stats`` (n, mean, m2, min, max, ...) with the digest of their canonical 48 bytes, lowercase hex; null where one of them is.

    Filters on other columns do not move in front of the digest: apply them to ``stats``.
    """
    rest = [c for c in stats.columns if c != name]
    values = ("mean", "m2", "min", "max")
    bits = stats.select(*rest, *[ieee.double_bits(F.col(c)).alias(f"_bits_of_{c}") for c in values])
    head = F.lit(struct.pack("<II", 1, STATS).hex().upper())
    data = F.unhex(F.concat(head, *[ieee.little_endian(F.col(c)) for c in ("n", *[f"_bits_of_{c}" for c in values])]))
    return bits.select(*rest, F.sha2(data, 256).alias(name))


def crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (CASTAGNOLI if i & 1 else 0)
        out.append(i)
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C of the bytes of a column as a long, in Spark expressions only; null for null."""
    table = F.array(*[F.lit(x).cast("long") for x in crc_table()])
    code = F.hex(data.cast("binary"))
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    step = lambda c, i: F.shiftright(c, 8).bitwiseXOR(F.get(table, c.bitwiseXOR(byte(i)).bitwiseAND(255).cast("int")))
    size = F.octet_length(data)
    at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(data.isNotNull(), F.aggregate(at, F.lit(0xFFFFFFFF).cast("long"), step).bitwiseXOR(F.lit(0xFFFFFFFF).cast("long")))
