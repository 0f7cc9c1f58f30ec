import hashlib
import math
import random
import struct

from pyspark.sql import functions as F

from martingrid.functions import codec, ieee


def test_bits_of_all_kinds_of_doubles(spark):
    rng = random.Random(4)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [s * v for s in (1, -1) for e in range(-1074, 1024) for v in (math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0.0), math.nextafter(math.ldexp(1.0, e), math.inf))]
    values += [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, None]
    values = [v for v in values if v is None or not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", ieee.double_bits(F.col("x")).alias("b"), ieee.little_endian(ieee.double_bits(F.col("x"))).alias("h")).collect()
    assert len(rows) == len(values)
    for v, r in zip(values, rows, strict=True):
        assert (r.b, r.h) == ((None, None) if v is None else (struct.unpack("<q", struct.pack("<d", v))[0], struct.pack("<d", v).hex().upper()))
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(ieee.double_bits(F.col("x"))).first()[0]
    assert math.isnan(struct.unpack("<d", struct.pack("<q", nan))[0])


def test_checksums_are_those_of_the_packed_bytes(spark):
    rows = [(2048, 10.5, 3.25e5, 0.0, 99.0), (1, -0.0, 0.0, 5e-324, 1e308), (7, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    got = [r.checksum for r in codec.with_checksum(spark.createDataFrame(rows, "n long, mean double, m2 double, min double, max double")).collect()]
    assert got == [None if None in r else hashlib.sha256(codec.aggregate_payload(*r)).hexdigest() for r in rows]


def test_checksums_form_no_lambdas_and_each_double_once(spark):
    """Lambdas are interpreted: a digest took about 100 us that way."""
    plan = codec.with_checksum(spark.range(3).selectExpr("id as n", "1D as mean", "id / 7 as m2", "0D as min", "id * 1D as max"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "transform(" not in plan and plan.count("doubleToLongBits") <= 4
