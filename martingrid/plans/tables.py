"""Validation and gate operators bound to table rows, with their DuckDB SQL."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martingrid.functions import codec, heston, ieee, parse
from martingrid.operators import gate, manifests, scan, validation
from martingrid.sources import documents, records, shared
from martingrid.streaming import arrivals

RUN = {"run_hash": "run", "layout_hash": "layout", "build": "build", "incarnation": 2, "rng_version": 2, "stats_schema": 1}
#: A block for each order key; the last fiftieth of them is outside the universe.
UNIVERSE = "(max(o_orderkey) + 1) * 49 DIV 50"
UNIVERSE_SQL = "(SELECT (max(o_orderkey) + 1) * 49 // 50 FROM orders)"
#: The same text is read by Spark and by DuckDB: results, with faults and nulls of every kind, made from order keys.
RESULTS = """SELECT o_orderkey AS result_id, o_orderkey AS block_id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'x' WHEN o_orderkey % 71 = 0 THEN NULL ELSE 'run' END AS run_hash, CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE 'layout' END AS layout_hash,
  CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE 'build' END AS build, CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 2 END AS incarnation,
  CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 2 END AS rng_version, CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 1 END AS stats_schema,
  o_orderkey * 100 + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS start_scenario, o_orderkey * 100 + 100 AS end_scenario,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE 100 - CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END END AS n, o_totalprice AS mean, CASE WHEN o_orderkey % 59 = 0 THEN -1.0 ELSE 1.0 END AS m2,
  o_totalprice - 1 AS min, o_totalprice + CASE WHEN o_orderkey % 61 = 0 THEN -2 ELSE 1 END AS max,
  CASE WHEN o_orderkey % 43 = 0 THEN 'bad' WHEN o_orderkey % 73 = 0 THEN NULL ELSE 'right' END AS checksum, 'bad' AS computed_checksum,
  CASE WHEN o_orderkey % 47 = 0 THEN 0 WHEN o_orderkey % 79 = 0 THEN NULL ELSE 1 END AS lease_epoch FROM orders"""


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digested(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    """The results of ``only`` some orders, or all, with the digest of their statistics, which is their checksum where the text says that it is right."""
    rows = spark.sql(RESULTS.replace("FROM orders", "FROM {orders}"), orders=_rows(spark, sf_dir, "orders").where(only))
    return codec.with_checksum(rows, "digest").withColumn("checksum", F.when(F.col("checksum") == "right", F.col("digest")).otherwise(F.col("checksum")))


def _results(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    return _digested(spark, sf_dir, only).drop("digest")


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _rows(spark, sf_dir, "orders").selectExpr(UNIVERSE).first()[0] or 0
    return spark.range(n).selectExpr("id AS block_id", "id * 100 AS start_scenario", "id * 100 + 100 AS end_scenario", "1 AS lease_epoch")


def f7_validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh block is committed, every fifty-third of those with another digest; a column that poses as the computed digest is not trusted."""
    universe, results = _universe(spark, sf_dir), _results(spark, sf_dir)
    done = codec.with_checksum(results.where("block_id % 7 = 0")).selectExpr("block_id", "if(block_id % 53 = 0, 'other', checksum) AS checksum")
    return validation.validate_results(results, universe, done, RUN).select("result_id", "block_id", "status", "code", "benign")


def _delivered(spark: SparkSession, sf_dir: str, arrival: Column) -> DataFrame:
    """Each result at its arrivals: some with other statistics, an old lease or another digest than before; both digests are formed ahead of them."""
    d = F.col("result_id") + F.col("arrival")
    plain = _digested(spark, sf_dir).withColumn("_max", F.col("max")).withColumn("max", F.col("_max") + 1.0)
    sent = codec.with_checksum(plain, "_moved").select("*", arrival.alias("arrival"))
    digest = F.when(d % 5 == 0, F.col("_moved")).otherwise(F.col("digest"))
    right = F.when(d % 11 == 0, "bad").when(F.col("checksum").isNull() | (F.col("checksum") == "bad"), F.col("checksum")).otherwise(digest)
    made = {"checksum": right, "max": F.when(d % 5 == 0, F.col("max")).otherwise(F.col("_max")), "lease_epoch": F.when(d % 4 == 1, 0).otherwise(F.col("lease_epoch"))}
    return sent.withColumns(made).drop("digest", "_moved", "_max")


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result four times."""
    return _delivered(spark, sf_dir, F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])))


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every seventh block has contributed: its result, or for some another digest."""
    return codec.with_checksum(_results(spark, sf_dir, "o_orderkey % 7 = 0")).selectExpr("block_id", "if(block_id % 53 = 0, 'other', checksum) AS checksum").where("checksum is not null")


def f7_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = validation.judge_arrivals(_deliveries(spark, sf_dir), _universe(spark, sf_dir), _committed(spark, sf_dir), RUN)
    return judged.select("result_id", "arrival", "status", "code", "benign")


def e7_result_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deliveries as a stream of files, one delivery after another, three files a micro-batch."""
    folder = f"{shared.shared_root(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(4):
        sent = _delivered(spark, sf_dir, F.lit(k).cast("long"))
        sent.repartition(4, "block_id").write.mode("append").parquet(f"{folder}/sent")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/sent")
    judged = arrivals.judge_stream(stream, _universe(spark, sf_dir), _committed(spark, sf_dir), RUN, columns=["result_id", "arrival"])
    return arrivals.run_to_end(judged, folder).select("result_id", "arrival", "status", "code", "benign")


def f4_invariant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = validation.invariant_error(F.lit(100), *[F.col(c) for c in ("n", "mean", "m2", "min", "max")])
    return _results(spark, sf_dir).select("result_id", wrong.alias("reason"))


def j3_missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _rows(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS block_id")
    return validation.missing_blocks(_universe(spark, sf_dir), done).select("block_id")


def j5_orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _universe(spark, sf_dir).where("block_id % 3 = 0").selectExpr("block_id", "2 AS incarnation", "1 AS lease_epoch")
    return validation.orphan_results(_results(spark, sf_dir), manifest).select("result_id", "block_id")


def f6_universe_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _rows(spark, sf_dir, "orders").where("o_orderkey % 89 <> 5").selectExpr(
        "o_orderkey AS block_id", "o_orderkey * 100 + if(o_orderkey % 101 = 1, 5, 0) AS start_scenario", "o_orderkey * 100 + 100 + if(o_orderkey % 97 = 1, 3, 0) AS end_scenario"
    )
    return validation.universe_gaps(blocks)


def f6_universe_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are shifted, ranges moved, incarnations and leases wrong for some orders; the last block ends where the scenarios do."""
    orders = _rows(spark, sf_dir, "orders")
    blocks = orders.selectExpr(
        "if(o_orderkey % 83 = 4, o_orderkey + 1, o_orderkey) AS block_id", "o_orderkey * 100 + if(o_orderkey % 101 = 1, 5, 0) AS start_scenario",
        "o_orderkey * 100 + 100 + if(o_orderkey % 97 = 1, 3, 0) AS end_scenario", "if(o_orderkey % 103 = 2, 9, 2) AS incarnation", "if(o_orderkey % 107 = 3, 0, 1) AS lease_epoch",
    )
    n = orders.agg(F.max("o_orderkey")).first()[0] + 1
    return validation.universe_problems(blocks, n * 100, 100)


def f1_spec_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "part").selectExpr(
        "p_partkey", "if(p_size % 17 = 0, 0, p_size) AS scenarios", "if(p_size % 13 = 0, 0, 1) AS steps", "if(p_size = 50, double('NaN'), 1D) AS maturity", "if(p_partkey % 19 = 0, -1D, 100D) AS spot", "100D AS strike",
        "if(p_partkey % 23 = 0, double('Infinity'), 0.05D) AS rate", "if(p_partkey % 29 = 0, null, 0.2D) AS volatility", "if(p_partkey % 31 = 0, 'put', 'asian_call') AS payoff", "p_partkey % 2 = 0 AS antithetic",
        "CASE WHEN p_partkey % 37 = 0 THEN 'cev' WHEN p_partkey % 3 = 0 THEN 'heston' ELSE 'gbm' END AS model", "if(p_partkey % 41 = 0, 3, 2) AS block_size", "if(p_partkey % 43 = 0, -0.01D, 0.04D) AS initial_variance", "1.5D AS reversion",
        "if(p_partkey % 47 = 0, double('NaN'), 0.04D) AS long_variance", "0.3D AS variance_volatility", "if(p_partkey % 53 = 0, 1.5D, -0.7D) AS correlation",
    )
    return rows.select("p_partkey", validation.spec_problem(rows).alias("problem"))


def x7_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return _rows(spark, sf_dir, "orders").select("o_orderkey", codec.crc32c(key).alias("crc"))


#: Texts that are numbers, and texts that nearly are, by order key.
TEXTS = """CASE o_orderkey % 12 WHEN 9 THEN concat(o_orderkey, chr(10)) WHEN 10 THEN concat(o_orderkey, '.5', chr(13)) WHEN 11 THEN concat(chr(10), o_orderkey) WHEN 0 THEN concat(' ', o_orderkey) WHEN 1 THEN concat('+', o_orderkey) WHEN 2 THEN concat(o_orderkey, 'x') WHEN 3 THEN concat('1844674407370955', o_orderkey % 10000)
  WHEN 4 THEN concat(o_orderkey, '.25e2') WHEN 5 THEN concat('-', o_orderkey, '.5') WHEN 6 THEN '1e999' WHEN 7 THEN '' ELSE concat('', o_orderkey) END"""


def x11_strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "orders").select("o_orderkey", F.expr(TEXTS).alias("t"))
    return rows.select("o_orderkey", parse.parse_u64(F.col("t")).alias("whole"), F.round(parse.parse_finite(F.col("t")), 6).alias("number"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of runs a day: events of even ids are the control, the others the treatment."""
    events = _rows(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("day"), (F.col("event_id") % 2).alias("odd"), "value")
    rates = events.groupBy("day", "odd").agg(F.avg("value").alias("rate"))
    control, treatment = (rates.where(F.col("odd") == k).select("day", F.col("rate").alias(n)) for k, n in ((0, "control"), (1, "treatment")))
    return control.join(treatment, "day")


def j7_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("day", F.round("control", 7).alias("control"), F.round("treatment", 7).alias("treatment"))


def x15_throughput_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("day", F.round(gate.throughput_loss(F.col("control"), F.col("treatment")), 7).alias("loss"))


SAMPLES = 1_000


def a18_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _paired(spark, sf_dir).select(F.lit("all").alias("gate"), F.col("day").alias("pair"), "control", "treatment", (F.col("day") % 2 == 0).alias("control_first"))
    made = gate.decide(pairs, "gate", gate.Policy(samples=SAMPLES))
    return made.select(*[F.round(c, 7).alias(c) if t == "double" else c for c, t in made.dtypes])


def o2_canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the order keys that lines of each flag name; a run is canonical if it names each key once."""
    lines = _rows(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 3")
    return scan.intervals(lines, "l_orderkey", ["l_returnflag"]).withColumn("canonical", F.col("ids") == F.col("rows"))


#: Block ids of a run in the coverage query.
RUN_BLOCKS = 16


def u1_covered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered and computed blocks of each run against its universe: orders in process count as both, and every 89th was lost."""
    orders = _rows(spark, sf_dir, "orders").where("o_orderkey % 89 <> 5").selectExpr(f"o_orderkey div {RUN_BLOCKS} AS run", "o_orderkey AS block_id", "o_orderstatus")
    parts = [scan.intervals(orders.where(f"o_orderstatus IN {kinds}"), "block_id", ["run"]) for kinds in ("('F', 'P')", "('O', 'P')")]
    n = _rows(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    runs = spark.range(0 if n is None else n // RUN_BLOCKS + 1).selectExpr("id AS run", f"id * {RUN_BLOCKS} AS first", f"id * {RUN_BLOCKS} + {RUN_BLOCKS - 1} AS last")
    return scan.exactly_once(parts[0].unionByName(parts[1]), runs, ["run"])


def u2_uncommitted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of order keys, of all that there can be, that no finished order has."""
    orders = _rows(spark, sf_dir, "orders")
    done = scan.intervals(orders.where("o_orderstatus = 'F'"), "o_orderkey")
    whole = orders.agg(F.lit(0).cast("long").alias("first"), (F.max("o_orderkey") + 100).alias("last"))
    return scan.difference(whole, done)


def w6_commits_since_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are commits, a purchase starts a new checkpoint: commits since the last one, and whether another is due."""
    found = scan.since_reset(_rows(spark, sf_dir, "events"), "event_id", F.lit(1), F.col("event_type") == "purchase")
    return found.select("event_id", "since", F.col("resets").alias("checkpoint"), (F.col("since") >= CHECKPOINT_EVERY).alias("due"))


#: Commits after which a checkpoint is due.
CHECKPOINT_EVERY = 8


def k1_json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "if(p_size % 7 = 0, null, p_size / 8D) AS ratio", "p_partkey % 2 = 0 AS even")
    return documents.json_result(rows).select(F.get_json_object("document", "$.p_partkey").cast("long").alias("p_partkey"), "document")


def m15_heston_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of strikes, maturities and correlations by part, against the bounds of a call; price and error as they come."""
    rows = _rows(spark, sf_dir, "part").selectExpr(
        "p_partkey", "100D AS spot", "60D + p_partkey % 81 AS strike", "0.03D AS rate", "(1 + p_size % 10) / 4D AS maturity", "0.04D AS initial_variance", "1.5D AS reversion",
        "0.04D AS long_variance", "(p_partkey % 7) / 10D AS variance_volatility", "(p_partkey % 9 - 4) / 5D AS correlation",
    )
    return heston.heston_calls(rows).select("p_partkey", F.round("price", 8).alias("price"), "error")


def _line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the lines of each order, from exact sums of whole quantities, and the digest of their 48 bytes."""
    q = F.col("l_quantity").cast("long")
    sums = _rows(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(q).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("ss"), F.min(q).cast("double").alias("min"), F.max(q).cast("double").alias("max"))
    stats = sums.select("l_orderkey", "n", (F.col("s") / F.col("n")).alias("mean"), ((F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / F.col("n")).alias("m2"), "min", "max")
    return codec.with_checksum(stats)


def x8_result_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_stats(spark, sf_dir).select("l_orderkey", "n", "checksum")


def k8_block_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each order written as binary records and read back, some columns only."""
    zero = F.lit("00" * 32)
    numbers = {"start_scenario": F.col("block_id") * 8, "end_scenario": F.col("block_id") * 8 + F.col("n"), "incarnation": F.lit(1), "lease_epoch": F.lit(1), "rng_version": F.lit(codec.RNG), "stats_schema": F.lit(codec.STATS), "worker_id": F.lit(0)}
    rows = _line_stats(spark, sf_dir).withColumnRenamed("l_orderkey", "block_id")
    rows = rows.withColumns({k: v.cast("long") for k, v in numbers.items()} | {k: zero for k in ("run_id", "run_hash", "layout_hash", "build")})
    records.register(spark)
    path = f"{shared.shared_root(spark)}/records-{uuid.uuid4().hex}"
    rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in records.BlockRecords({}).schema().split(", ")]).write.format("block_records").mode("append").save(path)
    found = spark.read.format("block_records").option("columns", "block_id,end_scenario,n,min,max,checksum").load(path)
    return found.select("block_id", "end_scenario", "n", "min", "max", "checksum")


def m17_feller_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _rows(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 10.0D AS kappa", "(p_partkey % 20) / 200.0D AS theta", "(p_partkey % 11) / 10.0D AS xi")
    ratio = validation.feller_ratio(*[F.col(c) for c in ("kappa", "theta", "xi")])
    return grid.select("p_partkey", ratio.alias("r")).select("p_partkey", F.when(F.col("r") == float("inf"), None).otherwise(F.round("r", 9)).alias("ratio"), (F.col("r") < 1 - 1e-12).alias("warned"))


def m16_scaled_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of parameters near the ends of the range, scaled back: plain steps overflow to infinity or lose all digits."""
    x = F.col("x")
    rows = _rows(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size as double) AS size", "cast(p_retailprice as double) AS price", "cast(p_partkey % 7 + 1 as double) AS x")
    large = validation.feller_ratio(F.col("size") * 1e300, F.col("price") * 1e-300, x * 1e-10)
    small = validation.feller_ratio(F.col("size") * 1e-300, F.col("price") * 1e300, x * 1e150)
    return rows.select("p_partkey", F.round(large / 1e20, 5).alias("large"), F.round(small * 1e300, 5).alias("small"))


def a11_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.nearest_rank(_rows(spark, sf_dir, "events"), "event_type", "value")


def a13_linear_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = gate.linear_quantiles(_rows(spark, sf_dir, "events"), "event_type", "value")
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75", "iqr")])


def a14_median_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gate.median_deviation(_rows(spark, sf_dir, "events"), "event_type", "value")
    return m.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "mad")])


def a16_theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rows(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("run")).agg(F.avg("value").alias("rate"))
    return gate.theil_sen(rates, "run", "rate").select("pairs", F.round("slope", 9).alias("slope"), F.round("drift_pct", 7).alias("drift_pct"))


def j8_median_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift of all customers' balances along their keys: every pair of customers counts."""
    return gate.theil_sen(_rows(spark, sf_dir, "customer"), "c_custkey", "c_acctbal").select("pairs", F.round("slope", 9).alias("slope"), F.round("drift_pct", 6).alias("drift_pct"))


def a17_order_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _rows(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 2 == 0).alias("first"), "value")
    return gate.order_effect(pairs, "event_type", "first", "value").select("event_type", F.round("effect", 6).alias("effect"))


def x16_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _rows(spark, sf_dir, "customer").groupBy("c_mktsegment", (F.col("c_nationkey") + 1).alias("workers")).agg(F.max("c_acctbal").alias("rate"))
    return gate.speedup(runs, "c_mktsegment", "workers", "rate").select("c_mktsegment", "workers", *[F.round(c, 9).alias(c) for c in ("speedup", "efficiency")])


#: A manifest for each order, in its customer's run, and its lines as entries; the same text is read by Spark and by DuckDB.
HEADS = "SELECT o_custkey AS run, o_orderkey AS sequence, 1 AS schema, 2 + o_orderkey % 3 AS incarnation, 90 AS block_count, o_orderkey FROM orders"
ENTRIES = """SELECT run, sequence, l_linenumber - 1 AS place, l_linenumber * 10 + l_suppkey % 13 AS block_id, CASE WHEN l_partkey % 61 = 0 THEN incarnation + 1 ELSE incarnation - l_partkey % 2 END AS result_incarnation,
  CASE WHEN l_partkey % 67 = 0 THEN 5 WHEN l_partkey % 71 = 0 THEN NULL WHEN l_partkey % 2 = 1 THEN 2 ELSE 4 END AS lease_epoch, 4 AS high_water FROM heads JOIN lineitem ON l_orderkey = o_orderkey"""


def o1_latest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest manifest of each run whose entries are canonical; every 29th head says one entry more than it has."""
    orders, lines = _rows(spark, sf_dir, "orders"), _rows(spark, sf_dir, "lineitem")
    heads = spark.sql(HEADS.replace("FROM orders", "FROM {orders}"), orders=orders)
    entries = spark.sql(ENTRIES.replace("FROM heads JOIN lineitem", "FROM {heads} JOIN {lines}"), heads=heads, lines=lines)
    counted = entries.groupBy("run", "sequence").agg(F.count("*").alias("n"))
    heads = heads.join(counted, ["run", "sequence"], "left").withColumn("committed", F.coalesce("n", F.lit(0)) + F.expr("if(sequence % 29 = 0, 1, 0)")).drop("n", "o_orderkey")
    return manifests.latest_valid_manifests(heads, entries)


#: Doubles of either sign, of all sizes down to the smallest ones, by order.
DOUBLES = """CASE o_orderkey % 8 WHEN 0 THEN 0.0 WHEN 1 THEN o_totalprice WHEN 2 THEN -o_totalprice WHEN 3 THEN o_totalprice / 3 WHEN 4 THEN -o_totalprice * 1e-320
  WHEN 5 THEN o_totalprice * 1e302 WHEN 6 THEN o_orderkey * 1.0 ELSE o_totalprice * 1e-312 END"""


def x6_payload_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits of doubles, and the digest of their bytes."""
    rows = _rows(spark, sf_dir, "orders").select("o_orderkey", F.expr(DOUBLES).cast("double").alias("x"))
    bits = rows.select("o_orderkey", ieee.double_bits(F.col("x")).alias("bits"))
    return bits.select("*", F.sha2(F.unhex(ieee.little_endian(F.col("bits"))), 256).alias("digest"))


QUERIES = (
    f7_validate_results, f7_arrivals, e7_result_stream, f4_invariant_check, j3_missing_blocks, j5_orphan_results, f6_universe_gaps, m17_feller_warnings, m16_scaled_ratios, a11_latency_percentiles, a13_linear_quantiles,
    a14_median_deviation, a16_theil_sen, j8_median_slope, a17_order_effect, x16_speedup, o1_latest_manifest, x6_payload_sha256, f6_universe_problems, f1_spec_check, x7_crc32c, x11_strict_parse,
    j7_paired_runs, x15_throughput_loss, a18_gate_decision, o2_canonical_ids, u1_covered_once, u2_uncommitted_ranges, w6_commits_since_checkpoint, k1_json_result, m15_heston_prices, x8_result_checksums, k8_block_records,
)



def _crc_step(n: int) -> str:
    """A table entry: n halvings, each with the polynomial where the last bit is set."""
    return f"list_reduce(list_prepend(c0::BIGINT, range({n})), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, {codec.CASTAGNOLI}) ELSE x >> 1 END)"


def _gate_sql() -> str:
    """The bootstrap's generator in 128-bit numbers; no output falls below 2^64 mod the number of pairs in these tables."""
    p = gate.Policy()
    big = lambda x: f"{x}::UHUGEINT"
    mix = lambda x, shift, by: f"((xor({x}, {x} >> {shift}) * {big(by)}) % {big(1 << 64)})"
    return f"""WITH e AS (SELECT *, dayofmonth(ts) AS day FROM events),
      r AS (SELECT day, avg(value) FILTER (event_id % 2 = 0) AS control, avg(value) FILTER (event_id % 2 = 1) AS treatment FROM e GROUP BY day HAVING control IS NOT NULL AND treatment IS NOT NULL),
      l AS (SELECT *, 100 * (1 - treatment / control) AS loss, day % 2 = 0 AS first, row_number() OVER (ORDER BY day) - 1 AS place FROM r),
      s AS (SELECT count(*) AS pairs, median(loss) AS median_loss, quantile_cont(loss, 0.25) AS q25, quantile_cont(loss, 0.75) AS q75, mad(loss) AS mad, median(loss) FILTER (first) - median(loss) FILTER (NOT first) AS order_effect, median(control) AS middle FROM l),
      g AS (SELECT k, ({big(p.seed)} + (k + 1)::UHUGEINT * {big(0x9E3779B97F4A7C15)} % {big(1 << 64)}) % {big(1 << 64)} AS x FROM s, range({SAMPLES} * pairs) t(k)),
      g1 AS (SELECT k, {mix('x', 30, 0xBF58476D1CE4E5B9)} AS x FROM g), g2 AS (SELECT k, {mix('x', 27, 0x94D049BB133111EB)} AS x FROM g1),
      d AS (SELECT k // pairs AS sample, (xor(x, x >> 31) % pairs::UHUGEINT)::BIGINT AS place FROM g2, s),
      b AS (SELECT sample, median(loss) AS m FROM d JOIN l USING (place) GROUP BY sample), c AS (SELECT quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM b),
      t AS (SELECT 100 * median((y.control - x.control) / (y.place - x.place)) AS slope FROM l x JOIN l y ON x.place < y.place),
      a AS (SELECT *, slope * (pairs - 1) / middle AS drift_pct FROM s, c, t)
      SELECT 'all' AS gate, pairs, {', '.join(f'round({x}, 7) AS {x}' for x in ('median_loss', 'q25', 'q75', 'mad', 'ci_low', 'ci_high', 'drift_pct', 'order_effect'))}, round(q75 - q25, 7) AS iqr, NULL::VARCHAR AS problem,
        pairs >= {p.minimum_pairs} AS enough, ci_high < {p.maximum_loss} AS loss_ok, abs(drift_pct) <= {p.maximum_drift} AS drift_ok, abs(order_effect) <= {p.maximum_order_effect} AS order_ok,
        pairs >= {p.minimum_pairs} AND ci_high < {p.maximum_loss} AND abs(drift_pct) <= {p.maximum_drift} AND abs(order_effect) <= {p.maximum_order_effect} AS passed FROM a"""


def _bits_sql(x: str) -> str:
    """Bits of a finite double: multiples of the smallest number, or exponent and fraction."""
    a, e = f"abs({x})", f"greatest(floor(log2(abs({x}))), -1022)"
    e = f"({e} + CASE WHEN {a} / pow(2, {e}) >= 2 THEN 1 WHEN {a} / pow(2, {e}) < 1 THEN -1 ELSE 0 END)"
    size = f"CASE WHEN {a} < pow(2::DOUBLE, -1022) THEN ({a} * pow(2::DOUBLE, 537) * pow(2::DOUBLE, 537))::BIGINT ELSE ({e} + 1023)::BIGINT * {1 << 52} + (({a} / pow(2, {e}) - 1) * {1 << 52})::BIGINT END"
    return f"(({size})::HUGEINT - CASE WHEN {x} < 0 THEN 9223372036854775808::HUGEINT ELSE 0 END)::BIGINT"


def _le_sql(bits: str) -> str:
    """Its eight bytes, the lowest first, as hexadecimal digits."""
    byte = lambda i: f"printf('%02x', ({bits} >> {8 * i}) & 255)"
    return "(" + " || ".join(byte(i) for i in range(8)) + ")"


_X8 = f"""SELECT l_orderkey, n, sha256(unhex('{struct.pack("<II", 1, codec.STATS).hex()}' || {' || '.join(_le_sql(c) for c in ('n', 'b1', 'b2', 'b3', 'b4'))})) AS checksum FROM (SELECT l_orderkey, n, {', '.join(f"{_bits_sql(c)} AS b{i}" for i, c in enumerate(('mean', 'm2', 'low', 'high'), 1))}
      FROM (SELECT l_orderkey, n, s::DOUBLE / n AS mean, (n * ss - s * s)::DOUBLE / n AS m2, low, high FROM (SELECT l_orderkey, count(q) AS n, sum(q)::BIGINT AS s, sum(q * q)::BIGINT AS ss, min(q)::DOUBLE AS low, max(q)::DOUBLE AS high FROM (SELECT l_orderkey, l_quantity::BIGINT AS q FROM lineitem) GROUP BY l_orderkey)))"""
_INVARIANT = "CASE WHEN n IS DISTINCT FROM 100 THEN 'count' WHEN m2 < 0 THEN 'm2' WHEN min > max THEN 'range' WHEN mean < min OR mean > max THEN 'mean' END"
_WRONG = _INVARIANT
#: Deliveries; their digests are told apart by the statistics that they are formed from, and from the committed ones.
_ARRIVALS = f"""WITH d AS (SELECT * EXCLUDE (max, lease_epoch, checksum), max + CASE WHEN (result_id + arrival) % 5 = 0 THEN 1 ELSE 0 END AS max, CASE WHEN (result_id + arrival) % 4 = 1 THEN 0 ELSE lease_epoch END AS lease_epoch,
        CASE WHEN (result_id + arrival) % 11 = 0 THEN 'bad' ELSE checksum END AS checksum, (result_id + arrival) % 5 = 0 AS variant FROM ({RESULTS}) r, range(4) t(arrival)),
      s AS (SELECT *, CASE WHEN run_hash IS DISTINCT FROM 'run' THEN 'InvalidRun' WHEN layout_hash <> 'layout' THEN 'ExecutionLayoutMismatch' WHEN build <> 'build' THEN 'BuildMismatch'
        WHEN incarnation <> 2 THEN 'StaleIncarnation' WHEN rng_version <> 2 THEN 'RngVersionMismatch' WHEN stats_schema <> 1 THEN 'StatsSchemaMismatch'
        WHEN block_id >= {UNIVERSE_SQL} OR start_scenario <> block_id * 100 THEN 'InvalidBlock' WHEN ({_WRONG}) IS NOT NULL THEN 'InvalidAggregate'
        WHEN checksum IS DISTINCT FROM 'right' THEN 'CorruptPayload' WHEN lease_epoch IS DISTINCT FROM 1 THEN 'StaleLease' ELSE 'Accepted' END AS alone FROM d),
      w AS (SELECT *, CASE WHEN block_id % 7 = 0 AND n IS NOT NULL THEN CASE WHEN block_id % 53 = 0 THEN 'other' ELSE 'false' END
        ELSE first_value(CASE WHEN alone = 'Accepted' THEN variant::VARCHAR END IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS done FROM s)
      SELECT result_id, arrival, status, list_position({list(validation.STATUS_CODES)}, status) - 1 AS code, status IN ('Duplicate', 'StaleIncarnation', 'StaleLease') AS benign FROM (SELECT *,
        CASE WHEN alone NOT IN ('Accepted', 'StaleLease') OR done IS NULL THEN alone WHEN done = variant::VARCHAR THEN 'Duplicate' ELSE 'DeterminismError' END AS status FROM w)"""
ORACLES = {
    "f7_arrivals": _ARRIVALS,
    "e7_result_stream": _ARRIVALS,
    "f7_validate_results": f"""SELECT result_id, block_id, status, list_position({list(validation.STATUS_CODES)}, status) - 1 AS code, status IN ('Duplicate', 'StaleIncarnation', 'StaleLease') AS benign FROM (SELECT *, CASE
      WHEN run_hash IS DISTINCT FROM 'run' THEN 'InvalidRun' WHEN layout_hash <> 'layout' THEN 'ExecutionLayoutMismatch' WHEN build <> 'build' THEN 'BuildMismatch'
      WHEN incarnation <> 2 THEN 'StaleIncarnation' WHEN rng_version <> 2 THEN 'RngVersionMismatch' WHEN stats_schema <> 1 THEN 'StatsSchemaMismatch'
      WHEN block_id >= {UNIVERSE_SQL} OR start_scenario <> block_id * 100 THEN 'InvalidBlock' WHEN ({_WRONG}) IS NOT NULL THEN 'InvalidAggregate'
      WHEN checksum IS DISTINCT FROM 'right' THEN 'CorruptPayload' WHEN block_id % 7 = 0 AND block_id % 53 <> 0 THEN 'Duplicate' WHEN block_id % 7 = 0 THEN 'DeterminismError'
      WHEN lease_epoch IS DISTINCT FROM 1 THEN 'StaleLease' ELSE 'Accepted' END AS status FROM ({RESULTS}) r)""",
    "f4_invariant_check": f"SELECT result_id, {_INVARIANT} AS reason FROM ({RESULTS})",
    "j3_missing_blocks": f"SELECT o_orderkey AS block_id FROM orders WHERE o_orderkey < {UNIVERSE_SQL} AND o_orderstatus <> 'F'",
    "j5_orphan_results": f"SELECT result_id, block_id FROM ({RESULTS}) WHERE NOT (block_id % 3 = 0 AND block_id < {UNIVERSE_SQL} AND incarnation = 2 AND coalesce(lease_epoch, 0) = 1)",
    "f6_universe_gaps": """WITH b AS (SELECT o_orderkey AS block_id, o_orderkey * 100 + CASE WHEN o_orderkey % 101 = 1 THEN 5 ELSE 0 END AS start_scenario,
      o_orderkey * 100 + 100 + CASE WHEN o_orderkey % 97 = 1 THEN 3 ELSE 0 END AS end_scenario FROM orders WHERE o_orderkey % 89 <> 5)
      SELECT * FROM (SELECT a.block_id, a.end_scenario, n.start_scenario AS next_start, CASE WHEN n.start_scenario > a.end_scenario THEN 'gap' WHEN n.start_scenario < a.end_scenario THEN 'overlap'
        WHEN n.block_id IS NULL AND a.block_id < (SELECT max(block_id) FROM b) THEN 'hole' END AS problem FROM b a LEFT JOIN b n ON n.block_id = a.block_id + 1) WHERE problem IS NOT NULL""",
    "f6_universe_problems": """SELECT * FROM (SELECT CASE WHEN o_orderkey % 83 = 4 THEN o_orderkey + 1 ELSE o_orderkey END AS block_id, CASE WHEN o_orderkey % 83 = 4 OR o_orderkey % 101 = 1 OR o_orderkey % 97 = 1 THEN 'range' WHEN o_orderkey % 103 = 2 THEN 'incarnation' WHEN o_orderkey % 107 = 3 THEN 'lease' END AS problem FROM orders) WHERE problem IS NOT NULL
      UNION ALL SELECT o_orderkey + 1, 'repeated' FROM orders WHERE o_orderkey % 83 = 4 AND o_orderkey < (SELECT max(o_orderkey) FROM orders)
      UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey % 83 = 4""",
    "f1_spec_check": f"""SELECT p_partkey, CASE WHEN p_size % 17 = 0 THEN 'scenarios' WHEN p_size % 13 = 0 THEN 'steps' WHEN p_size = 50 THEN 'maturity' WHEN p_partkey % 19 = 0 THEN 'spot' WHEN p_partkey % 23 = 0 THEN 'rate'
      WHEN p_partkey % 37 = 0 THEN 'model' WHEN p_partkey % 3 <> 0 AND p_partkey % 29 = 0 THEN 'volatility' WHEN p_partkey % 3 = 0 AND (p_partkey % 43 = 0 OR p_partkey % 47 = 0) THEN 'variance' WHEN p_partkey % 3 = 0 AND p_partkey % 53 = 0 THEN 'correlation' WHEN p_partkey % 31 = 0 THEN 'payoff' WHEN p_partkey % 2 = 0 AND (p_size % 2 = 1 OR p_partkey % 41 = 0) THEN 'pairs' END AS problem FROM part""",
    "x7_crc32c": f"""WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, {_crc_step(8)} AS c FROM (SELECT i, i AS c0 FROM range(256) r(i))))
      SELECT o_orderkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda j: ascii(substr(k, j, 1))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc
      FROM (SELECT o_orderkey, concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority) AS k FROM orders), t""",
    "x11_strict_parse": f"""SELECT o_orderkey, CASE WHEN regexp_matches(t, '{parse.U64}') THEN CASE WHEN t::UHUGEINT < 18446744073709551616::UHUGEINT THEN t::DECIMAL(20,0) END END AS whole,
      CASE WHEN regexp_matches(t, '{parse.DOUBLE}') THEN CASE WHEN isfinite(try_cast(t AS DOUBLE)) THEN round(try_cast(t AS DOUBLE), 6) END END AS number
      FROM (SELECT o_orderkey, {TEXTS} AS t FROM orders)""",
    "x15_throughput_loss": "SELECT day, round(100 * (1 - treatment / control), 7) AS loss FROM (SELECT day, avg(value) FILTER (event_id % 2 = 0) AS control, avg(value) FILTER (event_id % 2 = 1) AS treatment FROM (SELECT *, dayofmonth(ts) AS day FROM events) GROUP BY day) WHERE control > 0 AND treatment > 0",
    "a18_gate_decision": _gate_sql(),
    "j7_paired_runs": "SELECT day, round(avg(value) FILTER (event_id % 2 = 0), 7) AS control, round(avg(value) FILTER (event_id % 2 = 1), 7) AS treatment FROM (SELECT *, dayofmonth(ts) AS day FROM events) GROUP BY day HAVING control IS NOT NULL AND treatment IS NOT NULL",
    "o2_canonical_ids": """WITH k AS (SELECT l_returnflag, l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 3 GROUP BY ALL), r AS (SELECT *, id - row_number() OVER (PARTITION BY l_returnflag ORDER BY id) AS run FROM k)
      SELECT l_returnflag, min(id) AS first, max(id) AS last, count(*) AS ids, sum(n)::BIGINT AS rows, count(*) = sum(n) AS canonical FROM r GROUP BY l_returnflag, run""",
    "u1_covered_once": f"""WITH u AS (SELECT r // {RUN_BLOCKS} AS run, r AS id FROM range(((SELECT max(o_orderkey) FROM orders) // {RUN_BLOCKS} + 1) * {RUN_BLOCKS}) t(r)),
      p AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS n FROM orders WHERE o_orderkey % 89 <> 5)
      SELECT run, coalesce(sum(n), 0)::BIGINT AS blocks, count(*) FILTER (n IS NULL) AS missing, 0::BIGINT AS outside, coalesce(sum(n - 1), 0)::BIGINT AS repeated, count(*) FILTER (n IS NULL) = 0 AND coalesce(sum(n - 1), 0) = 0 AS covered FROM u LEFT JOIN p USING (id) GROUP BY run""",
    "u2_uncommitted_ranges": """WITH u AS (SELECT r AS id FROM range((SELECT max(o_orderkey) + 101 FROM orders)) t(r)), m AS (SELECT id, id - row_number() OVER (ORDER BY id) AS run FROM u ANTI JOIN (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F') USING (id))
      SELECT min(id) AS first, max(id) AS last FROM m GROUP BY run""",
    "w6_commits_since_checkpoint": f"""SELECT event_id, since, checkpoint, since >= {CHECKPOINT_EVERY} AS due FROM (SELECT event_id, checkpoint, row_number() OVER (PARTITION BY checkpoint ORDER BY event_id) AS since
      FROM (SELECT event_id, sum((event_type = 'purchase')::INTEGER) OVER (ORDER BY event_id)::BIGINT AS checkpoint FROM events))""",
    "k1_json_result": """SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","ratio":' || CASE WHEN p_size % 7 = 0 THEN 'null' ELSE printf('%.12f', p_size / 8.0::DOUBLE) END || ',"even":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS document FROM part""",
    "m17_feller_warnings": """SELECT p_partkey, CASE WHEN xi = 0 THEN NULL ELSE round(r, 9) END AS ratio, xi <> 0 AND r < 1 - 1e-12 AS warned FROM (SELECT *, CASE WHEN xi = 0 THEN NULL ELSE kappa / xi * 2 * (theta / xi) END AS r
      FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS kappa, (p_partkey % 20) / 200.0::DOUBLE AS theta, (p_partkey % 11) / 10.0::DOUBLE AS xi FROM part))""",
    "m16_scaled_ratios": """SELECT p_partkey, round(r, 5) AS large, round(r, 5) AS small
      FROM (SELECT p_partkey, 2 * p_size::DOUBLE * p_retailprice::DOUBLE / ((p_partkey % 7 + 1)::DOUBLE * (p_partkey % 7 + 1)) AS r FROM part)""",
    "a11_latency_percentiles": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE value <> 0 GROUP BY event_type",
    "a13_linear_quantiles": "SELECT event_type, round(a, 6) AS q25, round(b, 6) AS q50, round(c, 6) AS q75, round(c - a, 6) AS iqr FROM (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events GROUP BY event_type)",
    "a14_median_deviation": "SELECT event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM events GROUP BY event_type",
    "a16_theil_sen": """WITH r AS (SELECT user_id % 40 AS run, avg(value) AS rate FROM events GROUP BY 1), s AS (SELECT count(*) AS pairs, median((b.rate - a.rate) / (b.run - a.run)) AS slope FROM r a JOIN r b ON a.run < b.run)
      SELECT pairs, round(slope, 9) AS slope, round(slope * span / middle * 100, 7) AS drift_pct FROM s, (SELECT median(rate) AS middle, max(run) - min(run) AS span FROM r)""",
    "j8_median_slope": """WITH s AS (SELECT count(*) AS pairs, median((b.c_acctbal - a.c_acctbal) / (b.c_custkey - a.c_custkey)) AS slope FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey)
      SELECT pairs, round(slope, 9) AS slope, round(slope * span / middle * 100, 6) AS drift_pct FROM s, (SELECT median(c_acctbal) AS middle, max(c_custkey) - min(c_custkey) AS span FROM customer)""",
    "a17_order_effect": "SELECT event_type, round(median(value) FILTER (event_id % 2 = 0) - median(value) FILTER (event_id % 2 = 1), 6) AS effect FROM events GROUP BY event_type",
    "x16_speedup": """SELECT c_mktsegment, workers, round(rate / r0, 9) AS speedup, round(rate / r0 * w0 / workers, 9) AS efficiency FROM (SELECT *, first_value(rate) OVER w AS r0, first_value(workers) OVER w AS w0
      FROM (SELECT c_mktsegment, c_nationkey + 1 AS workers, max(c_acctbal) AS rate FROM customer GROUP BY ALL) WINDOW w AS (PARTITION BY c_mktsegment ORDER BY workers))""",
    "o1_latest_manifest": f"""WITH heads AS ({HEADS}), e AS ({ENTRIES}), w AS (SELECT *, lag(block_id) OVER (PARTITION BY run, sequence ORDER BY place) AS previous, lag(place) OVER (PARTITION BY run, sequence ORDER BY place) AS p0, count(*) OVER (PARTITION BY run, sequence) AS n FROM e),
      bad AS (SELECT DISTINCT run, sequence FROM w JOIN heads USING (run, sequence) WHERE place < 0 OR place >= n + CASE WHEN sequence % 29 = 0 THEN 1 ELSE 0 END OR place IS NOT DISTINCT FROM p0 OR place <> coalesce(p0 + 1, 0) OR block_id NOT BETWEEN 0 AND block_count - 1
        OR result_incarnation > incarnation OR result_incarnation < 1 OR coalesce(lease_epoch NOT BETWEEN 1 AND high_water, true) OR (result_incarnation = incarnation AND lease_epoch <> high_water) OR previous >= block_id),
      j AS (SELECT h.run, h.sequence, sequence % 29 <> 0 AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.run = h.run AND b.sequence = h.sequence) AS good, (SELECT count(*) FROM lineitem WHERE l_orderkey = h.sequence) AS committed FROM heads h),
      v AS (SELECT run, max(sequence) FILTER (good) AS sequence, max(sequence) AS newest FROM j GROUP BY run HAVING count(*) FILTER (good) > 0)
      SELECT v.run, v.sequence, newest, (SELECT committed FROM j WHERE j.run = v.run AND j.sequence = v.sequence) AS committed, (SELECT count(*) FROM j WHERE j.run = v.run AND j.sequence > v.sequence) AS skipped FROM v""",
    "x6_payload_sha256": f"SELECT o_orderkey, bits, sha256(unhex({_le_sql('bits')})) AS digest FROM (SELECT o_orderkey, {_bits_sql('x')} AS bits FROM (SELECT o_orderkey, ({DOUBLES})::DOUBLE AS x FROM orders))",
    "x8_result_checksums": _X8,
    "k8_block_records": f"SELECT l_orderkey AS block_id, l_orderkey * 8 + n AS end_scenario, n, min, max, checksum FROM ({_X8}) JOIN (SELECT l_orderkey, min(l_quantity)::DOUBLE AS min, max(l_quantity)::DOUBLE AS max FROM lineitem GROUP BY l_orderkey) USING (l_orderkey)",
}
