"""The engine's queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martingrid.functions import pricing, rng
from martingrid.functions.pricing import black_scholes_call, confidence, standard_error
from martingrid.operators.simulate import RunSpec, block_stats, blocks, normals, path_payoffs, price
from martingrid.plans import tables
from martingrid.sources import runs

#: Scenarios are the events of a table, whose ids are dense.
SPEC = RunSpec(seed=0x0123456789ABCDEF)
ASIAN = RunSpec(seed=42, steps=4, payoff="asian_call", block_size=512)
HESTON = RunSpec(seed=0x484553544F4E, steps=4, model="heston", block_size=512)
PAIRED = RunSpec(seed=0x51A7ED, antithetic=True)
PAIRED_HESTON = RunSpec(seed=0x484553544F4E, steps=2, model="heston", antithetic=True, block_size=512)
#: What an order's total is measured against, and its run.
ORDER_STRIKE, ORDERS = 150_000.0, RunSpec(seed=7, strike=150_000.0)
DIGITS = 8


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _sized(spark: SparkSession, sf_dir: str, spec: RunSpec) -> RunSpec:
    """The specification with as many scenarios as there are events (for pairs, an even number)."""
    n = _events(spark, sf_dir).count()
    return replace(spec, scenarios=n - n % 2 if spec.antithetic else n)


def s1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, _sized(spark, sf_dir, SPEC))


def s3_raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rng.raw_stream(spark, SPEC.seed, 2 * _sized(spark, sf_dir, SPEC).scenarios, 2)


def r1_philox_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("scenario"))
    return rng.with_words(rows, SPEC.seed, F.col("scenario"), F.lit(0), F.lit(0), F.lit(0))


def r8_standard_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("scenario"), F.lit(0).cast("long").alias("step"))
    return normals(rows, SPEC.seed).select("scenario", "u", F.round("z", DIGITS).alias("z"))


def _order_payoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a scenario that starts from its total."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("scenario"), F.lit(0).cast("long").alias("step"), F.col("o_totalprice").alias("spot"), "o_custkey")
    final = F.col("spot") * F.exp(F.lit(ORDERS.drift) + F.lit(ORDERS.diffusion) * F.col("z"))
    paid = F.lit(ORDERS.discount) * F.greatest(final - F.lit(ORDER_STRIKE), F.lit(0.0))
    return normals(rows, ORDERS.seed).select("scenario", "o_custkey", paid.alias("payoff"))


def m8_european_payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_payoffs(spark, sf_dir).select("scenario", F.round("payoff", 5).alias("payoff"))


def x1_price_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, error and interval of each customer segment, from its orders."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    stats = _order_payoffs(spark, sf_dir).join(customers, "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("payoff").alias("mean"), (F.var_pop("payoff") * F.count("*")).alias("m2"))
    n, mean, m2 = F.col("n"), F.col("mean"), F.col("m2")
    low, high = confidence(n, mean, m2)
    return stats.select("c_mktsegment", "n", *[F.round(c, 4).alias(a) for c, a in ((mean, "price"), (standard_error(n, m2), "standard_error"), (low, "ci_low"), (high, "ci_high"))])


def a1_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_stats(spark, _sized(spark, sf_dir, SPEC)).select("block_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "m2", "min", "max")])


def _priced(spark: SparkSession, sf_dir: str, spec: RunSpec) -> DataFrame:
    made = price(spark, _sized(spark, sf_dir, spec))
    return made.select("n", *[F.round(c, DIGITS).alias(c) for c in ("price", "standard_error", "ci_low", "ci_high", "min", "max")])


def t1_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, SPEC)


def t1_price_asian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, ASIAN)


def x4_analytic_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price beside its reference, for plain and for stochastic variance."""
    made = [price(spark, _sized(spark, sf_dir, s)).select(F.lit(s.model).alias("model"), "analytic", "analytic_error", "standard_error") for s in (SPEC, HESTON)]
    both = made[0].unionByName(made[1])
    return both.select("model", F.round("analytic", 7).alias("analytic"), F.round("analytic_error", 7).alias("analytic_error"), F.round("standard_error", 7).alias("standard_error"))


def m13_black_scholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices along a chain of strikes and volatilities, one for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select("p_partkey", (F.col("p_retailprice") / 10).alias("spot"), (F.lit(0.1) + F.col("p_size") / 100).alias("volatility"))
    return rows.withColumn("price", F.round(black_scholes_call(F.col("spot"), F.lit(100.0), F.lit(0.05), F.col("volatility"), F.lit(1.0)), DIGITS))


def _paid(spark: SparkSession, sf_dir: str, spec: RunSpec) -> DataFrame:
    return path_payoffs(spark, _sized(spark, sf_dir, spec)).withColumn("payoff", F.round("payoff", DIGITS))


def m5_heston_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir, HESTON)


def m3_antithetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir, PAIRED)


def m7_heston_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir, PAIRED_HESTON)


def m9_asian_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir, ASIAN)


#: Blocks a batch of the durable run, and batches before it is stopped.
BATCH, STOPPED_AFTER = 8, 2


def e8_durable_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is stopped after some batches and gone on with; then once more, which computes nothing."""
    spec, folder = _sized(spark, sf_dir, ASIAN), runs.new_folder(spark)
    first = runs.run_durable(spark, spec, folder, BATCH, STOPPED_AFTER)
    second = runs.run_durable(spark, spec, folder, BATCH)
    third = runs.run_durable(spark, spec, folder, BATCH)
    made = [d.withColumn("attempt", F.lit(i)) for i, d in enumerate((first, second, third), 1)]
    every = made[0].unionByName(made[1]).unionByName(made[2])
    return every.select("attempt", "status", "blocks", "recovered", "computed", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


def s7_latest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest that a run goes on from, after the newest entries are lost."""
    spec, folder = _sized(spark, sf_dir, SPEC), runs.new_folder(spark)
    runs.run_durable(spark, spec, folder, 1, 2)
    newest = runs.heads(spark, folder)[0]
    last = next(h for h in runs.heads(spark, folder) if h.added)
    spark.createDataFrame([], "block_id long, incarnation long, lease_epoch long, checksum string").write.mode("overwrite").parquet(f"{folder}/entries/sequence={last.sequence}")
    found = runs.latest_valid(spark, folder, 1 + (spec.scenarios - 1) // spec.block_size)
    return spark.createDataFrame([(newest.sequence, found.sequence, found.committed, found.status)], "newest long, valid long, committed long, status string")


QUERIES = (
    m5_heston_paths, m3_antithetic_pairs, m7_heston_pairs, m9_asian_paths, *tables.QUERIES, s1_blocks, s3_raw_stream, r1_philox_words, r8_standard_normal, m8_european_payoff,
    x1_price_by_segment, a1_block_stats, t1_price, t1_price_asian, x4_analytic_error, m13_black_scholes, e8_durable_resume, s7_latest_manifest,
)


#: Where the scenarios of the SQL come from; pairs take an even number of them.
EVENTS, ORDER_ROWS = "(SELECT event_id AS i FROM events)", "(SELECT o_orderkey AS i FROM orders)"
EVEN_EVENTS = "(SELECT event_id AS i FROM events WHERE event_id < (SELECT count(*) - count(*) % 2 FROM events))"


def _philox_sql(rows: str, seed: int, step: int = 0, dimension: int = 0) -> str:
    sql = f"SELECT i AS scenario, (i & {rng.MASK})::BIGINT AS w0, ((i >> 32) + {step << 8})::BIGINT AS w1, {dimension}::BIGINT AS w2, 0::BIGINT AS w3 FROM {rows}"
    key = [seed & rng.MASK, seed >> 32 & rng.MASK]
    m0, m1 = rng.MULTIPLIERS
    for _ in range(rng.ROUNDS):
        sql = (
            f"SELECT scenario, xor(xor(p1 >> 32, w1), {key[0]}) AS w0, p1 & {rng.MASK} AS w1, xor(xor(p0 >> 32, w3), {key[1]}) AS w2, p0 & {rng.MASK} AS w3 "
            f"FROM (SELECT scenario, w1, w3, {m0}::HUGEINT * w0 AS p0, {m1}::HUGEINT * w2 AS p1 FROM ({sql}))"
        )
        key = [(k + w) & rng.MASK for k, w in zip(key, rng.WEYL, strict=True)]
    return f"SELECT scenario, w0::BIGINT AS w0, w1::BIGINT AS w1, w2::BIGINT AS w2, w3::BIGINT AS w3 FROM ({sql})"


def _poly(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _normal_sql(rows: str, seed: int, step: int = 0, dimension: int = 0) -> str:
    ends = lambda x: f"{_poly(rng.ACKLAM_C, x)} / {_poly(rng.ACKLAM_D, x)}"
    return f"""SELECT scenario, u, CASE WHEN u < {rng.ACKLAM_LOW} THEN {ends('t')} WHEN u > {1 - rng.ACKLAM_LOW} THEN -({ends('t')})
      ELSE {_poly(rng.ACKLAM_A, 'q')} * (u - 0.5) / {_poly(rng.ACKLAM_B, 'q')} END AS z
    FROM (SELECT scenario, u, (u - 0.5) * (u - 0.5) AS q, sqrt(-2.0::DOUBLE * ln(least(u, 1 - u))) AS t
      FROM (SELECT scenario, CASE WHEN raw = 0 THEN pow(2.0::DOUBLE, -54) ELSE raw::DOUBLE * pow(2.0::DOUBLE, -53) END AS u
        FROM (SELECT scenario, w0 * 2097152 + (w1 >> 11) AS raw FROM ({_philox_sql(rows, seed, step, dimension)}))))"""


def _order_sql() -> str:
    s = ORDERS
    return f"SELECT scenario, o_custkey, {s.discount!r}::DOUBLE * greatest(o_totalprice * exp({s.drift!r}::DOUBLE + {s.diffusion!r}::DOUBLE * z) - {ORDER_STRIKE!r}::DOUBLE, 0.0::DOUBLE) AS payoff FROM ({_normal_sql(ORDER_ROWS, s.seed)}) n JOIN orders ON o_orderkey = scenario"


def _walk_sql(s: RunSpec, rows: str, sign: int = 1) -> str:
    """(scenario, payoff): step after step price, variance and the sum of prices, by joins of the draws."""
    dt = s.maturity / s.steps
    d = lambda x: f"{x!r}::DOUBLE"
    sql = f"SELECT i AS scenario, {d(s.spot)} AS s, {d(s.initial_variance)} AS v, 0::DOUBLE AS total FROM {rows}"
    for step in range(s.steps):
        z0, z1 = (_normal_sql(rows, s.seed, step, k) for k in (0, 1))
        up, v = f"s * exp({d(s.drift)} + {d(s.diffusion)} * ({sign} * a.z))", "v"
        if s.model == "heston":
            root = f"sqrt(greatest(v, 0)) * {d(math.sqrt(dt))}"
            up = f"s * exp(({d(s.rate)} - 0.5::DOUBLE * greatest(v, 0)) * {d(dt)} + {root} * ({sign} * a.z))"
            shock = f"({d(s.correlation)} * ({sign} * a.z) + {d(math.sqrt(1 - s.correlation**2))} * ({sign} * b.z))"
            v = f"v + {d(s.reversion)} * ({d(s.long_variance)} - greatest(v, 0)) * {d(dt)} + {d(s.variance_volatility)} * {root} * {shock}"
        more = f" JOIN ({z1}) b ON p.scenario = b.scenario" if s.model == "heston" else ""
        sql = f"SELECT scenario, s, v, total + s AS total FROM (SELECT p.scenario, {up} AS s, {v} AS v, total FROM ({sql}) p JOIN ({z0}) a ON p.scenario = a.scenario{more})"
    settled = "s" if s.payoff == "european_call" else f"total / {s.steps}"
    return f"SELECT scenario, {d(s.discount)} * greatest({settled} - {d(s.strike)}, 0) AS payoff FROM ({sql})"


def _path_sql(s: RunSpec) -> str:
    if not s.antithetic:
        return _walk_sql(s, EVENTS)
    return f"SELECT scenario, 0.5 * (a.payoff + b.payoff) AS payoff FROM ({_walk_sql(s, EVEN_EVENTS)}) a JOIN ({_walk_sql(s, EVEN_EVENTS, -1)}) b USING (scenario) WHERE scenario % 2 = 0"


def _price_sql(s: RunSpec) -> str:
    r, half = lambda x: f"round({x}, {DIGITS})", f"{pricing.CI_Z}::DOUBLE * stddev_samp(payoff) / sqrt(count(*))"
    return f"SELECT count(*) AS n, {r('avg(payoff)')} AS price, {r('stddev_samp(payoff) / sqrt(count(*))')} AS standard_error, {r(f'avg(payoff) - {half}')} AS ci_low, {r(f'avg(payoff) + {half}')} AS ci_high, {r('min(payoff)')} AS min, {r('max(payoff)')} AS max FROM ({_path_sql(s)})"


def _cdf(x: str) -> str:
    a = f"abs({x})"
    below = f"exp(-({a}) * ({a}) / 2) * {_poly(pricing.HART_P, a)} / {_poly(pricing.HART_Q, a)}"
    far = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k} / {far})"
    c = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < {pricing.HART_SPLIT} THEN {below} ELSE exp(-({a}) * ({a}) / 2) / {far} / {pricing.ROOT_TWO_PI} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {c} ELSE {c} END)"


def oracle_sql() -> dict[str, str]:
    s, r = SPEC, lambda x, d=DIGITS: f"round({x}, {d})"
    paid = lambda x: f"SELECT scenario, {r('payoff')} AS payoff FROM ({_path_sql(x)})"
    half = f"{pricing.CI_Z}::DOUBLE * stddev_samp(payoff) / sqrt(count(*))"
    n = "(SELECT count(*) FROM events)"
    blocks_of = lambda size: f"(({n} + {size - 1}) // {size})"
    done = f"least({blocks_of(ASIAN.block_size)}, {BATCH * STOPPED_AFTER})"
    return tables.ORACLES | {
        "m5_heston_paths": paid(HESTON),
        "m3_antithetic_pairs": paid(PAIRED),
        "m7_heston_pairs": paid(PAIRED_HESTON),
        "m9_asian_paths": paid(ASIAN),
        "s1_blocks": f"SELECT event_id AS block_id, event_id * {s.block_size} AS start_scenario, least((event_id + 1) * {s.block_size}, {n}) AS end_scenario FROM events WHERE event_id < {blocks_of(s.block_size)}",
        "s3_raw_stream": f"SELECT scenario * 2 + w.dimension AS position, scenario, w.dimension, printf('%08x%08x', w0, w1) AS raw FROM (SELECT *, 0 AS dimension FROM ({_philox_sql(EVENTS, s.seed)}) UNION ALL SELECT *, 1 FROM ({_philox_sql(EVENTS, s.seed, 0, 1)})) w",
        "r1_philox_words": _philox_sql(EVENTS, s.seed),
        "r8_standard_normal": f"SELECT scenario, u, {r('z')} AS z FROM ({_normal_sql(EVENTS, s.seed)})",
        "m8_european_payoff": f"SELECT scenario, {r('payoff', 5)} AS payoff FROM ({_order_sql()})",
        "x1_price_by_segment": f"SELECT c_mktsegment, count(*) AS n, {r('avg(payoff)', 4)} AS price, {r('stddev_samp(payoff) / sqrt(count(*))', 4)} AS standard_error, CASE WHEN count(*) >= {pricing.CI_MINIMUM} THEN {r(f'avg(payoff) - {half}', 4)} END AS ci_low, CASE WHEN count(*) >= {pricing.CI_MINIMUM} THEN {r(f'avg(payoff) + {half}', 4)} END AS ci_high FROM ({_order_sql()}) JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
        "a1_block_stats": f"SELECT scenario // {s.block_size} AS block_id, count(*) AS n, {r('avg(payoff)', 6)} AS mean, {r('var_pop(payoff) * count(*)', 6)} AS m2, {r('min(payoff)', 6)} AS min, {r('max(payoff)', 6)} AS max FROM ({_path_sql(s)}) GROUP BY 1",
        "t1_price": _price_sql(SPEC),
        "t1_price_asian": _price_sql(ASIAN),
        "m13_black_scholes": f"SELECT p_partkey, spot, volatility, round(spot * {_cdf('d1')} - 100.0::DOUBLE * exp(-0.05::DOUBLE) * {_cdf('(d1 - volatility)')}, {DIGITS}) AS price FROM (SELECT *, (ln(spot / 100) + (0.05 + volatility * volatility / 2)) / volatility AS d1 FROM (SELECT p_partkey, p_retailprice / 10 AS spot, 0.1::DOUBLE + p_size / 100.0::DOUBLE AS volatility FROM part))",
        "s7_latest_manifest": f"SELECT 1 + d + (d = b)::BIGINT AS newest, d AS valid, d - 1 AS committed, 'Running' AS status FROM (SELECT b, least(b, 2) AS d FROM (SELECT {blocks_of(s.block_size)} AS b))",
        "e8_durable_resume": f"""WITH p AS (SELECT count(*) AS n, round(avg(payoff), 6) AS mean, round(min(payoff), 6) AS min, round(max(payoff), 6) AS max FROM ({_path_sql(ASIAN)})), b AS (SELECT {blocks_of(ASIAN.block_size)} AS blocks, {done} AS done)
          SELECT attempt::INTEGER AS attempt, CASE WHEN whole THEN 'Completed' ELSE 'Running' END AS status, blocks, recovered, computed, CASE WHEN whole THEN n END AS n, CASE WHEN whole THEN mean END AS mean, CASE WHEN whole THEN min END AS min, CASE WHEN whole THEN max END AS max
          FROM p, (SELECT 1 AS attempt, done = blocks AS whole, blocks, 0::BIGINT AS recovered, done AS computed FROM b UNION ALL SELECT 2, true, blocks, done, blocks - done FROM b UNION ALL SELECT 3, true, blocks, blocks, 0 FROM b)""",
    }


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
