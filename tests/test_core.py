import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from martingrid.functions import codec, heston, parse, pricing, rng
from martingrid.operators import gate, ranks, validation
from martingrid.operators.simulate import RunSpec, block_stats, blocks, discounted_payoff, one_step_payoffs, ordered_stats, path_payoffs, price, reduce_blocks
from martingrid.sources import documents, runs


def test_raw_words(spark):
    """Fixed values of the generator: seed, then scenario 0 and 1 on dimension 0 and 1."""
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "s long, d int")
    got = rng.with_words(rows, 0x123456789ABCDEF0, F.col("s"), F.lit(0), F.col("d"), F.lit(0)).orderBy("s", "d").collect()
    assert [f"{r.w0 << 32 | r.w1:016X}" for r in got] == ["092C9B4478384BC0", "392FD6B226FC076C", "389D999A609CF517", "EACE5522A93BE4CF"]


def test_out_of_range_coordinate_raises(spark):
    rows = spark.createDataFrame([(1 << 40,)], "s long")
    with pytest.raises(Exception, match="out of range"):
        rng.with_words(rows, 1, F.col("s"), F.lit(0), F.lit(0), F.lit(0)).collect()


def test_inverse_normal_and_cdf(spark):
    r = spark.range(1).select(*[rng.inverse_normal(F.lit(p)).alias(f"q{i}") for i, p in enumerate((0.5, 0.975, 0.025))]).first()
    assert r[0] == 0 and abs(r[1] - 1.959963984540054) < 1e-8 and abs(r[2] + 1.959963984540054) < 1e-8
    xs = [(-8 + i / 10,) for i in range(161)]
    for x, y in spark.createDataFrame(xs, "x double").select("x", pricing.normal_cdf(F.col("x"))).collect():
        assert abs(y - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-11


def test_black_scholes(spark):
    v = spark.range(1).select(pricing.black_scholes_call(*[F.lit(x) for x in (100.0, 100.0, 0.05, 0.2, 1.0)])).first()[0]
    assert abs(v - 10.450583572185565) < 1e-10


def test_price_is_near_the_closed_form_and_ignores_partitioning(spark):
    spec = RunSpec(seed=42, scenarios=20_000)
    r = price(spark, spec).first()
    assert abs(r.analytic_error) <= 4 * r.standard_error
    stats = block_stats(spark, spec)
    a, b = (reduce_blocks(stats.repartition(n), 10).drop("block_id").first() for n in (1, 7))
    assert a == b


def test_kernel_equals_expressions(spark):
    spec = RunSpec(seed=9, scenarios=1_000, block_size=300)
    a = {r.block_id: r for r in block_stats(spark, spec).collect()}
    b = one_step_payoffs(spark, spec).groupBy("block_id").agg(F.avg("payoff").alias("m"), F.count("*").alias("n")).collect()
    assert len(b) == 4 and all(a[r.block_id].n == r.n and abs(a[r.block_id].mean - r.m) < 1e-9 for r in b)
    assert [r.end_scenario for r in blocks(spark, spec).orderBy("block_id").collect()] == [300, 600, 900, 1000]


def test_bad_specifications():
    for bad in ({"scenarios": 0}, {"volatility": 0.0}, {"rate": math.inf}, {"payoff": "put"}):
        with pytest.raises(ValueError):
            RunSpec(**bad)


def test_constant_variance_equals_plain_paths(spark):
    """Without volatility of variance both models walk the same paths, for either payoff."""
    same = {"seed": 20_240_117, "scenarios": 300, "steps": 12, "volatility": 0.3, "block_size": 80}
    flat = {"model": "heston", "initial_variance": 0.09, "long_variance": 0.09, "reversion": 0.7, "variance_volatility": 0.0, "correlation": -0.5}
    for payoff in ("european_call", "asian_call"):
        a, b = ({r.scenario: r.payoff for r in path_payoffs(spark, RunSpec(payoff=payoff, **same, **more)).collect()} for more in ({}, flat))
        assert len(a) == 300 and all(abs(a[k] - b[k]) < 2e-12 for k in a)


def test_pairs_lower_the_error(spark):
    plain, paired = (price(spark, RunSpec(seed=5_077, scenarios=20_000, antithetic=x)).first() for x in (False, True))
    assert paired.n == 10_000 and paired.standard_error < plain.standard_error
    for bad in ({"antithetic": True, "scenarios": 101}, {"model": "heston", "correlation": 2.0}, {"model": "none"}):
        with pytest.raises(ValueError):
            RunSpec(**bad)


def test_invariants_and_gaps(spark):
    nan, inf = math.nan, math.inf
    cases = [(0, 0.0, 0.0, 0.0, 0.0, 0, None), (2, 1.0, 0.0, 1.0, 1.0, 3, "count"), (0, 1.0, 0.0, 0.0, 0.0, 0, "empty"), (2, nan, 0.0, 1.0, 1.0, 2, "finite"), (2, 1.0, inf, 1.0, 1.0, 2, "finite"), (2, 1.0, -1.0, 1.0, 1.0, 2, "m2"), (2, 1.0, 0.0, 2.0, 1.0, 2, "range"), (2, 3.0, 0.0, 1.0, 2.0, 2, "mean"), (1, 1.0, 1.0, 1.0, 1.0, 1, "single")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, mean double, m2 double, low double, high double, e long, why string")
    for r in rows.withColumn("got", validation.invariant_error(*[F.col(c) for c in ("e", "n", "mean", "m2", "low", "high")])).collect():
        assert r.got == r.why
    blocks_ = spark.createDataFrame([(0, 0, 10), (1, 10, 20), (2, 25, 30), (3, 29, 40)], "block_id long, start_scenario long, end_scenario long")
    assert [(r.block_id, r.problem) for r in validation.universe_gaps(blocks_).orderBy("block_id").collect()] == [(1, "gap"), (2, "overlap")]
    holed = spark.createDataFrame([(0, 0, 10), (2, 20, 30), (3, 30, 40)], "block_id long, start_scenario long, end_scenario long")
    assert [(r.block_id, r.next_start, r.problem) for r in validation.universe_gaps(holed).collect()] == [(0, None, "hole")] and validation.universe_gaps(holed.limit(0)).count() == 0


def test_gate_drift(spark):
    rising = spark.createDataFrame([(i, 1000.0 + 10 * i) for i in range(20)], "i long, rate double")
    got = gate.theil_sen(rising, "i", "rate").first()
    assert got.pairs == 190 and got.slope == 10 and abs(got.drift_pct - 190 / 1095 * 100) < 1e-9


def test_universe_problems(spark):
    rows = [(0, 0, 10, 1, 1), (1, 10, 20, 1, 1), (1, 10, 20, 1, 1), (3, 30, 41, 1, 1), (4, 40, 50, 2, 1), (5, 50, 60, 1, 0), (6, 60, 65, None, 1), (9, 90, 95, 1, 1), (None, 0, 10, 1, 1)]
    table = spark.createDataFrame(rows, "block_id long, start_scenario long, end_scenario long, incarnation long, lease_epoch long")
    got = sorted((-1 if r.block_id is None else r.block_id, r.problem) for r in validation.universe_problems(table, 65, 10).collect())
    assert got == [(-1, "outside"), (1, "repeated"), (2, "missing"), (3, "range"), (4, "incarnation"), (5, "lease"), (6, "incarnation"), (9, "outside")]
    odd = spark.createDataFrame([(0, 0, 5, 1, 1), (1, 5, 10, 1, 1)], table.schema)
    assert {r.problem for r in validation.universe_problems(odd, 10, 5, antithetic=True).collect()} == {"pair"}


RUN = {"run_hash": "r", "layout_hash": "l", "build": "b", "incarnation": 1, "rng_version": 2, "stats_schema": 1}


def result(spark, block=0, n=4, **changes):
    row = {"block_id": block, "start_scenario": block * 4, "end_scenario": block * 4 + 4, "lease_epoch": 1, "n": n, "mean": 1.0, "m2": 0.0, "min": 1.0, "max": 1.0, **RUN}
    made = codec.with_checksum(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in row.items())))
    for k, v in changes.items():
        made = made.withColumn(k, F.lit(v).cast(made.schema[k].dataType))
    return made


def test_validation_fails_closed(spark):
    universe = spark.range(3).selectExpr("id AS block_id", "id * 4 AS start_scenario", "id * 4 + 4 AS end_scenario", "1L AS lease_epoch")
    none = universe.limit(0).select("block_id", F.lit("").alias("checksum"))
    status = lambda made, done=none, pairs=False: validation.validate_results(made, universe, done, RUN, pairs).first()["status"]
    assert status(result(spark)) == "Accepted"
    for name, want in (("run_hash", "InvalidRun"), ("layout_hash", "ExecutionLayoutMismatch"), ("build", "BuildMismatch"), ("incarnation", "StaleIncarnation"), ("rng_version", "RngVersionMismatch"),
                       ("stats_schema", "StatsSchemaMismatch"), ("start_scenario", "InvalidBlock"), ("n", "InvalidAggregate"), ("checksum", "CorruptPayload"), ("lease_epoch", "StaleLease")):
        assert status(result(spark, **{name: None})) == want
    assert status(result(spark, 7)) == "InvalidBlock" and status(result(spark, max=2.0)) == "CorruptPayload"
    assert status(result(spark, n=2)) == "InvalidAggregate" and status(result(spark, n=2), pairs=True) == "Accepted"
    done = result(spark).select("block_id", "checksum")
    assert status(result(spark), done) == "Duplicate" and status(result(spark), done.withColumn("checksum", F.lit("other"))) == "DeterminismError"


def test_digests_of_canonical_bytes(spark):
    """Digests of the default specification and of its layout at rate 0, and the check value of the checksum."""
    assert codec.spec_hash(RunSpec()).hex() == "19a2aa7d5da2e20312af30c2dc418dceb3069429328f7406d2ec31f0d34b248a"
    assert codec.layout_hash(RunSpec(rate=0.0)).hex() == "cfa142b5e8d0b22ecf3852a9711613bd6fab14dd238970c7cfecc95ba097ab07"
    assert len(codec.spec_payload(RunSpec(model="heston"))) == 124 and len(codec.aggregate_payload(1, 0.0, 0.0, 0.0, 0.0)) == 48
    assert codec.spec_hash(RunSpec(rate=0.0)) != codec.spec_hash(RunSpec(rate=-0.0)), "bits count"
    got = spark.createDataFrame([("123456789",), ("",), (None,)], "t string").select(codec.crc32c(F.col("t"))).collect()
    assert [r[0] for r in got] == [0xE3069283, 0, None]
    r = result(spark).first()
    assert r.checksum == hashlib.sha256(codec.aggregate_payload(4, 1.0, 0.0, 1.0, 1.0)).hexdigest()


#: Spot, strike, rate, maturity, variance, reversion, long variance, its volatility, correlation; published prices.
HESTON_GRID = (
    (100, 100, 0.05, 1, 0.04, 1.5, 0.04, 0.3, -0.7, 10.361869020966115),
    (100, 120, 0.05, 1, 0.04, 1.5, 0.04, 0.3, -0.7, 2.193309940983057),
    (100, 100, 0.01, 2, 0.09, 1.2, 0.08, 0.9, -0.45, 14.435003424669659),
    (80, 70, 0.03, 0.4, 0.06, 2, 0.05, 0.5, 0.4, 11.579204967505497),
    (100, 200, 0, 10, 0.16, 1, 0.16, 2, -0.8, 4.952114720879724),
    (100, 100, 0.05, 0.003, 0.04, 1.5, 0.04, 0.3, -0.7, 0.444468816447376),
    (100, 100, 0.05, 0.0001, 0.04, 1.5, 0.04, 0.3, -0.7, 0.080038149854062),
    (100, 100, 0.05, 0.00001, 0.04, 1.5, 0.04, 0.3, -0.7, 0.025256315544304),
    (65.99779952199391, 43.526450272648084, 0.07060460362936678, 0.25531661856505, 0.01291364012647647, 0.37699273164639985, 0.00870054854053283, 0.618193710082573, -0.6753969423733619, 23.251706360406523),
    (97.6414857002654, 103.12116976885129, 0.033126487376587535, 0.05073276139648636, 0.005283700109833077, 0.9259389160635384, 0.010406167317041066, 0.07065601601611003, 0.12170623882999854, 0.00047644435405),
)


def test_heston_call(spark):
    for *given, want in HESTON_GRID:
        assert abs(heston.heston_call(*given) - want) < 5e-10
    plain = spark.range(1).select(pricing.black_scholes_call(*[F.lit(x) for x in (100.0, 90.0, 0.02, 0.3, 2.0)])).first()[0]
    for xi in (0.0, 1e-9, 1e-6):
        assert abs(heston.heston_call(100, 90, 0.02, 2, 0.09, 1.0, 0.09, xi, -0.5) - plain) < 1e-5 * (xi > 0) + 1e-9
    assert heston.heston_call(100, 90, 0.0, 1, 0.0, 0.0, 0.0, 0.5, 0.0) == 10.0
    bad = [(0.0, 90, 0.0, 1, 0.04, 1, 0.04, 0.3, 0), (100, 90, 0.0, 1, 0.04, 1, 0.04, 0.3, 1.5), (100, 90, 0.0, math.nan, 0.04, 1, 0.04, 0.3, 0)]
    for given in bad:
        with pytest.raises(ValueError):
            heston.heston_call(*given)
    kinds = ", ".join(f"{c} double" for c in heston.INPUTS) + ", price string"
    rows = spark.createDataFrame([(*map(float, HESTON_GRID[0][:-1]), "x"), (*map(float, bad[0]), "x"), (*[None] * 9, "x")], kinds)
    got = heston.heston_calls(rows).collect()
    assert abs(got[0].price - HESTON_GRID[0][-1]) < 5e-10 and got[0].error is None and all(r.price is None and r.error for r in got[1:])
    assert heston.heston_calls(rows.limit(0)).count() == 0


def test_heston_paths_meet_the_closed_form(spark):
    r = price(spark, RunSpec(seed=77, scenarios=60_000, steps=32, model="heston")).first()
    assert abs(r.analytic - 10.361869020966115) < 1e-9 and abs(r.analytic_error) < 5 * r.standard_error


def test_ordered_statistics(spark):
    x = np.random.default_rng(3).normal(size=(5, 37)) * 10
    mean, m2 = ordered_stats(x)
    for row, a, b in zip(x, mean, m2, strict=True):
        m = s = 0.0
        for i, v in enumerate(row.tolist(), 1):
            d = v - m
            m += d / i
            s += d * (v - m)
        assert (m, s) == (a, b), "the same bits as one after another"
    spec = RunSpec(seed=3, scenarios=5_000, block_size=300)
    every = block_stats(spark, spec)
    parts = block_stats(spark, spec, blocks(spark, spec).where("block_id % 3 = 1").repartition(2))
    assert sorted(parts.collect()) == sorted(every.where("block_id % 3 = 1").collect())
    assert discounted_payoff(spec, 7) == path_payoffs(spark, spec).where("scenario = 7").first()["payoff"]
    with pytest.raises(Exception, match="missing"):
        reduce_blocks(parts, 17).collect()
    with pytest.raises(Exception, match="repeated"):
        reduce_blocks(every.union(parts), 17).collect()
    assert reduce_blocks(parts, 17, partial=True).first()["n"] == parts.agg(F.sum("n")).first()[0]
    with pytest.raises(Exception, match="left the positive numbers"):
        price(spark, RunSpec(rate=-1e308, maturity=1e308, scenarios=8)).collect()


def test_prices_of_the_default_specification(spark):
    """Published prices by number of scenarios."""
    for n, want in ((200_000, 10.462563283), (1_000_000, 10.451521144)):
        assert abs(price(spark, RunSpec(scenarios=n)).first()["price"] - want) < 1e-8


def test_durable_run_goes_on(spark, tmp_path):
    spec, folder = RunSpec(seed=8, scenarios=4_000, steps=2, payoff="asian_call", block_size=500), str(tmp_path / "run")
    got = lambda d: tuple(d.first())[:4]
    assert got(runs.run_durable(spark, spec, folder, 2, max_batches=1)) == ("Running", 8, 0, 2)
    assert got(runs.run_durable(spark, spec, folder, 2, max_batches=1)) == ("Running", 8, 2, 2)
    # the newest manifest loses its entries: the one before it stands in
    newest = runs.heads(spark, folder)[0]
    spark.createDataFrame([(0, 1, 1, "x")], "block_id long, incarnation long, lease_epoch long, checksum string").write.mode("overwrite").parquet(f"{folder}/entries/sequence={newest.sequence}")
    assert runs.latest_valid(spark, folder, 8).committed == 2
    done = runs.run_durable(spark, spec, folder, 3)
    assert got(done) == ("Completed", 8, 2, 6)
    whole = price(spark, spec).first()
    assert (done.first()["n"], done.first()["mean"]) == (whole.n, whole.price)
    before = len(runs.heads(spark, folder))
    assert got(runs.run_durable(spark, spec, folder, 3)) == ("Completed", 8, 8, 0) and len(runs.heads(spark, folder)) == before
    with pytest.raises(runs.RunError, match="another run"):
        runs.run_durable(spark, RunSpec(seed=9, scenarios=4_000, block_size=500), folder)


def test_lost_results_are_computed_again(spark, tmp_path):
    spec, folder = RunSpec(seed=8, scenarios=1_000, block_size=250), str(tmp_path / "run")
    runs.run_durable(spark, spec, folder, 1, max_batches=3)
    path = next((tmp_path / "run" / "results").glob("computed_in=1/batch=2/*.parquet"))
    spark.read.parquet(str(path)).withColumn("mean", F.col("mean") + 1).coalesce(1).write.mode("overwrite").parquet(str(path.parent) + "-new")
    spark.read.parquet(str(path.parent) + "-new").write.mode("overwrite").parquet(str(path.parent))
    __import__("shutil").rmtree(str(path.parent) + "-new")
    done = runs.run_durable(spark, spec, folder, 1).first()
    assert (done.status, done.recovered, done.computed) == ("Completed", 2, 2) and done["mean"] == price(spark, spec).first()["price"]


def test_gate_decisions(spark):
    def decide(pairs, **policy):
        rows = [("g", i, float(a), float(b), i % 2 == 0) for i, (a, b) in enumerate(pairs)]
        return gate.decide(spark.createDataFrame(rows, "gate string, pair long, control double, treatment double, control_first boolean"), "gate", gate.Policy(samples=2_000, **policy)).first()

    r = decide([(1000, 950)] * 20)
    assert r.passed and abs(r.median_loss - 5) < 1e-12 and abs(r.ci_low - 5) < 1e-12 and abs(r.ci_high - 5) < 1e-12
    assert not decide([(1000, 800)] * 20).loss_ok
    r = decide([(1000 + 10 * i, (1000 + 10 * i) * 0.95) for i in range(20)])
    assert not r.drift_ok and not r.passed
    r = decide([(1000, 950 if i % 2 else 850) for i in range(20)])
    assert not r.order_ok and not r.passed
    r = decide([(1000, 950)] * 4)
    assert not r.enough and not r.passed
    assert decide([(1000, 950), (0, 1)]).problem == "rates" and decide([(1000, 950)]).problem == "pairs" and decide([(1000, 950)] * 101).problem == "pairs"
    one_sided = spark.createDataFrame([("g", i, 10.0, 9.0, True) for i in range(6)], "gate string, pair long, control double, treatment double, control_first boolean")
    assert gate.decide(one_sided, "gate").first()["problem"] == "balance" and gate.decide(one_sided.limit(0), "gate").count() == 0
    for bad in ({"samples": 10}, {"maximum_loss": -1.0}, {"minimum_pairs": 1}, {"maximum_drift": math.inf}):
        with pytest.raises(ValueError):
            gate.Policy(**bad)


def test_resampling_is_the_generator_one_by_one():
    state, want, mask = 99, [], (1 << 64) - 1
    while len(want) < 500:
        state = state + 0x9E3779B97F4A7C15 & mask
        x = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        x ^= x >> 31
        if x >= (1 << 64) % 7:
            want.append(x % 7)
    assert gate.sample_indices(99, 7, 500).tolist() == want


def test_strict_numbers(spark):
    texts = ["0", "18446744073709551615", "18446744073709551616", " 1", "+1", "-1", "1x", "", None, "1.5", "1e3", ".5", "nan", "inf", "1e999", "0x1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse.parse_u64(F.col("t")), parse.parse_size(F.col("t")), parse.parse_finite(F.col("t"))).collect()
    assert [None if r[0] is None else int(r[0]) for r in rows] == [0, 2**64 - 1] + [None] * 14
    assert [r[1] for r in rows] == [0] + [None] * 15
    assert [r[2] for r in rows] == [0.0, 2.0**64, 2.0**64, None, None, -1.0, None, None, None, 1.5, 1000.0, 0.5, None, None, None, None]


def test_documents_and_streams(spark, tmp_path):
    import json

    rows = spark.createDataFrame([('a "b"\\', 1, 0.1, None, True), (None, None, math.nan, 2.0, None)], "s string, n long, x double, y double, b boolean")
    got = [r.document for r in documents.json_result(rows).collect()]
    assert got[0] == '{"s":"a \\"b\\"\\\\","n":1,"x":0.100000000000,"y":null,"b":true}' and json.loads(got[1]) == {"s": None, "n": None, "x": None, "y": 2.0, "b": None}
    documents.write_csv(rows.select("n", "x"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).na.fill("-").collect()) == [("-", "-"), ("1", "0.100000000")]
    stream = rng.raw_stream(spark, 0x123456789ABCDEF0, 4, 2)
    rng.stream_lines(stream, str(tmp_path / "words"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "words")).collect()].__len__() == 4
    assert [r.raw.upper() for r in stream.orderBy("position").collect()] == ["092C9B4478384BC0", "392FD6B226FC076C", "389D999A609CF517", "EACE5522A93BE4CF"]


def test_command_line(spark, tmp_path, capsys):
    import json

    from martingrid import __main__ as cli

    cli.main(["--scenarios", "2000", "--seed", "3"])
    assert json.loads(capsys.readouterr().out)["n"] == 2000
    cli.main(["--scenarios", "2000", "--seed", "3", "--folder", str(tmp_path / "run")])
    assert json.loads(capsys.readouterr().out)["status"] == "Completed"
    for bad in (["--scenarios", "+5"], ["--spot", "1e999"], ["--seed", "1 "]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


@pytest.mark.parametrize("spread", [3, 50, 100_000])
def test_order_statistics_equal_plain_ones(spark, spread):
    rng_ = np.random.default_rng(spread)
    group = rng_.choice(np.array(["a", "b", "c", None], object), 4_000, p=[0.6, 0.3, 0.05, 0.05])
    value = np.round(rng_.normal(size=4_000) * spread)
    rows = [(g, None if v % 7 == 3 else float(v), bool(i % 2)) for i, (g, v) in enumerate(zip(group, value, strict=True))]
    rows += [("void", None, True), ("one", 5.0, True), ("same", 2.0, False), ("same", 2.0, True), ("high", float("inf"), True)]
    df = spark.createDataFrame(rows, "g string, v double, first boolean")
    held = {g: sorted(v for k, v, _ in rows if k == g and v is not None) for g in {r[0] for r in rows}}
    at = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)

    ranked = {r["g"]: r for r in gate.nearest_rank(df, "g", "v").collect()}
    for g, v in held.items():
        v = [x for x in v if x]
        if not v:
            assert g not in ranked
            continue
        want = [next(x for i, x in enumerate(v, 1) if i / len(v) >= p) for p in (0.5, 0.95, 0.99)]
        assert [ranked[g][c] for c in ("n", "p50", "p95", "p99")] == [len(v), *want]

    smooth = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", at).collect()}
    spread_ = {r["g"]: r for r in gate.median_deviation(df, "g", "v").collect()}
    assert set(smooth) == set(spread_) == set(held)
    for g, v in held.items():
        assert smooth[g]["total"] == len(v)
        if not v:
            assert smooth[g]["q2"] is None and spread_[g]["median"] is None and spread_[g]["mad"] is None
        elif g != "high":
            assert [smooth[g][f"q{i}"] for i in range(len(at))] == pytest.approx(np.quantile(v, at).tolist(), abs=1e-9)
            assert spread_[g]["mad"] == pytest.approx(np.median(np.abs(np.array(v) - np.median(v))), abs=1e-9)
    assert smooth["high"]["q2"] == float("inf")

    effect = {r["g"]: r["effect"] for r in gate.order_effect(df, "g", "first", "v").collect()}
    for g in held:
        parts = [[v for k, v, f in rows if k == g and f is side and v is not None] for side in (True, False)]
        assert effect[g] == (pytest.approx(np.median(parts[0]) - np.median(parts[1]), abs=1e-9) if all(parts) else None)
    assert gate.linear_quantiles(df.limit(0), "g", "v").count() == 0
