"""Results judged as they arrive: any split into micro-batches gives what the batch gives."""

import random

import pytest

from martingrid.functions import codec
from martingrid.operators import validation
from martingrid.streaming import arrivals

RUN = {"run_hash": "r", "layout_hash": "l", "build": "b", "incarnation": 2, "rng_version": 2, "stats_schema": 1}
SCHEMA = "block_id long, start_scenario long, end_scenario long, lease_epoch int, run_hash string, layout_hash string, build string, incarnation int, rng_version int, stats_schema int, n long, mean double, m2 double, min double, max double, arrival long"
KEY = ["block_id", "arrival", "status"]


def sent(spark, seed):
    """Up to six results of each of nine blocks and of none, in order of arrival."""
    rng, rows = random.Random(seed), []
    for arrival in range(60):
        b = rng.choice([*range(9), None, 77])
        lease, low = rng.choice([1, 1, 1, 0, None]), rng.choice([0.0, 0.0, 0.0, -1.0])
        rows.append((b, (b or 0) * 10, (b or 0) * 10 + 10, lease, rng.choice("rrrrrx"), "l", "b", rng.choice([2, 2, 2, 2, 1]), 2, 1, rng.choice([10, 10, 10, None]), 1.0, 1.0, low, 2.0, arrival))
    return codec.with_checksum(spark.createDataFrame(rows, SCHEMA)).selectExpr("*", "'extra' as status", "arrival as code_of_mine")


def known(spark):
    blocks = spark.range(9).selectExpr("id as block_id", "id * 10 as start_scenario", "id * 10 + 10 as end_scenario", "1 as lease_epoch")
    return blocks, spark.createDataFrame([(0, "other"), (1, None)], "block_id long, checksum string").where("checksum is not null")


def plain(results, committed):
    """One result after another."""
    done, out = {r.block_id: r.checksum for r in committed}, []
    for r in sorted(results, key=lambda r: r.arrival):
        status = r.status
        if status in ("Accepted", "StaleLease") and r.block_id in done:
            status = "Duplicate" if done[r.block_id] == r.checksum else "DeterminismError"
        elif status == "Accepted":
            done[r.block_id] = r.checksum
        out.append((r.block_id, r.arrival, status))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cuts", [[60], [7, 8, 31, 60]])
def test_any_split_equals_the_batch(spark, tmp_path, cuts):
    results, (blocks, committed) = sent(spark, 5), known(spark)
    want = plain(validation.screen(results, blocks, RUN).collect(), committed.collect())
    batch = validation.judge_arrivals(results, blocks, committed, RUN)
    assert sorted((tuple(r) for r in batch.select(KEY).collect()), key=repr) == want
    assert {w[2] for w in want} >= {"Accepted", "Duplicate", "DeterminismError", "StaleLease", "InvalidRun", "StaleIncarnation", "InvalidBlock", "InvalidAggregate"}
    got = None
    for half in (cuts[: len(cuts) // 2], cuts[len(cuts) // 2 :]):  # the stream is started twice: the second goes on after the first
        for cut in half:
            low = max([c for c in cuts if c < cut], default=0)
            results.where(f"arrival >= {low} and arrival < {cut}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/sent")
        if half:
            stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/sent")
            got = arrivals.run_to_end(arrivals.judge_stream(stream, blocks, committed, RUN), str(tmp_path))
    assert sorted((tuple(r) for r in got.select(KEY).collect()), key=repr) == want
    assert got.columns == batch.columns and got.where("code is null or benign is null").count() == 0


def test_null_arrival_raises(spark, tmp_path):
    results, (blocks, committed) = sent(spark, 6), known(spark)
    results.selectExpr("* except (arrival)", "nullif(arrival, 3) as arrival").coalesce(1).write.parquet(f"{tmp_path}/sent")
    stream = spark.readStream.schema(results.schema).parquet(f"{tmp_path}/sent")
    with pytest.raises(Exception, match="no arrival number"):
        arrivals.run_to_end(arrivals.judge_stream(stream, blocks, committed, RUN), str(tmp_path))


def test_state_is_pages_of_blocks(spark, tmp_path):
    """2,500 blocks are three keys of state, not one each; only the columns asked for are given."""
    rows = spark.range(2_500).selectExpr("id as block_id", "id * 10 as start_scenario", "id * 10 + 10 as end_scenario", "1 as lease_epoch", "'r' as run_hash", "'l' as layout_hash", "'b' as build", "2 as incarnation", "2 as rng_version", "1 as stats_schema", "10L as n", "1D as mean", "1D as m2", "0D as min", "2D as max", "0L as arrival")
    codec.with_checksum(rows).coalesce(1).write.parquet(f"{tmp_path}/sent")
    stored = spark.read.parquet(f"{tmp_path}/sent")
    blocks, committed = spark.range(2_500).selectExpr("id as block_id", "id * 10 as start_scenario", "id * 10 + 10 as end_scenario", "1 as lease_epoch"), stored.where("block_id % 5 = 0").selectExpr("block_id", "if(block_id % 2 = 0, checksum, 'other') as checksum")
    stream = spark.readStream.schema(stored.schema).parquet(f"{tmp_path}/sent")
    got = arrivals.run_to_end(arrivals.judge_stream(stream, blocks, committed, RUN, columns=["block_id"]), str(tmp_path))
    assert got.columns == ["block_id", "status", "code", "benign"]
    assert {r["status"]: r["count"] for r in got.groupBy("status").count().collect()} == {"Accepted": 2_000, "Duplicate": 250, "DeterminismError": 250}
    assert spark.read.format("statestore").option("stateVarName", "page").load(f"{tmp_path}/progress").count() == 3
