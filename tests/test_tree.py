import random

import pytest
from pyspark.sql import functions as F

from martingrid.operators.simulate import RunSpec, block_stats, merge_stats, price, reduce_blocks
from martingrid.sources import runs, tree


def plain_tree(leaves):
    """All nodes of a full list of leaves, level by level."""
    out, level = {}, dict(enumerate(leaves))
    k = 0
    while True:
        out |= {(k, p): v for p, v in level.items()}
        if len(level) == 1:
            return out
        level = {p: merge_stats(level[2 * p], level[2 * p + 1]) if 2 * p + 1 in level else level[2 * p] for p in range((len(level) + 1) // 2)}
        k += 1


def test_nodes_grow_in_any_order():
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 8, 13, 40):
        leaves = [(1, rng.random(), 0.0, 0.0, 1.0) for _ in range(n)]
        known, order, made = {}, rng.sample(range(n), n), set()
        while order:
            some, order = order[:3], order[3:]
            known |= {(0, p): leaves[p] for p in some}
            new = tree.grown(known, {(0, p) for p in some}, n, tree.height(n))
            assert not made & set(new)
            made |= set(new)
        assert known == plain_tree(leaves) and tree.height(n) == max(k for k, _ in known)


def test_commits_write_their_own_blocks_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "CHUNK", 3)
    spec = RunSpec(seed=4, scenarios=4_400, block_size=100)
    folder, n = str(tmp_path / "run"), 44
    leaves = block_stats(spark, spec).cache()
    done, rows = [], []
    for s, (low, high) in enumerate(((0, 11), (30, 43), (12, 12), (13, 29)), 1):
        tree.add(spark, folder, s, leaves.where(F.col("block_id").between(low, high)), n, done)
        done.append(s)
        rows.append(spark.read.parquet(f"{folder}/tree/sequence={s}").count())
        assert rows[-1] <= 2 * (high - low + 1) + 2 * tree.height(n) and (tree.root(spark, folder, done, n) is None) == (s < 4)
    assert sum(rows) == sum(tree.width(n, k) for k in range(tree.height(n) + 1))
    whole = reduce_blocks(leaves, n).first()
    assert tree.root(spark, folder, done, n) == tuple(whole[c] for c in tree.VALUES)
    assert tree.differing(spark, folder, done, leaves, n).count() == 0
    other = leaves.withColumn("mean", F.when(F.col("block_id") == 5, F.col("mean") * (1 + 1e-9)).otherwise(F.col("mean")))
    assert {tuple(r) for r in tree.differing(spark, folder, done, other, n).collect()} >= {(0, 5), (tree.height(n), 0)}
    assert tree.differing(spark, folder, done[:-1], leaves, n).count() > 17


def test_runs_recover_from_damage_of_any_part(spark, tmp_path):
    spec, folder = RunSpec(seed=8, scenarios=1_000, block_size=125), str(tmp_path / "run")
    runs.run_durable(spark, spec, folder, 2, max_batches=3)
    assert [h.added for h in runs.heads(spark, folder)] == [2, 2, 2, 0]
    newest = runs.heads(spark, folder)[0]
    nodes = f"{folder}/tree/sequence={newest.sequence}"
    spark.createDataFrame(spark.read.parquet(nodes).where("level = 0 or position > 9").collect(), tree.NODE).write.mode("overwrite").parquet(nodes)
    assert runs.latest_valid(spark, folder, 8).committed == 4
    done = runs.run_durable(spark, spec, folder, 2).first()
    assert (done.status, done.recovered, done.computed) == ("Completed", 4, 4) and done["mean"] == price(spark, spec).first()["price"]
    sequence = runs.compact(spark, spec, folder)
    head = runs.latest_valid(spark, folder, 8)
    assert (head.sequence, head.base, head.added, head.status) == (sequence, 0, 8, "Completed")
    assert runs.run_durable(spark, spec, folder, 2).first().computed == 0


def test_small_batches_share_their_jobs(spark, tmp_path):
    spec, sc, took = RunSpec(seed=8, scenarios=4_000, block_size=100), spark.sparkContext, {}
    for batches in (4, 40):
        sc.setJobGroup(f"batches-{batches}", "")
        runs.run_durable(spark, spec, str(tmp_path / str(batches)), 40 // batches)
        took[batches] = len(sc.statusTracker().getJobIdsForGroup(f"batches-{batches}"))
    sc.setJobGroup("others", "")
    assert [h.added for h in runs.heads(spark, str(tmp_path / "40"))] == [0, *[1] * 40, 0]
    assert took[40] < 2 * took[4]


def test_manifests_of_one_wave_hold_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "CHUNK", 2)
    monkeypatch.setattr(runs, "WAVE_BATCHES", 4)
    spec, folder = RunSpec(seed=8, scenarios=2_900, block_size=100), str(tmp_path / "run")
    done = runs.run_durable(spark, spec, folder, 3).first()
    assert (done.status, done.computed, done["mean"]) == ("Completed", 29, price(spark, spec).first()["price"])
    known = runs.heads(spark, folder)
    assert [h.committed for h in known] == [29, 29, *range(27, -1, -3)]
    assert all(runs.is_valid(spark, folder, h, 29, known) for h in known if h.sequence in (4, 8, 12))


def test_a_bad_block_fails_the_run_after_the_batches_before_it(spark, tmp_path, monkeypatch):
    right = runs.validate_results
    spoilt = lambda *a: right(*a).withColumn("status", F.when(F.col("block_id") == 5, "DeterminismError").otherwise(F.col("status"))).withColumn("benign", F.lit(False))
    monkeypatch.setattr(runs, "validate_results", spoilt)
    spec, folder = RunSpec(seed=8, scenarios=1_000, block_size=125), str(tmp_path / "run")
    for _ in range(2):
        with pytest.raises(runs.RunError, match="block 5: DeterminismError"):
            runs.run_durable(spark, spec, folder, 2)
        assert [(h.status, h.committed) for h in runs.heads(spark, folder)] == [("Failed", 4), ("Running", 4), ("Running", 2), ("Running", 0)]
