import pytest

from martingrid.operators import manifests

HEADS = "run string, sequence long, schema int, incarnation long, block_count long, committed long"
ENTRIES = "run string, sequence long, place long, block_id long, result_incarnation long, lease_epoch long, high_water long"


def frames(spark, heads, entries):
    return spark.createDataFrame(heads, HEADS), spark.createDataFrame(entries, ENTRIES)


def test_each_kind_of_damage(spark):
    good = [(0, 1, 1, 1, 3), (1, 4, 2, 3, 3), (2, 9, 1, 2, 3)]
    cases = {
        None: good, "outside": [*good[:2], (2, 10, 1, 2, 3)], "incarnation": [(0, 1, 3, 3, 3), *good[1:]], "lease": [(0, 1, 1, 4, 3), *good[1:]], "current lease": [good[0], (1, 4, 2, 2, 3), good[2]],
        "order": [good[0], (1, 1, 2, 3, 3), good[2]], "repeated": [*good, good[1]], "missing": good[:2], "place": [*good[:2], (7, 9, 1, 2, 3)],
    }
    heads = [(str(k), 5, 1, 2, 10, 3) for k in cases]
    entries = [(str(k), 5, *e) for k, rows in cases.items() for e in rows]
    got = {r.run: r.problem for r in manifests.manifest_problems(*frames(spark, heads, entries)).collect()}
    assert got == {str(k): k for k in cases}


def test_damage_falls_back_and_policy_raises(spark):
    heads = [("a", s, 1, 1, 9, 1) for s in (1, 2, 3, 4)] + [("b", 1, 1, 1, 9, 1), ("c", 1, 1, 1, 9, 0)]
    entries = [("a", 1, 0, 0, 1, 1, 1), ("a", 2, 0, 3, 1, 1, 1), ("a", 3, 0, 9, 1, 1, 1), ("b", 1, 0, None, 1, 1, 1), ("x", 1, 0, 0, 1, 1, 1)]
    got = sorted(tuple(r) for r in manifests.latest_valid_manifests(*frames(spark, heads, entries)).collect())
    assert got == [("a", 2, 4, 1, 2), ("c", 1, 1, 0, 0)]
    for more in (("a", 9, 2, 1, 9, 1), ("a", 4, 1, 1, 9, 1)):
        with pytest.raises(Exception, match="unknown format|two manifests"):
            manifests.latest_valid_manifests(*frames(spark, [*heads, more], entries)).collect()
    assert manifests.latest_valid_manifests(*frames(spark, [], [])).count() == 0
