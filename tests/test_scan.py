import random

from pyspark.sql import functions as F

from martingrid.operators import scan


def plain_runs(ids):
    out = []
    for i in sorted(set(ids)):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b, b - a + 1, sum(a <= i <= b for i in ids)) for a, b in out]


def test_sums_since_resets_by_group(spark):
    rng = random.Random(3)
    for kinds in (3,):
        rows = [(g if g else None, i, rng.randrange(-3, 9) if rng.random() < 0.9 else None, rng.random() < p, "x") for g, p in zip(range(kinds), (0.01, 0.3, 0.0), strict=False) for i in rng.sample(range(10_000), 700)]
        df = spark.createDataFrame(rows, "g int, at long, amount int, reset boolean, since string").drop("since")
        got = {(r.g, r.at): (r.since, r.resets) for r in scan.since_reset(df.repartition(3), "at", F.col("amount"), F.col("reset"), ["g"]).collect()}
        want, state = {}, {}
        for g, at, amount, reset, _ in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
            total, seen = state.get(g, (0, 0))
            state[g] = (amount or 0, seen + 1) if reset else (total + (amount or 0), seen)
            want[g, at] = state[g]
        assert got == want
    none = df.limit(0)
    assert scan.since_reset(none, "at", F.lit(1), F.lit(False)).count() == 0
    one = scan.since_reset(df.limit(1), "at", F.lit(1), F.lit(None).cast("boolean")).first()
    assert (one.since, one.resets) == (1, 0)


def test_no_window_without_partition(spark):
    plan = scan.since_reset(spark.range(100), "id", F.lit(1), F.col("id") % 7 == 0)._jdf.queryExecution().toString()
    assert "windowspecdefinition(_range" in plan and "SinglePartition" not in plan.split("Physical Plan")[1].split("BroadcastExchange")[0]


def test_interval_sets(spark):
    rng = random.Random(5)
    a = [rng.randrange(-500, 3_000) for _ in range(2_500)] + [7] * 400
    b = [i for i in range(0, 3_100) if i % 97 or i < 1_000]
    sets = [scan.intervals(spark.createDataFrame([(i,) for i in [*x, None]], "i long"), "i") for x in (a, b)]
    runs = [sorted(tuple(r) for r in s.collect()) for s in sets]
    assert runs == [plain_runs(a), plain_runs(b)]
    both = sorted(tuple(r) for r in scan.union(sets[0].unionByName(sets[1])).collect())
    assert both == plain_runs(a + b)
    less = sorted((r.first, r.last) for r in scan.difference(sets[1], sets[0]).collect())
    assert less == [r[:2] for r in plain_runs(set(b) - set(a))]


def test_ten_billion_dense_ids_are_a_few_rows(spark):
    n = 10**10
    parts = spark.createDataFrame([(0, n // 3 - 1), (n // 3, n // 2), (n // 2 + 1, n - 1), (5, 4)], "first long, last long")
    whole = spark.createDataFrame([(0, n - 1)], "first long, last long")
    assert [tuple(r) for r in scan.union(parts).collect()] == [(0, n - 1, n, n)]
    assert tuple(scan.exactly_once(parts, whole).first()) == (n, 0, 0, 0, True)
    flawed = spark.createDataFrame([(1, n // 2), (n // 2, n + 4)], "first long, last long")
    assert tuple(scan.exactly_once(flawed, whole).first()) == (n + 5, 1, 5, 1, False)
    assert tuple(scan.exactly_once(flawed.limit(0), whole).first()) == (0, n, 0, 0, False)
