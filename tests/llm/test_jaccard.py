import random
import re

import duckdb
import numpy as np

from martingrid.llm import catalog, jaccard, sql

DOCS = "doc_id long, text string, n string"


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def plain(rows, percent=90):
    """All pairs of different sets; (doc_id, size, least id reachable) of each row."""
    sets = [frozenset(plain_set(t)) for _, t in rows]
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    several = list(root)
    for i, a in enumerate(several):
        for b in several[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if doc_id is not None:
            least[find(s)] = min(least.get(find(s), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(s)) if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


def run(spark, rows, **more):
    found = jaccard.similar_sets(spark.createDataFrame([(*r, "x") for r in rows], DOCS), **more)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = [f"new{rng.randrange(9999)}"] * rng.randrange(2)
    return w


def corpus(seed):
    """Chains and clusters of edited texts of all small sizes, around the threshold, with a passage that many share."""
    rng = random.Random(seed)
    passage, rows = [f"p{i}" for i in range(30)], []
    for size in (1, 2, 3, 8, 11, 12, 13, 14, 21, 22, 30, 31, 45, 60, 90, 140):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(7):
            rows.append((len(rows), " ".join(base)))
            base = edited(rng, base, rng.randrange(3)) if size > 8 else base
        rows += [(len(rows) + i, " ".join(passage + [f"q{rng.randrange(400)}" for _ in range(size)])) for i in range(3)]
    return rows


def test_equals_all_pairs(spark):
    rows = corpus(1) + corpus(2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = plain(rows)
    assert run(spark, rows) == want and len({r[2] for r in want}) < len(rows) - 60
    assert run(spark, rows, percent=75) == plain(rows, 75)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(30_000))
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (9, "one\ntwo"), (7, "É x y"), (8, "é x y"), (20, base), (19, base.upper()), (20, base), (20, "other words here"), (21, base + " more"), (None, base), (None, "alone here now"), (31, long), (30, long + " x")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_many_near_copies_make_few_pairs(spark, monkeypatch):
    seen, links = [], jaccard._links

    def counted(pairs, *more):
        seen.append(pairs.select("a", "b").distinct().count())
        return links(pairs, *more)

    monkeypatch.setattr(jaccard, "_links", counted)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:j] + [f"e{i}"] + base[j + 1 :])) for i in range(300) for j in [rng.randrange(200)]]
    got = run(spark, rows)
    assert {r[2] for r in got} == {0} and sum(seen) < 5 * len(rows)  # of 44,850 pairs


def test_sketches_and_keys_lose_no_link():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(9, 400))
        pool = np.unique(rng.integers(0, 1 << 63, n + 80).astype(np.uint64) * np.uint64(2))
        most = int(jaccard.most_different(n, n))
        k = int(rng.integers(0, most // 2 + 1))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[k:n], pool[n : n + k]]))
        differ = len(np.setxor1d(a, b))
        assert np.bitwise_count((jaccard.sketch_of(a) ^ jaccard.sketch_of(b)).view(np.uint64)).sum() <= differ
        if 100 * (2 * n - differ) >= 90 * (2 * n + differ):
            assert len(np.intersect1d(jaccard.keys_of(a), jaccard.keys_of(b)))


def test_equals_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(tuple(r) for r in catalog.op11_ngram_jaccard(spark, sf).collect()) == sorted(con.execute(sql.JACCARD).fetchall())
