import hashlib
import random
import re
import zlib

import numpy as np

from martingrid.llm import catalog, periodic


def plain_runs(w, least):
    """Every period on its own: stretches of equal words q apart, less those of a shorter period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, 2 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 60), rng.randint(1, 4)
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n > 4:
                a, p = rng.randrange(n), rng.randint(1, 8)
                w = [w[i] if i < a else w[a + (i - a) % p] if a + p <= n else 0 for i in range(n)]
            texts.append(w)
        least = rng.choice([2, 4, 12])
        found = periodic.runs([np.array(w, dtype=np.int64) for w in texts], least)
        for w, f in zip(texts, found, strict=True):
            assert [tuple(r) for r in f.tolist()] == plain_runs(w, least)


def test_words_of_fibonacci_and_one_letter():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    for w in (b, [7] * 500, list(range(300)) * 2, [0, 1] * 100 + [1] + [0, 1] * 100):
        assert [tuple(r) for r in periodic.runs([np.array(w)])[0].tolist()] == plain_runs(w, 12)


def test_wide_keys_sort_alike():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 50, 200) for _ in range(2)] + [np.arange(200)]
    for a, b in zip(periodic._ordered(8, *parts), periodic._ordered(40, *parts), strict=True):
        assert (a == b).all()


def test_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \t\n", "a " * 11, "a " * 12, "\xa0 x y " * 9, f"{line} {line} tail", f"x {line}\n{line}\x0b{line} w0 y", "one", "é\x00 " * 20]
    rows = [(i, t, "x") for i, t in enumerate(texts * 4)] + [(3, "b " * 30, "x"), (3, "b " * 30, "x"), (None, "c " * 30, "x"), (-5, " ".join(str(i % 97) for i in range(40_000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    want = sorted((plain(*r[:2]) for r in rows[:-1]), key=repr)
    for block in (1, 50, 1 << 20):
        got = [tuple(r) for r in periodic.find_runs(df, block).collect()]
        assert sorted((r for r in got if r[0] != -5), key=repr) == want
        long = next(r for r in got if r[0] == -5)
        assert long[:6] == (-5, 1, 0, 40_000, 97, 412_371)
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    some = [r for r in rows if len((r.text or "").split()) < 400]
    got = {r.doc_id: tuple(r) for r in catalog.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows) and len(some) > 100
    assert [got[r.doc_id] for r in some] == [plain(r.doc_id, r.text) for r in some]
