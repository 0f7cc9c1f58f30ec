"""Cards in runs of digit groups: against a plain search, there and back, and in linear time."""

import random
import re
import time

from pyspark.sql import functions as F

from martingrid.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_cards(run):
    """(start, text) of the cards of a run, by trying every layout at every group."""
    digits = re.sub("[ -]", "", run)
    if 13 <= len(digits) <= 19 and luhn(digits):
        return [(0, run)]
    layouts = (r"[0-9]{13,19}(?![0-9])", r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}(?![0-9])", r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])")
    out, free = [], 0
    for start in (m.start() for m in re.finditer("[0-9]+", run)):
        tried = (re.match(x, run[start:]) for x in layouts)
        card = next((m.group() for m in tried if m and luhn(re.sub("[ -]", "", m.group()))), None) if start >= free else None
        if card:
            out.append((start, card))
            free = start + len(card)
    return out


def runs(n, seed):
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        groups = []
        for _ in range(draw.randint(1, 6)):
            shape = draw.choice([[4] * 4, [4] * 4 + [draw.randint(1, 3)], [4, 6, 4], [4, 6, 5], [draw.randint(13, 19)], [4], [4, 6], [draw.randint(1, 3)], [25]])
            part = [text(k) for k in shape]
            if draw.random() < 0.7:  # the last digit makes it valid
                part[-1] = next(part[-1][:-1] + d for d in "0123456789" if luhn("".join(part)[:-1] + d) or d == "9")
            groups += part
        out.append("".join(g + draw.choice(" -") for g in groups)[:-1])
    return [x for x in out if len(re.sub("[ -]", "", x)) >= 13]


def test_cards_of_runs_equal_a_plain_search_and_come_back(spark):
    texts = sorted(set(runs(1_500, 3)))
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    new = table.select("i", pii._card(F.col("text"), "k", True).alias("text")).persist()
    back = {r.i: r.text for r in new.select("i", pii._card(F.col("text"), "k", False).alias("text")).collect()}
    got = {r.i: r.text for r in new.collect()}
    assert [texts[i] for i in got] == [back[i] for i in got]
    changed = 0
    for i, t in enumerate(texts):
        old, made = plain_cards(t), plain_cards(got[i])
        assert [(a, len(c)) for a, c in old] == [(a, len(c)) for a, c in made], (t, got[i])
        inside = {k for a, c in old for k in range(a, a + len(c))}
        assert all(x == y for k, (x, y) in enumerate(zip(t, got[i], strict=True)) if k not in inside or not x.isdigit())
        changed += sum(t[a : a + len(c)] != got[i][a : a + len(c)] for a, c in old)
    assert changed > 1_000


def test_a_long_line_of_groups_takes_linear_time(spark):
    draw = random.Random(1)
    line = " ".join(f"{draw.randrange(10_000):04d}" for _ in range(200_000))  # 1 MB
    rows = [(0, line), (1, "4111 1111 1111 1111"), (1, "4111 1111 1111 1111"), (2, "7 " * 300_000 + "4111 1111 1111 1111")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    pii.pseudonymise_documents(table.where("doc_id = 1")).collect()
    start = time.perf_counter()
    got = [(r.doc_id, r.text) for r in pii.pseudonymise_documents(table.repartition(4, "doc_id")).collect()]
    took = time.perf_counter() - start
    by = {i: t for i, t in got}
    assert len(got) == 4 and len({t for i, t in got if i == 1}) == 1 and by[1] != rows[1][1]
    assert by[0] != line and re.sub("[0-9]", "0", by[0]) == re.sub("[0-9]", "0", line) and by[2].startswith("7 " * 299_000)
    back = spark.createDataFrame(list(by.items()), "doc_id long, text string").select("doc_id", pii.pseudonymise(F.col("text"), forward=False).alias("text"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    assert took < 60, took
    print("seconds", took)
