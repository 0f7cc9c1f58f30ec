"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from martingrid.llm import bpe, catalog, quality, simhash
from tests.llm.test_operators import brute_components, brute_repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    base = text(300)
    rows = [(i, text(draw.randint(20, 200)), f"s{i % 3}") for i in range(40)]
    rows += [(50, base, "s0"), (51, base, "s1"), (52, base + " end", None), (53, None, "s1"), (54, "", "s1"), (55, "few words", "s2"), (56, "a b c d e " * 40, "s2")]
    rows += [(57, text(4_000), None), (1, rows[1][1], "s1"), (58, text(60) + "\nmail a.b@example.com and 2024-02-29\n", "s2")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, folder)
    plain = [r for r in docs.collect() if not fails(r.text or "")]
    assert good.columns == docs.columns and Counter(good.collect()) == Counter(plain)
    one = stages["simhash_near_dedup"](spark, good, folder)
    comp = brute_components({r.doc_id: simhash.text_fingerprint(r.text) for r in plain})
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(comp.values()))
    safe = stages["pii_pseudonyms"](spark, one, folder)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert len(texts) == one.count() and "a.b@example.com" not in texts[58] and "2024-02-29" not in texts[58]
    assert all(texts[r.doc_id] == r.text for r in one.collect() if r.doc_id != 58)
    mixed = stages["mix_sources"](spark, safe, folder)
    rows, size = mixed.collect(), {i: len(t.split()) for i, t in texts.items()}
    taken = Counter()
    for r in rows:
        assert f" {' '.join(r.text.split())} " in f" {' '.join(texts[r.doc_id].split())} " and r.n_chars == len(r.text)
        taken[r.doc_id] += len(r.text.split())
    assert mixed.columns == docs.columns and all(taken[i] <= 3 * n for i, n in size.items())
    assert abs(sum(taken.values()) - sum(size.values())) <= 64 * 4
    ids = stages["byte_bpe"](spark, mixed, folder)
    keys = bpe.codec(open(public_tokenizers.path(catalog.VOCABULARY), "rb").read(), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(keys.keys, keys.ids)), special_tokens={})
    want = Counter((r.doc_id, np.array(e.encode_ordinary(r.text), "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in ids.collect()) == want


def fails(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.split()]
    chars, symbols = sum(map(len, words)), sum(c in quality.SYMBOLS for c in text)
    dup = len(lines) - len(set(lines))
    return (
        len(words) < 10 or 100 * brute_repeats(words) > 20 * len(words) or symbols * 10 > len(words) * quality.MAX_SYMBOLS_PER_TEN
        or dup >= quality.MIN_DUP_LINES and dup * 10 > len(lines) * quality.MAX_DUP_LINES_PER_TEN
        or chars < 2 * len(words) or len(text.encode()) * 2 < len(text) * 3 and chars > quality.MAX_WORD_CHARS * len(words)
    )


def test_whole_run_and_empty_table(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, str(folder))
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 0
    again = corpus_pipeline.run(spark, str(folder))
    assert Counter(map(str, got.drop("ids").collect())) == Counter(map(str, again.drop("ids").collect()))
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
