import hashlib
import pickle
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from martingrid.llm import bpe, catalog, chat, langid, licences, mixing, pii, quality, simhash, transport, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, "call +1 (974) 555-3436 or pa.90@mail2.example.com about 4111 1111 1111 1111 on 2024-02-29"), (7, "a b c d e " * 30), (7, "a b c d e " * 30)]
    return spark.createDataFrame([(i, t, "en", "s" if i < 4 else None, len(t or ""), "x") for i, t in rows], DOCS)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark, docs):
    text = "x 4111111111111111 y 4111111111111112 z 10.0.0.255 999.1.1.1 123-45-6789 +1 (974) 555-3436 Jo.9@a.example.com 2024-02-29 2023-02-29 " + "ab" * 20
    row = spark.createDataFrame([(text,), (text + " tail",), (None,), ("",)], "text string")
    got = [r[0] for r in row.select(pii.pseudonymise(F.col("text"))).collect()]
    a = got[0].split()
    assert got[1] == got[0] + " tail" and got[2] is None and got[3] == ""
    old = text.split()
    assert luhn(a[1]) and a[1] != old[1] and len(a[1]) == 16
    assert a[3] == old[3] and a[6] == old[6], "numbers that are not valid stay"
    assert "2023-02-29" in a and "2024-02-29" not in a and a[-1] != old[-1] and len(a[-1]) == 40
    back = spark.createDataFrame([(got[0],)], "text string").select(pii.pseudonymise(F.col("text"), forward=False)).first()[0]
    assert back == text
    assert pii.pseudonymise_documents(docs).columns == docs.columns


def test_ip_permutation_is_one_to_one(spark):
    ips = spark.range(2_000).select(F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("id") / 256).cast("int").cast("string"), (F.col("id") % 256).cast("string")).alias("t"))
    assert ips.select(pii.pseudonymise(F.col("t")).alias("p")).distinct().count() == 2_000


PERSONAL = [
    "+1 (017) 555-7713", "+1 (132) 555-1352", "555-123-4567", "(212) 555-0100", "212.555.0100", "1-800-555-0100", "+1 212 555 0100", "+44 20 7946 0958", "+442079460958",
    "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "0x" + "ab12" * 10, "aB3" * 20, "0f" * 50, "1066-10-14", "2024-02-29", "31/12/2024", "12/31/2024", "2024/02/29", "29.02.2024",
    "4465758382889437", "4111 1111 1111 1111", "3782 822463 10005", "4111-1111-1111-1111",
]


def test_personal_data_of_every_format_goes_and_comes_back(spark):
    texts = [f"x {p} y" for p in PERSONAL] + ["seen 2024-02-29T10:00:00Z", "a 42 4465758382889437 b", "a 2024 4111 1111 1111 1111 b", "a 4111 1111 1111 1111 123 b", "a 4111 1111 1111 1111 2024-02-29 b"]
    kept = ["a 99/99/2024 b", "v 1.2.3 of 30.02.2024", "n 4111 1111 1111 1112 m", "deadbeef", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts + kept)], "i int, text string")
    got = [r.text for r in pii.pseudonymise_documents(table).orderBy("i").collect()]
    gone = PERSONAL + ["2024-02-29", "4465758382889437", "4111 1111 1111 1111", "4111 1111 1111 1111", "4111 1111 1111 1111"]
    assert [t for t, p, g in zip(texts, gone, got) if p in g] == [] and got[len(texts) :] == kept
    assert "2024-02-29" not in got[len(texts) - 1]
    assert [re.sub("[0-9A-Fa-f]", "0", g) for g in got] == [re.sub("[0-9A-Fa-f]", "0", t) for t in texts + kept], "the format stays"
    back = spark.createDataFrame(list(enumerate(got)), "i int, text string").select("i", pii.pseudonymise(F.col("text"), forward=False).alias("text"))
    assert [r.text for r in back.orderBy("i").collect()] == texts + kept


def test_long_runs_and_odd_tables(spark):
    texts = ["x@" + "a." * 40_000 + "com y", "x@" + "a." * 40_000, "1 2 " * 300, "+" * 20_000, "a" * 100_000 + "@b.example.com", None, ""]
    table = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, m string")
    got = {r.doc_id: r.text for r in pii.pseudonymise_documents(table).collect()}
    assert got[0] != texts[0] and got[0].endswith("a.com y") and [got[i] for i in (1, 2, 3, 5, 6)] == [texts[i] for i in (1, 2, 3, 5, 6)]
    assert pii.pseudonymise_documents(table.limit(0)).count() == 0


def test_late_dates_are_one_to_one(spark):
    days = spark.range(146_097).select(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12").select(F.date_format("d", "dd/MM/yyyy").alias("t"))
    made = days.select(pii._late_date(F.col("t"), "k", True, "dd/MM/yyyy").alias("p")).persist()
    assert made.distinct().count() == days.count() == 88_497 and made.join(days, made.p == days.t).count() == 88_497


def brute_repeats(words):
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(5)})


def test_quality(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        w = (r.text or "").split()
        assert got[r.doc_id].n_words == len(w) and got[r.doc_id].n_repeat_words == brute_repeats(w)
    assert got[1].kept and not got[4].kept and not got[7].kept
    assert {r.doc_id for r in quality.keep_good(docs).collect()} >= {1, 2, 3}
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_cascade_order(spark):
    """Costly rules with few rejections come last; a rule whose rejections an earlier one has already made comes behind."""
    rules = [quality.Rule(n, lambda c: c["n_words"] < 0) for n in "abc"]
    verdicts = {(True, True, False): 50, (False, False, True): 10, (False, False, False): 40}
    assert [m.rule.name for m in quality.order(rules, [2.0, 1.0, 1.0], verdicts)] == ["b", "c", "a"]
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 40 + 5)) + " word" * 3) for i in range(800)], "doc_id long, text string")
    slow = quality.Rule("slow", lambda c: (c["n_repeat_words"] + c["n_dup_lines"]) > 10_000)
    quick = quality.Rule("quick", lambda c: c["n_words"] < 30)
    assert [m.rule.name for m in quality.measure(docs, [slow, quick])] == ["quick", "slow"]
    assert [m.rule.name for m in quality.measure(docs.limit(0), [slow, quick])] == ["slow", "quick"]


def test_quality_equals_duckdb(spark, tmp_path):
    import duckdb

    from martingrid.llm import sql

    draw = random.Random(4)
    texts = [None, "", " \n ", "x\n" * 30, "汉字" * 200 + " 汉" * 12, "#a " * 30, "a" * 900 + " b" * 11]
    texts += ["\n".join(" ".join(draw.choices("ab cd efg hi $ é".split(), k=draw.randint(0, 8))) for _ in range(draw.randint(1, 12))) for _ in range(60)]
    docs = spark.createDataFrame([(i % 60, t, i) for i, t in enumerate(texts)], "doc_id long, text string, w int")
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = quality.judge(docs)
    want = con.execute(sql.QUALITY)
    names = [c[0] for c in want.description]
    assert sorted(map(str, [tuple(r[n] for n in names) for r in got.collect()])) == sorted(map(str, want.fetchall()))


def test_transport_round_trip(docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in transport.digests(docs).collect():
        assert r.payload_sha256 == hashlib.sha256(transport.pad(texts[r.doc_id])).hexdigest() and "continuity_errors=0" in r.feature
    assert {r.error for r in transport.digests(docs).collect()} == {None} and transport.digests(docs.limit(0)).count() == 0
    media = transport.mux(bytes(range(256)) * 90)
    assert transport.demux(media[: 5 * 188] + media[6 * 188 :]).continuity_errors == 1


def test_damaged_streams_say_so(spark):
    media = transport.mux(bytes(range(256)) * 90)
    packet = bytearray(media[4 * 188 : 5 * 188])
    packet[3], packet[4] = packet[3] | 0x20, 250  # an adaptation field longer than the packet
    odd = [media, media[:-7], b"x" + media[1:], media[: 4 * 188] + bytes(packet) + media[5 * 188 :], media[3 * 188 :], b"", b"no stream at all", media[: 2 * 188] + b"\x47\x41\0\x30\xb7" + bytes(183) + media[2 * 188 :], None]
    table = spark.createDataFrame([(i, None if m is None else bytearray(m), "x") for i, m in enumerate(odd)], "doc_id long, media binary, error string")
    got = {r.doc_id: r for r in transport.parse(table).collect()}
    assert got[0].error is None and bytes(got[0].payload) == bytes(range(256)) * 90 and all(got[i].error for i in (1, 2, 3, 6, 7)) and got[8].payload is None
    assert got[5].error is None and bytes(got[5].payload) == b""


def test_language(spark, docs):
    words = {"en": "the and of with this that", "de": "und der die nicht ein auch"}
    rows = [(" ".join(np.random.default_rng(i).permutation(words[y].split() * 3)), y) for i in range(40) for y in words]
    m = langid.fit(rows)
    assert m.predict("und die der ein")[0] == "de" and m.predict("this of the")[0] == "en"
    assert m.predict(None) == (langid.UNKNOWN, 0.0, True) and m.predict("123 !")[0] == langid.UNKNOWN
    assert langid.predict(docs, m).count() == docs.count() and langid.predict(docs.limit(0), m).count() == 0
    none = langid.fit([])
    assert none.predict("und die") == (langid.UNKNOWN, 0.0, True)
    table = spark.createDataFrame([*rows, (None, "en"), ("x y", None), *rows[:2] * 30], "text string, lang string")
    a, b = langid.train(table), langid.train(table.repartition(5))
    assert a.languages == ["de", "en"] and np.array_equal(a.embed, b.embed) and a.least == b.least
    few = langid.train(table.where("lang = 'de'").union(table.where("lang = 'en'").limit(3)), max_rows=8)
    assert few.languages == ["de", "en"], "a rare language has its share"


def test_language_pieces_cover_the_whole_text():
    text = " ".join(f"wort{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(676)) * 3
    rng = np.random.default_rng(1)
    found = list(langid.pieces_of(text, rng))
    at = [text.index(" ".join(re.findall(r"[a-z]+", p))[:6]) for p in found]
    assert len(found) == langid.MAX_PIECES and all(p for p in found) and " ".join(found[-1].split()[:3]) in text[len(text) * 18 // 20 :] and at


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = catalog.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    r = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    assert r[0] > 0.95 and r[1] < 0.3


def test_language_features():
    for text in ("ab c", "", "123", "a", " żółć, d'été x1y  zz"):
        words = re.findall(r"[^\W\d_]+", text)
        own = [len(w) + 1 + sum(max(0, len(w) + 3 - n) for n in (2, 3, 4)) for w in words]
        assert np.bincount(langid._features(text)[1], minlength=len(own)).tolist() == own
    assert sorted(langid._features("un deux")[0]) == sorted(langid._features("deux  un")[0])
    m = langid.fit([("un deux", "fr"), ("one two", "en")])
    assert np.allclose(m.mean("un deux " * 300_000), m.mean("un deux"))


def test_bpe_without_builtin_form():
    assert bpe.builtin_pattern(r"(?i:a)|\p{Lu}") is None and re.compile(bpe.builtin_pattern(public_tokenizers.PATTERN))


def test_chat(spark):
    rows = [(1, 0, "user", catalog.TRAP), (1, 1, "assistant", "a<\\|b"), (1, 100, "assistant", None), (1, 101, "assistant", "c\n<|im_sep|>"), (2, None, None, "x"), (2, 1, "us\ner", "")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in made.withColumn("turns", chat.read_turns(F.col("formatted"))).collect():
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
    for r in made.collect():
        said = "".join(r.formatted[s.start : s.start + s.length] for s in r.loss_spans)
        assert re.sub(r"<\\(\\*)\|", r"<\1|", said) == "".join(x[3] or "" for x in rows if x[0] == r.conv_id and x[2] == "assistant")
    assert chat.digests(made.limit(0)).count() == 0
    same = chat.format_chats(spark.createDataFrame([(None, 3, "user", f"t{i}") for i in (2, 1, 1)], "conv_id long, turn long, role string, text string")).first()
    assert same.formatted == "<|im_start|>user\nt1<|im_sep|>t1<|im_sep|>t2<|im_end|>\n"
    d = {r.conv_id: r for r in chat.digests(made).collect()}
    assert d[1].loss_sha256 == hashlib.sha256("a<\\|bc\n<|im_sep|>".encode()).hexdigest() and d[1].n_turns == 4


def test_bpe_equals_tiktoken(docs):
    path = public_tokenizers.path(catalog.VOCABULARY)
    c = bpe.codec(open(path, "rb").read(), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(c.keys, c.ids)), special_tokens={})
    c = pickle.loads(pickle.dumps(c))
    draw = random.Random(1)
    letters = [*map(chr, range(1, 0x250)), *map(chr, (0x2028, 0x3000, 0x1F600, 0x10400, 0x660, 0x200D)), *" " * 200, *"'strevmld" * 20]
    strange = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(2_000)]
    for t in [*strange, *(r.text or "" for r in docs.collect()), "z" * 3000, "日本 🎉", "<|endoftext|>", " \n\n x"]:
        assert c.encode(t) == np.array(e.encode_ordinary(t), "<u4").tobytes() and c.decode(c.encode(t)) == t.encode()


def test_bpe_query_equals_tiktoken(spark, monkeypatch):
    """The query's rows, long texts and a memo that overflows within a text included."""
    path = public_tokenizers.path(catalog.VOCABULARY)
    keys = bpe.codec(open(path, "rb").read(), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(keys.keys, keys.ids)), special_tokens={})
    draw = random.Random(2)
    long = " ".join("".join(draw.choices("abcdeé ", k=6)) for _ in range(30_000))
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x"), (4, long), (5, " " * 5_000 + "\n" + "ab" * 4_000)]
    docs = spark.createDataFrame([(i, t, b"own", 7) for i, t in rows], "doc_id long, text string, decoded binary, ids int")
    got = sorted(map(tuple, bpe.round_trip(docs, path, public_tokenizers.PATTERN).drop("ids").collect()), key=str)
    ids = [np.array(e.encode_ordinary(t or ""), "<u4").tobytes() for _, t in rows]
    want = [(i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in zip(rows, ids)]
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    monkeypatch.setattr(bpe, "REMEMBERED", 5_000)
    monkeypatch.setattr(bpe, "SPLIT_AT_ONCE", 100)
    monkeypatch.setattr(bpe, "MATCHES", 7)
    small = pickle.loads(pickle.dumps(keys))
    assert small.encode(long) == ids[5] and sum(map(len, small.memo.values())) < 5_000


def test_licences(spark):
    rows = [(1, "RELEASED under the mit licence"), (2, "Copyright 2020 Me\nReleased under the MIT License."), (3, "text\nLicensed under CC BY 4.0."), (4, None), (None, "plain")]
    got = {r.doc_id: (r.whole_licence, r.notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("MIT", "MIT"), 3: (None, "CC-BY-4.0"), 4: (None, ""), None: (None, "")}


def test_licences_of_odd_texts(spark):
    rows = [
        (1, "Кириллический документ.\nCopyright 2020 Me\nReleased under the MIT License."), (2, "licence licence x"), (3, "non-commercial sub licences https"),
        (4, "-\n" * 20_000), (5, "---- All rights reserved\nИ слово"), (6, "(" * 50_000),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    canon = {r.doc_id: r.c for r in table.select("doc_id", licences.canonical(F.col("text")).alias("c")).collect()}
    assert canon == {1: "кириллический документ released under the mit license", 2: "license license x", 3: "noncommercial sublicenses http", 4: "", 5: "и слово", 6: ""}
    own = spark.createDataFrame([(hashlib.sha256(b"license license x").hexdigest(), "own", 1, 2)], "digest string, licence string, id int, whole int")
    got = {r.doc_id: (r.whole_licence, r.notices) for r in licences.scan(table, own).collect()}
    assert got[2] == ("own", "own") and got[1] == (None, "") and licences.scan(table.limit(0)).count() == 0
    assert {r.doc_id: r.notices for r in licences.scan(table).collect()}[1] == "MIT"


def test_full_licences_at_any_width(spark):
    import textwrap

    texts = dict([(n, x) for n, x in licences.KNOWN if n == "ISC"] + licences.full_texts()[::-1])
    # paragraphs with a copyright clause keep their lines, for the clause ends with its line
    wrap = lambda x, w: "\n\n".join(p if re.search(r"copyright \(c\)|copyright \d", p, re.I) else textwrap.fill(" ".join(p.split()), w, break_on_hyphens=False) for p in x.split("\n\n"))
    want = {(n, w): wrap(texts[n], w) for n in sorted(texts) for w in (50, 72, 80)}
    rows = [(f"{n} {w}", "Copyright (c) 2020 Foo Inc. and others\n\n" + x) for (n, w), x in want.items()]
    rows += [("in", "Some words.\n\n" + wrap(texts["MIT"], 70) + "\n\nMore words."), ("line", "Copyright 2024 X. Released under the MIT License."), ("part", texts["MIT"].split("\n\n")[0])]
    got = {r.doc_id: (r.whole_licence, r.notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause"} <= set(texts)
    assert [k for k in want if got[f"{k[0]} {k[1]}"][0] != k[0]] == []
    assert got["line"] == ("MIT", "MIT") and got["in"][0] is None and "MIT" in got["in"][1] and got["part"][0] is None and got["part"][1] == "MIT"


def test_pages(spark):
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav><div class=\"ad\">Buy</div><article><h1>Head</h1><p>A&amp;B <b>bold<br><p>two\n three</p><aside>side</aside></article><footer>F</footer></body></html>"
    rows = [(1, "http://h.example/1", page), (2, "http://h.example/2", page.replace("two", "other")), (3, None, None), (4, "x", "")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head A&B bold two three", 2: "Head A&B bold other three", 3: "", 4: ""}


def test_pages_of_telling_wrappers_and_odd_markup(spark):
    import time

    pages = [
        '<body class="no-sidebar"><p>one</p></body>', '<article class="post share-enabled"><p>two</p><div class="share">x</div></article>',
        '<form><div class="has-sidebar"><main><p>three</p></main></div></form>', '<main><p>four</p></main><div class="comments"><article class="comment"><p>x</p></article></div>',
    ]
    rows = [(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)] + [(9, None, None), (9, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in wrappers.extract(table).collect())
    assert got == [(0, "one"), (1, "two"), (2, "three"), (3, "four"), (9, ""), (9, "")] and wrappers.extract(table.limit(0)).count() == 0
    for odd in ("<a", "<!", '<a "', "<a '\""):
        start = time.perf_counter()
        wrappers.main_text(odd * 60_000, [])
        assert time.perf_counter() - start < 5


def test_pages_are_read_through_their_wrapper(spark):
    wide = "".join(f'<section id="s{i}"><p>part {{0}} of {i}</p></section>' for i in range(2_100))
    body = '<div class="top">Our paper</div><div class="story"><p>first of {0}</p><p>second of {0}</p></div><div class="end">All rights {1}</div>'
    page = lambda x, n: f"<html><body>{x.format(n, 'reserved')}</body></html>"
    rows = [(i, "http://a.example/", page(body, i)) for i in range(4)]
    rows += [(4, "http://a.example/", page("<article><p>own {0}</p></article>", 4))]  # another page's article takes nothing away
    rows += [(i, "http://b.example/", page(wide + "<p>always</p>", i)) for i in range(5, 9)]  # over 2,000 slots
    rows += [(i, "http://c.example/", page(body, 0)) for i in range(9, 13)]  # copies of one page say nothing
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(table).collect()}
    assert all(got[i] == f"first of {i} second of {i}" for i in range(4)) and got[4] == "own 4"
    assert all(got[i] == " ".join(f"part {i} of {k}" for k in range(2_100)) for i in range(5, 9))
    assert all(got[i] == "Our paper first of 0 second of 0 All rights reserved" for i in range(9, 13))
    assert got == {r.page_id: r.text for r in wrappers.extract(table.repartition(7)).collect()}


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_components(prints):
    """Component of each id by comparing all pairs."""
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if comp[b] < comp[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    comp[a], changed = comp[b], True
    return comp


@pytest.mark.parametrize("crowd", [simhash.CROWD, 4, 1])
def test_links_equal_brute_force(spark, crowd):
    """Chains of 4-bit steps, a dense cluster and one key with many fingerprints apart, by every way that crowded keys go."""
    draw = random.Random(5)
    flip = lambda x, n, bits=range(64): x ^ sum(1 << b for b in draw.sample(list(bits), n))
    found = [draw.getrandbits(64) for _ in range(60)]
    for _ in range(4):
        found.append(draw.getrandbits(64))
        for _ in range(8):
            found.append(flip(found[-1], draw.choice([3, 4, 4, 5])))
    centre = draw.getrandbits(64)
    found += [flip(centre, draw.randint(1, 3)) for _ in range(40)] + [flip(centre, draw.randint(4, 9), range(39, 64)) for _ in range(60)]
    prints = dict(enumerate(dict.fromkeys(found)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x), i) for i, x in prints.items()], "fp long, rep long").repartition(3)
    got = {r.rep: r.component for r in simhash.links(table, crowd).collect()}
    assert {i: got.get(i, i) for i in prints} == brute_components(prints)


def test_near_duplicates(spark, docs):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    prints = {r.doc_id: simhash.text_fingerprint(r.text) for r in docs.collect()}
    comp = brute_components(prints)
    assert sorted(got) == sorted((r.doc_id, comp[r.doc_id]) for r in docs.select("doc_id").collect())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))
    odd = spark.createDataFrame([(None, "lonely words of no id", 1), (9, "text one of two", 1), (9, "another text with this id", 2), (9, "text one of two", 1)], "doc_id long, text string, tag int")
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0
    runs = [sorted(map(str, simhash.drop_near_duplicates(odd.repartition(n)).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 2


def test_licence_marks_are_in_every_clause(spark):
    """Texts passed over for lack of a mark have no clause that the patterns would take."""
    texts = ["", "words only", "(c) 2020 x", "(C) by A\nb", "© B", "COPYRIGHT 2001 c", "a copyright notice", "copyright\t(c) d", "All  Rights Reserved", "- all rights reserved.\ne", "\n\nCopyright Me", "İ (c) 2019 ſ"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), licences._CLAUSE, ""), r"(?m)^[^\p{L}\p{N}\n]*+all rights reserved\b", "")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    for r in d.select("text", licences.canonical(F.col("text")).alias("a"), plain.alias("b")).collect():
        assert r.a == r.b, r.text
