"""Articles that names, constants, teasers or menus must not take away; the aligner against a plain one."""

import random
from functools import cache

from martingrid.llm import wrappers

PROSE = "Long sentences of the story of {0} that go on and on, as stories do."


def texts(spark, pages):
    table = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(table).collect()}
    assert got == {r.page_id: r.text for r in wrappers.extract(table.repartition(5)).collect()}
    return [got[i] for i in range(len(pages))]


def test_names_do_not_take_the_article(spark):
    nav = '<nav><a href="/">Home</a></nav>'
    foot = '<div class="footer">Imprint</div>'
    wraps = [
        '<div class="wrapper no-sidebar">{0}</div>', '<div class="post share-enabled">{0}</div>', '<div id="social-history">{0}</div>', "<form>{0}</form>",
        '<div class="comments-open">{0}</div>', '<form class="has-menu"><div id="ad-free"><section>{0}</section></div></form>', "<header>{0}</header>",
        '<article class="x"><div class="share-enabled">{0}</div></article>', '<div class="comments-open post">{0}</div><p>By us</p>',
    ]
    one = "<h1>Title {0}</h1><p>" + PROSE + "</p><p>And then more of {0}, told at some length.</p>"
    want = lambda n: f"Title {n} {PROSE.format(n)} And then more of {n}, told at some length."
    pages, expected = [], []
    for k, w in enumerate(wraps):
        for copies in (1, 3):  # a host with one page, and one with constants
            for n in range(copies):
                pages.append((f"http://h{k}-{copies}.example/{n}", f"<html><head><title>T</title><body>{nav}{w.format(one.format(n))}{foot}</body></html>"))
                tail = " By us" if "By us" in w and copies == 1 else ""
                expected.append(want(n) + tail)
    assert texts(spark, pages) == expected


def test_constants_between_fields_stay(spark):
    body = "<div>Our paper</div><div><h1>Case {0}</h1><h2>Summary</h2><p>In short {0}.</p><h2>Background</h2><p>At length {0}.</p></div><div>All rights reserved</div>"
    lead = "<div>Our paper</div><main><h2>Summary</h2><p>In short {0}.</p><h2>Background</h2><p>At length {0}.</p><p>Share this</p></main>"
    for copies in (2, 3, 4):
        got = texts(spark, [(f"http://a.example/{n}", f"<body>{body.format(n)}</body>") for n in range(copies)])
        assert got == [f"Case {n} Summary In short {n}. Background At length {n}." for n in range(copies)]
        got = texts(spark, [(f"http://a.example/{n}", f"<body>{lead.format(n)}</body>") for n in range(copies)])
        assert [g.removesuffix(" Share this") for g in got] == [f"Summary In short {n}. Background At length {n}." for n in range(copies)]


def test_teasers_menus_and_comments_go(spark):
    links = "".join(f'<li><a href="/{k}">Part {k} of the paper</a></li>' for k in range(9))
    story = "<h1>Head</h1><p>" + PROSE.format("x") + "</p>"
    told = "Head " + PROSE.format("x")
    teaser = "<article><h2>Other</h2><p>teaser elsewhere</p></article>"
    pages = [
        f"<body><article>{story}</article>{teaser}</body>",
        f"<main>{story}{teaser}{teaser}</main>",
        f"<body><ul>{links}</ul><div>{story}</div><ul>{links}</ul></body>",
        f"<body><article>{story}<ul><li><a href='/a'>Source one</a></li><li><a href='/b'>Source two</a></li></ul></article></body>",
        f"<body><div>{story}</div><div class='comments'><p>{'much talk of readers ' * 50}</p></div></body>",
        f"<main>{story}</main><div class='comments'><article>{'talk ' * 90}</article></div>",
        "<article><p>first half</p></article><article><p>second one</p></article>",
        "<head><title>T</title><p>no end of head</p>",
        "<nav><p>all that there is</p></nav>",
    ]
    want = [told, told, told, told + " Source one Source two", told, told, "first half second one", "no end of head", "all that there is"]
    assert texts(spark, [(f"http://h{k}.example/", p) for k, p in enumerate(pages)]) == want


def test_alignments_are_whole_and_as_good_as_a_plain_one():
    draw = random.Random(2)

    def plain(a, b):
        @cache
        def best(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + 1 if a[i] == b[j] else 0)

        return best(0, 0)

    short = 0
    for _ in range(300):
        base = [f"p{draw.randrange(12)}" for _ in range(draw.randint(0, 30))]
        edit = lambda xs: [y for x in xs for y in ([x] if draw.random() < 0.8 else draw.choice(([], [x, "n"], ["m"])))]
        a, b = edit(base), edit(base)
        codes = list(wrappers.opcodes(a, b))
        assert [x for op, i, j, k, m in codes for x in a[i:j]] == a and [x for op, i, j, k, m in codes for x in b[k:m]] == b
        assert all(a[i:j] == b[k:m] for op, i, j, k, m in codes if op == "equal")
        found = sum(j - i for op, i, j, _, _ in codes if op == "equal")
        assert found <= plain(tuple(a), tuple(b))
        short += plain(tuple(a), tuple(b)) - found
    assert short < 300  # under one node a pair
    a = [f"s{i}" for i in range(20_000)]
    b = [x for i, x in enumerate(a) if i % 7] + ["end"]
    assert sum(j - i for op, i, j, _, _ in wrappers.opcodes(a, b) if op == "equal") == len(b) - 1
