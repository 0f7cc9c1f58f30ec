"""Main text of web pages by wrapper inference: union-free regular expressions per host.

A page becomes a stream of blocks, each a place (open elements) and a text.  Neighbouring
repeats become one repeated node.  The streams of a host are aligned pair by pair:
what matches stays, what only some pages have becomes optional, and the text of a node is
a constant while all its pages agree and a field (``VARIES``) once two differ.  A page is
read by aligning it with its host's whole expression: constants of different articles
before its first field and behind its last one are template and go, those between fields
and the headings that lead to the first one stay.  Markup that names its purpose
(``OUTSIDE``, ``INSIDE``) bounds the part that is read so, but no name takes away what holds
most of the text that varies.

Pages of one shape are folded by a commutative sum.  Shapes are aligned in sorted order,
first within ``BUCKETS`` by hash, then over the buckets, neighbours first, so the expression does not depend
on how rows are dealt out.  Nothing is cut.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martingrid.llm.common import cut

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements, and words of class and id values, whose text is not of the article.
OUTSIDE = frozenset("head nav header footer aside form button dialog menu".split()) | RAW
OUTSIDE_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header menu nav navbar newsletter notice popup promo related share sharing sidebar social sponsored subscribe".split())
#: What is of readers, or beside an article, however much text it holds, if another part can be the article.
BESIDE = frozenset("nav footer aside button dialog menu".split())
READERS = frozenset(("comment", "comments"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold an article.
INSIDE = frozenset(("article", "main"))
#: The text of a node whose pages differ.
VARIES = "*"
#: Different articles that a text is compared over before it can be a constant: fewer leave nothing to compare.
MIN_PAGES = 2
#: Parts that the shapes of one host are aligned in first.
BUCKETS = 64
#: Shapes that a task holds before it hands them on.
HELD = 20_000
#: Expressions of all hosts that are sent to the tasks, at most.
SENT_BYTES = 16 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|</?([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|[^<]+|<", re.S)
_CLASSES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A paragraph ends where one of these opens.
_ENDS_P = BLOCKS - {"br", "body", "html", "title"}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): open and close tags with their class words, and text; comments and raw elements go."""
    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = (m.group(1) or "").lower()
        if not name:
            if not m.group().startswith(("<!", "<?")):
                yield "text", "", m.group()
            continue
        if m.group().startswith("</"):
            yield "close", name, ""
            continue
        words = " ".join(x for g in _CLASSES.findall(m.group(2)) for x in g if x).lower()
        if name in RAW and not m.group(2).endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        yield "open", name, words


def blocks(page: str) -> tuple[list[tuple[str, str]], list[tuple[int, ...]], list[int]]:
    """(place, text) of each block, the numbers of its open elements, and its characters outside links: place is their path with their class words."""
    stack: list[tuple[str, str, int]] = []
    out: list[tuple[str, str]] = []
    paths: list[tuple[int, ...]] = []
    plain: list[int] = []
    held: list[tuple[str, bool]] = []
    place, opened = "", 0
    link: int | None = None  # open elements where a link began

    def flush() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            out.append((place, text))
            paths.append(tuple(n for _, _, n in stack))
            plain.append(sum(len(t.strip()) for t, linked in held if not linked))
        held.clear()

    for kind, name, value in tokens(page):
        if kind == "text":
            held.append((value, link is not None))
            continue
        if name == "a":
            link = len(stack) if kind == "open" else None
        if name not in BLOCKS and name not in OUTSIDE:
            continue
        flush()
        if kind == "open":
            if name in _ENDS_P and stack and stack[-1][0] == "p":
                stack.pop()
            if name in _ENDS_P | {"body"} and stack and stack[-1][0] == "head":
                stack.pop()
            if name not in VOID:
                opened += 1
                stack.append((name, ".".join(sorted(set(re.split(r"[^a-z0-9]+", value)) - {""})), opened))
        else:
            deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if deep is not None:
                del stack[deep:]
                if link is not None and len(stack) < link:
                    link = None
        place = "/".join(f"{n}.{w}" if w else n for n, w, _ in stack)
    flush()
    return out, paths, plain


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def squeeze(found: list[tuple[str, str]], longest: int = 4) -> list[list]:
    """[place, marks, text digest, block numbers] by node; neighbouring repeats of up to ``longest`` nodes are one group, marked +."""
    nodes = [[p, "", digest(t), [i]] for i, (p, t) in enumerate(found)]
    for width in range(1, longest + 1):
        out: list[list] = []
        for n in nodes:
            out.append(n)
            if len(out) >= 2 * width and all(out[-k][0] == out[-k - width][0] for k in range(1, width + 1)):
                for x, y in zip(out[-2 * width : -width], out[-width:], strict=True):
                    x[1], x[2] = "+", x[2] if x[2] == y[2] else VARIES
                    x[3] += y[3]
                del out[-width:]
        nodes = out
    return nodes


def least(a: list[str], b: list[str]) -> list[str]:
    """The least ``MIN_PAGES`` of both sets of page digests, which is enough to count up to that."""
    return a if a == b else sorted({*a, *b})[:MIN_PAGES]


def joined(x: list, y: list) -> list:
    """The node of both pages or wrappers: [place, marks, text, page digests]."""
    return [x[0], "".join(c for c in "+?" if c in x[1] + y[1]), x[2] if x[2] == y[2] else VARIES, least(x[3], y[3])]


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of three places in a row that both lists have once, in rising order in both."""

    def once(xs: list[str]) -> dict[tuple[str, ...], int]:
        at: dict[tuple[str, ...], int] = {}
        for i, g in enumerate(zip(xs, xs[1:], xs[2:])):  # noqa: B905
            at[g] = -1 if g in at else i
        return at

    other = once(b)
    pairs = [(i, other[g]) for g, i in once(a).items() if i >= 0 and other.get(g, -1) >= 0]
    ends: list[int] = []  # least end in b of a rising chain of each length, and the pair that has it
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before.append(last[n - 1] if n else -1)
        ends[n : n + 1], last[n : n + 1] = [j], [k]
    chain = []
    k = last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def opcodes(a: list[str], b: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """Alignment of two lists of places: common head and tail need no search, and the rest is searched between its anchors only."""
    n, m = len(a), len(b)
    head = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - head) if a[n - 1 - i] != b[m - 1 - i]), min(n, m) - head)
    yield "equal", 0, head, 0, head
    i, j = head, head
    for x, y in [*((x + head, y + head) for x, y in anchors(a[head : n - tail], b[head : m - tail])), (n - tail, m - tail)]:
        if x < i or y < j:
            continue
        for op, p, q, r, t in SequenceMatcher(None, a[i:x], b[j:y], autojunk=False).get_opcodes():
            yield op, p + i, q + i, r + j, t + j
        i, j = x, y
    yield "equal", n - tail, n, m - tail, m


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of both: shared nodes are joined, nodes of one side become optional, marked ?."""
    if not a:
        return b
    out: list[list] = []
    for op, i, j, k, m in opcodes([x[0] for x in a], [x[0] for x in b]):
        if op == "equal":
            out += [joined(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[x[0], x[1] if "?" in x[1] else x[1] + "?", *x[2:]] for x in (*a[i:j], *b[k:m])]
    return out


def candidates(found: list[tuple[str, str]], paths: list[tuple[int, ...]], weight: list[int]) -> list[bool]:
    """Whether each block can be of the article: inside the page's article element if it has one, and in nothing that is not of it.

    ``weight`` is the text that can tell: what varies, outside links.  Names decide nothing
    about an element that holds most of it (a page's wrapper may be of class no-sidebar,
    or all of it one form), unless they say that it stands beside an article or is of
    readers, and neither the page's title heading nor all the rest is in it.  Of several
    article elements the one that holds most of their text stands for the page; smaller
    ones inside it are teasers.  Without one, lists of links alone before or behind all
    other text are menus.
    """
    named = {p: [x.split(".") for x in p.split("/") if x] for p, _ in found}
    titles = [any(x[0] in ("head", "title") for x in named[p]) for p, _ in found]
    weight = [0 if title else w for w, title in zip(weight, titles, strict=True)]
    if not any(weight):
        weight = [0 if title else len(t) for (_, t), title in zip(found, titles, strict=True)]
    under: dict[int, int] = {}
    element: dict[int, list[str]] = {}
    for (p, _), path, w in zip(found, paths, weight, strict=True):
        for x, n in zip(named[p], path, strict=True):
            under[n] = under.get(n, 0) + w
            element[n] = x
    total = sum(weight)
    articles = {n for n, x in element.items() if x[0] in INSIDE}
    readers = {n for path in paths for k, n in enumerate(path) if n in articles and any(not READERS.isdisjoint(element[y][1:]) for y in path[: k + 1])}
    outermost = {next(n for n in path if n in articles) for path in paths if not articles.isdisjoint(path)}
    main = max((outermost - readers) or outermost, key=lambda n: (under[n], -n), default=None)
    scope = total if main is None else under[main]
    if main is None:
        bounds = None
    else:
        bounds = {main} if 2 * under[main] > sum(under[n] for n in outermost - readers) else outermost - readers
    nested = {n for path in paths for n in path if n in articles - outermost and element[n][0] == "article" and main in path and 2 * under[n] < scope}
    teasers = nested if 2 * sum(w for path, w in zip(paths, weight, strict=True) if main in path and nested.isdisjoint(path)) >= scope else set()

    whole = next((set(path[: path.index(main) + 1]) for path in paths if main in path), set())
    title = next((set(path) for (p, _), path in zip(found, paths, strict=True) if any(x[0] == "h1" for x in named[p])), set())
    named_outside = {n for n, x in element.items() if n not in whole and (x[0] in OUTSIDE or x[0] not in ("html", "body") and not OUTSIDE_WORDS.isdisjoint(x[1:]))}
    heavy = {n for n in named_outside if 2 * under[n] > scope and element[n][0] != "head"}
    beside = {n for n in heavy if n not in title and (element[n][0] in BESIDE or not READERS.isdisjoint(element[n][1:]))}

    def kept(outside: set[int]) -> list[bool]:
        return [(bounds is None or not bounds.isdisjoint(path)) and not t and outside.isdisjoint(path) and teasers.isdisjoint(path) for path, t in zip(paths, titles, strict=True)]

    out = kept(named_outside - heavy | beside)
    if not any(w for w, k in zip(weight, out, strict=True) if k):
        out = kept(named_outside - heavy)
    return out if main is not None else [k and not menu for k, menu in zip(out, menus(element, paths, weight, out), strict=True)]


def menus(element: dict[int, list[str]], paths: list[tuple[int, ...]], weight: list[int], keep: list[bool]) -> list[bool]:
    """Whether each block is of a list with nothing but links, before the first other text or behind the last."""
    told = [i for i, (w, k) in enumerate(zip(weight, keep, strict=True)) if w and k]
    lists: dict[int, list[int]] = {}
    for i, path in enumerate(paths):
        for n in path:
            if element[n][0] in ("ul", "ol"):
                lists.setdefault(n, []).append(i)
    out = [False] * len(paths)
    for at in lists.values():
        if told and len(at) > 1 and not any(weight[i] for i in at) and (at[-1] < told[0] or at[0] > told[-1]):
            for i in at:
                out[i] = True
    return out


def merged(wrappers: list[list[list]]) -> list[list]:
    """The wrapper of all, neighbours first, so that no long expression meets each short one."""
    while len(wrappers) > 1:
        wrappers = [align(*wrappers[i : i + 2]) if i + 1 < len(wrappers) else wrappers[i] for i in range(0, len(wrappers), 2)]
    return wrappers[0] if wrappers else []


def match(places: list[str], wrapper: list[list]) -> list[list | None]:
    """The wrapper's node for each place of a page, or none."""
    out: list[list | None] = [None] * len(places)
    for op, i, j, k, m in opcodes(places, [x[0] for x in wrapper]):
        if op == "equal":
            out[i:j] = wrapper[k:m]
    return out


def main_text(page: str | None, wrapper: list[list], memo: dict[str, list[list | None]] | None = None) -> str:
    """The article's blocks, joined by spaces: from the page's first field to its last, without the wrapper's constants around them.  ``memo`` keeps matches by shape."""
    found, paths, plain = blocks(page or "")
    nodes = squeeze(found)
    shape = "\n".join(n[0] for n in nodes)
    memo = {} if memo is None else memo
    if shape not in memo:
        memo[shape] = match([n[0] for n in nodes], wrapper)
    constant = [False] * len(found)
    for n, w in zip(nodes, memo[shape], strict=True):
        if w and w[2] == n[2] != VARIES and len(w[3]) >= MIN_PAGES:
            for i in n[3]:
                constant[i] = True
    weight = [0 if c else w for w, c in zip(plain, constant, strict=True)]
    keep = candidates(found, paths, weight if any(weight) else plain)
    fields = [i for i, (k, w, c) in enumerate(zip(keep, plain, constant, strict=True)) if k and w and not c]
    if fields:
        first, last = fields[0], fields[-1]
        parent = lambda i: found[i][0].rpartition("/")
        while first and keep[first - 1] and parent(first - 1)[0] == parent(fields[0])[0] and parent(first - 1)[2].split(".")[0] in HEADINGS:
            first -= 1
        keep = [k and (first <= i <= last or not constant[i]) for i, k in enumerate(keep)]
    return " ".join(t for (_, t), k in zip(found, keep, strict=True) if k)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def page_state(page: str) -> tuple[str, list]:
    """Shape of a page, and [marks, texts, page digests] of it; pages with one article count as one."""
    found, paths, plain = blocks(page)
    nodes = squeeze(found)
    own = digest("\n".join(f"{p} {t}" for (p, t), k in zip(found, candidates(found, paths, plain), strict=True) if k))
    return "\n".join(n[0] for n in nodes), [[n[1] for n in nodes], [n[2] for n in nodes], [own]]


def folded(x: list, y: list) -> list:
    """The state of both; order does not matter."""
    return [[a or b for a, b in zip(x[0], y[0], strict=True)], [a if a == b else VARIES for a, b in zip(x[1], y[1], strict=True)], least(x[2], y[2])]


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the union-free expression of each host over all its pages, as a JSON list of nodes."""
    names = ("host", "shape", "state")
    schema = pa.schema([(n, pa.string()) for n in names])

    def partial(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[tuple[str, str], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(host, shape, json.dumps(s)) for (host, shape), s in have.items()]
            have.clear()
            return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)

        for b in frames:
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                shape, state = page_state(page or "")
                if shape:
                    have[host, shape] = folded(have[host, shape], state) if (host, shape) in have else state
            if len(have) > HELD:
                yield out()
        yield out()

    def of_bucket(parts: pd.DataFrame) -> pd.DataFrame:
        have: dict[str, list] = {}
        for shape, s in zip(parts["shape"], map(json.loads, parts["state"]), strict=True):
            have[shape] = folded(have[shape], s) if shape in have else s
        whole = merged([[[p, m, t, prints] for p, m, t in zip(shape.split("\n"), marks, texts, strict=True)] for shape, (marks, texts, prints) in sorted(have.items())])
        return pd.DataFrame({"host": parts["host"].iloc[:1], "bucket": parts["bucket"].iloc[:1], "wrapper": [json.dumps(whole)]})

    def of_host(parts: pd.DataFrame) -> pd.DataFrame:
        whole = merged([json.loads(w) for w in parts.sort_values("bucket")["wrapper"]])
        return pd.DataFrame({"host": parts["host"].iloc[:1], "bucket": parts["bucket"].iloc[:1], "wrapper": [json.dumps(whole)]})

    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string"))
    shapes = rows.mapInArrow(partial, "host string, shape string, state string").withColumn("bucket", F.pmod(F.xxhash64("shape"), F.lit(BUCKETS)))
    buckets = shapes.groupBy("host", "bucket").applyInPandas(of_bucket, "host string, bucket long, wrapper string")
    eighths = buckets.groupBy("host", F.floor(F.col("bucket") / 8)).applyInPandas(of_host, "host string, bucket long, wrapper string")
    return eighths.groupBy("host").applyInPandas(of_host, "host string, bucket long, wrapper string").select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html).

    Null and empty pages give an empty text; null urls and urls without a host are one
    host; repeated rows repeat; an empty table gives an empty result; other columns
    are ignored.  Whole pages are read.  Wrappers of up to ``SENT_BYTES`` in all are sent
    to the tasks; more of them meet their pages in a join by host.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str | None, tuple[list, dict]] = {}
        for b in frames:
            texts = []
            for page, w in zip(map(pa.StringScalar.as_py, b.column("html")), b.column("wrapper").to_pylist(), strict=True):
                if len(memo) > 200:
                    memo.clear()
                if w not in memo:
                    memo[w] = json.loads(w) if w else [], {}
                wrapper, shapes = memo[w]
                if len(shapes) > 1_000:
                    shapes.clear()
                texts.append(main_text(page, wrapper, shapes))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    hosted = rows.withColumn("host", host_of(F.col("url")))
    wrappers = cut(infer(rows))
    total = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    known = F.broadcast(wrappers) if total <= SENT_BYTES else wrappers
    return hosted.join(known, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string")
