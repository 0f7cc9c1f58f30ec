"""Whole-text licence lookup by canonical digest.

A text is normalised (case, spelling, copyright clauses, punctuation, white space) and
hashed; digests of whole texts, of their paragraphs and of their single lines meet those
of known licences and of their paragraphs in a hash join.  The known side is a table of a checked size.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martingrid.llm.common import let

#: The known side is broadcast and may have so many rows at most.
MAX_KNOWN = 100_000
#: Spellings of one word that count as the same.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "sublicences": "sublicenses",
    "authorisation": "authorization", "authorisations": "authorizations", "authorised": "authorized", "organisation": "organization", "organisations": "organizations",
    "whilst": "while", "https": "http",
}
#: Parts of all of them and of the words written apart: most texts have none and need no look at each word.
_SPELLED = ("licenc", "sub licen", "non commercial", "authoris", "organis", "whilst", "https")
#: Words that are also written apart.
APART = {"non commercial": "noncommercial", "sub license": "sublicense", "sub licenses": "sublicenses"}
#: Short licence notices and texts as their publishers word them.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
)


#: Full texts, a file by licence; read by the driver.
TEXTS = Path(__file__).parent / "licence_texts"
#: A paragraph of a known text stands for it from so many words on.
MIN_PARAGRAPH_WORDS = 15
#: A copyright clause: the mark at the start of a line, then (c) or a year, or at the start of a paragraph, then an owner, up to the line's end or the licence's own words.
_NOT_OWNER = "notices?|holders?|owners?|laws?|licen[sc]es?|licen[sc]ed|statements?|disclaimers?|interests?|protection|and|or|in|is|are|to|on|as|of|for|treaty|control|permission|the"
_CLAUSE = rf"(?m)(?:^[^\p{{L}}\p{{N}}\n(©]*(?:copyright[ \t]+(?=[0-9]{{4}})|copyright[ \t]*(?=\(c\)|©)|\(c\)[ \t]*(?=(?:copyright[ \t]*)?(?:[0-9]{{4}}|by\b))|©)|(?<=\A|\n\n)[^\p{{L}}\p{{N}}\n(©]*copyright[ \t]+(?!(?:{_NOT_OWNER})\b)(?=\S))[^\n]*?(?=$|[.;,]\s+(?:released|licensed|permission|this|distributed|redistribution)\b)"

#: Every clause has one of the marks, every notice of rights the words.
_MARKS = ("copyright", "(c)", "©")
_RESERVED = ("all rights reserved",)


def canonical(text: Column) -> Column:
    """Lower case, no copyright clauses, one spelling, words parted by single spaces."""
    # each form bound once, as most texts have no clause and no other spelling to look for
    t = _only_with(F.lower(text), _MARKS, lambda x: F.regexp_replace(x, _CLAUSE, ""))
    t = _only_with(t, _RESERVED, lambda x: F.regexp_replace(x, r"(?m)^[^\p{L}\p{N}\n]*+all rights reserved\b", ""))
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    return _only_with(t, _SPELLED, _one_spelling)


def _only_with(text: Column, parts: tuple[str, ...], change) -> Column:
    """``change`` of a text that contains one of the parts, any other text as it is."""
    return let(text, lambda x: F.when(reduce(or_, [x.contains(p) for p in parts]), change(x)).otherwise(x))


def _one_spelling(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    out = F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.element_at(known, w), w)), " ")
    for a, b in APART.items():
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}]){a}(?![\p{{L}}\p{{N}}])", b)
    return out


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines that have a letter or digit."""
    return F.filter(F.split(text, r"\r?\n[ \t\r]*\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files; the Apache licence also without its appendix."""
    out = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    ends = "END OF TERMS AND CONDITIONS"
    return out + [(n, x[: x.index(ends) + (len(ends) if k else 0)]) for n, x in out if n.startswith("Apache") for k in (0, 1)]


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, licence, part), one row per digest; a part is a paragraph, and names all licences that have it."""
    known = [*KNOWN, *full_texts()] if known is None else known
    if len(known) > MAX_KNOWN:
        raise ValueError(f"over {MAX_KNOWN} known licences; join in parts")
    rows = spark.createDataFrame(list(known), "licence string, text string")
    digest = lambda x: F.sha2(canonical(x), 256)
    whole = {r.digest: r.licence for r in rows.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence")).collect()}
    found = defaultdict(set)
    for r in rows.select("licence", F.explode(paragraphs(F.col("text"))).alias("p")).where(F.size(F.split(canonical(F.col("p")), " ")) >= MIN_PARAGRAPH_WORDS).select("licence", digest(F.col("p")).alias("digest")).collect():
        found[r.digest].add(r.licence)
    out = [(d, n, False) for d, n in whole.items()] + [(d, " or ".join(sorted(n)), True) for d, n in found.items() if d not in whole]
    return spark.createDataFrame(out, "digest string, licence string, part boolean")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, whole_licence, notices) for each row.

    whole_licence: licence whose canonical text is the document's, or null; notices:
    sorted distinct licences of the text, its paragraphs and its single lines, comma-joined, empty if none.  Null and empty texts
    match nothing.  One row per row; other columns are ignored; an empty table gives an
    empty result.  Rows of one id and one canonical text share what they match, which is
    the same for each of them.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    if known.limit(MAX_KNOWN + 1).count() > MAX_KNOWN:
        raise ValueError(f"over {MAX_KNOWN} known licences; join in parts")
    known = known if "part" in known.columns else known.withColumn("part", F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    known = known.select("digest", "licence", "part")
    # a part that is the whole text has its digest already
    parts = F.filter(F.array_distinct(F.concat(lines, paragraphs(text))), lambda x: x != text)
    rows = docs.select(F.col("doc_id").alias("id"), F.sha2(canonical(text), 256).alias("whole"), F.transform(parts, lambda x: F.sha2(canonical(x), 256)).alias("lines"))
    units = rows.select("id", "whole", F.explode(F.array_distinct(F.concat(F.array("whole"), "lines"))).alias("digest"))
    hits = units.join(F.broadcast(known), "digest").groupBy("id", "whole").agg(
        F.min(F.when((F.col("digest") == F.col("whole")) & ~F.col("part"), F.col("licence"))).alias("whole_licence"), F.sort_array(F.collect_set("licence")).alias("notices")
    )
    mine = rows.select(F.col("id").alias("doc_id"), F.col("whole").alias("canonical_sha256"))
    found = mine.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("canonical_sha256") == F.col("whole")), "left")
    none = F.array().cast("array<string>")
    return found.select("doc_id", "canonical_sha256", "whole_licence", F.array_join(F.coalesce("notices", none), ",").alias("notices"))
