"""Quality rules as a short-circuit cascade of Spark expressions.

A rule is a Boolean expression over counts of a text, true where the text fails.  Cost
and rejections of every rule are measured on a bounded sample; the cascade then takes
the rule that rejects most of what is left per second, one after another, in one CASE
expression whose later branches Spark evaluates only for rows that passed the earlier
ones.  The order changes the time taken, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martingrid.llm.common import SPACE_RUN, let, word_array

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Symbols per ten words and repeated lines per ten lines: the fractions 0.1 and 0.3 that Rae et al. (2021) give for web text.
MAX_SYMBOLS_PER_TEN = 1
MAX_DUP_LINES_PER_TEN = 3
#: Fewer repeated lines say nothing: a short text may have its heading twice.
MIN_DUP_LINES = 3
#: Code points a word; the upper bound is for scripts that part words by spaces, whose code points take under 1.5 bytes on average.
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 20
SYMBOLS = "#*$%&|<>"
#: The sample that costs and rejections are measured on: rows, bytes a text, and runs of each rule.
SAMPLE_ROWS, SAMPLE_BYTES, RUNS = 1_000, 1 << 20, 3


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more.

    Windows are told apart by 64-bit hash first; where two agree, by their words.
    """

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        def mark(x: Column, j: Column) -> Column:
            same = lambda k: F.coalesce((F.get(s, k)["h"] == x["h"]) & (F.get(s, k)["w"] == x["w"]), F.lit(False))
            return F.when(same(j - 1) | same(j + 1), x["i"])

        return let(F.sort_array(F.filter(F.transform(s, mark), lambda x: x.isNotNull())), covered)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def count(w: Column, h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(w, i + 1, F.lit(window)).alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(each), repeated))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashes(words), lambda h: count(words, h))).cast("long")


#: What rules can read, by name: an expression or a column.
Counts = dict[str, Column]


def counts(text: Column, words: Column, split: Column) -> Counts:
    """The counts of a text that is not null, of its words and its lines; each is evaluated where it is read."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": n_symbols(text),
        "n_lines": F.size(split).cast("long"),
        "n_dup_lines": (F.size(split) - F.size(F.array_distinct(split))).cast("long"),
        "n_repeat_words": n_repeat_words(words),
        "n_chars": F.length(text).cast("long"),
        "n_bytes": F.octet_length(text).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """``fails`` gives, for the counts of a text, an expression that is true where it is to go."""

    name: str
    fails: Callable[[Counts], Column]


def _word_length(c: Counts) -> Column:
    spaced = c["n_bytes"] * 2 < c["n_chars"] * 3
    return (c["word_chars"] < c["n_words"] * MIN_WORD_CHARS) | (spaced & (c["word_chars"] > c["n_words"] * MAX_WORD_CHARS))


BASE_RULES = (
    Rule("few_words", lambda c: c["n_words"] < MIN_WORDS),
    Rule("repeated_windows", lambda c: c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEATED_PERCENT),
)
MORE_RULES = (
    Rule("symbols", lambda c: c["n_symbols"] * 10 > c["n_words"] * MAX_SYMBOLS_PER_TEN),
    Rule("duplicate_lines", lambda c: (c["n_dup_lines"] >= MIN_DUP_LINES) & (c["n_dup_lines"] * 10 > c["n_lines"] * MAX_DUP_LINES_PER_TEN)),
    Rule("word_length", _word_length),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    #: Rejections of this rule among those that the earlier ones leave, as a share of the sample.
    rejected: float


def order(rules: Sequence[Rule], seconds: Sequence[float], verdicts: dict[tuple[bool, ...], int]) -> list[Measured]:
    """The rules, each time that which rejects most of what is left per second; ties keep the given order."""
    total, left, out = max(1, sum(verdicts.values())), dict(verdicts), []
    todo = list(range(len(rules)))
    while todo:
        hits = {i: sum(n for v, n in left.items() if v[i]) for i in todo}
        best = max(todo, key=lambda i: hits[i] / seconds[i])
        out.append(Measured(rules[best], seconds[best], hits[best] / total))
        left = {v: n for v, n in left.items() if not v[best]}
        todo.remove(best)
    return out


def measure(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS, text: str = "text") -> list[Measured]:
    """The rules in the order of the cascade, measured on at most ``rows`` rows.

    The sample is what a scan that stops finds first, without texts over
    ``SAMPLE_BYTES``.  A rule's cost is the least of ``RUNS`` jobs less that of a job
    without a rule.  An empty table keeps the given order.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    some = docs.select(t).where(F.octet_length("text") <= SAMPLE_BYTES).take(rows)
    if not some:
        return [Measured(r, 0.0, 0.0) for r in rules]
    sample = docs.sparkSession.createDataFrame(some, "text string").coalesce(1).persist()
    try:
        fails = [_of_text(F.col("text"), lambda c, r=r: F.coalesce(r.fails(c), F.lit(False))) for r in rules]
        found = sample.groupBy(*[f.alias(f"f{i}") for i, f in enumerate(fails)]).count().collect()

        def seconds(value: Column) -> float:
            best = float("inf")
            for _ in range(RUNS):
                start = time.perf_counter()
                sample.agg(F.count_if(value)).collect()
                best = min(best, time.perf_counter() - start)
            return best

        none = seconds(F.length("text") < 0)
        return order(rules, [max(1e-4, seconds(f) - none) for f in fails], {tuple(r[:-1]): r["count"] for r in found})
    finally:
        sample.unpersist()


def _of_text(text: Column, body: Callable[[Counts], Column]) -> Column:
    """``body`` over the counts of a text, whose words are split once."""
    return let(word_array(text), lambda w: body(counts(text, w, lines(text))))


def first_failure(rules: Sequence[Rule], found: Counts) -> Column:
    """Name of the first rule that fails, in the order given; null if none does."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(F.coalesce(r.fails(found), F.lit(False)), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def keep_good(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *MORE_RULES)) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept.

    Null texts count as empty and so fail ``few_words``; repeated rows are judged
    alike; an empty table stays empty.
    """
    ordered = [m.rule for m in measure(docs, rules)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(_of_text(text, lambda c: first_failure(ordered, c)).isNull())


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row; null texts count as empty, other columns are ignored.

    Rules read the counts, which are there for every row anyway.
    """
    ordered = [m.rule for m in measure(docs, MORE_RULES)]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = counts(F.col("text"), F.col("w"), F.col("s"))
    counted = texts.select("doc_id", "text", word_array(F.col("text")).alias("w"), lines(F.col("text")).alias("s")).select("doc_id", *[e.alias(c) for c, e in made.items()])
    base = F.coalesce(first_failure(BASE_RULES, {c: F.col(c) for c in made}).isNotNull(), F.lit(False))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(first_failure(ordered, {c: F.col(c) for c in made}).isNull())
    return counted.withColumn("base_failed", base).withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
