r"""Chat formatting with Spark expressions only.

Turns are collected in two steps, first per run of ``CHUNK`` turn numbers, then per
conversation, so that a very long conversation reaches its task already merged.

Template: adjacent turns of one role form ``<|im_start|>role\ntext<|im_sep|>text<|im_end|>\n``.
Inside roles and texts ``<``, any backslashes and ``|`` get one more backslash
between them, so no control string occurs there; a newline in a role becomes
``<|nl|>``.  Both are undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martingrid.llm.common import let

START, END, SEPARATOR, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|nl|>"
LOSS_ROLE = "assistant"
#: Turn numbers that one task collects at first.
CHUNK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _runs(turns: Column) -> Column:
    """Sorted turn structs merged to array<struct<role, texts>>: adjacent turns of a role become one."""

    def merge(starts: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(turns))
        texts = lambda i, k: F.transform(F.slice(turns, i + 1, stop(k) - i), lambda t: t["text"])
        return F.transform(starts, lambda i, k: F.struct(F.get(turns, i)["role"].alias("role"), texts(i, k).alias("texts")))

    first = F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i))
    return let(F.filter(first, lambda i: i.isNotNull()), merge)


def _segments(runs: Column) -> Column:
    """array<struct<piece, loss>>: the formatted text in pieces, each inside or outside the loss mask."""

    def one(run: Column, i: Column) -> Column:
        before = F.get(runs, i - 1)["role"]
        role = F.replace(escape(run["role"]), F.lit("\n"), F.lit(NEWLINE))
        opening = F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END)), F.lit(START), role, F.lit("\n"))
        head = F.when(F.coalesce(before == run["role"], F.lit(False)), F.lit(SEPARATOR)).otherwise(opening)
        return F.flatten(
            F.transform(
                run["texts"],
                lambda t, j: F.array(
                    F.struct(F.when(j == 0, head).otherwise(F.lit(SEPARATOR)).alias("piece"), F.lit(False).alias("loss")),
                    F.struct(escape(t).alias("piece"), (run["role"] == LOSS_ROLE).alias("loss")),
                ),
            )
        )

    end = F.array(F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")))
    return F.concat(F.flatten(F.transform(runs, one)), end)


def _spans(segments: Column) -> Column:
    """array<struct<start, length>>: code points of the formatted text under the loss mask, from 0."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(a: Column, s: Column) -> Column:
        n = F.length(s["piece"]).cast("long")
        span = F.array(F.struct(a["at"].alias("start"), n.alias("length")))
        return F.struct((a["at"] + n).alias("at"), F.when(s["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(segments, empty, add, lambda a: a["spans"])


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of ``turns`` (conv_id, turn, role, text).

    loss_spans is the loss mask: (start, length) of the parts of formatted that count,
    in code points.  Turns go by number, nulls first, ties by role and text; repeated
    rows are repeated turns.  Null roles and texts are empty; a null conv_id is one
    conversation; an empty table gives an empty result; other columns are ignored.
    """
    number = F.col("turn").cast("long")
    rows = turns.select(
        "conv_id",
        F.expr(f"cast(floor(cast(turn as bigint) / {CHUNK}) as bigint)").alias("chunk"),
        F.struct(
            number.alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(F.collect_list("t").alias("ts")).select("conv_id", "chunk", _runs(F.sort_array("ts")).alias("runs"))
    whole = chunks.groupBy("conv_id").agg(F.collect_list(F.struct("chunk", "runs")).alias("cs"))
    merged = F.flatten(F.transform(F.sort_array("cs"), lambda c: c["runs"]))
    made = whole.select("conv_id", let(merged, _segments).alias("segments"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), _spans(F.col("segments")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, controls unescaped."""

    def block(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        texts = F.split(F.substring(b, F.length(role) + 2, F.length(b)), r"<\|im_sep\|>")
        clear = unescape(F.replace(F.substring(role, F.lit(len(START) + 1), F.length(role)), F.lit(NEWLINE), F.lit("\n")))
        return F.transform(texts, lambda t: F.struct(clear.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    return F.flatten(F.transform(blocks, block))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from their texts through their loss masks."""
    span = lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))
    said = F.array_join(F.transform("loss_spans", span), "")
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), said.alias("loss"), F.length("formatted").alias("n"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )
