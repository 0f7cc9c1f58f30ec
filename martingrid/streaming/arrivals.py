"""Results as a stream: each is judged when it arrives, against what its block has contributed so far.

The checks that need no other result are Spark expressions (``validation.screen``).
What a block has contributed is its state: one digest, kept by ``transformWithState`` in
pages of neighbouring blocks, as each key of state costs calls between the JVM and Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from martingrid.operators.validation import screen, with_code

#: The state stores that transformWithState works with.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Results that fail a check of their own have no state; they are spread over so many keys.
SPREAD = 1024
#: Bits of block ids within a page.
PAGE = 10
#: Partitions of the state for each core.
TASKS = 2


class _Contribution(StatefulProcessor):
    """At most one contribution a block; a page holds those of 2^PAGE neighbouring blocks."""

    def __init__(self, names: list[str], given: list[str]):
        self.names, self.given = names, given

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "page string")

    def _read(self) -> dict:
        known = self.page.get()
        return dict(json.loads(known[0])) if known else {}

    def _write(self, known: dict) -> None:
        self.page.update((json.dumps(list(known.items())),))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._write(self._read() | dict(zip(initialState.blocks, initialState.checksums, strict=True)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        given, make = [self.names.index(c) for c in self.given], Row(*self.given)
        block, at, status, checksum = (self.names.index(c) for c in ("block_id", "arrival", "status", "checksum"))
        if key[0] is None:
            for r in rows:
                yield make(*[r[i] for i in given])
            return
        known = self._read()
        before = len(known)
        for r in sorted(rows, key=lambda r: r[at]):
            values, done = list(r), known.get(r[block])
            if done is not None:
                values[status] = "Duplicate" if r[checksum] == done else "DeterminismError"
            elif r[status] == "Accepted":
                known[r[block]] = r[checksum]
            yield make(*[values[i] for i in given])
        if len(known) != before:
            self._write(known)

    def close(self) -> None:
        pass


def judge_stream(results: DataFrame, blocks: DataFrame, committed: DataFrame, run: dict, antithetic: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The stream ``results`` (of it all columns, or those named) with the columns status, code and benign, as ``validation.judge_arrivals`` gives them.

    Micro-batches may be cut anywhere, if a block's results come in order of arrival;
    within a micro-batch they are put in that order.  ``committed`` (block_id, checksum)
    is what blocks have contributed before the stream's first start; afterwards its
    checkpoint has it.  State is a digest a block and does not expire, as a block that was
    forgotten could contribute twice; it goes with the run's checkpoint.  A page of state
    is read, and written if it changed, once for each micro-batch that has results of its
    blocks.  A task holds what the blocks of one page get in one micro-batch, so bound
    those at the source.  Results with a null arrival raise; those without block or with
    any other fault are judged without state.
    """
    arrival = F.coalesce(F.col("arrival").cast("long"), F.raise_error(F.lit("a result has no arrival number")).cast("long"))
    screened = screen(results.withColumn("arrival", arrival), blocks, run, antithetic)
    given = [*[c for c in screened.columns if c != "status" and (columns is None or c in columns)], "status"]
    names = [c for c in screened.columns if c in {*given, "block_id", "arrival", "checksum"}]
    good = F.col("status").isin("Accepted", "StaleLease")
    page = F.shiftright(F.col("block_id").cast("long"), PAGE)
    key = [F.when(good, page).alias("_page"), F.when(good, F.lit(0)).otherwise(F.pmod(F.xxhash64("block_id", "arrival"), F.lit(SPREAD))).cast("int").alias("_part")]
    done = committed.where("checksum is not null").select(F.col("block_id").cast(results.schema["block_id"].dataType).alias("block_id"), "checksum")
    pages = done.groupBy(page.alias("_page"), F.lit(0).alias("_part")).agg(F.collect_list("block_id").alias("blocks"), F.collect_list("checksum").alias("checksums"))
    judged = (
        screened.select(*names, *key)
        .groupBy("_page", "_part")
        .transformWithState(_Contribution(names, given), screened.select(*given).schema, "Append", "None", pages.groupBy("_page", "_part"))
    )
    return with_code(judged)


def run_to_end(judged: DataFrame, folder: str) -> DataFrame:
    """All that the stream has so far, written once each to ``folder``/judged and read back; called again it goes on after that.

    Every micro-batch opens each partition of the state once, however little it holds,
    so there are TASKS a core at most; their number stays that of the first start.
    """
    spark: SparkSession = judged.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(tasks)}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        judged.writeStream.format("parquet").option("path", f"{folder}/judged").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return spark.read.schema(judged.schema).parquet(f"{folder}/judged")
