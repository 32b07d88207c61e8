"""Streams that keep a state for each key: the newest row of a ledger, and calls that wait for their results.

Both run on `transformWithState`, whose states live in RocksDB stores on the executors and in the checkpoint, so that a
batch reads and writes the states of its own keys only. A query sets `STORE` before it starts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.traces import latest

#: The provider of states that `transformWithState` asks for.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Batches whose changes wait beside the base until they are merged into it.
MERGED = 8


class Newest(StatefulProcessor):
    """Holds the newest row of each key; gives it on when a newer one comes. Of rows with equal order the first stays."""

    def __init__(self, schema: StructType, order: list[str]):
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", self.schema)

    def _place(self, row) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in self.order)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.held.get() if self.held.exists() else None
        held = None if held is None else dict(zip(self.schema.names, held, strict=True))
        new = held
        for row in rows:
            if new is None or self._place(row) > self._place(new):
                new = row.asDict()
        if new is not held:
            self.held.update(tuple(new[c] for c in self.schema.names))
            yield Row(**new)

    def close(self) -> None:
        pass


def newest(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The changes of the newest row of each key, whatever order and however often rows come."""
    return stream.groupBy(*keys).transformWithState(Newest(stream.schema, order), stream.schema, "Update", "None")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _parts(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the tables in a folder that were written to the end."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    found = [(int(s.getPath().getName()), s.getPath()) for s in fs.listStatus(at)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n, path in found if fs.exists(done(path, "_SUCCESS")))


def _tables(spark: SparkSession, target: str, upto: int | None = None) -> list[str]:
    base = _parts(spark, f"{target}/base")
    last = base[-1] if base else -1
    new = [n for n in _parts(spark, f"{target}/changes") if n > last and (upto is None or n <= upto)]
    return [f"{target}/base/{n}" for n in base[-1:]] + [f"{target}/changes/{n}" for n in new]


def held(spark: SparkSession, target: str, schema: StructType, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key that a query of `keep_newest` has written so far; no rows before the first batch."""
    tables = _tables(spark, target)
    return latest(spark.read.schema(schema).parquet(*tables), keys, order) if tables else spark.createDataFrame([], schema)


def keep_newest(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str, merged: int = MERGED):
    """Starts a query that keeps the newest row of each key under `target`, see `held`.

    A batch writes the keys that changed in it, under its number, so that one that is repeated after a failure writes the
    same again. Each `merged` batches the changes are merged into a new base; when that is whole, the base and the changes
    before it go. So there are never more than two bases and the changes of twice so many batches."""
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/changes/{number}")
        if (number + 1) % merged:
            return
        if number not in _parts(spark, f"{target}/base"):
            tables = _tables(spark, target, number)
            latest(spark.read.schema(schema).parquet(*tables), keys, order).write.mode("overwrite").parquet(f"{target}/base/{number}")
        for folder, numbers in (("base", [n for n in _parts(spark, f"{target}/base") if n < number]), ("changes", [n for n in _parts(spark, f"{target}/changes") if n <= number])):
            for n in numbers:
                fs, at = _fs(spark, f"{target}/{folder}/{n}")
                fs.delete(at, True)

    return newest(stream, keys, order).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CALL = StructType([StructField("called_ms", LongType()), StructField("answered_ms", LongType())])
OUTCOME = "call_id string, outcome string, called_ms long, answered_ms long"


class Calls(StatefulProcessor):
    """Waits for the other half of a call that was seen first, and no longer than a timer allows."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", CALL)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        called, answered = self.seen.get() if self.seen.exists() else (None, None)
        first = called is None and answered is None
        for row in rows:  # the earliest of each kind, however often it comes
            if row["kind"] == "call":
                called = row["at_ms"] if called is None else min(called, row["at_ms"])
            else:
                answered = row["at_ms"] if answered is None else min(answered, row["at_ms"])
        if called is not None and answered is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.seen.clear()
            yield Row(call_id=key[0], outcome="closed", called_ms=called, answered_ms=answered)
            return
        self.seen.update((called, answered))
        if first:
            self.handle.registerTimer((called if called is not None else answered) + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.seen.exists():
            called, answered = self.seen.get()
            self.seen.clear()
            yield Row(call_id=key[0], outcome="expired" if answered is None else "orphan", called_ms=called, answered_ms=answered)

    def close(self) -> None:
        pass


def call_outcomes(events: DataFrame, wait_ms: int, late: str = "0 seconds") -> DataFrame:
    """(call_id, outcome, called_ms, answered_ms): calls that got their result (`closed`), those that got none in time
    (`expired`) and results without a call (`orphan`), by event time. events: call_id, kind (call or result), at
    (timestamp); rows without an id are left out, those that repeat count once as long as the call is open."""
    rows = events.filter("call_id is not null").withWatermark("at", late).select("call_id", "kind", "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("call_id").transformWithState(Calls(wait_ms), OUTCOME, "Append", "EventTime")
