"""Advantages over a stream whose generations of a prompt arrive in parts (G1 and T8 with keyed state).

``advantage_sink`` needs whole groups in a micro-batch.  Here a group's rows
wait in the state store until as many have come as the group expects; then
its advantages are emitted and its state is cleared.  A group that stays
incomplete for ``timeout`` of event time is reported with what has come.
State holds the rows of open groups only, each group at most its expected
number; Spark partitions it by group and restores it after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from residua.session import ship_package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMPLETE, TIMED_OUT = "complete", "timed_out"


def relative_advantages(rewards: list[float | None]) -> list[float | None]:
    """G1 for one whole group: ``(r - mean) / population std``; null without spread and for null rewards."""
    known = np.sort(np.array([r for r in rewards if r is not None], float))
    if not len(known) or known[0] == known[-1]:
        return [None] * len(rewards)
    mean, std = known.mean(), known.std()
    return [None if r is None else float((r - mean) / std) for r in rewards]


class HeldGroups(StatefulProcessor):
    """Collects a group's rows; emits them with advantages once the group is whole, or without when its time is up."""

    def __init__(self, columns: list[str], schema: StructType, reward: str, expected: str, at: str | None,
                 timeout_ms: int):
        self.columns, self.schema, self.reward, self.expected, self.at, self.timeout_ms = (
            columns, schema, reward, expected, at, timeout_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.count = handle.getValueState("count", StructType([StructField("n", IntegerType())]))

    def _emit(self, rows: list[tuple], status: str) -> Iterator[Row]:
        n, at = len(rows), self.schema.names.index(self.reward)
        advantages = relative_advantages([r[at] for r in rows]) if status == COMPLETE else [None] * n
        made = Row(*self.schema.names, "advantage", "status", "n_generations")
        return (made(*r, advantage, status, n) for r, advantage in zip(rows, advantages, strict=True))

    def _close(self) -> None:
        self.rows.clear()
        self.count.clear()
        for timer in list(self.handle.listTimers()) if self.at else ():
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # each call on the state is a message to the JVM: none that a whole group can do without
        known = self.count.get()
        held = int(known[0]) if known is not None else 0
        names = self.schema.names
        places = [self.columns.index(c) for c in names]
        # NaN counts as no value
        came = [tuple(None if r[i] != r[i] else r[i] for i in places) for r in rows]
        # arrival order within a micro-batch is not defined; the order of the values is
        came.sort(key=repr)
        size, at = names.index(self.expected), names.index(self.at) if self.at else None
        while came:
            wanted = int(came[0][size])
            take, came = came[:wanted - held], came[max(wanted - held, 1):]
            if held + len(take) >= wanted:
                yield from self._emit([*(tuple(r) for r in self.rows.get()), *take] if held else take, COMPLETE)
                if held:
                    self._close()
                held = 0
                continue
            self.rows.appendList(take)
            held += len(take)
            self.count.update((held,))
            if self.at:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(max(r[at] for r in take) + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = [tuple(r) for r in self.rows.get()]
        self.rows.clear()
        self.count.clear()
        if rows:
            yield from self._emit(rows, TIMED_OUT)

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state with timers needs the RocksDB state store; it is set for the queries started inside."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


def held_advantages(stream: DataFrame, group: str = "prompt_id", reward: str = "reward",
                    num_generations: int | str = "num_generations", event_time: str | None = None,
                    timeout: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """Streaming G1: every row of a group once the group is whole, with ``advantage``, ``status``, ``n_generations``.

    ``num_generations`` is the size of every group, or a column that holds
    the group's.  With ``event_time``, a group of which no row has come for
    ``timeout`` (watermark delay ``late``) is emitted with status
    ``timed_out`` and null advantages; without, groups wait for ever.  Rows
    that come after their group was emitted begin a new round of it.
    """
    ship_package(stream.sparkSession)
    size, ms = "__expected", "__event_ms"
    expected = F.col(num_generations) if isinstance(num_generations, str) else F.lit(num_generations)
    checked = F.when(expected >= 1, expected).otherwise(
        F.raise_error(F.lit("num_generations must be at least 1")))
    x = stream.withColumn(size, checked.cast("int"))
    if event_time:
        x = x.withWatermark(event_time, late).withColumn(ms, F.unix_millis(event_time))
    columns = [c for c in stream.columns if c != event_time]
    state = StructType([x.schema[c] for c in columns] + [StructField(size, IntegerType())]
                       + ([StructField(ms, LongType())] if event_time else []))
    state = StructType([StructField(f.name, f.dataType, True) for f in state.fields])
    out = StructType([*state.fields, StructField("advantage", DoubleType()), StructField("status", StringType()),
                      StructField("n_generations", IntegerType())])
    parse = f"INTERVAL {timeout}"
    timeout_ms = int(stream.sparkSession.range(1).select(
        (F.unix_millis(F.expr(f"timestamp_millis(0) + {parse}")))).first()[0]) if event_time else 0
    held = x.groupBy(group).transformWithState(
        HeldGroups(x.columns, state, reward, size, ms if event_time else None, timeout_ms), out, "Append",
        "EventTime" if event_time else "None")
    if event_time:
        held = held.withColumn(event_time, F.timestamp_millis(F.col(ms)))
    return held.select(*stream.columns, "advantage", "status", "n_generations")


def run_held_advantages(stream: DataFrame, out: str, checkpoint: str, **kw) -> None:
    """Drain ``stream`` (already scored) into Parquet files at ``out``; a restart goes on from the state.

    The file sink commits each micro-batch once, so a replay adds no rows.
    """
    with _state_store(stream.sparkSession):
        q = (held_advantages(stream, **kw).writeStream.format("parquet").option("path", out).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
