"""A profile that a stream keeps by key: exact distinct counts, first and last rows, and late rows, across micro-batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import discard, written
from ..sources.state_table import StateTable

#: The setting that names the store of state, and the store that the processor needs.
SETTING, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds.
NUMBERS = "rows long, late long, distinct_values long, first_at long, first_value string, last_at long, total double"
OUTPUT = f"key string, arrived long, {NUMBERS}"
#: Distinct values that stand with a key's numbers, and the characters that each of them may have; the others are in the map.
FEW, SHORT = 32, 128
#: Values of one micro-batch that are known to be in the map.
MET = 1 << 14


class KeyProfile(StatefulProcessor):
    """Gives a key's whole profile whenever rows of it have come.

    The key's numbers and its first few short distinct values are one value of state, read and written once a micro-batch; its
    further values are a map of state, so that they need not fit into memory and a batch reads and writes only its own. A row is late
    if it has no time, or if its time lies more than late_ms before the key's last row of earlier batches; it is counted as late and
    nothing else. A null value is no distinct value. With ttl_ms, all values are in the map, and one that has not come for so long is
    forgotten, and counts again when it comes back.
    """

    def __init__(self, late_ms: int, ttl_ms: int | None = None):
        self.late_ms, self.ttl_ms = late_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", f"{NUMBERS}, few array<string>")
        self.seen = handle.getMapState("seen", "value string", "n long", self.ttl_ms)

    def _is_new(self, value: str, few: list[str], met: set[str]) -> bool:
        """Whether a value comes for the first time; it is kept then. few never shrinks, so a short value is in the map only if few was full."""
        if value in few or value in met:
            return False
        if self.ttl_ms is None and len(few) < FEW and len(value) <= SHORT:
            few.append(value)
            return True
        new = not self.seen.containsKey((value,))
        if new or self.ttl_ms is not None:
            self.seen.updateValue((value,), (1,))
        if len(met) == MET:
            met.clear()
        met.add(value)
        return new

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, late, distinct, first_at, first, last_at, total, few = self.numbers.get() or (0, 0, 0, None, None, None, 0.0, [])
        closed, few, met = None if last_at is None else last_at - self.late_ms * 1000, [*few], set()
        for _, at, value, amount in rows:
            if at is None or closed is not None and at < closed:
                late += 1
                continue
            n += 1
            if amount is not None and amount == amount:  # neither null nor NaN
                total += amount
            if value is not None:
                distinct += self._is_new(value, few, met)
            if first_at is None or at < first_at or at == first_at and (value is None, value or "") < (first is None, first or ""):
                first_at, first = at, value
            last_at = at if last_at is None else max(last_at, at)
        self.numbers.update((n, late, distinct, first_at, first, last_at, total, few))
        yield Row(key=key[0], arrived=n + late, rows=n, late=late, distinct_values=distinct, first_at=first_at, first_value=first, last_at=last_at, total=total)

    def close(self) -> None:
        pass


def key_profiles(stream: DataFrame, key: str, at: str, value: str, amount: str, late_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """A stream of profiles by key: after each micro-batch a row for each key that it touched. Null keys are a key of their own. The session needs PROVIDER under SETTING."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(value).cast("string").alias("value"), F.col(amount).cast("double").alias("amount"))
    made = rows.groupBy("key").transformWithState(KeyProfile(late_ms, ttl_ms), OUTPUT, "update", "none" if ttl_ms is None else "processingTime")
    return made.withColumns({c: F.timestamp_micros(c) for c in ("first_at", "last_at")})


@contextlib.contextmanager
def _provider(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(SETTING, before) if before else spark.conf.unset(SETTING)


def kept_profiles(profiles: DataFrame, table: StateTable, checkpoint: str) -> None:
    """Runs a stream of key_profiles over all that has come, and merges each micro-batch into table, whose key is `key`.

    A profile that has seen more rows of a key is the later one, so a micro-batch that is run again after a failure changes nothing.
    A merge reads its changes more than once, so they are written first: the processor runs once over a micro-batch.
    """

    def merged(df: DataFrame, _: int) -> None:
        once = written(df, "profiles")
        table.merge(once, "arrived")
        discard(once)

    with _provider(profiles.sparkSession):
        query = profiles.writeStream.outputMode("update").foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
