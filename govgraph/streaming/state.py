"""Keyed state of the streaming jobs, held in RocksDB on the executors and versioned by the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstDelivery(StatefulProcessor):
    """Per key a mark that it was delivered; of a batch's rows the one that comes first by ``order``."""

    def __init__(self, order: str | None):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def _before(self, row: Row, other: Row | None) -> bool:
        if other is None:
            return True
        if self.order is None or row[self.order] is None:
            return False
        return other[self.order] is None or row[self.order] < other[self.order]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, first = self.done.exists(), None
        for row in rows:
            if not known and self._before(row, first):
                first = row
        if first is not None:
            self.done.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.done.update((True,))

    def close(self) -> None:
        pass


def first_deliveries(stream: DataFrame, key: list[str], order: str | None = None, completed: DataFrame | None = None) -> DataFrame:
    """The first row of every key ever: nothing but the key is kept, and no earlier output is read.

    ``completed`` has the keys that count as delivered before the stream's first batch.
    """
    use_rocksdb(stream)
    if order is None and completed is None:
        # Any row of a batch may stand for its key: then Spark's own state does it, without a worker per row.
        return stream.dropDuplicates(key)
    seeds = None if completed is None else completed.select(*key).distinct().groupBy(*key)
    return stream.groupBy(*key).transformWithState(
        statefulProcessor=FirstDelivery(order),
        outputStructType=stream.schema,
        outputMode="Append",
        timeMode="None",
        initialState=seeds,
    )


LEASE_OUTPUT = (
    "execution_id string, seq bigint, kind string, claimed boolean, prior_status string, "
    "status string, attempts int"
)
_KINDS = ("CLAIM", "COMPLETED", "FAILED")


class LeaseProcessor(StatefulProcessor):
    """Claims per execution: RUNNING until completed, failed or out of lease.

    A key is a bucket of executions, so that state and rows are exchanged once per bucket and batch, not per execution.
    Of each execution one moment counts: the end of the lease while it runs, afterwards the end of ``keep_seconds``.
    One timer per bucket stands for the earliest of these.
    """

    def __init__(self, lease_seconds: int, keep_seconds: int):
        self.lease, self.keep = lease_seconds, keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = "execution_id string, status string, attempts int, started_at double, due bigint"
        self.state = handle.getListState("leases", held)

    def _store(self, held: dict[str, tuple], fired: int | None = None) -> None:
        if not held:
            self.state.clear()
            return
        self.state.put([(key, *row) for key, row in held.items()])
        # A timer fires once the watermark is past it. One that an earlier end has replaced fires too and finds nothing due.
        due = min(row[3] for row in held.values())
        self.handle.registerTimer(due if due - 1 == fired else due - 1)

    def _held(self) -> dict[str, tuple]:
        return {row[0]: tuple(row[1:]) for row in self.state.get()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Four values per event are kept of a batch, however wide its rows are.
        events = pd.concat([batch[["execution_id", "at", "seq", "kind"]] for batch in rows], ignore_index=True)
        moments = events["at"].astype("datetime64[us]").astype("int64")
        order = np.lexsort((events["seq"].to_numpy(), moments.to_numpy()))
        columns = (events["execution_id"], moments, events["seq"], events["kind"])
        held, out = self._held(), []
        for execution, micros, seq, what in zip(*[c.to_numpy()[order].tolist() for c in columns], strict=True):
            status, attempts, started, due = held.get(execution, (None, 0, 0.0, None))
            if what not in _KINDS:
                raise ValueError(f"an event has the unknown kind {what}")
            moment, prior, claimed = micros / 1e6, status, False
            if what == "CLAIM":
                live = status == "RUNNING" and moment - started < self.lease
                claimed = status != "COMPLETED" and not live
                if claimed:
                    status, attempts, started = "RUNNING", attempts + 1, moment
            elif status is not None and status != "COMPLETED":
                status = what
            if status is not None:
                ends = started + self.lease if status == "RUNNING" else moment + self.keep
                held[execution] = (status, attempts, started, int(ends * 1000))
            out.append((execution, seq, what, claimed, prior, status, attempts))
        self._store(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, over = self._held(), []
        now = timerValues.getCurrentWatermarkInMs()
        for execution, (status, attempts, started, due) in list(held.items()):
            if due > now:
                continue
            if status == "RUNNING":
                # Claimable from now on; later claims count on from these attempts until the execution is forgotten.
                held[execution] = ("EXPIRED", attempts, started, due + 1000 * self.keep)
                over.append((execution, None, "LEASE_OVER", False, "RUNNING", "EXPIRED", attempts))
            else:
                del held[execution]
        self._store(held, expiredTimerInfo.getExpiryTimeInMs())
        if over:
            yield self._frame(over)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in LEASE_OUTPUT.split(", ")])
        return frame.astype({"seq": "Int64", "attempts": "int32"})

    def close(self) -> None:
        pass
