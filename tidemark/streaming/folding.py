"""The forward fold of an entity's history as a stream with keyed state.

A row waits in its key's list until the watermark has passed its time; then all that wait are folded in their order, as the
batch fold does, onto the state that the rows before them left. So rows may come late by as much as the watermark
allows, in any order and in any number of batches, and the outcome is that of one batch over all of them. State and
lists are in the checkpoint: a query that is started again goes on where it stopped.

Edge cases: rows of one time are in the order of their ids; a null value moves no state; rows later than the watermark are
left out by it; keys have nothing in common, so a batch touches only the keys that have rows or due timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the fold needs of a row: its key, id, time, step (an amount or null), state (whether a rule comes into force, or null), and two marks.
ROW = "id long, at timestamp, step decimal(18,2), state boolean, converts boolean, forms boolean"
FOLDED = "key long, id long, prev_amount decimal(18,2), in_force boolean, converted boolean, founded timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at) -> int:
    return int(pd.Timestamp(at, tz="UTC").timestamp() * 1000)


def _none(x):
    return None if pd.isna(x) else x


class Fold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "prev_amount decimal(18,2), in_force boolean, converted boolean, founded timestamp")
        self.waiting = handle.getListState("waiting", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for df in rows:
            for r in df[["id", "at", "step", "state", "converts", "forms"]].itertuples(index=False):
                self.waiting.appendValue(tuple(_none(x) for x in r))
                times.add(_ms(r.at))
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        every = list(self.waiting.get())
        due = sorted((r for r in every if _ms(r[1]) <= passed), key=lambda r: (r[1], r[0]))
        if not due:
            return
        later = [r for r in every if _ms(r[1]) > passed]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        amount, in_force, converted, founded = self.state.get() if self.state.exists() else (None, False, False, None)
        out = []
        for id_, at, step, state, converts, forms in due:
            founded = at if founded is None and forms else founded
            out.append((key[0], id_, amount, in_force, converted, founded))
            amount = amount if step is None else step
            in_force = in_force if state is None else bool(state)
            converted = converted or bool(converts)
        self.state.update((amount, in_force, converted, founded))
        told = pd.DataFrame(out, columns=["key", "id", "prev_amount", "in_force", "converted", "founded"])
        told["founded"] = pd.to_datetime(told["founded"])
        yield told

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """(key, id, prev_amount, in_force, converted, founded) of a stream (key and the columns of ``ROW``), each row once it can't be overtaken."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = stream.withWatermark("at", late).groupBy("key")
    return timed.transformWithStateInPandas(Fold(), outputStructType=FOLDED, outputMode="Append", timeMode="EventTime")
