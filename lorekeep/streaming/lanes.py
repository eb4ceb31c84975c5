"""Many keys behind one grouping key of a stream.

A keyed processor in Python costs a call, a frame in, a frame out and some turns of a socket for each key of each batch: 5 to 8 ms, whatever its rows. Here keys
share lanes, by hash; a lane's rows come as one frame and its output goes as one, while each key keeps its own entry in a map state, of which a batch reads and writes
only those it has rows of.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Lanes of a stream; fixed for the life of its checkpoint. A task holds one lane's rows of a batch at a time.
LANES = 1024


class Logic:
    """What a key's rows do to its state. OUT, STATE: schemas; NAMES: the columns of OUT; ROWS: the columns read; ORDER: the columns by which a key's rows come within a batch."""

    OUT: str
    NAMES: list[str]
    STATE: str
    ROWS: tuple[str, ...]
    ORDER: tuple[str, ...]
    TIMED = False

    def step(self, key: str, state: tuple | None, rows: Iterable[tuple]) -> tuple[tuple | None, list[tuple]]:
        """The state after a batch's rows of a key (None: nothing to keep) and what they give."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """The moment from which expired() has something to give, if no row comes before."""

    def expired(self, key: str, state: tuple, by: int) -> tuple[tuple | None, list[tuple]]:
        """The state once event time has come to a moment, and what that gives."""
        raise NotImplementedError


class Lanes(StatefulProcessor):
    """Runs a Logic for the keys (strings) of a lane. A lane has one timer, that of its earliest key."""

    def __init__(self, logic: Logic, key: str):
        self.logic, self.key = logic, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "key string", self.logic.STATE)
        if self.logic.TIMED:
            self.timer = handle.getValueState("timer", "due long")

    def _kept(self, key: str | None, before: tuple | None, after: tuple | None) -> None:
        if after is None:
            if before is not None:
                self.states.removeKey((key,))
        elif before is None or tuple(before) != tuple(after):
            self.states.updateValue((key,), after)

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.logic.NAMES)

    def _remind(self, due: int | None) -> None:
        held = self.timer.get()[0] if self.timer.exists() else None
        if due is None or held is not None and held <= due:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        codes, keys = pd.factorize(pdf[self.key], use_na_sentinel=False)
        order = np.lexsort([*(pdf[c].to_numpy() for c in reversed(self.logic.ORDER)), codes])
        columns = [pdf[c].to_numpy()[order].tolist() for c in self.logic.ROWS]
        ends = np.flatnonzero(np.diff(codes[order], append=-1)) + 1
        out, due, begin = [], None, 0
        for k, end in zip(keys[codes[order][ends - 1]], ends.tolist(), strict=True):
            k = k if isinstance(k, str) else None
            before = self.states.getValue((k,))
            after, given = self.logic.step(k, before, zip(*(c[begin:end] for c in columns), strict=True))
            self._kept(k, before, after)
            out += given
            begin = end
            if self.logic.TIMED and after is not None:
                own = self.logic.due(after)
                due = own if due is None or own is not None and own < due else due
        if self.logic.TIMED:
            self._remind(due)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # what the watermark has passed is given at once; the next timer is that of the earliest that is left
        by, out, left = timerValues.getCurrentWatermarkInMs(), [], None
        for (k,), state in list(self.states.iterator()) if self.states.exists() else []:
            own = self.logic.due(state)
            if own is not None and own <= by:
                after, given = self.logic.expired(k, state, by)
                self._kept(k, state, after)
                out += given
                own = self.logic.due(after) if after is not None else None
            left = own if left is None or own is not None and own < left else left
        self.timer.clear()
        self._remind(left)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def laned(rows: DataFrame, key: str, logic: Logic, lanes: int = LANES, also: tuple[str, ...] = ()) -> DataFrame:
    """What a Logic makes of a stream's rows by a key of strings; `also` are columns that must stay, as that of a watermark. Needs the RocksDB state store."""
    lane = F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int").alias("lane")
    keyed = rows.select(lane, *dict.fromkeys((key, *logic.ROWS, *logic.ORDER, *also)))
    return keyed.groupBy("lane").transformWithStateInPandas(Lanes(logic, key), logic.OUT, "Append", "EventTime" if logic.TIMED else "None")
