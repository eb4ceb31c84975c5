"""Keyed stream processors: a voice gate with hysteresis, levels that follow, attention that is held."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .lanes import Logic, laned

FRAME_S = 0.032
THRESHOLD = 0.5
OPEN_FRAMES = 2
CLOSE_FRAMES = 10
PREROLL_FRAMES = 7
MAX_SEGMENT_S = 12.0
MIN_SEGMENT_S = 0.2
ATTENTION_S = 45.0
#: Hours of the spans within which streams of utterances are joined.
SPAN_H = 12


class Gate:
    """Opens after OPEN_FRAMES frames of speech in a row, keeps PREROLL_FRAMES before them, closes after CLOSE_FRAMES quiet ones or at MAX_SEGMENT_S.

    push() returns None or a finished run (start, end, reason); runs shorter than MIN_SEGMENT_S are dropped. The state is five numbers.
    """

    def __init__(self, state: tuple | None = None):
        self.open, self.start, self.speech, self.quiet, self.held = state or (False, 0.0, 0, 0, 0)

    @property
    def state(self) -> tuple:
        return self.open, self.start, self.speech, self.quiet, self.held

    def push(self, t: float, p: float) -> tuple[float, float, str] | None:
        loud = p >= THRESHOLD
        if not self.open:
            self.held = min(self.held + 1, PREROLL_FRAMES)
            self.speech = self.speech + 1 if loud else 0
            if self.speech >= OPEN_FRAMES:
                self.open, self.start, self.quiet = True, t - (self.held - 1) * FRAME_S, 0
            return None
        self.quiet = 0 if loud else self.quiet + 1
        if self.quiet >= CLOSE_FRAMES:
            return self._close(t, "quiet")
        if t + FRAME_S - self.start >= MAX_SEGMENT_S:
            return self._close(t, "long")
        return None

    def finish(self, t: float) -> tuple[float, float, str] | None:
        return self._close(t, "end") if self.open else None

    def _close(self, t: float, reason: str) -> tuple[float, float, str] | None:
        run = (self.start, t + FRAME_S, reason)
        self.open, self.speech, self.quiet, self.held = False, 0, 0, 0
        return run if run[1] - run[0] >= MIN_SEGMENT_S else None


RUN = T.StructType([T.StructField("session", T.StringType()), T.StructField("t0", T.DoubleType()), T.StructField("t1", T.DoubleType()), T.StructField("reason", T.StringType())])
_STATE = T.StructType([T.StructField("open", T.BooleanType()), T.StructField("start", T.DoubleType()), *[T.StructField(n, T.IntegerType()) for n in ("speech", "quiet", "held")]])


def _runs(key: tuple, frames: Iterator[pd.DataFrame], gate: Gate) -> pd.DataFrame:
    rows = pd.concat(list(frames)).sort_values("t")
    found = [r for r in (gate.push(t, p) for t, p in zip(rows["t"].tolist(), rows["p"].tolist(), strict=True)) if r]
    return pd.DataFrame([(key[0], *r) for r in found], columns=[f.name for f in RUN.fields])


def gated_stream(frames: DataFrame) -> DataFrame:
    """Finished runs of a stream of frames (session, t, p), state kept by session. Frames of a session arrive in order; within a batch they are sorted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(state.get if state.exists else None)
        out = _runs(key, batches, gate)
        state.update(gate.state)
        yield out

    return frames.groupBy("session").applyInPandasWithState(step, RUN, _STATE, "append", GroupStateTimeout.NoTimeout)


def gated(frames: DataFrame) -> DataFrame:
    """The same over a table; what is open at a session's end is closed there."""

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gate = Gate()
        out = _runs(key, iter([pdf]), gate)
        last = gate.finish(float(pdf["t"].max()))
        return pd.concat([out, pd.DataFrame([(key[0], *last)], columns=out.columns)]) if last else out

    return frames.groupBy("session").applyInPandas(whole, RUN)


class Attention(Logic):
    """Decides by session whether an utterance (session, at, named, request) is addressed: the name opens attention, every addressed utterance in it holds it for ATTENTION_S more."""

    OUT = "session string, at double, addressed boolean"
    NAMES = ["session", "at", "addressed"]
    STATE = "until double"
    ROWS, ORDER = ("at", "named", "request"), ("at",)

    def step(self, key, state, rows):
        until = state[0] if state else 0.0
        out = []
        for at, named, request in rows:
            addressed = bool(named) or (at < until and bool(request))
            until = at + ATTENTION_S if addressed else until
            out.append((key, at, addressed))
        return (until,), out


def attended_stream(utterances: DataFrame) -> DataFrame:
    """Utterances of a stream with whether they are addressed. Needs the RocksDB state store."""
    return laned(utterances, "session", Attention())


def self_heard_stream(utterances: DataFrame, own: DataFrame, lead: float = 0.3, tail: float = 0.6, delay: str = "10 minutes") -> DataFrame:
    """Pairs of utterances (session, id, a, b: timestamps) and own speech (session, c, d) that overlap, own speech widened: an interval join of two streams with watermarks, so state is bounded.

    Both sides are joined within spans of SPAN_H hours, so a row meets its neighbours and not all that its session holds; own speech within an hour of the next span is in both.
    """
    hour = 3_600_000_000
    span = lambda t, by=0: f"(unix_micros({t}) + {by}) div {SPAN_H * hour}"  # noqa: E731  never falls as t grows, which is all that is needed
    u = utterances.withWatermark("a", delay).withColumn("span", F.expr(span("a")))
    o = own.select("session", "c", "d").withWatermark("c", delay).withColumn("span", F.explode(F.expr(f"sequence({span('c', -hour)}, {span('c', hour)})")))
    widened = F.expr(f"u.session = o.session and u.span = o.span and b > c - interval {lead} seconds and a < d + interval {tail} seconds and c >= a - interval 1 hour and c <= a + interval 1 hour")
    return u.alias("u").join(o.alias("o"), widened).select("u.session", "id", "a", "b", "c", "d")


def level_windows(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and mean levels by key in tumbling windows of event time; rows later than the watermark are dropped, windows are given once they are final."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "key").agg(F.count("*").alias("n"), F.avg("value").alias("level")).select(F.col("window.start").alias("start"), "key", "n", "level")
