"""A listening session as one stream with its sinks; waiting with deadlines; learning people as they are heard."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.speakers import DECAY, MIN_STRENGTH, MOST_PRINTS
from ..session import shared_folder
from . import commits
from .gate import CLOSE_FRAMES, OPEN_FRAMES, PREROLL_FRAMES, THRESHOLD
from .lanes import Logic, laned

#: Seconds that a request waits for a person; that a device may deliver nothing.
APPROVAL_S, STALL_S = 45.0, 6.0
#: The distance up to which a match is confident, how far behind the next person must be, the limit of any match, what a match adds to a print, and confident matches between consolidations.
CONFIDENT_MAX, MARGIN_MIN, MATCH_MAX = 0.40, 0.10, 0.70
MATCH_BONUS = 1.0
CONSOLIDATE_EVERY = 16
#: Samples of a frame and of a second, frames that wait for a reader.
FRAME, RATE, QUEUE_MAX = 512, 16_000, 200
#: Quiet frames that part two utterances of a segment.
PAUSE_FRAMES = 3

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: For inner joins of streams: one store a partition for both sides instead of four, and no batch without rows, which would give nothing; the next one with rows evicts.
JOINED = {"spark.sql.streaming.join.stateFormatVersion": "3", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def rocksdb(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """The state store that processors with lists, maps and timers need, and further settings, for the queries started meanwhile."""
    settings = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", **(settings or {})}
    held = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def slices(rows: DataFrame, by: str, n: int) -> list[DataFrame]:
    """rows cut into n ranges of a number, in order."""
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    if lo is None:
        return [rows]
    cuts = [lo + (hi - lo) * k / n for k in range(1, n)]
    return [rows.where((F.col(by) >= a if a is not None else F.lit(True)) & (F.col(by) < b if b is not None else F.lit(True))) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]


def fed(parts: list[DataFrame], start: Callable[[DataFrame, str], object], base: str | None = None, settings: dict[str, str] | None = None) -> str:
    """Feeds parts to a stream one after another, each by a query that goes on from the checkpoint of the one before; gives the folder.

    start takes the stream and the folder and returns a DataStreamWriter. What a part brings is one batch, so rows only need an order within it.
    """
    spark = parts[0].sparkSession
    base = base or f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        go_on(spark, part.schema, start, base, settings)
    return base


def go_on(spark: SparkSession, schema, start: Callable[[DataFrame, str], object], base: str, settings: dict[str, str] | None = None) -> None:
    """Runs a stream over what has come since its checkpoint."""
    with rocksdb(spark, settings):
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        start(stream, base).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


class Session(Logic):
    """Segments of a session's frames (session, at, id, p, move), as they close.

    Frames before speech are held in a list of PREROLL_FRAMES; OPEN_FRAMES loud ones in a row open a segment, to which the held ones belong; CLOSE_FRAMES quiet ones
    close it. A move (`paused`, `capturing`) is no frame: it says whether segments that close after it are kept. The state is two lists of frames and five numbers.
    """

    FRAME = "at: double, id: long, loud: boolean"
    OUT = f"session string, segment long, t0 double, t1 double, capturing boolean, frames array<struct<{FRAME}>>"
    NAMES = ["session", "segment", "t0", "t1", "capturing", "frames"]
    STATE = f"open boolean, loud int, quiet int, capturing boolean, segments long, held array<struct<{FRAME}>>, said array<struct<{FRAME}>>"
    ROWS, ORDER = ("at", "id", "p", "move"), ("at", "id")

    def step(self, key, state, rows):
        is_open, loud, quiet, capturing, segments, held, said = state or (False, 0, 0, True, 0, [], [])
        held, said, out = [tuple(f) for f in held], [tuple(f) for f in said], []
        for at, i, p, move in rows:
            if isinstance(move, str) and move:
                capturing = move == "capturing"
                continue
            frame = (float(at), int(i), bool(p >= THRESHOLD))
            if not is_open:
                held = [*held, frame][-PREROLL_FRAMES:]
                loud = loud + 1 if frame[2] else 0
                if loud >= OPEN_FRAMES:
                    is_open, said, held, quiet = True, held, [], 0
            else:
                said.append(frame)
                quiet = 0 if frame[2] else quiet + 1
                if quiet >= CLOSE_FRAMES:
                    segments += 1
                    out.append((key, segments, said[0][0], frame[0], bool(capturing), [dict(zip(("at", "id", "loud"), f, strict=True)) for f in said]))
                    is_open, loud, said = False, 0, []
        return (is_open, loud, quiet, capturing, segments, held, said), out


def utterances(segments: DataFrame) -> DataFrame:
    """(session, segment, utterance, start, stop, frames): loud frames of a segment with at most PAUSE_FRAMES - 1 quiet ones between them."""
    order = W.partitionBy("session", "segment").orderBy("pos")  # a segment's frames, whose length is bounded by the gate
    loud = segments.select("session", "segment", F.posexplode("frames").alias("pos", "f")).where("f.loud")
    starts = loud.withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(order) > PAUSE_FRAMES, F.lit(True)).cast("long"))
    return starts.withColumn("utterance", F.sum("new").over(order)).groupBy("session", "segment", "utterance").agg(F.min("f.at").alias("start"), F.max("f.at").alias("stop"), F.count("*").alias("frames"))


def blobs(segments: DataFrame) -> DataFrame:
    """(digest, session, segment, n): a segment's sound by its content."""
    content = F.array_join(F.transform("frames", lambda f: f["id"].cast("string")), ",")
    return segments.select(F.sha2(content, 256).alias("digest"), "session", "segment", F.size("frames").cast("long").alias("n"))


#: What goes where: everything is published; blobs, records and utterances are kept only while capturing.
SINKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "archive": lambda s: blobs(s.where("capturing")),
    "store": lambda s: utterances(s.where("capturing")),
    "records": lambda s: s.where("capturing").select("session", "segment", "t0", "t1", F.size("frames").cast("long").alias("frames")),
    "channel": lambda s: s.select("session", "segment", "t0", "t1", "capturing"),
}


def to_sinks(base: str, sinks: dict[str, Callable[[DataFrame], DataFrame]] = SINKS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch of segments to every sink.

    Each sink has a folder for each batch id, which a batch that is run again writes anew; a batch counts for readers when all its
    sinks are written and its marker is put. So a stream that is killed between two sinks and started again leaves each segment once in every sink.
    """

    def write(segments: DataFrame, batch: int) -> None:
        if commits.committed(segments.sparkSession, base, batch):
            return
        segments = segments.persist()
        try:
            for name, of in sinks.items():
                of(segments).write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
            commits.put(segments.sparkSession, base, batch)
        finally:
            segments.unpersist()

    return write


def listening(sinks: dict[str, Callable[[DataFrame], DataFrame]] = SINKS) -> Callable[[DataFrame, str], object]:
    """For fed(): a stream of frames through the session processor into the sinks."""

    def start(frames: DataFrame, base: str):
        return laned(frames, "session", Session()).writeStream.foreachBatch(to_sinks(base, sinks))

    return start


def sink(spark: SparkSession, base: str, name: str) -> DataFrame:
    """What readers see of a sink: the rows of its committed batches."""
    batches = commits.all_of(spark, base)
    if not batches:
        return SINKS[name](spark.createDataFrame([], Session.OUT))
    found = spark.read.option("basePath", f"{base}/{name}").parquet(*[f"{base}/{name}/batch={b}" for b in batches])
    return found.drop("batch")


class Waiting(Logic):
    """Requests of a caller (caller, ms, id, kind) that wait for a person: an `approve` or `deny` resolves all that wait, and what is not resolved before its deadline times out, by the caller's next row or by a timer of event time.

    Silence is not consent: a decision at the very deadline is too late. The state lists the waiting requests with their deadlines.
    """

    OUT = "caller string, id long, asked long, outcome string, resolved long"
    NAMES = ["caller", "id", "asked", "outcome", "resolved"]
    STATE = "waiting array<struct<id: long, asked: long, deadline: long>>"
    ROWS, ORDER = ("ms", "id", "kind"), ("ms", "id")
    TIMED = True

    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def _resolved(self, caller: str, waiting: dict[int, tuple[int, int]], by: int, decision: str | None) -> list[tuple]:
        """What times out up to a moment, and with a decision what still waits then; both wait no more."""
        out = [(caller, i, asked, "timeout", deadline) if deadline <= by else (caller, i, asked, decision, by) for i, (asked, deadline) in waiting.items() if deadline <= by or decision]
        for _, i, *_ in out:
            del waiting[i]
        return out

    def step(self, key, state, rows):
        waiting = {i: (asked, deadline) for i, asked, deadline in state[0]} if state else {}
        out, due = [], min((d for _, d in waiting.values()), default=None)
        for ms, i, kind in rows:
            decision = {"approve": "approved", "deny": "denied"}.get(kind)
            if waiting and (decision or due <= ms):
                out += self._resolved(key, waiting, ms, decision)
                due = min((d for _, d in waiting.values()), default=None)
            if kind == "ask":
                waiting[i] = (ms, ms + self.wait)
                due = ms + self.wait if due is None else min(due, ms + self.wait)
        return self._state(waiting), out

    def _state(self, waiting: dict[int, tuple[int, int]]) -> tuple | None:
        return ([(i, asked, deadline) for i, (asked, deadline) in waiting.items()],) if waiting else None

    def due(self, state):
        return min(deadline for _, _, deadline in state[0])

    def expired(self, key, state, by):
        waiting = {i: (asked, deadline) for i, asked, deadline in state[0]}
        out = self._resolved(key, waiting, by, None)
        return self._state(waiting), out


class Stalled(Logic):
    """When a device (device, ms) has delivered nothing for more than a time: given once for each silence, by its next block or by a timer of event time."""

    OUT = "device string, last long, blocks long"
    NAMES = ["device", "last", "blocks"]
    STATE = "last long, blocks long, told boolean"
    ROWS, ORDER = ("ms",), ("ms",)
    TIMED = True

    def __init__(self, most_ms: int):
        self.most = most_ms

    def step(self, key, state, rows):
        last, blocks, told = state or (None, 0, False)
        out = []
        for (ms,) in rows:
            if last is not None and ms - last > self.most and not told:
                out.append((key, last, blocks))
            last, blocks, told = int(ms), blocks + 1, False
        return (last, blocks, False), out

    def due(self, state):
        last, _, told = state
        return None if told else last + self.most + 1

    def expired(self, key, state, by):
        last, blocks, _ = state
        return (last, blocks, True), [(key, last, blocks)]


def timed(logic: Logic, key: str, delay: str = "1 hour") -> Callable[[DataFrame, str], object]:
    """For fed(): rows with a timestamp `at` through a processor with timers of event time, into a table of files."""

    def start(rows: DataFrame, base: str):
        out = laned(rows.withWatermark("at", delay), key, logic, also=("at",))
        return out.writeStream.format("parquet").option("path", f"{base}/out")

    return start


class Learning(StatefulProcessor):
    """Prints of a person (person, at, id, embedding, anchor, others) that learn from confident matches, as rows come.

    A row's nearest print is the anchor or a learned one. The match is confident within CONFIDENT_MAX and MARGIN_MIN nearer than `others`, the distance to
    the next person (null: none); anything else is only counted. A confident one strengthens the learned print that matched and is appended; after CONSOLIDATE_EVERY of them, or with more than MOST_PRINTS, prints fade, the faint
    go, and the nearest two are merged until MOST_PRINTS are left. State: the list of learned prints and a map of counts. After each batch the person's prints are given with how many rows made them.
    """

    OUT = "person long, seen long, confident long, borderline long, consolidations long, place int, strength double, matches long, vector array<double>"
    COUNTS = ("seen", "confident", "borderline", "since", "consolidations")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prints = handle.getListState("prints", "vector array<double>, strength double, matches long")
        self.counts = handle.getMapState("counts", "name string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(np.asarray(v, np.float64), s, m) for v, s, m in self.prints.get()] if self.prints.exists() else []
        n = {c: self.counts.getValue((c,))[0] if self.counts.containsKey((c,)) else 0 for c in self.COUNTS}
        for r in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            n["seen"] += 1
            held = learn(held, n, unit(r.embedding), unit(r.anchor), r.others)
        for c, x in n.items():
            self.counts.updateValue((c,), (x,))
        if held:
            self.prints.put([(v.tolist(), s, m) for v, s, m in held])
        else:
            self.prints.clear()
        out = [(key[0], n["seen"], n["confident"], n["borderline"], n["consolidations"], k, s, m, v.tolist()) for k, (v, s, m) in enumerate(held)]
        yield pd.DataFrame(out or [(key[0], n["seen"], n["confident"], n["borderline"], n["consolidations"], None, None, None, None)], columns=["person", "seen", "confident", "borderline", "consolidations", "place", "strength", "matches", "vector"])

    def close(self) -> None:
        pass


def unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    n = np.linalg.norm(v)
    return v / n if n else v


def learn(held: list[tuple], n: dict[str, int], e: np.ndarray, anchor: np.ndarray, others: float | None) -> list[tuple]:
    """The prints (vector, strength, matches) after one row; n counts along. Distances are compared to nine places, ties go to the anchor, then to the older print."""
    distance = np.round(1.0 - np.stack([anchor, *[v for v, _, _ in held]]) @ e, 9)
    nearest = int(np.argmin(distance))
    clear = others is None or others != others or others - distance[nearest] >= MARGIN_MIN
    if not (distance[nearest] <= CONFIDENT_MAX and clear):
        n["borderline"] += distance[nearest] <= MATCH_MAX
        return held
    if nearest:
        v, s, m = held[nearest - 1]
        held = [*held[: nearest - 1], (v, s + MATCH_BONUS, m + 1), *held[nearest:]]
    held = [*held, (e, 1.0, 1)]
    n["confident"] += 1
    n["since"] += 1
    if n["since"] >= CONSOLIDATE_EVERY or len(held) > MOST_PRINTS:
        held = consolidated(held)
        n["since"], n["consolidations"] = 0, n["consolidations"] + 1
    return held


def consolidated(held: list[tuple]) -> list[tuple]:
    """Prints after fading: the faint go, then the nearest two become their mean by strength, at the end of the list, until MOST_PRINTS are left."""
    held = [(v, s * DECAY, m) for v, s, m in held if s * DECAY >= MIN_STRENGTH]
    while len(held) > MOST_PRINTS:
        vectors = np.stack([v for v, _, _ in held])
        near = vectors @ vectors.T
        near[np.tril_indices(len(held))] = -np.inf
        i, j = np.unravel_index(np.argmax(near), near.shape)
        (a, s, m), (b, t, k) = held[i], held[j]
        held = [x for p, x in enumerate(held) if p not in (i, j)] + [(unit(a * s + b * t), s + t, m + k)]
    return held


def learning(rows: DataFrame, base: str):
    """For fed(): rows through the learning processor, into a table of files."""
    out = rows.groupBy("person").transformWithStateInPandas(Learning(), Learning.OUT, "Append", "None")
    return out.writeStream.format("parquet").option("path", f"{base}/out")


class Clock(Logic):
    """How a device's clock runs against the wall's, and its blocks cut anew into frames (device, at, id, samples; a row with samples null empties the queue).

    Elapsed against heard seconds since the first block go into running sums, so the line through all blocks needs none of them. Blocks of any size become frames of
    FRAME samples, the rest is carried on; frames wait in a queue of QUEUE_MAX, of which the oldest are dropped when it is full. After each batch the device's
    numbers are given with how many blocks made them.
    """

    OUT = "device string, blocks long, samples long, frames long, carry long, dropped long, drift double, drift_max double, rate double"
    NAMES = ["device", "blocks", "samples", "frames", "carry", "dropped", "drift", "drift_max", "rate"]
    FIELDS = ("blocks", "samples", "frames", "queued", "dropped", "first_samples", "first_at", "drift", "drift_max", "sx", "sy", "sxx", "sxy")
    STATE = ", ".join(f"{f} {t}" for f, t in zip(FIELDS, ["long"] * 6 + ["double"] * 7, strict=True))
    ROWS, ORDER = ("at", "samples"), ("at", "id")

    def step(self, key, state, rows):
        s = dict(zip(self.FIELDS, state or [0] * 6 + [0.0] * 7, strict=True))
        for at, samples in rows:
            if samples is None or samples != samples:
                s["queued"] = 0
                continue
            s["blocks"] += 1
            s["samples"] += int(samples)
            if s["blocks"] == 1:
                s["first_samples"], s["first_at"] = s["samples"], float(at)
            x, y = (s["samples"] - s["first_samples"]) / RATE, float(at) - s["first_at"]
            s["drift"] = y - x
            s["drift_max"] = s["drift"] if abs(s["drift"]) > abs(s["drift_max"]) else s["drift_max"]
            s["sx"], s["sy"], s["sxx"], s["sxy"] = s["sx"] + x, s["sy"] + y, s["sxx"] + x * x, s["sxy"] + x * y
            new = s["samples"] // FRAME - s["frames"]
            s["frames"] += new
            over = max(0, s["queued"] + new - QUEUE_MAX)
            s["dropped"], s["queued"] = s["dropped"] + over, s["queued"] + new - over
        spread = s["blocks"] * s["sxx"] - s["sx"] * s["sx"]
        rate = (s["blocks"] * s["sxy"] - s["sx"] * s["sy"]) / spread if s["blocks"] > 1 and spread > 0 else None
        out = (key, s["blocks"], s["samples"], s["frames"], s["samples"] % FRAME, s["dropped"], s["drift"], s["drift_max"], rate)
        return tuple(int(s[f]) if k < 6 else float(s[f]) for k, f in enumerate(self.FIELDS)), [out]


def clocked(rows: DataFrame, base: str):
    """For fed(): blocks through the clock processor, into a table of files."""
    return laned(rows, "device", Clock()).writeStream.format("parquet").option("path", f"{base}/out")
