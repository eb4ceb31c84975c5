"""What a listening session knows of itself: its levels, cues and curves, and who spoke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from .governance import first_match
from .timeline import overlaps

LEAST_WORDS = 8
HORIZON_S = 180.0
OWN_WORDS, ROOM_WORDS = 50, 10


def recent_medians(words: DataFrame, by: str, rows: int = 40) -> DataFrame:
    """For each word the median level of the unsuspected words up to it, the last `rows` of them, once there are LEAST_WORDS."""
    w = W.partitionBy(by).orderBy("end", "id").rowsBetween(1 - rows, 0)
    good = words.where(~F.col("suspect"))
    return good.select("id", by, F.when(F.count("loud").over(w) >= LEAST_WORDS, F.percentile("loud", F.lit(0.5)).over(w)).alias("level"))


def live_cues(words: DataFrame, cues: list[str]) -> DataFrame:
    """Which cues were measured anywhere."""
    return words.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in cues])


def default_cues(words: DataFrame) -> DataFrame:
    """The scores that count by default: pitch and level against the long term, duration against the short."""
    return words.select("id", F.col("pitch_lt").alias("pitch"), F.col("loud_lt").alias("loud"), F.col("dur_st").alias("dur"))


def stored_decline(cue: Column, place: Column, slope: Column, start: Column) -> Column:
    """What is left of a cue above a stored curve at a place in its sentence."""
    return cue - (start + slope * place)


def level_decline(words: DataFrame, cue: str, by: list[str]) -> DataFrame:
    """What is left of a cue above a line of its speaker's stored `slope` through the sentence's own mean point."""
    w = W.partitionBy(*by)
    has = F.col(cue).isNotNull()
    mean, centre = F.avg(cue).over(w), F.avg(F.when(has, F.col("place"))).over(w)
    return words.withColumn("rest", F.col(cue) - (mean + F.col("slope") * (F.col("place") - centre)))


def diagnosed(counters: DataFrame) -> DataFrame:
    """counters (session, frames, level_max, speech, opens, closes, with_words) with the first stage that saw nothing, null if all saw something: no frames, silence, no speech, speech never in a row, segments never closed, no words."""
    stage = first_match(
        (F.col("frames") == 0, "frames"), (F.col("level_max") < fixed.SILENT_DB, "silence"), (F.col("speech") == 0, "speech"), (F.col("opens") == 0, "in a row"), (F.col("closes") == 0, "closed"), (F.col("with_words") == 0, "words"),
        default=None,
    )
    return counters.select("session", stage.alias("first_silent"))


def with_context(words: DataFrame, by: str, starts: DataFrame, horizon: float = HORIZON_S) -> DataFrame:
    """The words that scoring a segment (by, segment, start, stop) looks at: those within the horizon before its start and its own, which carry its number.

    An equi-join on the speaker and a stretch of time as long as the horizon: a word is in one, a segment in those that it and its horizon touch.
    """
    stretch = lambda x: F.floor(x / horizon)
    listed = starts.withColumn("_k", F.explode(F.sequence(stretch(F.col("start") - horizon), stretch(F.col("stop")))))
    near = words.withColumn("_k", stretch(F.col("end"))).join(listed, [by, "_k"]).where((F.col("end") >= F.col("start") - horizon) & (F.col("end") < F.col("stop")))
    return near.select(by, "segment", "id", (F.col("end") >= F.col("start")).alias("new"))


def level_reference(words: Column) -> Column:
    """What levels are held against: one's own words, those of the room, or nothing, by how many there are."""
    return first_match((words >= OWN_WORDS, "own"), (words >= ROOM_WORDS, "room"), default="none")


def offset(slope: Column, value: Column, median: Column) -> Column:
    """The level that distance takes away."""
    return slope * (value - median)


def dynamic_range(frames: DataFrame, by: str, value: str) -> DataFrame:
    """The 90th less the 10th percentile of the levels: the nearer the mouth, the wider."""
    q = lambda p: F.percentile(value, F.lit(p))
    return frames.groupBy(by).agg(F.round(q(0.9) - q(0.1), 6).alias("range"), F.count(value).alias("n"))


def speech_seconds(windows: DataFrame, silences: DataFrame, by: list[str], width: float) -> DataFrame:
    """windows (id, a, b) with the seconds of them that no silence (c, d) covers; silences of one track don't overlap."""
    lost = overlaps(windows, silences, by, width).groupBy("id").agg(F.sum("overlap").alias("lost"))
    return windows.join(lost, "id", "left").select("id", (F.col("b") - F.col("a") - F.coalesce("lost", F.lit(0.0))).alias("seconds"))


def kept_windows(spoken: DataFrame, by: str, most: int = 200) -> DataFrame:
    """The newest of one's own speaking windows (at): so many are remembered."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("at"), F.desc("id")))
    return spoken.withColumn("_k", place).where(F.col("_k") <= most).drop("_k")


def utterance_vectors(utterances: DataFrame, windows: DataFrame, by: list[str], width: float) -> DataFrame:
    """The mean vector of the windows (id, a, b: of utterances; c, d, vector: of windows) that overlap each utterance; averages are combined by dimension before the shuffle."""
    met = overlaps(utterances, windows, by, width)
    mean = met.select("id", F.posexplode("vector").alias("pos", "x")).groupBy("id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p")).select(F.col("id").alias("vec_id"), F.col("p.m").alias("embedding"))
