"""How far a speaker was from the microphone: the modulation spectrum of a track's envelope, its range while there is speech, and whether either may stand for distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signals import noise_and_speech

#: Seconds between frames; bands of the modulation spectrum in Hz.
HOP_S = 0.010
SLOW_FROM, FAST_FROM, FAST_TO = 0.5, 4.0, 16.0
#: The smallest step over the largest, recordings at one distance that a calibration needs, and how often the span must exceed their spread.
LEAST_STEP_RATIO = 0.25
LEAST_SAME = 4
SPAN_OVER_SPREAD = 2.0


def _turn(times: Column, of: Column) -> Column:
    """The angle of so many `of`-ths of a turn, reduced before it becomes a float."""
    return F.pmod(times, of) * (2 * F.pi()) / of


def _split(n: Column, bins: Column) -> Column:
    """The divisor p of n for which p sums a frame and n / p sums a bin are the fewest."""
    small = F.filter(F.sequence(F.lit(1).cast("long"), F.ceil(F.sqrt(n)).cast("long")), lambda d: n % d == 0)
    every = F.concat(small, F.transform(small, lambda d: (n / d).cast("long")))
    return F.array_min(F.transform(every, lambda p: F.struct((n * p + bins * (n / p)).alias("cost"), p.alias("p"))))["p"]


def modulation(frames: DataFrame, by: str, hop: float = HOP_S) -> DataFrame:
    """(by, n, fast, slow): frames of each track and the energy of its envelope in the fast and the slow band; null where a band has no bin.

    frames (by, at: 0, 1, ... without gaps, db). The envelope less its mean, under a Hann window, is transformed at the bands' bins only, by grouped sums of
    cosine and sine products in two steps: with n = p q, frame q a + b and bin j, first over a for each b and each j mod p, then over
    b. That takes n p + bins q products, p being the divisor of n that makes them fewest, where one step would take n bins;
    only a track of a prime number of frames has no such split. Sums are combined before each shuffle, and a track's sums are spread over b and j, so
    a long track is work for many tasks.
    """
    lin = F.pow(F.lit(10.0), F.col("db") / 20)
    tracks = frames.groupBy(by).agg(F.count("*").alias("n"), F.avg(lin).alias("mean"), (F.max("db") > F.min("db")).alias("moves"))
    n = F.col("n")
    last = F.least(F.floor(n / 2), F.ceil(n * hop * FAST_TO) + 1)
    tracks = tracks.withColumn("last", last).withColumn("p", _split(n, F.col("last"))).withColumn("q", (n / F.col("p")).cast("long"))
    hann = 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("at") / (n - 1))
    x = frames.join(tracks.where("moves and n > 2"), by).withColumn("x", (lin - F.col("mean")) * hann)
    p, q, r, j, b = F.col("p"), F.col("q"), F.col("r"), F.col("j"), F.col("b")
    x = x.select(by, "n", "p", "q", "last", "x", F.floor(F.col("at") / q).alias("a"), (F.col("at") % q).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), p - 1)).alias("r"))
    angle = _turn(r * F.col("a"), p)
    inner = x.groupBy(by, "n", "p", "last", "b", "r").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(-F.col("x") * F.sin(angle)).alias("im"))
    bins = F.when(r <= F.col("last"), F.sequence(r, F.col("last"), p))
    angle = _turn(j * b, n)
    outer = inner.withColumn("j", F.explode(bins)).where(j / (n * hop) >= SLOW_FROM).where(j / (n * hop) < FAST_TO)
    outer = outer.groupBy(by, "n", "j").agg(F.sum(F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle)).alias("re"), F.sum(F.col("im") * F.cos(angle) - F.col("re") * F.sin(angle)).alias("im"))
    power, fast = F.col("re") * F.col("re") + F.col("im") * F.col("im"), j / (n * hop) >= FAST_FROM
    bands = outer.groupBy(by).agg(F.sum(F.when(fast, power)).alias("fast"), F.sum(F.when(~fast, power)).alias("slow"))
    return tracks.select(by, "n").join(bands, by, "left")


def distance_proxies(frames: DataFrame, by: str, hop: float = HOP_S) -> DataFrame:
    """(by, n, mod_ratio, dyn_range, level): both proxies of distance and the level of speech of each track.

    mod_ratio: the fast band over the slow one in decibels; null where there is no slow bin or the level never moves. dyn_range: the 90th less the 10th percentile of the
    frames that aren't silent. Adding a constant to all levels changes neither.
    """
    levels = noise_and_speech(frames, by, "db")
    q = lambda p: F.percentile("db", F.lit(p))
    voiced = frames.join(levels.select(by, "threshold"), by).where("db >= threshold").groupBy(by).agg((q(0.9) - q(0.1)).alias("dyn_range"))
    ratio = F.when(F.col("slow") > 0, 10 * F.log10(F.col("fast") / F.col("slow")))
    return modulation(frames, by, hop).join(levels.select(by, F.col("speech").alias("level")), by, "left").join(voiced, by, "left").select(by, "n", ratio.alias("mod_ratio"), "dyn_range", "level")


def calibrated(readings: DataFrame, by: str, proxies: list[str]) -> DataFrame:
    """For each calibration and proxy whether the proxy may stand for distance, and its line of level.

    readings (by, distance, level, one column a proxy): distance counts recordings made at growing distances, and is null for those
    made at one. A proxy is usable if it rises or falls with every step, its smallest step is LEAST_STEP_RATIO of its largest, LEAST_SAME recordings at one distance
    measure it, and its span is more than SPAN_OVER_SPREAD times their spread. `chosen` is the first usable one in the order given. A proxy that isn't measured at some distance isn't usable.
    """
    long = readings.select(by, "distance", "level", F.posexplode(F.array(*proxies)).alias("place", "value"))
    far, same = long.where("distance is not null"), long.where("distance is null and value is not null")
    order = W.partitionBy(by, "place").orderBy("distance")  # one calibration's readings, a few
    step = F.col("value") - F.lag("value").over(order)
    steps = far.withColumn("step", step).groupBy(by, "place").agg(
        F.count("*").alias("n"), F.count("value").alias("measured"), F.min(F.signum("step")).alias("down"), F.max(F.signum("step")).alias("up"),
        F.min(F.abs("step")).alias("least"), F.max(F.abs("step")).alias("most"), F.abs(F.max_by("value", "distance") - F.min_by("value", "distance")).alias("span"),
        F.regr_slope("level", "value").alias("slope"), F.regr_intercept("level", "value").alias("start"),
    )
    spread = same.groupBy(by, "place").agg(F.count("*").alias("n_same"), F.when(F.count("*") > 1, F.max("value") - F.min("value")).alias("same_range"))
    t = steps.join(spread, [by, "place"], "left").withColumn("n_same", F.coalesce("n_same", F.lit(0)))
    monotonic = (F.col("n") > 1) & (F.col("measured") == F.col("n")) & (F.col("down") == F.col("up")) & (F.col("up") != 0)
    ratio = F.when(F.col("most") > 0, F.col("least") / F.col("most")).otherwise(0.0)
    t = t.withColumn("monotonic", monotonic).withColumn("step_ratio", ratio).withColumn("enough_same", F.col("n_same") >= LEAST_SAME)
    wide = F.coalesce(F.col("span") > SPAN_OVER_SPREAD * F.col("same_range"), F.lit(False))
    t = t.withColumn("usable", F.col("monotonic") & (F.col("step_ratio") >= LEAST_STEP_RATIO) & F.col("enough_same") & wide)
    first = F.min(F.when(F.col("usable"), F.col("place"))).over(W.partitionBy(by))
    name = F.element_at(F.array(*map(F.lit, proxies)), F.col("place") + 1)
    return t.select(by, name.alias("proxy"), "monotonic", "step_ratio", "span", "n_same", "same_range", "enough_same", "slope", "start", "usable", F.coalesce(F.col("place") == first, F.lit(False)).alias("chosen"))
