"""From captured segments to baselines, prints and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .governance import first_match
from .people import _setup
from .signals import PITCH_FALL
from .vectors import centroids

DIMENSIONS = 64
BASELINE = "speaker long, n long, mean double, sd double, setup string"


def save_baselines(stats: DataFrame, path: str, settings: dict[str, str]) -> None:
    """stats (speaker, n, mean, sd) as lines of JSON, each with the digest of its settings."""
    stats.select("speaker", "n", "mean", "sd", F.lit(_setup(stats.sparkSession, settings)).alias("setup")).write.json(path)


def load_baselines(spark: SparkSession, path: str, settings: dict[str, str]) -> DataFrame:
    """The baselines of a file; refused where any was made under other settings."""
    rows, own = spark.read.schema(BASELINE).json(path), _setup(spark, settings)
    if not rows.where(F.coalesce(F.col("setup") != own, F.lit(True))).isEmpty():
        raise ValueError("these baselines were made under other settings")
    return rows


def or_empty(speakers: DataFrame, stats: DataFrame) -> DataFrame:
    """Each speaker's baseline, the empty one, from which sums begin, where there is none."""
    rows = speakers.join(stats, "speaker", "left")
    return rows.select("speaker", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"), F.col("n").isNull().alias("empty"))


def finished(words: DataFrame, by: list[str]) -> DataFrame:
    """Of the last word (end, id, punct, pitch) of each sentence: does a final mark end it (marked), is its pitch well below the median of the words before it (fell)."""
    keys = ", ".join(by)
    placed = words.selectExpr("*", f"row_number() over (partition by {keys} order by end desc, id desc) as _k")
    before = placed.where("_k > 1").groupBy(*by).agg(F.percentile("pitch", F.lit(0.5)).alias("_before"))
    last = placed.where("_k = 1").join(before, by, "left")
    fell = F.coalesce(F.col("pitch") < (1 - PITCH_FALL) * F.col("_before"), F.lit(False))
    return last.select(*by, "id", F.coalesce("punct", F.lit("")).rlike("[.!?…]").alias("marked"), fell.alias("fell"))


def surveyed(calls: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Providers by their calls (provider, today, failed, at): without a key, out of the day's budget, failing at the last call, or available."""
    each = calls.groupBy("provider").agg(F.sum(F.col("today").cast("long")).alias("calls"), F.max_by("failed", "at").alias("failed"))
    state = first_match((~F.col("provider").isin(*keys), "no key"), (F.col("calls") >= most, "out of budget"), (F.col("failed"), "failing"), default="available")
    return each.select("provider", state.alias("state"), "calls")


def enrolled(windows: DataFrame, by: str) -> DataFrame:
    """The print of each person from their usable windows (embedding, usable), and how many those are."""
    good = windows.where("usable")
    return centroids(good, by).withColumnRenamed("centroid", "print").join(good.groupBy(by).agg(F.count("*").alias("windows")), by)


def embedded(texts: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, dims, norm): texts (key, text) as vectors of DIMENSIONS, given by their places above 0 with counts, and their length. Words and
    the kind ('passage:' or 'query:') count at the place that their hash gives; counts are combined before the shuffle. No model is asked."""
    words = F.concat(F.array(F.lit(kind)), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(0)))
    place = (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % DIMENSIONS).cast("int")
    counts = texts.select(key, F.explode(words).alias("word")).groupBy(key, place.alias("place")).agg(F.count("*").alias("n"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("dims"), F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    return held


def handled(segments: DataFrame, moves: DataFrame, by: str) -> DataFrame:
    """segments (by, at, event_id, speech) with whether capture was on when they came, by the last move (state) before them, and the sinks they go to."""
    both = segments.select(by, "at", "event_id", "speech", F.lit(None).cast("string").alias("state")).unionByName(moves.select(by, "at", "event_id", F.lit(None).cast("boolean").alias("speech"), "state"))
    now = F.expr(f"last(state, true) over (partition by {by} order by at, event_id rows between unbounded preceding and current row)")
    rows = both.withColumn("_on", F.coalesce(now, F.lit("capturing")) == "capturing").where("speech is not null")
    sinks = first_match((~F.col("_on"), ""), (F.col("speech"), "archive,channel,records,store"), default="channel,records")
    return rows.select("event_id", F.col("_on").alias("kept"), sinks.alias("sinks"))
