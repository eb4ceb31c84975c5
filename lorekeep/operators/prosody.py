"""Measured words: baselines, z-scores, weights, marks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT_TERM_S = 180.0
SHORT_TERM_WORDS = 20
WEIGHTS = {"loud": 0.45, "dur": 0.25, "pitch": 0.20, "pause": 0.10}
LIGHT, STRONG = 1.143, 1.659
TAIL_POINTS = 2.0
TAIL_P = 0.15
GRADE_P = (0.1, 0.025, 0.00625, 0.0015625)
QUIET_DB = 12.0
EWMA = 0.05


def z(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / F.nullif(sd, F.lit(0.0))


def sums(value: Column, prefix: str) -> list[Column]:
    """Mergeable statistics: count, sum, sum of squares."""
    v = value.cast("double")
    return [F.count(v).alias(f"{prefix}_n"), F.sum(v).alias(f"{prefix}_s"), F.sum(v * v).alias(f"{prefix}_q")]


def mean_sd(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
    """Mean and sample deviation from sums; no deviation for fewer than two, no negative variance."""
    return s / F.nullif(n, F.lit(0)), F.when(n >= 2, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))


def _whole(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Floats as whole numbers of any size over one power of two, and that power: what is reckoned from them is exact."""
    m, e = np.frexp(x)
    e = np.where(m == 0, 0, e) - 53
    least = int(e.min(initial=0))
    return (m * 2.0**53).astype(np.int64).astype(object) * np.array([1 << k for k in range(int(e.max(initial=least)) - least + 1)], object)[e - least], -least


def _others(end: np.ndarray, x: np.ndarray, span: float, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and deviation of the other finite values whose end is in the last `span` seconds, for rows from `begin` of one speaker, in order of end. Sums are exact."""
    own = np.isfinite(x)
    v, power = _whole(np.where(own, x, 0.0))
    sums = [np.concatenate([[0], np.cumsum(w)]) for w in (own.astype(np.int64), v, v * v)]
    at = slice(begin, None)
    lo, hi = np.searchsorted(end, end[at] - span, "left"), np.searchsorted(end, end[at], "right")
    n, s, q = (c[hi] - c[lo] - w[at] for c, w in zip(sums, (own, v, v * v), strict=True))
    n = n.astype(np.int64)
    mean, sd = np.full(len(n), np.nan), np.full(len(n), np.nan)
    one, two = n > 0, n > 1
    k = n.astype(object)
    mean[one] = (s[one] / (k[one] * (1 << power))).astype(np.float64)
    sd[two] = np.sqrt(((q[two] * k[two] - s[two] * s[two]) / (k[two] * (k[two] - 1) * (1 << 2 * power))).astype(np.float64))
    return n, mean, sd


def rolling_z(words: DataFrame, cue: str, span: float = SHORT_TERM_S) -> DataFrame:
    """For each word the mean and deviation of its speaker's other unsuspect words in the last `span` seconds, and its z. Words of the same end are among them.

    A speaker's words pass one task in order, of which those of the last `span` seconds are kept. Sums are whole numbers and lose nothing when a word's own value is taken off them,
    so words that differ little, or not at all, have the deviation that they have. Words without an end have each other.
    """
    kinds = dict(words.dtypes)
    out = f"id {kinds['id']}, speaker {kinds['speaker']}, st_n long, m double, sd double, x double"
    rows = words.select("id", "speaker", F.col("end").isNull().alias("none"), F.coalesce(F.col("end").cast("double"), F.lit(0.0)).alias("end"), F.when(~F.col("suspect"), F.col(cue)).cast("double").alias("x"))
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "speaker").sortWithinPartitions("speaker", "none", "end")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, old = None, 0  # rows still needed, of which the first `old` have been given
        for pdf in chain(batches, [None]):
            now = pdf if held is None else held if pdf is None else pd.concat([held, pdf], ignore_index=True)
            if now is None or not len(now):
                continue
            who, none, end = now["speaker"].ne(now["speaker"].shift()).to_numpy() & (now["speaker"].notna() | now["speaker"].shift().notna()).to_numpy(), now["none"].to_numpy(bool), now["end"].to_numpy(np.float64)
            who[0] = True
            fresh = who | (none != np.roll(none, 1))
            first = np.flatnonzero(fresh)
            last = first[-1]
            # words of the last end may have others of it in the next batch
            ready = len(now) if pdf is None else last + int(np.searchsorted(end[last:], end[-1], "left"))
            x, got = now["x"].to_numpy(np.float64), []
            for a, b in zip(first, [*first[1:], len(now)], strict=True):
                stop = min(b, ready)
                if stop > max(a, old):
                    got.append(_others(end[a:stop], x[a:stop], span, max(0, old - a)))
            if got:
                n, m, sd = (np.concatenate(c) for c in zip(*got, strict=True))
                given = now.iloc[old:ready]
                yield pd.DataFrame({"id": given["id"], "speaker": given["speaker"], "st_n": n, "m": pd.array(m, "Float64"), "sd": pd.array(sd, "Float64"), "x": pd.array(x[old:ready], "Float64")})
            keep = last + int(np.searchsorted(end[last:], end[-1] - span, "left"))
            held, old = now.iloc[keep:].reset_index(drop=True), max(ready, keep) - keep

    t = dealt.mapInPandas(walk, out).select("id", "speaker", "st_n", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("m", "sd", "x")])
    mean, sd = F.col("m"), F.when(F.col("sd") > 1e-9, F.col("sd"))
    return t.select("id", "speaker", "st_n", F.round(F.when(F.col("x").isNotNull(), mean), 9).alias("st_mean"), F.round((F.col("x") - mean) / sd, 6).alias("st_z"))


def declination(words: DataFrame, cue: str, least: int = 4) -> DataFrame:
    """Per speaker the mean line of a cue over falling sentences with enough words, and the deviation from that line, from sums alone."""
    order = W.partitionBy("speaker", "sentence").orderBy("end", "id")
    size = W.partitionBy("speaker", "sentence")
    rows = words.where(~F.col("suspect")).where(F.col(cue).isNotNull()).withColumn("n", F.count("*").over(size)).where(F.col("n") >= least)
    rows = rows.withColumns({"x": (F.row_number().over(order) - 1) / (F.col("n") - 1), "y": F.col(cue)})
    each = rows.groupBy("speaker", "sentence").agg(
        F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
    ).where("b <= 0")
    t = each.groupBy("speaker").agg(F.count("*").alias("sentences"), F.avg("b").alias("b"), F.avg("a").alias("a"), *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])
    a, b = F.col("a"), F.col("b")
    left = F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + F.col("n") * a * a + 2 * a * b * F.col("sx") + b * b * F.col("sxx")
    return t.select("speaker", "sentences", F.round("b", 6).alias("slope"), F.round("a", 6).alias("intercept"), F.round(F.sqrt(F.greatest(left, F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0))), 4).alias("resid_sd"))


def position_class(pos: Column) -> Column:
    return F.when(pos >= 0.999, "final").when(pos <= 0.001, "initial").otherwise("middle")


def with_positions(words: DataFrame) -> DataFrame:
    """sent_pos from 0 to 1 in the sentence (0 for a single word), gaps to the neighbours in it."""
    order, size = W.partitionBy("speaker", "sentence").orderBy("end", "id"), W.partitionBy("speaker", "sentence")
    n, k = F.count("*").over(size), F.row_number().over(order)
    gap = F.col("end") - F.lag("end").over(order)
    return words.withColumns({"sent_pos": F.when(n > 1, (k - 1) / (n - 1)).otherwise(0.0), "gap_before": gap, "gap_after": F.lead("end").over(order) - F.col("end")})


def position_offsets(words: DataFrame, cue: str) -> DataFrame:
    """Per speaker and place in the sentence how far unsuspect words lie from the speaker's mean, with the pooled deviation of what is left."""
    rows = with_positions(words).where(~F.col("suspect")).withColumn("place", position_class(F.col("sent_pos")))
    centred = rows.withColumn("_c", F.col(cue) - F.avg(cue).over(W.partitionBy("speaker")))
    each = centred.groupBy("speaker", "place").agg(F.count("_c").alias("n"), F.avg("_c").alias("offset"), F.coalesce(F.var_pop("_c"), F.lit(0.0)).alias("v"))
    pooled = F.sqrt(F.sum(F.col("v") * F.col("n")).over(W.partitionBy("speaker")) / F.nullif(F.sum("n").over(W.partitionBy("speaker")) - 1, F.lit(0)))
    return each.select("speaker", "place", "n", F.round("offset", 6).alias("offset"), F.round(pooled, 6).alias("resid_sd"))


def pause_reference(words: DataFrame, share: float = 0.8) -> DataFrame:
    """Per speaker the cap, a percentile of the gaps in sentences, and mean and deviation of min(before, cap) + min(after, cap), zeros included."""
    rows = with_positions(words)
    cap = rows.where("gap_before > 0").groupBy("speaker").agg(F.percentile("gap_before", F.lit(share)).alias("cap"))
    t = F.least(F.coalesce("gap_before", F.lit(0.0)), F.col("cap")) + F.least(F.coalesce("gap_after", F.lit(0.0)), F.col("cap"))
    both = rows.join(cap, "speaker").withColumn("pause", t)
    return both.groupBy("speaker").agg(F.round(F.first("cap"), 6).alias("cap"), F.round(F.avg("pause"), 4).alias("mean"), F.round(F.stddev_samp("pause"), 4).alias("sd"))


def emphasis(cues: dict[str, Column]) -> Column:
    """The weighted mean of the z-scores that are there; null if none is."""
    total = sum((F.coalesce(c * WEIGHTS[k], F.lit(0.0)) for k, c in cues.items()), F.lit(0.0))
    held = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in cues.items()), F.lit(0.0))
    return total / F.nullif(held, F.lit(0.0))


def mark_level(weight: Column) -> Column:
    return F.when(weight > STRONG, 2).when(weight > LIGHT, 1).otherwise(0)


def long_term_z(words: DataFrame) -> DataFrame:
    """z-scores of each word against its speaker's unsuspect words, the emphasis of them and its mark."""
    w = W.partitionBy("speaker")
    good = lambda c: F.when(~F.col("suspect"), F.col(c))
    score = lambda c: z(F.col(c), F.avg(good(c)).over(w), F.stddev_samp(good(c)).over(w))
    rows = words.withColumns({f"{c}_z": score(c) for c in ("loud", "dur", "pitch")})
    rows = rows.withColumn("weight", emphasis({c: F.col(f"{c}_z") for c in ("loud", "dur", "pitch")}))
    return rows.select("id", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in ("loud", "dur", "pitch")], F.round("weight", 6).alias("weight"), mark_level(F.round("weight", 6)).alias("level"))


def tail_quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per key the median and for each grade the upper boundary: an empirical quantile where enough points lie beyond, else the exponential tail over the threshold's exceedances; null where too few."""
    u = rows.groupBy(by).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(1 - TAIL_P)).alias("u"), *[F.percentile(value, F.lit(1 - p / 2)).alias(f"q{k}") for k, p in enumerate(GRADE_P)])
    over = rows.join(u.select(by, "u"), by).where(F.col(value) > F.col("u")).groupBy(by).agg(F.count("*").alias("m"), F.avg(F.col(value) - F.col("u")).alias("e"))
    t = u.join(over, by, "left").where("n >= 4")
    tail = lambda p: F.when((F.col("m") >= 2) & (F.col("e") > 0), F.col("u") + F.col("e") * F.log(F.lit(TAIL_P / p)))
    return t.select(by, "n", F.round("median", 6).alias("median"), *[F.round(F.when(F.lit(p / 2) * F.col("n") >= TAIL_POINTS, F.col(f"q{k}")).otherwise(tail(p / 2)), 6).alias(f"rung{k + 1}") for k, p in enumerate(GRADE_P)])


def leave_one_out_median(words: DataFrame) -> DataFrame:
    """Per speaker and sentence the median loudness of the speaker's unsuspect words in other sentences: per speaker the sorted values are kept with their sentences, and each sentence takes its own out."""
    good = words.where(~F.col("suspect")).where("loud is not null")
    every = good.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("loud", "sentence"))).alias("v"))
    rows = good.select("speaker", "sentence").distinct().join(every, "speaker")
    rest = F.transform(F.filter("v", lambda x: x["sentence"] != F.col("sentence")), lambda x: x["loud"])
    rows = rows.select("speaker", "sentence", rest.alias("r")).withColumn("n", F.size("r"))
    middle = (F.get("r", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("r", F.floor(F.col("n") / 2).cast("int"))) / 2
    return rows.select("speaker", "sentence", F.round(F.when(F.col("n") > 0, middle), 6).alias("median"))


def utterance_stats(words: DataFrame, least: int = 3) -> DataFrame:
    """Rate, loudness, its deviation and that of pitch of each sentence with enough words, of them enough unsuspect."""
    good = lambda c: F.when(~F.col("suspect"), F.col(c))
    each = words.groupBy("speaker", "sentence").agg(
        F.count("*").alias("n"), F.count(good("loud")).alias("usable"), F.round(F.count("*") / F.nullif(F.max("end") - F.min("end"), F.lit(0.0)), 6).alias("rate"),
        F.round(F.avg(good("loud")), 6).alias("loud"), F.round(F.stddev_samp(good("loud")), 6).alias("loud_sd"), F.round(F.stddev_samp(good("pitch")), 6).alias("pitch_sd"),
    )
    return each.where((F.col("n") >= least) & (F.col("usable") >= least))


def suspect_reasons(words: DataFrame) -> DataFrame:
    """Why a word is suspect: zero length, hardly voiced, quiet against its speaker's median, long but hardly voiced."""
    median = words.groupBy("speaker").agg(F.percentile("loud", F.lit(0.5)).alias("_m"))
    rows = words.join(median, "speaker")
    reasons = F.array(
        F.when(F.col("dur") <= 0.0505, "zero_span"), F.when(F.col("pitch").isNull(), "few_voiced"),
        F.when(F.col("loud") < F.col("_m") - QUIET_DB, "quiet"), F.when((F.col("dur") > 0.8) & (F.col("pitch") > 300), "long_unvoiced"),
    )
    return rows.select("id", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ",").alias("reasons"))


def ewma(rows: DataFrame, by: str, alpha: float = EWMA) -> DataFrame:
    """Per key the exponentially weighted level after all its values (end, value, id) in order, from the first.

    A value counts by its place from the end, the first one for all before it too, so a key is a sorted sum that spills and no array.
    """
    w = W.partitionBy(by).orderBy(F.desc("end"), F.desc("id"))
    placed = rows.select(by, "value", (F.row_number().over(w) - 1).alias("_k"), F.count("*").over(W.partitionBy(by)).alias("_n"))
    share = F.pow(F.lit(1 - alpha), F.col("_k")) * F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(alpha)
    return placed.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(share * F.col("value")), 6).alias("level"))


def derived_levels(weights: DataFrame, by: str, step: float = 0.001) -> DataFrame:
    """Per key the cuts for light and strong marks: where the right half of the weights exceeds the mirrored left half.

    For a threshold t from the median on, the excess is the number of weights above t less that of left ones whose mirror image
    is above t. Light is the first t of a grid at which at least half of the weights above it are excess, strong the first from there on
    at which no more than half of light's excess is left. The grid's counts come from one sorted pass: each weight is put on
    its grid step, steps are counted, and running sums give every excess.
    """
    w = weights.where("w is not null")
    middle = w.groupBy(by).agg(F.percentile("w", F.lit(0.5)).alias("m"))
    signed = w.join(middle, by).select(by, "m", F.when(F.col("w") > F.col("m"), F.col("w")).otherwise(2 * F.col("m") - F.col("w")).alias("x"), (F.col("w") > F.col("m")).alias("right"))
    placed = signed.withColumn("k", F.ceil(F.round((F.col("x") - F.col("m")) / step, 6)).cast("long"))  # above t = m + j * step for all j < k
    counts = placed.groupBy(by, "m", "k").agg(F.sum(F.col("right").cast("long")).alias("r"), F.sum((~F.col("right")).cast("long")).alias("l"))
    after = W.partitionBy(by).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    # between two occupied steps nothing changes, so the first step of each stretch stands for it
    grid = counts.withColumns({"R": F.sum("r").over(after), "L": F.sum("l").over(after), "j": F.coalesce(F.lag("k").over(W.partitionBy(by).orderBy("k")), F.lit(0))})
    grid = grid.where("k > 0").withColumn("excess", F.col("R") - F.col("L"))
    light = grid.where((F.col("R") > 0) & (F.col("excess") * 2 >= F.col("R"))).groupBy(by).agg(F.min(F.struct("j", "excess")).alias("a")).select(by, F.col("a.j").alias("light_j"), F.col("a.excess").alias("light_x"))
    strong = grid.join(light, by).where((F.col("j") >= F.col("light_j")) & (F.col("excess") * 2 <= F.col("light_x"))).groupBy(by).agg(F.min("j").alias("strong_j"))
    out = middle.join(light, by, "left").join(strong, by, "left")
    return out.select(by, F.round("m", 6).alias("median"), F.round(F.col("m") + F.col("light_j") * step, 6).alias("light"), F.round(F.col("m") + F.col("strong_j") * step, 6).alias("strong"))


def word_rows(words: DataFrame, frames: DataFrame, width: float) -> DataFrame:
    """words (key, id, start, end) with what the frames (key, t, pitch, level) in them measured: an equi-join on buckets of time, then one aggregate."""
    listed = words.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    inside = listed.join(frames.withColumn("_k", F.floor(F.col("t") / width)), ["key", "_k"]).where("t >= start and t <= end")
    measured = inside.groupBy("id").agg(F.count("pitch").alias("n_voiced"), F.round(F.percentile("pitch", F.lit(0.5)), 6).alias("pitch_med"), F.round(F.percentile("level", F.lit(0.9)), 6).alias("int_p90"), F.round(F.avg("level"), 6).alias("int_mean"))
    return words.select("id").join(measured, "id", "left").withColumn("n_voiced", F.coalesce("n_voiced", F.lit(0)))


def silence_log(words: DataFrame, least: float) -> DataFrame:
    """Gaps between the words (key, id, end, word) of a key that last `least` or more, with the words on either side, and the pitch's fall."""
    w = W.partitionBy("key").orderBy("end", "id")
    rows = words.withColumns({"gap": F.col("end") - F.lag("end").over(w), "before": F.lag("word").over(w), "was": F.lag("pitch").over(w)})
    return rows.where(F.col("gap") >= least).select("key", "id", F.round("gap", 3).alias("gap"), "before", F.col("word").alias("next"), (F.col("pitch") < 0.95 * F.col("was")).alias("fell"))
