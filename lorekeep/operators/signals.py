"""Tracks and spans: pitch ranges, octave errors, silence thresholds, trimming, sentences, punctuation."""

from __future__ import annotations

from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_GAP_MIN_S = 0.6
SENTENCE_GAP_ALWAYS_S = 2.0
PITCH_FALL = 0.05


def pitch_range(values: DataFrame, by: str, value: str) -> DataFrame:
    """Per key 0.75 times the 5th to 1.5 times the 95th percentile, within 40 to 600; 60 to 300 for fewer than 100 values or an empty range."""
    q = lambda p: F.percentile(value, F.lit(p))
    t = values.groupBy(by).agg(F.count(value).alias("n"), (q(0.05) * 0.75).alias("lo"), (q(0.95) * 1.5).alias("hi"))
    lo, hi = F.greatest("lo", F.lit(40.0)), F.least("hi", F.lit(600.0))
    usable = (F.col("n") >= 100) & (lo < hi)
    return t.select(by, "n", F.round(F.when(usable, lo).otherwise(60.0), 6).alias("floor"), F.round(F.when(usable, hi).otherwise(300.0), 6).alias("ceiling"))


def without_octave_errors(track: Column, passes: int = 5, factor: float = 2.0) -> Column:
    """The values of an array after dropping, up to `passes` times, those beyond `factor` times its median."""
    def step(v: Column, _: Column) -> Column:
        s = F.array_sort(v)
        n = F.size(s)
        median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
        return F.when(n > 0, F.filter(v, lambda x: x <= factor * median)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), track, step)


def silence_threshold(speech_db: Column, noise_db: Column) -> Column:
    return F.greatest(speech_db - 15.0, noise_db + 6.0)


def trimmed(start: Column, end: Column, silences: Column) -> Column:
    """(s, e): a span cut by the silences (t0, t1), in order, that reach over one of its edges."""
    cut = lambda x, q: F.struct(F.when((q["t0"] <= x["s"]) & (q["t1"] > x["s"]), F.least(q["t1"], x["e"])).otherwise(x["s"]).alias("s"), F.when((q["t1"] >= x["e"]) & (q["t0"] < x["e"]), F.greatest(q["t0"], x["s"])).otherwise(x["e"]).alias("e"))
    return F.aggregate(silences, F.struct(start.alias("s"), end.alias("e")), cut)


def split_punctuation(token: Column) -> Column:
    """(word, punct): trailing punctuation apart; a token of nothing else is a word."""
    tail = F.regexp_extract(token, r"([.,!?;:…]+)$", 1)
    word = F.regexp_replace(token, r"[.,!?;:…]+$", "")
    return F.when(word == "", F.struct(token.alias("word"), F.lit("").alias("punct"))).otherwise(F.struct(word.alias("word"), tail.alias("punct")))


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of sorted values that stand for so many each."""
    ends = np.cumsum(counts)
    low, high = np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")
    return float(values[low] + values[high]) / 2


def two_means(values: np.ndarray, counts: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """Medians of the quiet and the loud half of levels, each standing for its count: cut at their mean, then midway between both medians until that settles. Where one half is empty, both are the median of all."""
    n = np.ones(len(values), np.int64) if counts is None else counts
    order = np.argsort(values, kind="stable")
    order = order[np.isfinite(values[order]) & (n[order] > 0)]
    v, n = values[order], n[order]
    if not len(v):
        return float("nan"), float("nan")
    at = float((v * n).sum() / n.sum())
    for left in range(rounds, -1, -1):
        cut = int(np.searchsorted(v, at, side="right"))
        if cut in (0, len(v)):
            return (_median(v, n),) * 2
        low, high = _median(v[:cut], n[:cut]), _median(v[cut:], n[cut:])
        if not left or abs((low + high) / 2 - at) < 1e-6:
            break
        at = (low + high) / 2
    return low, high


def noise_and_speech(frames: DataFrame, by: str, value: str) -> DataFrame:
    """Per key the levels of noise and speech and the threshold between them. A key's levels are first counted in steps of 0.01, which bounds what a task holds of a long recording."""
    steps = frames.where(F.col(value).isNotNull()).groupBy(by, F.round(value, 2).alias("v")).agg(F.count("*").alias("n"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = two_means(pdf["v"].to_numpy(np.float64), pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "noise": [low], "speech": [high]})

    kind = dict(steps.dtypes)[by]
    t = steps.groupBy(by).applyInPandas(split, f"{by} {kind}, noise double, speech double")
    return t.withColumn("threshold", silence_threshold(F.col("speech"), F.col("noise")))


def sentences(words: DataFrame) -> DataFrame:
    """words (file, id, speaker, start, end, punct, pitch) with the number of their sentence in the file.

    A new one begins after a final mark, at another speaker, after a gap of SENTENCE_GAP_ALWAYS_S, and after SENTENCE_GAP_MIN_S if
    the pitch has fallen below the median of the sentence so far; what counts as fallen rests on where the sentence began, so a file
    is walked in order.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["start", "id"])
        start, end, pitch, punct, who = (rows[c].tolist() for c in ("start", "end", "pitch", "punct", "speaker"))
        number, so_far, out = 0, [], []
        for k in range(len(start)):
            if k:
                gap, last = start[k] - end[k - 1], pitch[k - 1]
                known = last is not None and last == last
                fell = not known or not so_far or last < (1 - PITCH_FALL) * median(so_far)
                final = isinstance(punct[k - 1], str) and any(c in ".!?…" for c in punct[k - 1])
                if final or who[k] != who[k - 1] or gap >= SENTENCE_GAP_ALWAYS_S or (gap >= SENTENCE_GAP_MIN_S and fell):
                    number, so_far = number + 1, []
                elif known:
                    so_far.append(last)
            out.append(number)
        return rows.assign(sentence=out)

    schema = ", ".join(f"`{n}` {k}" for n, k in words.dtypes)
    return words.groupBy("file").applyInPandas(walk, f"{schema}, sentence long")
