"""What is handed on of a search: judged hits with their neighbours, short ones in their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIGHT_GAP_S = 3.0
STAND_ALONE_WORDS = 8


def narrowed(hits: DataFrame, obs: DataFrame, gap: float = TIGHT_GAP_S) -> DataFrame:
    """hits (id, rank, keep, needs_context) that were kept, with the observations next to those that need context if near enough; each id once, at its best rank, as a hit before a neighbour.

    A null verdict counts as withheld.
    """
    order = W.partitionBy("session").orderBy("started_at", "id")
    near = obs.select(
        "id",
        F.when(F.col("started_at") - F.lag("ended_at").over(order) <= gap, F.lag("id").over(order)).alias("prev"),
        F.when(F.lead("started_at").over(order) - F.col("ended_at") <= gap, F.lead("id").over(order)).alias("next"),
    )
    kept = hits.where(F.coalesce("keep", F.lit(False))).join(near, "id", "left")
    beside = F.when(F.coalesce("needs_context", F.lit(False)), F.array("prev", "next")).otherwise(F.array().cast("array<string>"))
    roles = F.concat(F.array(F.struct(F.lit(0).alias("role"), F.col("id").alias("hit"))), F.transform(F.filter(beside, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(1).alias("role"), x.alias("hit"))))
    rows = kept.select("rank", F.explode(roles).alias("r")).select("rank", "r.role", F.col("r.hit").alias("id"))
    return rows.groupBy("id").agg(F.min(F.struct("rank", "role")).alias("m")).select("id", F.col("m.rank").alias("rank"), F.when(F.col("m.role") == 0, "hit").otherwise("neighbour").alias("role"))


def released(hits: DataFrame, windows: DataFrame, least: int = STAND_ALONE_WORDS) -> DataFrame:
    """hits (id, text) with the text of their window where they are too short to stand alone and the window says more."""
    from .timeline import word_count

    rows = hits.join(windows.select("id", F.col("text").alias("_window")), "id", "left")
    short = (word_count("text") < least) & (word_count("_window") > word_count("text"))
    return rows.select("id", F.when(short, F.col("_window")).otherwise(F.col("text")).alias("text"), F.coalesce(short, F.lit(False)).alias("released"))
