"""Batch twins of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.views import epoch, table
from ..streaming import gate
from .catalog import query


@query(None)
def vad_segments_batch(spark, sf_dir):
    """Events as frames of a voice detector, 32 ms apart in each user's order; tests hold the gate against a direct restatement and against the stream."""
    rows = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as session", f"(row_number() over (partition by user_id order by {epoch('ts')}, event_id) - 1) * {gate.FRAME_S}D as t", "least(1.0D, value / 60) as p")
    return gate.gated(rows).select("session", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "reason")


@query("select date_trunc('hour', ts) as start, event_type as key, count(*) as n, round(avg(value), 6) as level from events group by 1, 2")
def level_windows_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("key"), "value")
    out = rows.groupBy(F.window("ts", "1 hour"), "key").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("level"))
    return out.select(F.col("window.start").alias("start"), "key", "n", "level")
