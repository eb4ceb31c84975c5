"""Beliefs: decay, provenance, chains of replacement, rebuilding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints

HALF_LIFE_DAYS = 30.0
RETURN_BONUS = 0.25
WEIGHT_CEILING = 4.0
FAINT = 0.05
MIN_CERTAINTY = 0.6
SHOWN = 8


def decayed(weight: Column, touched: Column, now: Column) -> Column:
    """weight * 0.5 ^ (days / half-life); days before `touched` count as 0."""
    return weight * F.pow(F.lit(0.5), F.greatest(now - touched, F.lit(0.0)) / 86400 / HALF_LIFE_DAYS)


def touch_fold(returns: DataFrame, by: str) -> DataFrame:
    """Per belief the weight after its returns (at) in order, from weight 1 at the first: each decays it, adds the bonus, and is cut at the ceiling. (by, weight, last_touched, times_returned)."""
    events = returns.groupBy(by).agg(F.array_sort(F.collect_list("at")).alias("e"))
    state = F.struct(F.lit(1.0).alias("w"), F.col("e")[0].alias("at"))
    step = lambda s, at: F.struct(F.least(decayed(s["w"], s["at"], at) + RETURN_BONUS, F.lit(WEIGHT_CEILING)).alias("w"), at.alias("at"))
    rows = events.withColumn("s", F.aggregate("e", state, step))
    return rows.select(by, F.round("s.w", 6).alias("weight"), F.col("s.at").alias("last_touched"), F.size("e").cast("long").alias("times_returned"))


def without_provenance(beliefs: DataFrame, sources: DataFrame) -> DataFrame:
    """Beliefs (id) for which no source names them (belief_id)."""
    return beliefs.join(sources.select(F.col("belief_id").alias("id")), "id", "left_anti")


def current_versions(beliefs: DataFrame, replaces: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, current, hops): each belief with the newest that replaces it, directly or through others.

    Pointers double each round, so rounds grow with the logarithm of the longest chain, and lineage is cut by a checkpoint each
    time. In a cycle there is no newest: a pointer stops when it would come back to its start. Of several replacements the one
    with the smallest id counts.
    """
    with_checkpoints(beliefs.sparkSession)
    by = replaces.where("src_id != dst_id").groupBy(F.col("dst_id").alias("id")).agg(F.min("src_id").alias("to"))
    at = beliefs.select("id").join(by, "id", "left").select("id", F.coalesce("to", "id").alias("to"), F.col("to").isNotNull().cast("long").alias("hops")).checkpoint()
    moving = at.where("hops > 0").count()
    for _ in range(most_rounds):
        if not moving:
            break
        onward = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        joined = at.join(onward, "to", "left")
        go = (F.coalesce("more", F.lit(0)) > 0) & (F.col("next") != F.col("id"))
        new = joined.select("id", F.when(go, F.col("next")).otherwise(F.col("to")).alias("to"), (F.col("hops") + F.when(go, F.col("more")).otherwise(0)).alias("hops"), go.alias("_go")).checkpoint()
        moving = new.where("_go").count()
        at = new.drop("_go")
    return at.withColumnRenamed("to", "current")


def derivations(beliefs: DataFrame, sources: DataFrame, replaces: DataFrame) -> DataFrame:
    """Each belief with its sources and what it replaces, both sorted and joined by commas: all that a rebuild needs."""
    text = lambda x: F.array_join(F.array_sort(F.collect_list(x)), ",")
    s = sources.groupBy(F.col("belief_id").alias("id")).agg(text(F.lpad(F.col("source_id").cast("string"), 12, "0")).alias("sources"))
    r = replaces.groupBy(F.col("src_id").alias("id")).agg(text(F.col("dst_id").cast("string")).alias("replaces"))
    return beliefs.join(s, "id", "left").join(r, "id", "left").select("id", "about", "certainty", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("replaces", F.lit("")).alias("replaces"))


def shown(beliefs: DataFrame, superseded: DataFrame, now: float, most: int = SHOWN) -> DataFrame:
    """The newest beliefs that are certain enough, not superseded and not faint."""
    w = decayed(F.col("weight"), F.col("formed_at"), F.lit(now))
    live = beliefs.where(F.col("certainty") >= MIN_CERTAINTY).withColumn("weight_now", w).where(F.col("weight_now") >= FAINT)
    live = live.join(superseded.select("id"), "id", "left_anti")
    return live.select("id", "certainty", F.round("weight_now", 6).alias("weight_now"), "formed_at").orderBy(F.desc("formed_at"), F.desc("id")).limit(most)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side: empty if a rebuild gave what there was."""
    return a.exceptAll(b).withColumn("side", F.lit("only_before")).union(b.exceptAll(a).withColumn("side", F.lit("only_after")))
