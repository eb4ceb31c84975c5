"""Deletion: what follows from what, plans, new snapshots, tombstones, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints

GRACE_S = 3600.0


def closure(seed: DataFrame, cites: DataFrame) -> DataFrame:
    """(id) of the seed and of all that cite any of it (src cites dst), directly or through others.

    Only the newest ids are joined in a round, and only they are written: the set is the union of the rounds' checkpoints. It ends when a round finds
    nothing, so cycles end by themselves and chains may be of any length.
    """
    with_checkpoints(seed.sparkSession)
    edges = cites.select("src", F.col("dst").alias("id")).where("src is not null")
    everything = fresh = seed.select("id").distinct().checkpoint()
    while not fresh.isEmpty():
        fresh = edges.join(fresh, "id", "left_semi").select(F.col("src").alias("id")).distinct().join(everything, "id", "left_anti").checkpoint()
        everything = everything.union(fresh)
    return everything


def exclusive_blobs(uses: DataFrame, gone: DataFrame) -> DataFrame:
    """Digests of which every user (id) is gone, with how many used them."""
    marked = uses.join(gone.select("id", F.lit(True).alias("_gone")), "id", "left")
    return marked.groupBy("digest").agg(F.count("*").alias("uses"), F.bool_and(F.coalesce("_gone", F.lit(False))).alias("_all")).where("_all").drop("_all")


def scrubbed(ids: Column, gone: Column) -> Column:
    """A log's ids with those that are gone replaced; their number stays."""
    return F.transform(ids, lambda x: F.when(F.array_contains(gone, x), F.lit("forgotten")).otherwise(x))


def scrub_log(log: DataFrame, gone: DataFrame) -> DataFrame:
    """log (key, returned: ids) with gone ids scrubbed, by a join on ids, so that neither side is collected."""
    each = log.select("key", F.posexplode("returned").alias("at", "id"))
    marked = each.join(gone.select("id", F.lit(True).alias("_gone")), "id", "left")
    named = F.when(F.coalesce("_gone", F.lit(False)), "forgotten").otherwise(F.col("id"))
    return marked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", named.alias("id")))).alias("r"), F.count("_gone").alias("n_scrubbed")).select("key", F.array_join("r.id", ",").alias("returned"), "n_scrubbed")


def latest(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The newest row of each key: an aggregate that is combined before the shuffle, not a window. The heart of every upsert."""
    best = F.max(F.struct(*order, *[c for c in fields if c not in order])).alias("_m")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in dict.fromkeys([*order, *fields])])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of delta in place of those with their keys."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def orphans(blobs: DataFrame, uses: DataFrame, now: float, grace: float = GRACE_S) -> DataFrame:
    """Blobs (digest, bytes, at) that nothing uses and that are older than the grace."""
    return blobs.join(uses.select("digest").where("digest is not null"), "digest", "left_anti").where(F.lit(now) - F.col("at") > grace)
