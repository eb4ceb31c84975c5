"""Deletion that is applied: everything that follows from what is forgotten goes in one change, and its files with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints
from . import forget as G
from . import timeline as T
from .store import Store
from .versions import Change

SWEPT = "swept: no observation referred to it"


def follows(c: Change, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of observations and of beliefs that go with the seed (id): all that cite or draw on any of them, directly or through others. What replaces a belief doesn't draw on it."""
    every = G.closure(seed, c.read("edges").where("type in ('cites', 'came-from')"))
    beliefs = c.read("beliefs").select(F.col("id").cast("string").alias("id")).join(every, "id", "left_semi").checkpoint()
    return c.read("observations").select("id").join(every, "id", "left_semi").distinct().checkpoint(), beliefs


def forget(store: Store, seed: DataFrame, reason: str, at: float, purge: bool = True) -> dict[str, int]:
    """Forgets the observations in seed (id) and all that follows from them; how many of what went.

    Observations, answers that cite them, beliefs that draw on any of them, edges at either end, samples that nothing left uses, and windows
    whose text holds their words go; sessions that lost a row get their windows anew. In the log what was returned stays in number and place
    with 'forgotten' for ids that are gone. Each leaves a tombstone. All of it is one change: readers see everything or nothing, and only folders
    that hold a row in question are written anew. With purge the files of former versions are removed afterwards; if the job dies before, the
    next purge() does it. Another change meanwhile raises Conflict with nothing changed. An id that isn't known does nothing.
    """
    with_checkpoints(store.spark)
    with store.change(alone=True) as c:
        obs, beliefs = follows(c, c.read("observations").select("id").join(seed.select("id"), "id", "left_semi").distinct())
        gone = obs.union(beliefs).distinct().checkpoint()
        n = {"observations": obs.count(), "beliefs": beliefs.count()}
        uses = c.read("uses")
        blobs = c.read("blobs").join(G.exclusive_blobs(uses, obs), "digest", "left_semi").select("digest").distinct().checkpoint()
        n["blobs"] = blobs.count()
        sessions = c.read("observations").join(obs, "id", "left_semi").select("session").distinct().checkpoint()

        without(c, "observations", "id", obs)
        without(c, "beliefs", "id", beliefs)
        without(c, "edges", "src", gone)
        without(c, "edges", "dst", gone)
        without(c, "uses", "id", obs)
        without(c, "blobs", "digest", blobs.select(F.col("digest").alias("id")))
        n["log"] = scrub(c, gone)
        n["windows_dropped"], n["windows_rebuilt"] = repair(c, obs, sessions)
        kinds = ((obs, "id", "observation"), (beliefs, "id", "belief"), (blobs, "digest", "audio"))
        stones = [ids.select(F.col(key).alias("id"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(at).alias("at")) for ids, key, kind in kinds]
        if n["observations"] or n["beliefs"]:
            c.append("tombstones", stones[0].union(stones[1]).union(stones[2]))
    if purge:
        store.purge()
    return n


def forget_sessions(store: Store, sessions: list[int], at: float, purge: bool = True) -> dict[str, int]:
    """Whole sessions, on the same path."""
    seed = store.read("observations").where(F.col("session").isin(*sessions)).select("id")
    return forget(store, seed, "forget sessions " + ",".join(map(str, sessions)), at, purge)


def forget_minutes(store: Store, minutes: float, at: float, purge: bool = True) -> dict[str, int]:
    """What was observed in the last minutes."""
    seed = store.read("observations").where(F.col("started_at") >= at - 60 * minutes).select("id")
    return forget(store, seed, f"forget {minutes}m", at, purge)


def without(c: Change, name: str, key: str, gone: DataFrame) -> int:
    """Takes the rows whose key is in gone (id) out of a table; how many."""
    marks = gone.select(F.col("id").cast("string").alias("_id"))
    joined = lambda how: lambda rows: rows.join(marks, F.col(key).cast("string") == F.col("_id"), how)
    return c.rewrite(name, joined("left_semi"), joined("left_anti"))


def scrub(c: Change, gone: DataFrame) -> int:
    """Puts 'forgotten' in place of gone ids in what the log says was returned; in how many rows. Ids are joined, so no list of them is collected."""
    marks = gone.select(F.col("id").alias("_id"), F.lit(True).alias("_gone"))

    def hit(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_id", F.explode("returned")).join(marks, "_id", "left_semi").dropDuplicates(["id"])

    def of(rows: DataFrame) -> DataFrame:
        each = rows.select("id", F.posexplode("returned").alias("_at", "_id")).join(marks, "_id", "left")
        named = F.when(F.col("_gone"), "forgotten").otherwise(F.col("_id"))
        new = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", named.alias("_id")))).alias("_new"))
        return rows.join(new, "id", "left").withColumn("returned", F.coalesce(F.col("_new._id"), F.col("returned")))

    return c.rewrite("log", hit, of)


def repair(c: Change, gone: DataFrame, sessions: DataFrame) -> tuple[int, int]:
    """Drops the windows of gone observations and builds those of their sessions anew from what is left; how many of each."""
    dropped = without(c, "windows", "id", gone)
    rebuilt = c.rewrite("windows", lambda rows: rows.join(sessions, "session", "left_semi"), lambda rows: rows.join(sessions, "session", "left_anti"))
    if rebuilt:
        c.append("windows", T.centred_windows(c.read("observations").join(sessions, "session", "left_semi")))
    return dropped, rebuilt


def sweep(store: Store, now: float, grace: float = G.GRACE_S, apply: bool = False, purge: bool = True) -> dict[str, int]:
    """Samples that nothing uses and that are older than the grace: how many and of how many bytes. Only with apply do they go, in one change with a tombstone each."""
    with_checkpoints(store.spark)
    with store.change(alone=apply) as c:
        found = G.orphans(c.read("blobs"), c.read("uses"), now, grace).dropDuplicates(["digest"]).checkpoint()
        n, freed = found.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        if apply and n:
            ids = found.select(F.col("digest").alias("id"))
            without(c, "blobs", "digest", ids)
            c.append("tombstones", ids.select("id", F.lit("audio").alias("kind"), F.lit(SWEPT).alias("reason"), F.lit(now).alias("at")))
    if apply and purge:
        store.purge()
    return {"blobs": n, "bytes": freed}
