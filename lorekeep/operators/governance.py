"""Who may do what: admission, release, presence, logs, budgets, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import REQUEST_WORDS

WRITE_TOOLS = ("write_belief", "record_answer")
DEAD_AFTER_S = 90.0
SILENT_S = 900.0
ALONE_S = 300.0
DAILY_CALLS = 200
DAILY_TOKENS = 300_000
MIN_WORDS = 4


def first_match(*cases: tuple[Column, str], default: str) -> Column:
    """The label of the first condition that holds; null conditions don't."""
    out = None
    for when, label in cases:
        out = F.when(when, label) if out is None else out.when(when, label)
    return F.lit(default) if out is None else out.otherwise(default)


def admitted(requests: DataFrame, callers: DataFrame) -> DataFrame:
    """requests (id, caller, tool) with the decision: unknown callers no, writing tools need can_write, others can_read."""
    rows = requests.join(callers.select("caller", "can_read", "can_write", F.lit(True).alias("_known")), "caller", "left")
    write = F.col("tool").isin(*WRITE_TOOLS)
    decision = first_match((F.col("_known").isNull(), "unknown"), (write & ~F.col("can_write"), "may not write"), (~write & ~F.col("can_read"), "may not read"), default="ok")
    return rows.select("id", "caller", "tool", decision.alias("decision"))


def released(requests: DataFrame, grants: DataFrame, now: float) -> DataFrame:
    """requests (id, caller, tool, stale, mode) with how their results are released: stale code refuses, mode off allows, a live grant allows, else one asks."""
    live = grants.where(F.col("expires_at") > now).groupBy("caller", "tool").agg(F.max("expires_at").alias("expires_at"))
    rows = requests.join(live, ["caller", "tool"], "left")
    how = first_match((F.col("stale"), "refuse"), (F.col("mode") == "off", "allow"), (F.col("expires_at").isNotNull(), "standing"), default="ask")
    return rows.select("id", how.alias("release"))


def presence(rows: DataFrame, now: float, window: float = ALONE_S) -> DataFrame:
    """By place: alone, accompanied or no evidence, from the people heard in [now - window, now], both ends bound; unknown voices count as company."""
    near = rows.where((F.col("at") >= now - window) & (F.col("at") <= now))
    each = near.groupBy("place").agg(F.countDistinct("person").alias("people"), F.sum(F.col("person").isNull().cast("long")).alias("unknown"))
    state = first_match((F.col("people") + F.col("unknown") == 0, "no evidence"), ((F.col("people") == 1) & (F.col("unknown") == 0), "alone"), default="accompanied")
    return each.select("place", "people", "unknown", state.alias("state"))


def addressed(rows: DataFrame) -> DataFrame:
    """The first rung on which an utterance (id, text, paused, recognised) fails: paused, short, no request, unrecognised; else for the model."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(0)))
    first = F.lower(F.regexp_extract("text", r"^\s*([A-Za-z']+)", 1))
    asks = first.isin(*REQUEST_WORDS) | F.col("text").rlike(r"\?\s*$")
    return rows.select("id", first_match((F.col("paused"), "paused"), (n < MIN_WORDS, "short"), (~asks, "no request"), (~F.col("recognised"), "unrecognised"), default="ask the model").alias("rung"))


def shaped_log(log: DataFrame) -> DataFrame:
    """log (id, caller, arguments as json) with its arguments sorted and without secrets."""
    args = F.from_json("arguments", "map<string,string>")
    kept = F.array_sort(F.map_entries(F.map_filter(args, lambda k, v: ~k.isin("secret", "caller"))))
    return log.select("id", "caller", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("arguments"))


def spend(calls: DataFrame) -> DataFrame:
    """Per provider and day calls, tokens, cost and whether the day's budget is spent."""
    each = calls.groupBy("provider", "day").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    return each.withColumn("halted", (F.col("calls") >= DAILY_CALLS) | (F.col("tokens") >= DAILY_TOKENS))


def liveness(beats: DataFrame, now: float) -> DataFrame:
    """Per process its last heartbeat and whether it lives."""
    each = beats.groupBy("pid").agg(F.max("at").alias("last_seen"), F.count("*").alias("beats"))
    return each.withColumn("alive", F.lit(now) - F.col("last_seen") < DEAD_AFTER_S)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys (key, value) in which two configurations differ; a missing key is null."""
    both = a.select("key", F.col("value").alias("old")).join(b.select("key", F.col("value").alias("new")), "key", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def secret_hash(salt: Column, secret: Column) -> Column:
    return F.sha2(F.concat(salt, secret), 256)


def authenticated(attempts: DataFrame, callers: DataFrame) -> DataFrame:
    """attempts (id, caller, secret) with their outcome, callers having (caller, salt, hash)."""
    rows = attempts.join(callers.select("caller", "salt", "hash", F.lit(True).alias("_known")), "caller", "left")
    given = F.length(F.coalesce("secret", F.lit(""))) > 0
    outcome = first_match((F.col("_known").isNull(), "unknown"), (F.col("hash").isNull(), "no secret set"), (~given, "none presented"), (secret_hash(F.col("salt"), F.col("secret")) != F.col("hash"), "wrong"), default="ok")
    return rows.select("id", outcome.alias("outcome"))


def listed(callers: DataFrame) -> DataFrame:
    """Callers as anyone may see them: that there is a secret, and nothing of it."""
    return callers.select("caller", "can_read", "can_write", F.col("hash").isNotNull().alias("has_secret"))


def ledger(calls: DataFrame) -> DataFrame:
    """calls (id, provider, day, tokens, out, at) with the calls and tokens of their provider and day up to them, and whether credit has run out by then."""
    w = W.partitionBy("provider", "day").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    return calls.select("id", F.count("*").over(w).alias("calls"), F.sum("tokens").over(w).alias("tokens"), F.max("out").over(w).alias("halted"))


def banners(transitions: DataFrame, by: str) -> DataFrame:
    """The status sentence after the last of each one's transitions (event_id, at, state)."""
    last = transitions.groupBy(by).agg(F.max_by(F.struct("state", "at"), F.struct("at", "event_id")).alias("x"))
    since = F.concat(F.lit(" since "), F.date_format("x.at", "yyyy-MM-dd HH:mm"), F.lit("."))
    return last.select(by, F.when(F.col("x.state") == "paused", F.concat(F.lit("Paused"), since)).when(F.col("x.state") == "incognito", F.concat(F.lit("Off the record"), since)).otherwise("Listening.").alias("banner"))


def snapshot(files: DataFrame) -> DataFrame:
    """files (path, content) as (path, digest)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def changed(then: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose digest isn't what it was: edited, deleted or added."""
    both = then.select("path", F.col("digest").alias("old")).join(now.select("path", F.col("digest").alias("new")), "path", "full_outer")
    change = first_match((F.col("new").isNull(), "deleted"), (F.col("old").isNull(), "added"), default="edited")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", change.alias("change"))


def reaped(beats: DataFrame, now: float) -> DataFrame:
    """Processes (pid, at, event_id, ended) that stay: whose last sign isn't their end and isn't older than SILENT_S."""
    last = beats.groupBy("pid").agg(F.max("at").alias("last_seen"), F.max_by("ended", F.struct("at", "event_id")).alias("ended"))
    return last.where(~F.col("ended") & (F.lit(now) - F.col("last_seen") <= SILENT_S)).select("pid", "last_seen")


def stamped(rows: DataFrame) -> DataFrame:
    """rows (config, digest, held_config, held_digest) with whether what was stamped under the held ones may be used."""
    state = first_match((~F.col("held_config").eqNullSafe(F.col("config")), "made under other settings"), (~F.col("held_digest").eqNullSafe(F.col("digest")), "content has changed"), default="ok")
    return rows.withColumn("state", state)


def replies(rows: DataFrame) -> DataFrame:
    """rows (reply) by the schema of a judge's answer: its state, malformed, no answer or ok, and the numbers to keep."""
    read = F.from_json("reply", "keep array<long>, why string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    state = first_match((F.col("_r").isNull() | F.col("_r.broken").isNotNull(), "malformed"), (F.col("_r.keep").isNull(), "no answer"), default="ok")
    return rows.withColumn("_r", read).withColumn("state", state).withColumn("keep", F.when(F.col("state") == "ok", F.col("_r.keep"))).drop("_r")
