"""The record store: observations, beliefs, edges and what else a memory holds, as tables whose changes are versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import settings_digest
from ..session import shared_folder, with_checkpoints
from .beliefs import FAINT, current_versions, decayed
from .guards import question_shaped
from .versions import Change, Versions

SCHEMAS = {
    "observations": "id string, kind string, session long, started_at double, ended_at double, person string, text string, is_question boolean",
    "beliefs": "id long, owner long, statement string, about string, author string, certainty double, weight double, formed_at double",
    "edges": "src string, dst string, type string, at double",
    "meta": "key string, value string, at double",
    "uses": "id string, digest string",
    "blobs": "digest string, bytes long, at double",
    "log": "id string, caller string, returned array<string>, at double",
    "windows": "id string, session long, text string",
    "tombstones": "id string, kind string, reason string, at double",
}


class Store(Versions):
    """A store in a folder that all machines share. A reader sees one version of all tables; what one call writes becomes visible at once, or not at all."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        super().__init__(spark, path or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", SCHEMAS)

    def append(self, name: str, rows: DataFrame) -> None:
        with self.change() as c:
            c.append(name, rows)

    def open(self, settings: dict[str, str]) -> None:
        """Checks the tables' columns and that the settings are those the store was made with; the first to open it sets them."""
        for name in SCHEMAS:
            self.read(name)
        own = self.spark.range(1).select(settings_digest(F.create_map(*[x for k, v in settings.items() for x in (F.lit(k), F.lit(v))])).alias("d")).first()["d"]
        held = self.read("meta").where("key = 'settings'").agg(F.max("value")).first()[0]
        if held is None:
            self.append("meta", self.spark.createDataFrame([("settings", own, 0.0)], SCHEMAS["meta"]))
        elif held != own:
            raise ValueError("the store was made with other settings")

    def add_observations(self, rows: DataFrame) -> None:
        """rows (id, kind, session, started_at, ended_at, person, text); whether each asks is noted as it is written."""
        self.append("observations", rows.withColumn("is_question", question_shaped(F.col("text"))))

    def add_answers(self, rows: DataFrame, at: float) -> DataFrame:
        """rows (like observations, and cites: ids): those that cite anything, and only what is known, become observations and edges, together. The others come back, with the reason."""
        judged = self._once(cited(rows, self.read("observations")))
        good = judged.where("reason = 'ok'")
        with self.change() as c:
            c.append("observations", good.withColumn("is_question", F.lit(False)))
            c.append("edges", linked(good.select(F.col("id").alias("src"), F.explode(F.array_distinct("cites")).alias("dst")), "cites", at))
        return judged.where("reason != 'ok'")

    def add_beliefs(self, rows: DataFrame, at: float, then: Callable[[Change], None] | None = None) -> DataFrame:
        """rows (like beliefs, and sources: ids, replaces: an id or null): those with sources and a subject become beliefs and edges, together with what `then` adds to the change. The others come back, with the reason."""
        judged = self._once(proposed(rows))
        good = judged.where("reason = 'ok'")
        src = F.col("id").cast("string").alias("src")
        with self.change() as c:
            c.append("beliefs", good)
            came = good.select(src, F.explode(F.array_distinct(F.col("sources").cast("array<string>"))).alias("dst"))
            c.append("edges", linked(came, "came-from", at).union(linked(good.where("replaces is not null").select(src, F.col("replaces").cast("string").alias("dst")), "replaces", at)))
            if then:
                then(c)
        return judged.where("reason != 'ok'")

    def _once(self, rows: DataFrame) -> DataFrame:
        """rows, computed and kept once for all that reads them."""
        with_checkpoints(self.spark)
        return rows.checkpoint()

    def link(self, pairs: DataFrame, type: str, at: float) -> None:
        self.append("edges", linked(pairs, type, at))

    def edge_types(self) -> DataFrame:
        """The census of edges: type, n, first_seen, last_seen."""
        return self.read("edges").groupBy("type").agg(F.count("*").alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))

    def drop_beliefs(self) -> tuple[int, int]:
        """Empties beliefs and their edges; how many of each there were."""
        with self.change() as c:
            beliefs = c.read("beliefs").count()
            layer = F.col("type").isin("came-from", "replaces")
            edges = c.rewrite("edges", lambda rows: rows.where(layer), lambda rows: rows.where(~layer))
            c.replace("beliefs", self.spark.createDataFrame([], SCHEMAS["beliefs"]))
        return beliefs, edges


def linked(pairs: DataFrame, type: str, at: float) -> DataFrame:
    """pairs (src, dst) as edges of a type."""
    return pairs.select("src", "dst", F.lit(type).alias("type"), F.lit(at).alias("at"))


def cited(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (id, cites) with the reason: 'no sources', 'unknown source' if any id cited isn't known, else 'ok'."""
    each = rows.select("id", F.explode("cites").alias("cite"))
    lost = each.join(known.select(F.col("id").alias("cite")).distinct(), "cite", "left_anti").select("id").distinct().withColumn("_lost", F.lit(True))
    reason = F.when(F.coalesce(F.size("cites"), F.lit(0)) <= 0, "no sources").when(F.col("_lost"), "unknown source").otherwise("ok")
    return rows.join(lost, "id", "left").withColumn("reason", reason).drop("_lost")


def proposed(rows: DataFrame) -> DataFrame:
    """rows (sources, about) with the reason: 'no sources', 'no subject', else 'ok'."""
    return rows.withColumn("reason", F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no sources").when(F.length(F.btrim(F.coalesce("about", F.lit("")))) == 0, "no subject").otherwise("ok"))


def shaped_observations(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What callers may see of wanted rows (id): fields on a list, whether there is audio but never its digest; of deleted ones the reason alone."""
    text = F.when(F.col("reason").isNull(), F.col("text"))
    return rows.join(tombstones.select("id", "reason"), "id", "left").select(
        "id", F.when(F.col("reason").isNull(), F.col("person")).alias("person"), text.alias("text"), (F.col("blob").isNotNull() & F.col("reason").isNull()).alias("has_audio"), F.col("reason").alias("deleted")
    )


def shaped_beliefs(beliefs: DataFrame, sources: DataFrame, replaces: DataFrame, now: float) -> DataFrame:
    """Each belief as callers see it: its weight now to 3 places, whether it is faint, how many sources it has, what replaces it and what is current in its place."""
    weight = decayed(F.col("weight"), F.col("formed_at"), F.lit(now))
    n = sources.groupBy(F.col("belief_id").alias("id")).agg(F.count("*").alias("n"))
    by = replaces.groupBy(F.col("dst_id").alias("id")).agg(F.min("src_id").alias("replaced_by"))
    rows = beliefs.join(n, "id", "left").join(by, "id", "left").join(current_versions(beliefs, replaces).select("id", "current"), "id")
    return rows.select("id", "about", F.round("certainty", 3).alias("certainty"), F.round(weight, 3).alias("weight"), (weight < FAINT).alias("faint"), F.coalesce("n", F.lit(0)).alias("sources"), "replaced_by", "current")


def latest_settings(log: DataFrame, defaults: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, value) of every key of defaults: the last value in log (key, value, at) if it is one of those allowed, else the first of these."""
    last = log.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    allowed = log.sparkSession.createDataFrame(list(defaults.items()), "key string, allowed array<string>")
    return allowed.join(last, "key", "left").select("key", F.when(F.array_contains("allowed", F.col("value")), F.col("value")).otherwise(F.col("allowed")[0]).alias("value"))


def standing(log: DataFrame, now: Column) -> DataFrame:
    """Grants alive now of a log (caller, tool, action, at, minutes): the last action for a caller and tool counts, a grant until `minutes` after it, a revocation ends it."""
    last = log.groupBy("caller", "tool").agg(F.max_by(F.struct("action", "at", "minutes"), F.struct("at", "action")).alias("x")).select("caller", "tool", "x.*")
    return last.where("action = 'grant'").withColumn("expires_at", F.col("at") + 60 * F.col("minutes")).where(F.col("expires_at") > now).select("caller", "tool", "expires_at")


def remapped(old: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (src, dst) of a layer that was built anew, by the map ids (old_id, new_id); raises where a source has no new id."""
    lost = old.join(ids, old["id"] == ids["old_id"], "left_anti").count()
    if lost:
        raise ValueError(f"{lost} records have no new id")
    a, b = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src")), ids.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
