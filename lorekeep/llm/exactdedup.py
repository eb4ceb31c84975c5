"""Exact dedup of incoming batches against immutable snapshots that are screened by static binary-fuse filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, written

#: Distinct digests that a filter, and so a task that builds or probes it, holds on average.
FILTER_KEYS = 20_000
#: Ways into which the rows of one digest are split where the byte check has to shuffle.
SALTS = 32
_LOWEST = -(1 << 63)


class BinaryFuse8:
    """Three-wise binary fuse filter with 8-bit fingerprints over distinct 64-bit keys and 1/256 false positives. Never changes once built.

    Its size is 0.875 + 3.45 / ln(keys) bytes a key, 1.125 at least, rounded to whole segments: 9.8 bits a key for 20,000 keys, 9.5 for 50,000, 9.0 for many millions.
    """

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.astype(np.uint64) + np.uint64(seed)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return h ^ (h >> np.uint64(33))

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three places for each hash, in three neighbouring segments."""
        mask, size = np.uint64(segment - 1), np.uint64(segment)
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        return np.stack([first, (first + size) ^ ((h >> np.uint64(18)) & mask), (first + size + size) ^ (h & mask)], axis=1).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << min(18, max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
        room = int(round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))))
        segments = max(1, round(room / segment) - 2)
        for seed in range(1, 200):
            if seed % 20 == 0:
                segments += 1
            h = cls._mixed(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            places = cls._places(h, segment, segments)
            order = cls._peeled(places, (segments + 2) * segment)
            if order is None:
                continue
            prints, f = np.zeros((segments + 2) * segment, np.uint8), cls._print(h)
            for which, own in reversed(order):
                at = places[which]
                others = prints[at[:, 0]] ^ prints[at[:, 1]] ^ prints[at[:, 2]]  # the own place still holds 0
                prints[own] = f[which] ^ others
            return cls(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, segments, prints)
        raise RuntimeError("no seed gives a filter; are the keys distinct?")

    @staticmethod
    def _peeled(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the place that each alone holds at that time); None if some keys can't be peeled."""
        n = len(places)
        held = np.bincount(places.ravel(), minlength=size)
        xor = np.zeros(size, np.int64)
        for j in range(3):
            np.bitwise_xor.at(xor, places[:, j], np.arange(n))
        order, left = [], n
        alone = np.flatnonzero(held == 1)
        while len(alone):
            which, first = np.unique(xor[alone], return_index=True)
            order.append((which, alone[first]))
            left -= len(which)
            gone = places[which].ravel()
            np.subtract.at(held, gone, 1)
            np.bitwise_xor.at(xor, gone, np.repeat(which, 3))
            alone = np.unique(gone)
            alone = alone[held[alone] == 1]
        return order if not left else None

    def __contains__(self, key: int) -> bool:
        return bool(self.screen(np.array([key]))[0])

    def screen(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be held: never false for a key that is."""
        h = self._mixed(keys.astype(np.uint64), self.seed)
        p = self.prints[self._places(h, self.segment, self.segments)]
        return (p[:, 0] ^ p[:, 1] ^ p[:, 2]) == self._print(h)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = BinaryFuse8.build(pdf["fuse_key"].to_numpy().view(np.uint64))
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [np.uint64(f.seed).astype(np.int64)], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})


def _probe(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(filters):
        return batch.assign(maybe=False)
    f = filters.iloc[0]
    fuse = BinaryFuse8(int(np.int64(f["seed"]).view(np.uint64)), int(f["segment"]), int(f["segments"]), np.frombuffer(f["prints"], np.uint8))
    return batch.assign(maybe=fuse.screen(batch["fuse_key"].to_numpy().view(np.uint64)))


def digested(docs: DataFrame, text: Column, snapshot: Column) -> DataFrame:
    """(rid, doc_id, sha, in_snapshot) of each row, written: the only thing of a row that goes on, 32 bytes for its text."""
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", sha.alias("sha"), snapshot.alias("in_snapshot")), "dedup-digests")


def grouped(digests: DataFrame) -> DataFrame:
    """One row a digest: n, the largest doc_id and the row that has it. Combined before the shuffle, so a hot text is a few rows there."""
    order = F.coalesce("doc_id", F.lit(_LOWEST))
    return digests.groupBy("sha").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.max_by("rid", order).alias("keep_rid"))


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """A static binary-fuse filter for each bucket of a snapshot's distinct digests: (bucket, seed, segment, segments, prints)."""
    return snapshot.select("bucket", "fuse_key").groupBy("bucket").applyInPandas(_build, "bucket long, seed long, segment long, segments long, prints binary")


def screened(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """The batch's distinct digests with `maybe`: false means that no snapshot holds the digest."""
    from pyspark.sql import types as T

    schema = T.StructType([*batch.schema.fields, T.StructField("maybe", T.BooleanType())])
    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_probe, schema)


def byte_check(docs: DataFrame, text: Column, digests: DataFrame, count: int) -> None:
    """Reads the texts of all rows whose digest is in an exact bucket with other rows, and fails if one digest has two texts.

    Grouping by the text itself compares bytes; it is combined before the shuffle, so only positives move, and of a hot text one
    copy a task. digests are broadcast behind a size check; beyond it the join is shuffled by digest and salt.
    """
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select(text.alias("text"), sha.alias("sha"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    if small_enough(count, 64):
        rows = rows.join(F.broadcast(digests.select("sha")), "sha", "left_semi")
    else:
        spread = digests.select("sha", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.join(spread, ["sha", "salt"], "left_semi")
    texts = rows.groupBy("sha", "text").agg(F.count("*").alias("n")).groupBy("sha").agg(F.count("*").alias("texts")).where("texts > 1")
    if clash := texts.count():
        raise RuntimeError(f"{clash} digests have more than one text")


def _with_groups(digests: DataFrame, exact: DataFrame) -> DataFrame:
    """digests with the columns of their group, null for rows alone. Groups are broadcast behind a size check; beyond it only hot ones
    are, of a thousandth of all grouped rows or more and so a thousand at most, and no key of the shuffled join is hot."""
    count, rows = exact.agg(F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    if small_enough(count, 96):
        return digests.join(F.broadcast(exact), "sha", "left")
    hot = F.col("group_size") >= max(2, rows // 1000)
    large = exact.where(hot)
    rest = digests.join(F.broadcast(large.select("sha")), "sha", "left_anti").join(exact.where(~hot), "sha", "left")
    return rest.unionByName(digests.join(F.broadcast(large), "sha"))


def dedup(docs: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, in_snapshot.

    snapshot: which rows the immutable snapshot holds; the others are the incoming batch. By default every second doc_id by
    hash, which exercises both sides; the groups are the same for any split. Of equal texts the row with the largest doc_id
    stays, of rows that also share it (or have none) exactly one. A null text is equal to the empty one. An empty table gives
    no rows; further columns are not read.
    """
    if snapshot is None:
        snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = digested(docs, text, snapshot)
    buckets = max(64, -(-digests.count() // FILTER_KEYS))
    held, new = digests.where("in_snapshot"), digests.where("not coalesce(in_snapshot, false)")
    key = F.xxhash64("sha")
    placed = lambda x: grouped(x).withColumn("fuse_key", key).withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("long"))
    held, new = written(placed(held), "dedup-snapshot"), written(placed(new), "dedup-batch")
    maybe = written(screened(new, snapshot_filters(held, buckets)), "dedup-screened")

    cols = ["sha", "n", "keep_id", "keep_rid"]
    side = lambda x, s: x.select(*cols, F.lit(s).alias("side"))
    positive = maybe.where("maybe")
    both = positive.join(held.select("sha"), "sha", "left_semi").select("sha")
    shared = side(held.join(positive.select("sha"), "sha", "left_semi"), 0).union(side(positive.join(both, "sha", "left_semi"), 1))
    parts = shared.union(side(held.where("n > 1"), 0)).union(side(new.where("n > 1"), 1)).distinct()
    order = F.coalesce("keep_id", F.lit(_LOWEST))
    exact = parts.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max("keep_id").alias("keep_id"), F.max_by("keep_rid", order).alias("keep_rid"))
    exact = written(exact.where("group_size > 1"), "dedup-groups")
    byte_check(docs, text, exact, exact.count())

    out = _with_groups(digests, exact)
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "in_snapshot",
    )


def dedup_table(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).drop("in_snapshot")


DEDUP_ORACLE = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
