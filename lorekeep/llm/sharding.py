"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
SEED = 20240611


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int) -> list[Leaf]:
    """Four shards to a region, two to a rack, all of weight 1. The seventeenth shard opens a region of its own."""
    return [Leaf(s // 4, s // 2, s) for s in range(shards)]


def one_more(leaves: list[Leaf]) -> list[Leaf]:
    """The tree with one more shard in a rack and a region of its own: no other weight changes, so rows move into the new shard only, whatever tree it was."""
    new = Leaf(*[max((getattr(x, part) for x in leaves), default=-1) + 1 for part in ("region", "rack", "shard")])
    return [*leaves, new]


def _levels(leaves: list[Leaf]) -> list[dict[int, dict[int, float]]]:
    """For each level, parent -> child -> weight; a node weighs what its leaves weigh, and weightless nodes get no rows."""
    top: dict = {0: defaultdict(float)}
    racks: dict = defaultdict(lambda: defaultdict(float))
    shards: dict = defaultdict(dict)
    for x in leaves:
        if x.weight < 0:
            raise ValueError("weights can't be negative")
        if x.weight:
            top[0][x.region] += x.weight
            racks[x.region][x.rack] += x.weight
            shards[x.rack][x.shard] = x.weight
    if not shards:
        raise ValueError("no shard has a weight")
    return [top, racks, shards]


def _nodes(children: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("id"), F.lit(float(w)).alias("w")) for k, w in sorted(children.items())])


def _drawn(key: Column, level: int, nodes: Column, seed: int) -> Column:
    """The node with the least -ln(u)/weight, u being a hash of key and node: raising one weight moves keys to that node only."""
    def score(n: Column) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(level), n["id"], key).bitwiseAND((1 << 53) - 1)
        return F.struct((-F.log((h + F.lit(0.5)) / F.lit(float(1 << 53))) / n["w"]).alias("score"), n["id"].alias("id"))

    return F.array_min(F.transform(nodes, score))["id"]


def shard_of(key: Column, leaves: list[Leaf], seed: int = SEED) -> Column:
    """The shard of a key. Draws of a level use only the node's own id and weight, so a change of weights moves keys into or
    out of the subtrees whose weights changed and leaves all other subtrees as they were. A null key is a key like others."""
    at: Column = F.lit(0)
    for level, parents in enumerate(_levels(leaves)):
        table = F.create_map(*[x for k, children in sorted(parents.items()) for x in (F.lit(k), _nodes(children))])
        at = _drawn(key, level, F.element_at(table, at), seed)
    return at


def with_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """rows with a gapless number from 0 within each shard, in the order of the input's partitions.

    Rows are counted by (shard, input partition) and numbered within that pair from the running total, so no task ever holds a
    shard, whatever its size. The rows are written first: the numbers then rest on one fixed order.
    """
    fixed = written(rows.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), "slots")
    counts = fixed.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(shard, "_part").orderBy("_pos")
    return fixed.join(starts, [shard, "_part"]).withColumn(slot, F.col("_start") + F.row_number().over(within) - 1).drop("_part", "_pos", "_n", "_start")


def assign(docs: DataFrame, shards: int = SHARDS, leaves: list[Leaf] | None = None, grown: list[Leaf] | None = None, seed: int = SEED) -> DataFrame:
    """docs with shard and grown_shard (where the row lies once the tree has become `grown`; by default one more shard in a region of its own, into which alone rows then move).

    Law `key`: doc_id and the tree decide. Null doc_ids all have one shard, repeated rows share theirs, an empty table stays
    empty, further columns pass through (a column of docs named shard or grown_shard is replaced).
    """
    leaves = topology(shards) if leaves is None else leaves
    grown = one_more(leaves) if grown is None else grown
    key = F.col("doc_id")
    return docs.withColumns({"shard": shard_of(key, leaves, seed), "grown_shard": shard_of(key, grown, seed)})


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = with_slots(assign(slim, shards))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def stage(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All documents, with all their columns, and the shard that each goes to; a column `shard` of theirs is replaced.

    Nulls, texts of any length, repeats and empty tables are as in assign().
    """
    kept = [c for c in docs.columns if c != "shard"]
    return docs.select(*kept, shard_of(F.col("doc_id"), topology(shards)).alias("shard"))
