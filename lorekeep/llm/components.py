"""Connected components as DataFrame rounds (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple[int, ...]:
    """The number of edges and 128 bits of two sums over hashes of them, the same in any order."""
    halves = [x for h in (F.xxhash64("a", "b"), F.xxhash64("b", F.lit(1), "a")) for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    return tuple(edges.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in halves]).first())


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of the edges (a, b: long), component being the smallest node of its component.

    Each round is two joins against per-node minima. The minima are combined before the shuffle and written, so that the
    join reads two plain shuffles: a hub with a third of all edges is then split among tasks by adaptive execution. Rounds
    grow with the logarithm of the longest path; each is cut off by a written table. Self-links and repeats do no harm,
    null ends are ignored, and no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct()
    e = written(e, "cc-edges")
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "cc-large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        e = written(small.distinct(), "cc-edges")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
