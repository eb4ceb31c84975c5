"""Audit of how document filters interact: every order of the filters, run along a trie of permutations whose states are shared."""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_enough, written

FILTERS = "ABCDE"
#: Filter A: the least number of words; B and C: percentages of distinct words and of capitals.
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
#: Ways into which the rows of one text are split where the repeated texts have to be shuffled.
SALTS = 32
_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
_MEASURED = "doc_id long, lang string, a boolean, b boolean, c boolean, d boolean, sha binary"


def measured(docs: DataFrame) -> DataFrame:
    """Each document's own failures of A to D, and the digest of its text for E. bytes.split() cuts at just the six ASCII blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                raw = text.encode()
                words = raw.split()
                capitals = len(raw) - len(raw.translate(None, _CAPITALS))
                rows.append((len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * len(text), len(raw) > len(raw.translate(None, _SIGNS)), hashlib.sha256(raw).digest()))
            flags = list(zip(*rows, strict=True)) if rows else [()] * 5
            columns = [batch.column("doc_id"), batch.column("lang"), *[pa.array(f, pa.bool_()) for f in flags[:4]], pa.array(flags[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "a", "b", "c", "d", "sha"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, _MEASURED)


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows with e: whether a smaller doc_id has the same text. First ids are found with a combine before the shuffle; those of texts with more than one id
    are broadcast behind a size check, and beyond it shuffled by digest and salt, so that not even a text with a third of all rows goes to one task."""
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    first = written(first, "audit-repeats")
    if small_enough(first.count(), 96):
        out = rows.join(F.broadcast(first), "sha", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        out = salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sha", "salt"], "left").drop("salt")
    return out.withColumn("e", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("sha", "first")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether any label of the doc_id says quality 1 or toxic 1. Only doc_ids with either are joined."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null and (good or toxic)")
    marks = written(marks.groupBy("doc_id").agg(F.bool_or(F.coalesce("good", F.lit(False))).alias("good"), F.bool_or(F.coalesce("toxic", F.lit(False))).alias("toxic")), "audit-labels")
    side = F.broadcast(marks) if small_enough(marks.count(), 32) else marks
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.join(side, "doc_id", "left").select(F.coalesce("lang", F.lit("")).alias("part"), *[F.col(f.lower()).alias(f) for f in FILTERS], no("good"), no("toxic"))


_EDGE = "part string, state string, filter string, kept long, removed long, good_lost long, toxic_lost long"


class Trie:
    """Depth-first execution of all orders of the filters over flagged rows.

    A node of the trie is a prefix of an order. What survives it depends on the set of its filters alone, so all prefixes of one set share
    one state, which is run when the first of them is reached and looked up afterwards: 32 states and 80 edges for the 325 edges of
    120 orders. A state's survivors are its parent's persisted ones without those that the edge's filter removes; one
    pass over them fills the store and counts by part what each outgoing edge removes. They are given free when the state's subtree
    is done, so six are held at most. Persisted rows have a lineage of filters over a written table, from which a lost executor's are
    made anew. Counts go to a table, not to the driver.
    """

    def __init__(self, rows: DataFrame, filters: str = FILTERS):
        self.filters, self.spark = filters, rows.sparkSession
        self.path = f"{shared_dir(self.spark)}/lorekeep/audit-edges-{uuid.uuid4().hex}"
        self.reached: set[str] = set()
        self._descend("", rows.persist(StorageLevel.MEMORY_AND_DISK))

    def edges(self) -> DataFrame:
        """(part, state, filter, kept, removed, good_lost, toxic_lost) of every edge and every part with survivors in its state."""
        return self.spark.read.schema(_EDGE).parquet(self.path)

    def _descend(self, state: str, survivors: DataFrame) -> None:
        self.reached.add(state)
        rest = [f for f in self.filters if f not in state]
        try:
            self._count(state, rest, survivors)
            for f in rest:
                after = "".join(sorted(state + f))
                if after not in self.reached and len(after) < len(self.filters):
                    self._descend(after, survivors.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK))
        finally:
            survivors.unpersist()

    def _count(self, state: str, rest: list[str], survivors: DataFrame) -> None:
        of = lambda name, cond: F.count_if(cond).alias(name)
        sums = [x for f in rest for x in (of(f"removed{f}", F.col(f)), of(f"good{f}", F.col(f) & F.col("good")), of(f"toxic{f}", F.col(f) & F.col("toxic")))]
        counts = survivors.groupBy("part").agg(F.count("*").alias("n"), *sums)
        edge = lambda f: F.struct(F.lit(f).alias("filter"), (F.col("n") - F.col(f"removed{f}")).alias("kept"), F.col(f"removed{f}").alias("removed"), F.col(f"good{f}").alias("good_lost"), F.col(f"toxic{f}").alias("toxic_lost"))
        counts.select("part", F.lit(state).alias("state"), F.inline(F.array(*map(edge, rest)))).write.mode("append").parquet(self.path)


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, zeros included, over rows (part, a boolean a filter, good, toxic).

    What an order's step counts is looked up by the set of filters before it. A filter's failures are what it removes first, its own failures
    what it removes last, its Shapley sum what it removes at each state, times the orders that reach it there.
    """
    spark, n = rows.sparkSession, len(filters)
    edges = Trie(rows, filters).edges()
    keys = [(s, f) for k in range(n) for s in map("".join, itertools.combinations(filters, k)) for f in filters if f not in s]
    every = rows.select("part").distinct().select("part", F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s, f in keys])))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    full = every.join(edges, ["part", "state", "filter"], "left").select("part", "state", "filter", *map(zero, ("kept", "removed", "good_lost", "toxic_lost")))
    size = F.length("state")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), size + 1)
    whole = full.groupBy("part", "filter").agg(
        F.sum(F.when(size == 0, F.col("removed"))).alias("fails"), F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).cast("long").alias("shapley")
    )
    steps = [("".join(o), k + 1, "".join(sorted(o[:k])), o[k]) for o in itertools.permutations(filters) for k in range(n)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    return full.join(F.broadcast(steps), ["state", "filter"]).join(whole, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One written row a document: part, its failures of A to E, good, toxic."""
    return written(labelled(with_repeats(written(measured(docs), "audit-measured")), labels), "audit-flags")


def audit_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents. A null text is empty, a null lang the part '', a null doc_id has no label and is no repeat; an empty table gives no rows."""
    return audit(flagged(docs, labels))


AUDIT_ORACLE = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from texts),
flags as (
  select part, doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
      + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as m
  from words),
groups as (select part, m, count(*) as n, count(*) filter (good) as ng, count(*) filter (toxic) as nt from flags group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (
  select o, s::int as s, 1 << (ascii(o[s]) - 65) as bit,
    (select coalesce(sum(1 << (ascii(o[i]) - 65)), 0)::int from range(1, 6) as y(i) where i < s) as before
  from orders, range(1, 6) as x(s)),
counted as (
  select part, o as filter_order, s as step, bit,
    sum(n) filter (m & (before | bit) = 0) as kept, sum(n) filter (m & before = 0 and m & bit > 0) as removed,
    sum(n) filter (m & before > 0 and m & bit > 0) as redundant, sum(n) filter (m = bit) as unique_fails,
    sum(ng) filter (m & before = 0 and m & bit > 0) as good_lost, sum(nt) filter (m & before = 0 and m & bit > 0) as toxic_lost
  from groups, steps group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from counted
"""
