"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 2
#: Windows that a searcher, and so a broadcast, holds at most; a larger benchmark is searched for in several passes.
MOST_WINDOWS = 100_000

#: A-Z to a-z, other ASCII but digits and letters to a space; bytes of longer characters stay and belong to words.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def windows_of(words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    """All runs of WINDOW words; of a shorter item, if it has words, the whole."""
    for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
        yield tuple(words[i : i + WINDOW])


class WuManber:
    """Patterns of one length in words. shift: how far the search may move on when the block that ends at a place isn't the end of
    a pattern; blocks in no pattern skip the most. Blocks that end patterns lead to a bucket, where whole runs are compared."""

    def __init__(self, length: int, patterns: Iterable[tuple[tuple[bytes, ...], int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, set[int]]] = defaultdict(dict)
        for words, item in patterns:
            for end in range(self.block, length + 1):
                key = b" ".join(words[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[b" ".join(words[length - self.block :])].setdefault(b" ".join(words), set()).add(item)
        self.buckets = dict(self.buckets)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(first word, items) of every occurrence, in order."""
        length, far, shift, two = self.length, self.far, self.shift.get, self.block == 2
        at, end = length - 1, len(words)
        while at < end:
            key = words[at - 1] + b" " + words[at] if two else words[at]
            move = shift(key, far)
            if move:
                at += move
                continue
            if items := self.buckets[key].get(b" ".join(words[at - length + 1 : at + 1])):
                yield at - length + 1, items
            at += 1


class Searcher:
    """All windows of some items, one Wu-Manber machine for each length."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        by_length: dict[int, list] = defaultdict(list)
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            for w in windows_of(words):
                by_length[len(w)].append((w, k))
        self.machines = [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans (first word, end) of all occurrences and the names of their items."""
        spans, items = [], set()
        for m in self.machines:
            for at, found in m.search(words):
                spans.append((at, at + m.length))
                items |= found
        return spans, {self.names[k] for k in items}


def covered(spans: Iterable[tuple[int, int]]) -> int:
    """Words inside any span."""
    total = reach = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def searchers(benchmark: DataFrame) -> Iterator[Searcher]:
    """The benchmark in searchers of MOST_WINDOWS windows each at most, read row by row; an item's id counts as text, null as empty. At least one.

    An item of more windows is cut into runs of words that share WINDOW - 1 words, so that each window is in one of them.
    """
    items: list = []
    n = made = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary")).distinct()
    for name, text in rows.toLocalIterator():
        words = words_of(text)
        for at in range(0, max(1, len(words) - WINDOW + 1), MOST_WINDOWS):
            run = words[at : at + MOST_WINDOWS + WINDOW - 1]
            if items and n + max(1, len(run)) > MOST_WINDOWS:
                yield Searcher(items)
                items, n, made = [], 0, made + 1
            items.append((name, run))
            n += max(1, len(run))
    if items or not made:
        yield Searcher(items)


def _digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _report(doc_ids, words, hits, items) -> pa.RecordBatch:
    columns = [doc_ids, pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([_digest(i) for i in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FOUND.split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Texts are streamed past a broadcast searcher of bounded size: no shuffle, and no row waits for another. A benchmark of more
    windows is searched for in several passes over rows numbered in a written table, whose findings are merged by row. Null and
    empty texts have no words; repeated items count once by item_id; an empty benchmark hits nothing, empty docs give no rows;
    further columns aren't read.
    """
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    spark, passes = docs.sparkSession.sparkContext, searchers(benchmark)
    first, second = next(passes), next(passes, None)
    if second is None:
        only = spark.broadcast(first)

        def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, hits, items = [], [], []
                for text in b.column("text").to_pylist():
                    words = words_of(text)
                    spans, found = only.value.spans(words)
                    n.append(len(words))
                    hits.append(covered(spans))
                    items.append(found)
                yield _report(b.column("doc_id"), n, hits, items)

        return slim.mapInArrow(report, _FOUND)

    rows = written(slim.withColumn("rid", F.monotonically_increasing_id()), "decontaminate-rows")

    def finder(searcher):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                    spans, found = searcher.value.spans(words_of(text))
                    if spans:
                        out.append((rid, np.array(spans, np.int64).tobytes(), sorted(found)))
                columns = [[x[k] for x in out] for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.string()))], ["rid", "spans", "items"])

        return find

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(words_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(n, pa.int64())], ["rid", "doc_id", "n_words"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = [tuple(s) for x in pdf["spans"] for s in np.frombuffer(x, np.int64).reshape(-1, 2).tolist()]
        items = {i for x in pdf["items"] for i in x}
        return pd.DataFrame({"rid": [pdf["rid"].iloc[0]], "n_hit": [covered(spans)], "n_items": [len(items)], "items_sha256": [_digest(items)]})

    found = None
    for searcher in chain((first, second), passes):  # one at a time on the driver and in workers, its findings written
        shared = spark.broadcast(searcher)
        part = written(rows.select("rid", "text").mapInArrow(finder(shared), "rid long, spans binary, items array<string>"), "decontaminate-found")
        shared.destroy()
        found = part if found is None else found.union(part)
    merged = found.groupBy("rid").applyInPandas(merge, "rid long, n_hit long, n_items long, items_sha256 string")
    all_rows = rows.mapInArrow(count, "rid long, doc_id long, n_words long").join(merged, "rid", "left")
    none = F.lit(_digest(()))
    return all_rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold any benchmark window, streamed; a large benchmark is a chain of passes, each over a written table.

    All columns stay as they were. Null and empty texts hold no window and stay, repeats go or stay together, an empty table stays empty.
    """
    spark, passes = docs.sparkSession.sparkContext, searchers(benchmark)

    def cleaner(searcher):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for text in b.column("text").cast(pa.binary()).to_pylist():
                    words = words_of(text)
                    keep.append(not any(next(m.search(words), None) for m in searcher.value.machines))
                yield b.filter(pa.array(keep, pa.bool_()))

        return clean

    searcher = next(passes)
    for following in passes:
        shared = spark.broadcast(searcher)
        docs = written(docs.mapInArrow(cleaner(shared), docs.schema), "decontaminate-stage")
        shared.destroy()
        searcher = following
    return docs.mapInArrow(cleaner(spark.broadcast(searcher)), docs.schema)


#: Windows as joined runs of words; every distinct window length is looked up among the documents' runs of that length.
DECONTAMINATE_ORACLE = r"""
with d as (select rowid as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select row_number() over () as rowid, * from documents)),
b as (select distinct cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s
  from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
runs as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as s
  from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from wins) where len(w) >= n)),
hits as (select runs.r, runs.i, runs.n, wins.item from runs join wins on runs.n = wins.n and runs.s = wins.s),
hw as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from hits) group by r),
hi as (select r, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as items_sha256 from hits group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (r) left join hi using (r)
"""
