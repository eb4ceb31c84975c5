"""SimHash near-dedup by anchor-point covering: codewords of a perfect code are the anchors at which fingerprints meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import keep_by_id, small_enough, written
from .components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Two ways to cut the 64 bits into blocks (first bit, bits). Of two fingerprints at most DISTANCE apart, one of COARSE differs in at
#: most 1 bit, and two of FINE together do. Anchors are codewords for each of COARSE and pairs of codewords for each two of FINE.
COARSE = ((0, 23), (23, 23), (46, 18))
FINE = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK_DISTANCE = 1
#: Distinct fingerprints from which FINE is used: some 150 copies of each in place of 16, but cells of a hundredth of the rows.
FINE_FROM = 4_000_000
#: Rows that one side of a comparison holds at most; larger cells are compared in blocks of this size, by several tasks.
CELL_ROWS = 20_000
#: Rows that a comparing task gets on average.
TASK_ROWS = 100_000
_CHUNK = 1 << 16

# The binary Golay code of 23 bits, its generator polynomial and covering radius.
GOLAY_BITS = 23
GOLAY_CHECK_BITS = 11
GOLAY_GENERATOR = 0b110001110101
GOLAY_RADIUS = 3
# The binary Hamming code of 15 bits, covering radius 1.
HAMMING_BITS = 15


def _remainder(x: int) -> int:
    for bit in range(GOLAY_BITS - 1, GOLAY_CHECK_BITS - 1, -1):
        if x >> bit & 1:
            x ^= GOLAY_GENERATOR << (bit - GOLAY_CHECK_BITS)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits, and the error pattern of each remainder: the code is perfect, so each has exactly one of weight 3 at most."""
    low = np.array([_remainder(x) for x in range(1 << 12)])
    high = np.array([_remainder(x << 12) for x in range(1 << 11)])
    errors = np.zeros(1 << GOLAY_CHECK_BITS, np.int64)
    for weight in range(1, GOLAY_RADIUS + 1):
        for bits in combinations(range(GOLAY_BITS), weight):
            e = sum(1 << b for b in bits)
            errors[low[e & 4095] ^ high[e >> 12]] = e
    return low, high, errors


_LOW, _HIGH, _ERRORS = _tables()


def _hamming() -> np.ndarray:
    """The one codeword within distance 1 of each word: the remainder, the exclusive or of the set bits' numbers from 1, names the wrong bit."""
    remainder = np.zeros(1 << HAMMING_BITS, np.int64)
    for bit in range(HAMMING_BITS):
        remainder[1 << bit : 2 << bit] = remainder[: 1 << bit] ^ (bit + 1)
    return np.arange(1 << HAMMING_BITS) ^ (1 << remainder >> 1)


_NEAREST = _hamming()


def anchor_of(words: np.ndarray) -> np.ndarray:
    """The number of the one codeword within GOLAY_RADIUS of each 23-bit word: its 12 message bits."""
    return (words ^ _ERRORS[_LOW[words & 4095] ^ _HIGH[words >> 12]]) >> GOLAY_CHECK_BITS


def anchors_near(words: np.ndarray, bits: int, own_anchor: Callable[[np.ndarray], np.ndarray] = anchor_of) -> np.ndarray:
    """Each word's own anchor, then those within the covering radius + BLOCK_DISTANCE of it; -1 fills up.

    In a perfect code a codeword just beyond the radius is the own anchor of a neighbour at distance 1 that is one step nearer to
    it, so the anchors of all neighbours are those anchors. Bits beyond `bits` are 0 in all words and are not turned.
    """
    turned = np.concatenate([[0], 1 << np.arange(bits)])
    found = own_anchor(words[:, None] ^ turned[None, :])
    own, rest = found[:, :1], np.sort(found[:, 1:], axis=1)
    rest[:, 1:][rest[:, 1:] == rest[:, :-1]] = -1
    rest[rest == own] = -1
    return np.concatenate([own, rest], axis=1)


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 without words. Of a long text no more than a chunk of hashes is held."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        starts, ends, joined = [0], [sum(map(len, words)) + len(words) - 1], b" ".join(words)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(lengths + 1) - 1
        starts, ends, joined = (last - lengths)[: 1 - SHINGLE].tolist(), last[SHINGLE - 1 :].tolist(), b" ".join(words)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t or b"") for t in b.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _words(prints: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return (prints >> np.uint64(block[0]) & np.uint64((1 << block[1]) - 1)).astype(np.int64)


def coarse_anchors(prints: np.ndarray) -> Iterator[np.ndarray]:
    """For each block the anchors of each fingerprint, its own in front; -1 fills up."""
    return (anchors_near(_words(prints, b), b[1]) for b in COARSE)


def fine_anchors(prints: np.ndarray) -> Iterator[np.ndarray]:
    """The same for each two blocks: codewords of both, at most one of them being another than the own."""
    near = [anchors_near(_words(prints, b), b[1], _NEAREST.__getitem__) for b in FINE]
    for a, b in combinations(near, 2):
        own_a, own_b = a[:, :1] << HAMMING_BITS, b[:, :1]
        yield np.concatenate([own_a | own_b, np.where(a[:, 1:] < 0, -1, a[:, 1:] << HAMMING_BITS | own_b), np.where(b[:, 1:] < 0, -1, own_a | b[:, 1:])], axis=1)


def _replicas(anchors: Callable[[np.ndarray], Iterator[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(signed), _CHUNK):
                own = signed[at : at + _CHUNK]
                for block, near in enumerate(anchors(own.view(np.uint64))):
                    row, column = np.nonzero(near >= 0)
                    arrays = [np.full(len(row), block, np.int32), near[row, column].astype(np.int32), own[row], column == 0]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["block", "anchor", "fp", "home"])

    return copy


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j: each node has the least number of its component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def linked(homes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint of its component) that join all pairs of homes and near within DISTANCE: fewer than there are fingerprints."""
    nodes = np.unique(np.concatenate([homes, near]))
    label, at, other = np.arange(len(nodes)), np.searchsorted(nodes, homes), np.searchsorted(nodes, near)
    step = max(1, (1 << 21) // max(1, len(near)))
    for k in range(0, len(homes), step):
        i, j = np.nonzero(np.bitwise_count(homes[k : k + step, None] ^ near[None, :]) <= DISTANCE)
        label = _joined(label, at[k + i], other[j])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    cell = [pdf[c].to_numpy() for c in ("part_b", "part_a", "anchor", "block")]
    order = np.lexsort(cell)
    prints, home = pdf["fp"].to_numpy()[order].view(np.uint64), pdf["home"].to_numpy()[order]
    new = np.zeros(len(order), bool)
    for c in cell:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = []
    for x, h in zip(np.split(prints, np.flatnonzero(new)), np.split(home, np.flatnonzero(new)), strict=True):
        if len(x) > 1 and h.any():
            out.append(linked(x[h], x))
    a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) with the same components as all pairs at most DISTANCE bits apart.

    A fingerprint's home in a block is its own anchor there; it is copied to every anchor within covering radius plus block
    distance. Of two near fingerprints one block (or two of FINE together) differs by BLOCK_DISTANCE at most: there the second is
    copied to the first one's home, so comparing each cell's homes with its copies finds every pair. A cell returns fewer links
    than it has rows. A row is compared with some n / 256 others of n fingerprints by COARSE, with n / 30,000 by FINE. Counts of cells
    are broadcast behind a size check; beyond it only cells beyond CELL_ROWS are looked up. Such a cell is cut by hash into blocks
    on both sides and every pair of blocks is compared in a task: complete, and bounded in memory for one hot anchor too.
    """
    anchors = coarse_anchors if prints.count() < FINE_FROM else fine_anchors
    replicas = prints.select("fp").mapInArrow(_replicas(anchors), "block int, anchor int, fp long, home boolean")
    cells = replicas.groupBy("block", "anchor").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / CELL_ROWS).cast("int").alias("parts_a"),
        F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts_b"),
        F.count("*").alias("n"),
    )
    cells = written(cells.where("n > 1 and parts_a > 0"), "simhash-cells")
    count, total = cells.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(48, -(-total // TASK_ROWS))
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    place = lambda a, b, home: F.struct(F.lit(a).cast("int").alias("part_a") if isinstance(a, int) else a.alias("part_a"), b.alias("part_b"), home.alias("home"))
    as_home = F.transform(F.sequence(F.lit(0), F.col("parts_b") - 1), lambda b: place(part("parts_a"), b, F.lit(True)))
    as_copy = F.transform(F.sequence(F.lit(0), F.col("parts_a") - 1), lambda a: place(a, part("parts_b"), F.lit(False)))
    one = F.array(place(F.lit(0), F.lit(0), F.col("home")))
    places = F.when((F.col("parts_a") == 1) & (F.col("parts_b") == 1), one).otherwise(F.when(F.col("home"), F.concat(as_home, as_copy)).otherwise(as_copy))
    if small_enough(count, 32):
        rows = replicas.join(F.broadcast(cells), ["block", "anchor"])
    else:
        large = written(cells.where("parts_a > 1 or parts_b > 1"), "simhash-large")
        large = F.broadcast(large) if small_enough(large.count(), 32) else large
        rows = replicas.join(large, ["block", "anchor"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts_a", "parts_b")})
    rows = rows.select("block", "anchor", "fp", F.explode(places).alias("p"))
    rows = rows.select("block", "anchor", "fp", "p.part_a", "p.part_b", "p.home")
    rows = rows.withColumn("task", F.pmod(F.xxhash64("block", "anchor", "part_a", "part_b"), F.lit(tasks)))
    return rows.groupBy("task").applyInPandas(_compared, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs; fp as signed long, component_id the smallest doc_id of all rows that links reach.

    Null and wordless texts have fingerprint 0. Rows with equal fingerprints, repeated rows too, are one node and cost one
    comparison. A component whose doc_ids are all null has none. An empty table gives no rows; further columns aren't read.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")
    rows = written(rows, "simhash-rows")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-prints")
    nodes = connected_components(links(prints))
    roots = prints.join(nodes, prints["fp"] == nodes["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    roots = written(roots, "simhash-roots")
    least = written(roots.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-components")
    named = written(roots.join(least, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_table(docs: DataFrame) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def stage(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest doc_id; rows without doc_id stay.

    Rows that repeat the staying doc_id are repeats of it or clash with it: one of them stays, by the least text, source, lang
    and n_chars. All columns are kept, an empty table stays empty.
    """
    groups = written(near_groups(docs), "simhash-stage")
    kept = keep_by_id(docs, groups.where("doc_id != component_id"))
    repeated = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    order = F.struct(*[c for c in ("text", "source", "lang", "n_chars") if c in docs.columns])
    one = F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)]), order)
    first = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(one.alias("_one"))
    return keep_by_id(kept, repeated).union(first.select(*[F.col(f"_one._{k}").alias(c) for k, c in enumerate(docs.columns)]))
