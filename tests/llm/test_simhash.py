import random
import re

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64

from lorekeep.llm import simhash as S


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    """Brute force over all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [low.get(root(i)) for i in range(len(prints))]


def test_code_is_perfect():
    words = np.arange(1 << 23)
    count = np.bincount(S.anchor_of(words), minlength=4096)
    assert (count == 2048).all()
    message = np.arange(4096)
    code = np.array([m << 11 ^ S._remainder(m << 11) for m in message])
    assert (S.anchor_of(code) == message).all()
    w = np.random.default_rng(1).integers(0, 1 << 23, 200)
    for x, near in zip(w, S.anchors_near(w, 23), strict=True):
        assert set(near[near >= 0]) == set(message[np.bitwise_count(code ^ x) <= 4])


def test_hamming_code_is_perfect():
    words = np.arange(1 << 15)
    code = np.unique(S._NEAREST)
    assert len(code) == 2048 and (np.bincount(S._NEAREST, minlength=1 << 15)[code] == 16).all() and (np.bitwise_count(S._NEAREST ^ words) <= 1).all()
    for x, near in zip(words[::999], S.anchors_near(words[::999], 15, S._NEAREST.__getitem__), strict=True):
        assert set(near[near >= 0]) == set(code[np.bitwise_count(code ^ x) <= 2])


def test_anchors_meet_all_near_fingerprints():
    rng = random.Random(3)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = a ^ np.array([sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for _ in a], np.uint64)
    for way in (S.coarse_anchors, S.fine_anchors):
        met = [(own[:, :1] == near).any(1) for own, near in zip(way(a), way(b), strict=True)]
        assert np.logical_or.reduce(met).all()


def test_fine_cells_stay_small():
    rng = np.random.default_rng(6)
    for n in (50_000, 200_000):
        compared = 0
        for near in S.fine_anchors(rng.integers(0, 1 << 63, n, dtype=np.uint64)):
            homes = np.unique(near[:, 0], return_counts=True)
            copies = dict(zip(*np.unique(near[near >= 0], return_counts=True), strict=True))
            compared += sum(c * copies[h] for h, c in zip(*homes, strict=True))
        assert compared / n < 150 + n / 20_000


def test_fingerprints_agree_with_spark_hash(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = {r["doc_id"]: r["fingerprint"] for r in S.simhash_table(docs).collect()}
    assert got == {r["doc_id"]: f"{fingerprint(r['text']):016x}" for r in docs.collect()}


def test_components_are_those_of_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = components([fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in S.simhash_table(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == want


def planted(spark, n=900):
    """Fingerprints around a few centres, chains at distance 4 among them."""
    rng, out = random.Random(5), []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(n // 12):
            for b in rng.sample(range(64), rng.choice((1, 2, 4, 5, 9))):
                x ^= 1 << b
            out.append(x)
    return out, spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in out], "fp long").distinct()


def linked(spark, prints, frame):
    from lorekeep.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(S.links(frame)).collect()}
    prints = sorted({int(np.uint64(x).astype(np.int64)) for x in prints})
    want = components([x & (1 << 64) - 1 for x in prints], prints)
    assert [got.get(p, p) for p in prints] == want
    return want


def test_links_miss_nothing(spark, monkeypatch):
    prints, frame = planted(spark)
    want = linked(spark, prints, frame)
    monkeypatch.setattr(S, "FINE_FROM", 0)
    assert linked(spark, prints, frame) == want
    monkeypatch.setattr(S, "CELL_ROWS", 3)  # every cell is cut into blocks
    assert linked(spark, prints, frame) == want
    monkeypatch.setattr(S, "small_enough", lambda *_: False)
    assert linked(spark, prints, frame) == want
    monkeypatch.setattr(S, "FINE_FROM", 1 << 40)
    assert linked(spark, prints, frame) == want


def test_odd_rows(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    got = S.simhash_table(odd).collect()
    want = components([fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(r["doc_id"]), str(w)) for r, w in zip(rows, want, strict=True))
    assert S.simhash_table(empty).count() == 0 and S.stage(empty).count() == 0
    kept = S.stage(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "7", "8", "None", "None"]
    assert kept.columns == odd.columns


def test_stage_keeps_one_of_each_group(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    groups = S.near_groups(docs).select(F.col("component_id")).distinct().count()
    assert S.stage(docs).count() == groups
