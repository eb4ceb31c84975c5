import math
import zlib

from pyspark.sql import functions as F

from lorekeep.llm import sharding as S


def checked(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" and 0 <= r["shard"] < 16 for r in rows)


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = S.shard_table(docs).collect()
    checked(rows)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert 30 < sum(r["grown_shard"] == 16 for r in rows) < 100


def test_odd_rows(spark, odd, empty):
    rows = S.shard_table(odd).collect()
    checked(rows)
    assert len(rows) == 11 and [r["size"] for r in rows if r["doc_id"] == 3] == [1]
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert S.shard_table(empty).count() == 0
    assert S.stage(odd).columns == [*[c for c in odd.columns if c != "shard"], "shard"]
    assert S.stage(empty).count() == 0 and S.stage(odd).count() == 11
    given = {r["doc_id"]: r["shard"] for r in rows}
    assert {r["doc_id"]: r["shard"] for r in S.stage(odd).collect()} == given


def test_draws_against_brute_force(spark):
    """The tree walked in Python over the same hashes."""
    keys = [*range(300), -5, 1 << 40]
    nodes, frame = range(17), spark.createDataFrame([(k,) for k in keys], "doc_id long")
    hashed = frame.select("doc_id", *[F.xxhash64(F.lit(S.SEED), F.lit(level), F.lit(n), F.col("doc_id")).bitwiseAND((1 << 53) - 1).alias(f"h{level}_{n}") for level in range(3) for n in nodes])
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in S.assign(frame).collect()}
    for r in hashed.collect():
        for k, leaves in enumerate((S.topology(16), S.topology(17))):
            region = rack = None
            for level, name in enumerate(("region", "rack", "shard")):
                weight = {}
                for x in leaves:
                    if (level < 1 or x.region == region) and (level < 2 or x.rack == rack):
                        weight[getattr(x, name)] = weight.get(getattr(x, name), 0.0) + x.weight
                drawn = min(weight, key=lambda n: -math.log((r[f"h{level}_{n}"] + 0.5) / (1 << 53)) / weight[n])
                region, rack, shard = (drawn, None, None) if level == 0 else (region, drawn, None) if level == 1 else (region, rack, drawn)
            assert got[r["doc_id"]][k] == shard


def test_weights_move_rows_only_in_their_subtree(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    base = S.topology(16)
    heavier = [S.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in base]
    rows = S.assign(keys, 16, base, heavier).collect()
    region, rack = {x.shard: x.region for x in base}, {x.shard: x.rack for x in base}
    for r in rows:
        if r["shard"] != r["grown_shard"]:  # into the region; inside it, only towards the rack; inside the rack, only to the shard
            a, b = r["shard"], r["grown_shard"]
            assert region[b] == region[5]
            if region[a] == region[5]:
                assert rack[b] == rack[5]
                if rack[a] == rack[5]:
                    assert b == 5
    share = sum(r["grown_shard"] == 5 for r in rows) / len(rows)
    assert abs(share - 3 / 18) < 0.01


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert S.one_more(S.topology(16)) == S.topology(17)
    for n in (1, 14, 15, 16, 17, 18):
        rows = S.assign(keys, n).select("shard", "grown_shard").collect()
        moved = [r for r in rows if r["shard"] != r["grown_shard"]]
        assert {r["grown_shard"] for r in moved} == {n} and all(r["shard"] < n for r in rows)
        assert abs(len(moved) / len(rows) - 1 / (n + 1)) < 0.03
