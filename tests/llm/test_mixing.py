import hashlib
import math

from lorekeep.llm import mixing as M


def poisson(doc_id, rate):
    text = "7:" + ("" if doc_id is None else str(doc_id))
    u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_are_inverted_hashes(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "source")
    rows = M.mix_table(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    rates = {r["source"]: r["rate"] for r in rows}
    for d in docs.collect():
        n = poisson(d["doc_id"], rates[d["source"]])
        assert len(by.get(d["doc_id"], [])) == n
        assert sorted(r["copy_no"] for r in by.get(d["doc_id"], [])) == list(range(1, n + 1))


def test_targets(spark):
    docs = spark.range(30000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    out = M.mix(docs, {"hot": 1.0, "s1": 3.0}, 20000).groupBy("source").count().collect()
    assert {r["source"]: round(r["count"] / 1000) for r in out} == {"hot": 5, "s1": 15}


def test_order_is_random_and_the_same_again(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'a' as source")
    once, again = ([r["doc_id"] for r in M.mix(x).collect()] for x in (docs, docs.repartition(7)))
    assert once == again and once != sorted(once)


def test_odd_rows(spark, odd, empty):
    rates = M.source_rates(odd, {None: 40.0, "a": 800.0}, 8000.0)
    out = M.replicate(odd, rates).groupBy("doc_id").count().collect()
    n = {r["doc_id"]: r["count"] for r in out}
    assert set(n) == {1, 3, 4, 5, 6, None} and n[1] % 2 == 0 and n[5] > 900
    assert M.mix(empty).count() == 0 and M.stage(odd).columns == odd.columns and M.stage(empty).count() == 0


def test_stage_keeps_columns_named_like_its_own(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "'a' as source", "-99.0D as rate", "'mine' as mix_key", "map('k', 1) as n_copies", "7 as copy_no")
    out = M.stage(docs)
    assert out.dtypes == docs.dtypes
    assert {(r["rate"], r["mix_key"], r["n_copies"]["k"], r["copy_no"]) for r in out.collect()} == {(-99.0, "mine", 1, 7)}
