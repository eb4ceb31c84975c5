import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import exactdedup as X


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 50_000])
def test_filter_has_no_false_negatives(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    f = X.BinaryFuse8.build(keys)
    assert f.screen(keys).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert f.screen(others).mean() < 0.008
    if n >= 50_000:
        assert len(f.prints) < 1.2 * n


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, max(known) if known else None, len(ids), sha) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["doc_id % 3 = 0", "true", "false", "doc_id < 500", "cast(null as boolean)"])
def test_any_split_gives_the_same_groups(spark, medium, split):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = X.dedup(docs, F.expr(split)).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_odd_rows(spark, odd, empty):
    got = X.dedup_table(odd).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    assert X.dedup_table(empty).count() == 0


def test_shuffled_byte_check_and_clash(spark, odd, monkeypatch):
    monkeypatch.setattr(X, "small_enough", lambda *_: False)
    assert X.dedup_table(odd).count() == 11
    rows = [(k, "hot" if k % 3 else f"text {k % 40}") for k in range(600)]
    got = X.dedup_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("00" * 32))
    with pytest.raises(RuntimeError, match="more than one text"):
        X.byte_check(odd, text, odd.select(F.unhex(F.lit("00" * 32)).alias("sha")).limit(1), 1)
