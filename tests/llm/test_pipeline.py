import shutil

import pytest

import corpus_pipeline as P
from lorekeep.llm import decontaminate, langid, simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, at = docs.columns, docs
    for k, (_, stage) in enumerate(P.STAGES):
        before, at = at, stage(spark, at, small).cache()
        assert at.columns == (names if k < 4 else [*names, "shard"])
        if k < 3:
            assert at.count() <= before.count() and at.exceptAll(before).isEmpty()
    want = langid.stage(docs)
    want = simhash.stage(want)
    want = decontaminate.stage(want, spark.read.parquet(f"{small}/benchmark.parquet"))
    kept = {r["doc_id"] for r in want.select("doc_id").collect()}
    out = P.run(spark, small).collect()
    assert {r["doc_id"] for r in out} <= kept and all(0 <= r["shard"] < 16 for r in out)
    assert len({r["doc_id"] for r in out}) > 0.4 * len(kept)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_rows(spark, small, tmp_path, request, rows):
    docs = request.getfixturevalue(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{small}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard"]
    got = out.collect()
    assert (rows == "odd") == bool(got) and all(r["doc_id"] not in (3, 4, 7) and 0 <= r["shard"] < 16 for r in got)
