import os
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from lorekeep.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    if isinstance(v, list):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


def compared(rows, columns, result):
    assert sorted(result.columns) == sorted(columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in rows)
    assert got == sorted(tuple(norm(r[result.columns.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    compared(df.collect(), df.columns, duck.sql(catalog.ORACLES[name]))


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["vec_id", "win", "obs", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) > 80
    assert os.path.isdir("lorekeep")


def test_plans_prune_and_push_down(spark, small, capsys):
    catalog.QUERIES["knn_topk"](spark, small).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "label" not in plan.split("ReadSchema")[1]
    catalog.QUERIES["spend_by_day"](spark, small).explain("formatted")
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 1


def test_split_punctuation_reads_all_documents(spark, small):
    tokens = {t for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"] is not None for t in r["text"].split(" ")}
    rows = catalog.QUERIES["split_punctuation"](spark, small).collect()
    assert len(rows) == len(tokens) and {r["token"] for r in rows} == tokens
    for r in rows:
        word = r["token"].rstrip(".,!?;:…")
        assert (r["word"], r["punct"]) == ((word, r["token"][len(word) :]) if word else (r["token"], ""))


def test_ids_and_times_of_all_events(spark, small):
    ts = {r["event_id"]: r["ts"] for r in spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts").collect()}
    ulid, said = (catalog.QUERIES[q](spark, small).collect() for q in ("ulid_prefix", "spoken_times"))
    assert len(ulid) == len(said) == len(ts)
    assert {r["event_id"]: r["at"] for r in said} == {k: t.replace(second=0, microsecond=0) for k, t in ts.items()}
    assert all(r["decoded"] == round((ts[r["event_id"]] - datetime(1970, 1, 1)) / timedelta(milliseconds=1)) for r in ulid)


def test_windows_slide_for_all_speakers(spark, small):
    rows = catalog.QUERIES["sliding_windows"](spark, small).collect()
    speakers = {r["user_id"] for r in spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().collect()}
    assert {r["speaker"] for r in rows} == speakers and any(s % 10 for s in speakers)
