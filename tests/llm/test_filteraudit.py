import itertools
import re
from collections import Counter

import duckdb

from lorekeep.llm import filteraudit as X

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(doc_id, text, firsts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    first = firsts.get(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and first is not None and first < doc_id,
    }


def brute(docs, labels):
    """Every order filters the documents one by one."""
    docs = [(r["doc_id"], r["text"] or "", r["lang"] or "") for r in docs]
    good = {r["doc_id"] for r in labels if r["quality"] == 1} - {None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1} - {None}
    firsts = {}
    for d, t, _ in docs:
        if d is not None:
            firsts[t] = min(d, firsts.get(t, d))
    rows, out = [(d, part, fails(d, t, firsts)) for d, t, part in docs], []
    for part in {r[1] for r in rows}:
        own, total, part_rows = [r for r in rows if r[1] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                total[f] += len(gone)
                part_rows.append((f, "".join(order), k + 1, len(left), len(gone), sum(r[2][f] for r in own) - len(gone), sum(r[2][f] and sum(r[2].values()) == 1 for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out += [(part, *r[1:], total[r[0]]) for r in part_rows]
    return sorted(out)


def table(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_against_brute_and_sql(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = table(X.audit_table(docs, labels))
    assert got == brute(docs.collect(), labels.collect()) and len(got) == 600 * docs.select("lang").distinct().count()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    assert got == sorted(con.sql(f"select {', '.join(COLUMNS)} from ({X.AUDIT_ORACLE})").fetchall())


def test_odd_rows(spark, odd, empty, monkeypatch):
    labels = spark.createDataFrame([(1, 1, None, "x"), (1, 0, 1, "x"), (5, None, 1, "y"), (None, 1, 1, None), (99, 1, 1, "z"), (6, 0, 0, "q")], "doc_id long, quality int, toxic int, part string")
    assert table(X.audit_table(odd, labels)) == brute(odd.collect(), labels.collect())
    assert X.audit_table(empty, labels).count() == 0
    broadcast = sorted(map(str, X.flagged(odd, labels).collect()))
    monkeypatch.setattr(X, "small_enough", lambda *_: False)
    assert sorted(map(str, X.flagged(odd, labels).collect())) == broadcast and len(broadcast) == odd.count()
    assert sorted(map(str, X.flagged(odd, labels.limit(0)).collect())) != broadcast


def test_states_are_shared_and_given_free(spark):
    """All 32 combinations of failures, twice: every state has survivors, and each filter removes half of them."""
    rows = X.written(spark.range(64).selectExpr("'en' as part", *[f"id div {1 << k} % 2 = 1 as {f}" for k, f in enumerate(X.FILTERS)], "id < 32 as good", "id = 63 as toxic"), "test")
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before, trie = held(), X.Trie(rows)
    assert len(trie.reached) == 31 and held() <= before
    edges = trie.edges().collect()
    assert len(edges) == len({(r["state"], r["filter"]) for r in edges}) == 80
    assert all(r["removed"] == r["kept"] == 2 * r["good_lost"] == 64 >> len(r["state"]) + 1 and r["toxic_lost"] == (not r["state"]) for r in edges)


def test_hot_text(spark):
    rows = [(k, "same" if k % 3 else f"other {k}", "en", None, 4) for k in range(900)]
    docs, none = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flags = X.flagged(docs, none)
    assert flags.where("E").count() == 599
    assert X.audit(flags, "AE").where("filter_order = 'EA' and step = 2").select("kept", "removed", "redundant", "unique_fails", "shapley").collect() == [(0, 301, 599, 301, 1201)]
