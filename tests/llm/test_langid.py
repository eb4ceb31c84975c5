import zlib
from collections import Counter

import numpy as np

from lorekeep.llm import langid as L


def test_filter_corrects_false_positives():
    rng = np.random.default_rng(0)
    members = [rng.integers(0, 1 << 32, 3000, dtype=np.uint32) for _ in range(3)]
    f = L.LanguageFilter.build(["a", "b", "c"], members)
    for k, g in enumerate(members):
        assert (f.languages_of(g)[0] & (1 << k) != 0).all()
        mixed = np.concatenate([g, rng.integers(0, 1 << 32, 9000, dtype=np.uint32)])
        assert abs(f.counts(mixed)[k] - 3000) < 200


def test_more_languages_than_a_mask_holds(monkeypatch):
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 1 << 32, 200, dtype=np.uint32) for _ in range(7)]
    one = L.LanguageFilter.build(list("abcdefg"), members)
    want = [one.counts(g) for g in members]
    monkeypatch.setattr(L, "MASK_LANGUAGES", 3)
    f = L.LanguageFilter.build(list("abcdefg"), members)
    assert len(f.masks) == 3 and all(np.allclose(f.counts(g), w) for g, w in zip(members, want, strict=True))


def test_letters():
    assert [L.has_letter(t) for t in (None, "", "\u00bd \u00bd", "\u00b2\u00b3", "12 _ !", "\u00bdx", "\u00e9", "\u4e2d")] == [False] * 5 + [True] * 3


def test_predictions_against_brute_force(spark, medium):
    """Sets of n-grams in place of the filter, counts without false positives to correct."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows, by = docs.select("doc_id", "text", "lang").collect(), {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            by.setdefault(r["lang"], []).append(set(L.grams(r["text"]).tolist()))
    members = {}
    for lang, sets in by.items():
        n = Counter(g for s in sets for g in s)
        members[lang] = {g for g, k in n.items() if k >= max(1, L.MIN_SHARE * len(sets))}
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    same = clear = 0
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        g = L.grams(r["text"]).tolist()
        counts = sorted(((sum(x in m for x in g), lang) for lang, m in members.items()), reverse=True)
        if counts[0][0] > 1.1 * counts[1][0] + 5:  # beyond what false positives can turn
            clear += 1
            same += got[r["doc_id"]]["lang_pred"] == counts[0][1]
    assert clear > 0.9 * len(rows) and same == clear


def test_held_out_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_odd_rows(spark, odd, empty):
    got = {(r["doc_id"], r["lang_pred"]) for r in L.identify(odd).collect()}
    assert {(3, "und"), (4, "und"), (7, "und")} <= got and len(L.identify(odd).collect()) == 11
    assert L.identify(empty).count() == 0 and L.stage(empty).count() == 0
    assert L.stage(odd).columns == odd.columns
    assert {r["lang_pred"] for r in L.identify(odd.where("doc_id = 1").selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_stage_keeps_clean_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    gone = docs.join(L.stage(docs).select("doc_id"), "doc_id", "left_anti").select("text").collect()
    assert len(gone) < 0.03 * docs.count()
