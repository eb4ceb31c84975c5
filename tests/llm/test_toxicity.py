import itertools
import zlib

import numpy as np

from lorekeep.llm import toxicity as X


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    tr, start = rng.normal(size=(2, 2)), 0.3
    e = rng.normal(size=700) * 2
    first = np.zeros(700, bool)
    first[[0, 5, 6, 300, 690]] = True
    got = X.forward_backward(e, first, tr, start)
    for a, b in ((0, 5), (5, 6), (690, 700)):  # all state sequences of short chains
        weight = {}
        for s in itertools.product((0, 1), repeat=b - a):
            w = start * s[0] + sum(tr[i, j] for i, j in itertools.pairwise(s)) + sum(x * y for x, y in zip(e[a:b], s, strict=True))
            weight[s] = np.exp(w)
        z = sum(weight.values())
        for t in range(b - a):
            assert abs(got[a + t] - sum(w for s, w in weight.items() if s[t]) / z) < 1e-9
    lone = X.forward_backward(e[6:300], np.arange(294) == 0, tr, start)
    assert np.abs(lone - got[6:300]).max() < 1e-9


def test_held_out(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    rows = {r["doc_id"]: r for r in X.score(docs, labels).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == text.keys()
    held = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and len(held) > 50
    toxic, clean = [r["score"] for r, y in held if y], [r["score"] for r, y in held if not y]
    assert sum(s >= 0.5 for s in clean) <= 0.03 * len(clean)
    assert np.mean([a > b for a in toxic for b in clean]) > 0.75  # 41 toxic training documents in four languages: not every stem has been seen
    for r in rows.values():
        for s in r["spans"]:
            assert text[r["doc_id"]][s["start"] : s["end"]].strip()
    assert "idiot" in {text[k][s["start"] : s["end"]].lower() for k, r in rows.items() for s in r["spans"]}


def test_offsets_are_those_of_the_text():
    text = "\u0130stanbul \u0130zmir IDIOT stra\u00dfe"
    model = X.Tagger({"=idiot": 20.0})
    assert [text[a:b] for a, b, _ in model.spans(text, model.marginals([X.words_of(text)])[0])] == ["IDIOT"]


def test_scores_against_brute_force(spark, medium):
    """The score restated: chain marginals token by token in logarithms, then the regression on the top and the sum."""
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    model = X.fit(docs, labels)
    add = np.logaddexp

    def score(text):
        e = [model.bias + sum(model.emission.get(m, 0.0) for m in X.marks_of(w)) for w in X.words_of(text)]
        if not e:
            return 1 / (1 + np.exp(-(model.document @ [1, np.log(1e-6 / (1 - 1e-6)), 0])))
        f, b, t = [[0.0, model.start + e[0]]], [[0.0, 0.0]], model.transition
        for x in e[1:]:
            f.append([add(f[-1][0] + t[0, j], f[-1][1] + t[1, j]) + x * j for j in (0, 1)])
        for x in e[:0:-1]:
            b.append([add(t[i, 0] + b[-1][0], t[i, 1] + x + b[-1][1]) for i in (0, 1)])
        p = [1 / (1 + np.exp(u[0] + v[0] - u[1] - v[1])) for u, v in zip(f, b[::-1], strict=True)]
        top = min(max(max(p), 1e-6), 1 - 1e-6)
        return 1 / (1 + np.exp(-(model.document @ [1, np.log(top / (1 - top)), np.log1p(sum(p))])))

    text = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 3000}
    shared = spark.sparkContext.broadcast(model)
    X_fit, X.fit = X.fit, lambda *_: shared.value
    try:
        got = {r["doc_id"]: r["score"] for r in X.score(docs, labels).collect()}
    finally:
        X.fit = X_fit
    assert len(text) > 500 and max(abs(got[k] - score(t)) for k, t in text.items()) < 1e-6


def test_repeated_labelled_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(X, "TRAIN_DOCS", 50)
    rows = [(k % 3 + 1, f"some words and idiot number {k}" if k % 2 else f"plain words of number {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in X.score(docs, labels).limit(20).collect())


def test_spans_of_documents_with_low_scores(spark, medium, monkeypatch):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    model = X.fit(docs, labels)
    model.document = np.array([-50.0, 0.0, 0.0])  # every score is next to 0; marginals stay
    monkeypatch.setattr(X, "fit", lambda *_: model)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"]]
    got = {r["doc_id"]: r for r in X.score(docs, labels).collect()}
    want = {k: [(a, b) for a, b, _ in model.spans(t, model.marginals([X.words_of(t)])[0])] for k, t in rows if len(t) < 4000}
    assert all(r["score"] < 0.5 for r in got.values()) and any(want.values())
    assert {k: [(s["start"], s["end"]) for s in got[k]["spans"]] for k in want} == want


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, None), (None, 1, 1), (2, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for x in (labels, none):
        rows = X.toxicity_table(odd, x).collect()
        assert len(rows) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert X.toxicity_table(empty, labels).count() == 0
