"""Cases that only larger or odder tables than the test tables hold."""

import random

import numpy as np
import pytest

from lorekeep.operators import archive, nightly, prosody, similar, speakers, vectors


def test_silence_has_a_level_of_minus_infinity(spark):
    samples = spark.createDataFrame([("a", n, 0.0 if n < 2 else 10.0) for n in range(4)] + [("b", 0, None)], "track string, n long, value double")
    got = {(r["track"], r["block"]): (r["db"], r["n"]) for r in archive.block_levels(samples, "track", 2).collect()}
    assert got == {("a", 0): (float("-inf"), 2), ("a", 1): (20.0, 2), ("b", 0): (None, 0)}
    assert [r["db"] for r in archive.envelope(samples.where("track = 'a'"), "track", 0).orderBy("n").collect()] == [float("-inf")] * 2 + [20.0] * 2


def test_deviation_of_others_that_are_alike(spark):
    """Copies differ by nothing and near values by little, however far off the word itself is; across batches, speakers, equal ends and words without an end."""
    rows = [(k, "a", 5.0, 0.3, False) for k in range(3)] + [(3, "a", 6.0, 0.06046, False), (4, "a", 4.0, 0.9, True), (5, "a", 400.0, 0.06048, False), (6, "a", 401.0, 0.06046, False), (7, "a", 402.0, 0.9, False), (8, "b", 402.0, 0.5, False), (9, "b", None, 0.25, False), (10, "b", None, 0.75, False)]
    words = spark.createDataFrame(rows, "id long, speaker string, end double, dur double, suspect boolean")
    want = {0: (2, 0.3, None), 1: (2, 0.3, None), 2: (2, 0.3, None), 3: (3, 0.3, None), 4: (0, None, None), 5: (0, None, None), 6: (1, 0.06048, None), 7: (2, 0.06047, 59363.735601), 8: (0, None, None), 9: (1, 0.75, None), 10: (1, 0.25, None)}
    for size in (10_000, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {r["id"]: (r["st_n"], r["st_mean"], r["st_z"]) for r in prosody.rolling_z(words, "dur").collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_support_without_pairs_is_that_of_all_pairs(spark, monkeypatch):
    """The same as by a join of pairs, in one block and in many, with copies, repeated words and ids of lines only."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "ba ce di fo gu harb kitch morn it's".split() for b in "la me ni ro tu ours".split()]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 30))) for _ in range(90)]
    lines = spark.createDataFrame([(f"l{k:03}", t) for k, t in enumerate([*texts, *texts[:20], None, ""])], "id string, text string")
    quotes = spark.createDataFrame([(f"l{k:03}", " ".join(t.split()[-rng.randint(1, 9) :])) for k, t in enumerate(texts)] + [("x", "bala " * 300), ("y", "it was"), ("z", None)], "id string, text string")
    want = sorted(tuple(r) for r in similar.best_support(similar.containing(quotes, lines).where("quote != line")).collect())
    for a, b in ((1 << 16, 1 << 18), (16, 64)):
        monkeypatch.setattr(similar, "LINE_BLOCK", a), monkeypatch.setattr(similar, "QUOTE_BLOCK", b)
        assert sorted(tuple(r) for r in similar.supported(quotes, lines).collect()) == want and len(want) > 50


def test_replacing_is_the_fold_over_all_pairs(spark):
    rng = random.Random(5)
    words = "harbour kitchen morning garden window ladder bottle candle marble saddle".split()
    said = [(k, f"s{k % 3}", " ".join(rng.choices(words, k=rng.randint(0, 6))) or None, float(k // 2 % 60)) for k in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, about string, statement string, at double")
    old, new = frame(said[:150]), frame(said[150:])
    want = sorted(tuple(r) for r in nightly.replaced_in_order(nightly.supersedes(new, old.union(new))).collect())
    assert sorted(tuple(r) for r in nightly.replacing(new, old).collect()) == want and len(want) > 100


def test_percentiles_of_pairs_without_pairs(spark, monkeypatch):
    """Blocks, copies, labels of one vector, null vectors and vectors of another length against all pairs."""
    monkeypatch.setattr(vectors, "PAIR_BLOCK", 8)
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(60, 5))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = [(k, k % 3 if k < 59 else 9, unit[k % 40].tolist()) for k in range(60)] + [(60, 1, None), (61, 1, [1.0])]
    got = {r["label"]: r for r in vectors.pair_distances(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    for label in range(3):
        own = [np.array(v) for _, x, v in rows if x == label and v is not None and len(v) == 5]
        d = [1 - a @ b for k, a in enumerate(own) for b in own[k + 1 :]]
        n = len([1 for _, x, _ in rows if x == label])
        r = got[label]
        assert r["pairs"] == n * (n - 1) // 2
        assert [r["p10"], r["p50"], r["p90"], r["far_share"]] == pytest.approx([*np.quantile(d, [0.1, 0.5, 0.9]), np.mean(np.array(d) > 0.9)], abs=2e-6)
    assert set(got) == {0, 1, 2}


def test_prints_merge_as_by_measuring_all_each_time():
    rng = np.random.default_rng(4)
    prints = [(v, float(s)) for v, s in zip(rng.normal(size=(1500, 6)), rng.uniform(0.2, 2, 1500), strict=True)]
    held = [(v / np.linalg.norm(v), s * speakers.DECAY) for v, s in prints if s * speakers.DECAY >= speakers.MIN_STRENGTH]
    v, s = np.stack([x for x, _ in held]), np.array([x for _, x in held])
    while len(v) > 24:
        near = v @ v.T
        np.fill_diagonal(near, -np.inf)
        i, j = sorted(np.unravel_index(np.argmax(near), near.shape))
        new = v[i] * s[i] + v[j] * s[j]
        v, s = np.concatenate([np.delete(v, [i, j], 0), [new / np.linalg.norm(new)]]), np.append(np.delete(s, [i, j]), s[i] + s[j])
    got = speakers.consolidated(prints)
    assert [x for _, x in got] == pytest.approx(s.tolist()) and np.allclose([x for x, _ in got], v)


def test_search_in_blocks_is_that_of_all(spark, monkeypatch):
    """Ties after rounding go by id, whatever block they lie in; any number of vectors may be asked for."""
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(300, 4)), 1)
    rows, asked = [(k, x.tolist()) for k, x in enumerate(v)] + [(300, None)], [(k, v[k].tolist()) for k in range(0, 300, 7)]
    sets = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "caller long, embedding array<double>")
    want = sorted((c, k, p + 1) for c, q in asked for p, (_, k) in enumerate(sorted((-round(float(np.dot(q, x)), 6), k) for k, x in rows if x)[:5]))
    for block, once in ((1 << 14, 1 << 22), (16, 64)):
        monkeypatch.setattr(vectors, "SEARCH_BLOCK", block), monkeypatch.setattr(vectors, "AT_ONCE", once)
        assert sorted((r["caller"], r["vec_id"], r["place"]) for r in vectors.top_k_each(*sets, 5).collect()) == want
