import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import merging, nightly, sessions
from lorekeep.plans import recordings


def one_by_one(rows, limit):
    """Every centroid and every distance anew for each merge."""
    rows = [(label, np.asarray(v, np.float64)) for label, v in rows]
    now, trace = {label: label for label, _ in rows}, []
    while True:
        centres = {}
        for k in sorted(set(now.values())):
            mean = np.mean([v for label, v in rows if now[label] == k], axis=0)
            centres[k] = mean / np.linalg.norm(mean)
        pairs = [(round(1 - float(centres[i] @ centres[j]), 9), i, j) for i in centres for j in centres if i < j]
        if not pairs:
            return now, trace
        d, i, j = min(pairs)
        trace.append((i, j, d, d < limit))
        if d >= limit:
            return now, trace
        now = {k: i if v == j else v for k, v in now.items()}


def test_clusters_merge_as_one_file_alone_would(spark, medium):
    files = {}
    for r in spark.read.parquet(f"{medium}/embeddings.parquet").collect():
        files.setdefault(r["vec_id"] // 100, []).append((r["label"] * 3 + r["vec_id"] % 3, r["embedding"]))
    got = recordings.clusters_merged(spark, medium).collect()
    merges = 0
    for file, rows in files.items():
        now, trace = one_by_one(rows, 0.9)
        own = [r for r in got if r["file"] == file]
        assert {r["a"]: r["b"] for r in own if r["what"] == "cluster"} == now
        steps = sorted((r["step"], r["a"], r["b"], r["distance"], r["what"] == "merge") for r in own if r["what"] != "cluster")
        assert [s[1:3] + s[4:] for s in steps] == [t[:2] + t[3:] for t in trace] and [s[3] for s in steps] == pytest.approx([t[2] for t in trace], abs=2e-9)
        merges += sum(t[3] for t in trace)
    assert len(files) > 1 and merges > 5


def test_few_clusters(spark):
    frame = lambda rows: spark.createDataFrame(rows, "file long, label long, embedding array<float>")
    assert [tuple(r)[1:4] for r in merging.merge_centroids(frame([(1, 5, [1.0, 0.0])])).collect()] == [("cluster", 5, 5)]
    same = merging.merge_centroids(frame([(1, k, [1.0, 0.0]) for k in (3, 1, 2)] + [(1, 4, [-1.0, 0.0])])).collect()
    assert [(r["what"], r["a"], r["b"]) for r in sorted(same, key=lambda r: (r["what"] == "cluster", r["step"] or 0)) if r["what"] != "cluster"] == [("merge", 1, 2), ("merge", 1, 3), ("apart", 1, 4)]
    assert merging.merge_centroids(frame([])).count() == 0


@pytest.mark.parametrize(
    "text, rose, fell, line",
    [
        ("Is it late.", True, False, "Is it late?"), ("Is it late?", True, False, "Is it late?"), ("late…", True, False, "late?"), ("late", True, False, "late?"), ("late!", True, False, "late!?"),
        ("and then,", False, False, "and then—"), ("and then", False, False, "and then—"), ("and then", False, True, "and then"), ("Done.", False, False, "Done."), ("Well!", False, False, "Well!"),
        ("and then,,", False, False, "and then,—"), ("", False, False, "—"), ("tail ", False, False, "tail —"),
    ],
)
def test_terminal_signs(spark, text, rose, fell, line):
    row = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    assert row.select(nightly.terminal(t, F.lit(rose), t.endswith("?"), t.rlike("[.!?…]$"), F.lit(fell)).alias("x")).first()["x"] == line


def test_refusals_and_breakdowns(spark):
    said = {"Credit too low": "out of credit", "your PREPAYMENT is gone": "out of credit", "Quota exceeded": "out of credit", "quota": "rate limited", "cannot generate": "rate limited", "rate limit": "rate limited", "": "rate limited", None: "rate limited"}
    rows = spark.createDataFrame([(k,) for k in said], "d string").select("d", nightly.refused(F.col("d")).alias("x")).collect()
    assert {r["d"]: r["x"] for r in rows} == said
    cases = [(None, None, None, False), (True, None, None, True), (None, "request Timed out", None, True), (False, "too many", True, False), (None, None, False, True), (None, "Bad JSON here", True, True)]
    rows = spark.createDataFrame([c[:3] for c in cases], "u boolean, e string, ok boolean").select(nightly.broke(F.col("u"), F.col("e"), F.col("ok")).alias("x")).collect()
    assert [r["x"] for r in rows] == [c[3] for c in cases]


def test_diagnosis_names_the_first_silent_stage(spark):
    cases = [((0, None, 0, 0, 0, 0), "frames"), ((9, -70.1, 5, 1, 1, 1), "silence"), ((9, -70.0, 0, 0, 0, 0), "speech"), ((9, -20.0, 3, 0, 0, 0), "in a row"), ((9, -20.0, 3, 1, 0, 0), "closed"), ((9, -20.0, 3, 1, 1, 0), "words"), ((9, -20.0, 3, 1, 1, 1), None)]
    rows = spark.createDataFrame([(k, *c[0]) for k, c in enumerate(cases)], "session long, frames long, level_max double, speech long, opens long, closes long, with_words long")
    assert {r["session"]: r["first_silent"] for r in sessions.diagnosed(rows).collect()} == dict(enumerate(c[1] for c in cases))
