import re

import pytest

from lorekeep.functions.fixed import STOPWORDS
from lorekeep.operators import nightly as N
from lorekeep.operators.store import Store
from lorekeep.plans import nightly as plans


def share(old, new):
    """What part of old's content words new has, whole or by their first five letters."""
    words = [w for w in re.findall("[a-z0-9']+", old.lower()) if len(w) > 1 and w not in STOPWORDS]
    stems = {w[:5] for w in re.findall("[a-z0-9']+", new.lower())}
    return sum(w[:5] in stems for w in words) / len(words) if words else 0.0


def told_in_order(rows):
    """Days in order, each belief in order of its moment; it asks the current beliefs on its subject, newest first, and takes the first that it makes void."""
    held, out = [], {}
    for r in sorted(rows, key=lambda r: (r["day"], r["at"], r["id"])):
        known = [h for h in held if h["about"] == r["about"] and not h["gone"]]
        old = next((h for h in sorted(known, key=lambda h: (-h["at"], -h["id"])) if share(h["statement"], r["statement"]) >= 0.5), None)
        if old:
            old["gone"] = True
        held.append({**r, "gone": False})
        out[r["id"]] = old["id"] if old else None
    return out


def test_nights_equal_a_sequential_run(spark, medium):
    rows = [r.asDict() for r in plans._considered(spark, medium).where("reason = 'ok'").select("id", "day", "about", "statement", "at", "sources").collect()]
    got = plans.nights_consolidated(spark, medium).collect()
    beliefs = {r["id"]: r for r in got if r["what"] == "belief"}
    want = told_in_order(rows)
    assert {k: r["replaces"] for k, r in beliefs.items()} == want and len(want) > 50
    assert {r["id"]: r["sources"] for r in beliefs.values()} == {r["id"]: len(r["sources"]) for r in rows}
    assert sorted(r["id"] for r in got if r["what"] == "marker") == sorted({r["day"] for r in plans._episodes(spark, medium).select("day").collect()})
    assert not [r for r in got if r["what"] == "again"] and sum(r["replaces"] for r in got if r["what"] in ("night", "by hand")) == len(want)


EPISODE = "id long, day long, n long, recognised boolean, at double, words long, worth boolean, lines array<string>, statement string, about string, support string, sources array<string>"


def episodes(spark, rows):
    """rows: id, day, at, about, statement, which is also what was said."""
    return spark.createDataFrame([(i, d, 2, True, float(t), 30, True, [s, "and more"], s, a, s, [f"o{i}"]) for i, d, t, a, s in rows], EPISODE)


SAID = [
    (1, 0, 1, "Tea", "green tea in the morning"),
    (2, 0, 2, "tea, coffee", "green tea in the evening"),
    (3, 0, 3, "tea and cake", "green tea at noon"),
    (4, 1, 4, "tea", "no more green tea at noon or in the evening or morning"),
    (5, 1, 5, "tea", "green tea again"),
    (6, 1, 6, "cake", "green tea with cake"),
]


def test_each_takes_its_predecessor_out_of_the_next_ones_candidates(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    e = episodes(spark, SAID)
    assert N.run_day(s, e, 0) == {"day": 0, "written": 3, "rejected": 0}
    assert N.nightly(s, e, 2)["runs"] == [{"day": 1, "written": 3, "rejected": 0}]
    edges = {(int(r["src"]), int(r["dst"])) for r in s.read("edges").where("type = 'replaces'").collect()}
    want = told_in_order([{"id": i, "day": d, "at": t, "about": re.split(r"[,;/]| and ", a.lower())[0].strip(), "statement": x} for i, d, t, a, x in SAID])
    assert edges == {(k, v) for k, v in want.items() if v} == {(2, 1), (3, 2), (4, 3)}
    assert N.nightly(s, e, 2) == {"deferred": False, "pending": 0, "skipped": 0, "runs": []} and N.marked(s) == 1
    assert N.nightly(s, e, 9, ready=False) == {"deferred": True, "pending": 5, "skipped": 2, "runs": []} and N.marked(s) == 1


def test_a_night_that_dies_is_done_again(spark, tmp_path, monkeypatch):
    s, e = Store(spark, str(tmp_path / "s")), episodes(spark, SAID)
    N.run_day(s, e, 0)
    before = s.version(), sorted(map(str, s.read("edges").collect()))
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="killed"):
        m.setattr(s.files, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        N.nightly(s, e, 2)
    assert (s.version(), sorted(map(str, s.read("edges").collect()))) == before and N.marked(s) == 0
    assert N.nightly(s, e, 2)["runs"] == [{"day": 1, "written": 3, "rejected": 0}] and s.read("beliefs").count() == 6


def test_first_accepted_wins_in_order(spark):
    rows = [("a", 10, 3.0, 2, 2.0), ("a", 10, 3.0, 1, 1.0), ("a", 11, 4.0, 2, 2.0), ("a", 11, 4.0, 1, 1.0), ("a", 12, 5.0, 1, 1.0), ("b", 20, 1.0, 19, 0.5), ("a", 13, 6.0, 11, 4.0), ("a", 13, 6.0, 12, 4.0)]
    pairs = spark.createDataFrame(rows, "about string, new long, new_at double, old long, old_at double").repartition(3)
    assert {(r["id"], r["replaces"]) for r in N.replaced_in_order(pairs).collect()} == {(10, 2), (11, 1), (13, 12), (20, 19)}
    assert N.replaced_in_order(pairs.limit(0)).count() == 0


def test_pending_days():
    assert N.pending(None, 10) == ([9], 0) and N.pending(3, 10) == ([5, 6, 7, 8, 9], 1) and N.pending(9, 10) == ([], 0) and N.pending(4, 10) == ([5, 6, 7, 8, 9], 0)


def test_reasons_in_order(spark):
    ok = (1, 0, 2, True, 0.0, 25, True, ["Green tea, in the morning!", None, ""], "green tea", "Tea", "green tea in the morning", ["o"])
    change = lambda i, **x: tuple({**dict(zip(names, ok, strict=True)), "id": i, **x}[k] for k in names)
    names = [c.split()[0] for c in EPISODE.split(", ")]
    rows = [
        ok, change(2, words=24), change(3, worth=False), change(4, worth=None), change(5, statement="  "), change(6, about=" , tea"), change(7, about=None), change(8, support="something else altogether"),
        change(9, support=None), change(10, statement="black coffee tonight"), change(11, support="green tea, in te mornin"), change(12, lines=None), change(13, lines=[], support="x"),
    ]
    got = {r["id"]: (r["reason"], r["about"]) for r in N.considered(spark.createDataFrame(rows, EPISODE)).collect()}
    reasons = {k: v[0] for k, v in got.items()}
    assert reasons == {1: "ok", 2: "only 24 words", 3: "nothing worth concluding", 4: "nothing worth concluding", 5: "said worth but wrote nothing", 6: "no subject", 7: "no subject", 8: "not grounded", 9: "not grounded", 10: "words never said", 11: "ok", 12: "not grounded", 13: "not grounded"}
    assert got[1][1] == "tea"
