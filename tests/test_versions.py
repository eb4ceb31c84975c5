import pytest
from pyspark.sql import functions as F

from lorekeep.operators import deletion as D
from lorekeep.operators.store import Store
from lorekeep.operators.versions import Conflict, Versions

TABLES = {"a": "id string, n long", "b": "id string, n long"}


@pytest.fixture
def v(spark, tmp_path):
    return Versions(spark, str(tmp_path / "tables"), TABLES)


def rows(spark, *ids, n=1):
    return spark.createDataFrame([(i, n) for i in ids], "id string, n long")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_change_shows_in_all_tables_or_in_none(spark, v):
    with v.change() as c:
        c.append("a", rows(spark, "x"))
        c.append("b", rows(spark, "y"))
        assert v.version() == 0 and v.read("a").isEmpty() and v.read("b").isEmpty()
        assert ids(c.read("a")) == ["x"]
    reader = v.read("a"), v.read("b")
    with pytest.raises(RuntimeError, match="killed"), v.change() as c:
        c.append("a", rows(spark, "z"))
        c.replace("b", rows(spark, "w"))
        raise RuntimeError("killed")
    assert v.version() == 1 and ids(v.read("a")) == ["x"] and ids(v.read("b")) == ["y"]
    with v.change() as c:
        c.append("a", rows(spark, "z"))
        c.replace("b", rows(spark, "w"))
    assert [ids(r) for r in reader] == [["x"], ["y"]], "a reader keeps its version"
    assert ids(v.read("a")) == ["x", "z"] and ids(v.read("b")) == ["w"] and ids(v.read("b", 1)) == ["y"]
    assert v.purge() == 3, "the replaced folder, and two of the killed change"
    assert ids(v.read("a")) == ["x", "z"] and v.purge() == 0


def test_changes_side_by_side(spark, v):
    with v.change() as c:
        c.append("a", rows(spark, "x"))
    one, two = v.change(), v.change()
    with one as c:
        c.append("a", rows(spark, "p"))
        with two as d:
            d.append("a", rows(spark, "q"))
    assert ids(v.read("a")) == ["p", "q", "x"] and v.version() == 3
    with pytest.raises(Conflict, match="a was changed"), v.change() as c:
        c.replace("a", rows(spark, "late"))
        with v.change() as d:
            d.replace("a", rows(spark, "early"))
    assert ids(v.read("a")) == ["early"]
    with pytest.raises(Conflict, match="the store"), v.change(alone=True) as c:
        c.append("b", rows(spark, "late"))
        with v.change() as d:
            d.append("a", rows(spark, "early too"))
    assert v.read("b").isEmpty() and not v.files.put(f"{v.path}/_versions/{v.version():012d}", "{}")


def test_only_touched_folders_are_written(spark, v):
    for k in range(3):
        with v.change() as c:
            c.append("a", rows(spark, f"x{k}", f"y{k}"))
    before = v.manifest()["a"]
    with v.change() as c:
        assert c.rewrite("a", lambda r: r.where("id = 'y1'"), lambda r: r.where("id != 'y1'")) == 1
        assert c.rewrite("a", lambda r: r.where("id = 'none'"), lambda r: r.limit(0)) == 0
        assert c.rewrite("b", lambda r: r, lambda r: r) == 0
    after = v.manifest()["a"]
    assert len(set(before) & set(after)) == 2 and len(after) == 3 and ids(v.read("a")) == ["x0", "x1", "x2", "y0", "y2"]


def test_lost_files_and_other_columns_are_errors(spark, v):
    with v.change() as c:
        c.append("a", rows(spark, "x"))
    with pytest.raises(ValueError, match="other columns"):
        Versions(spark, v.path, {"a": "id string"}).read("a")
    v.files.remove(f"{v.path}/{v.manifest()['a'][0]}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        v.read("a").collect()


@pytest.fixture
def memory(spark, tmp_path):
    s = Store(spark, str(tmp_path / "memory"))
    obs = "id string, kind string, session long, started_at double, ended_at double, person string, text string, is_question boolean"
    said = [("o1", 1, 0.0, "my card is 4111"), ("o2", 1, 2.0, "the weather is fine"), ("o3", 2, 100.0, "tea at five"), ("a1", 1, 4.0, "you said your card is 4111"), ("a2", 2, 102.0, "about the card, as I said"), ("o4", None, 200.0, "no session")]
    with s.change() as c:
        c.append("observations", spark.createDataFrame([(i, "answer" if i[0] == "a" else "speech", n, t, t + 1, None, x, False) for i, n, t, x in said[:4]], obs))
        c.append("observations", spark.createDataFrame([(i, "answer" if i[0] == "a" else "speech", n, t, t + 1, None, x, False) for i, n, t, x in said[4:]], obs))
        c.append("beliefs", spark.createDataFrame([(7, 1, "has a card", "card", "m", 0.5, 1.0, 5.0), (8, 1, "likes tea", "tea", "m", 0.5, 1.0, 5.0), (9, 1, "has a new card", "card", "m", 0.5, 1.0, 6.0)], "id long, owner long, statement string, about string, author string, certainty double, weight double, formed_at double"))
        edges = [("a1", "o1", "cites"), ("a2", "a1", "cites"), ("a1", "a2", "cites"), ("7", "a1", "came-from"), ("7", "o3", "came-from"), ("8", "o3", "came-from"), ("9", "o3", "came-from"), ("9", "7", "replaces")]
        c.append("edges", spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, type string, at double"))
        c.append("uses", spark.createDataFrame([("o1", "d1"), ("o2", "d2"), ("a1", "d2"), ("a2", "d3")], "id string, digest string"))
        c.append("blobs", spark.createDataFrame([("d1", 10, 0.0), ("d2", 20, 0.0), ("d3", 30, 0.0), ("d4", 40, 0.0), ("d5", 50, 99_999.0)], "digest string, bytes long, at double"))
        c.append("log", spark.createDataFrame([("l1", "c", ["o1", "o3", "o1"], 1.0), ("l2", "c", ["o3"], 1.0), ("l3", "c", [], 1.0), ("l4", "c", None, 1.0), ("l5", "c", ["7", "8"], 1.0)], "id string, caller string, returned array<string>, at double"))
    with s.change() as c:
        c.append("windows", D.T.centred_windows(s.read("observations")))
    return s


def state(s):
    return {n: sorted(map(str, s.read(n).collect())) for n in s.schemas}


def test_forgetting_takes_all_that_follows(spark, memory):
    before = memory.version()
    n = D.forget(memory, spark.createDataFrame([("o1",), ("nobody",)], "id string"), "asked to", 50.0)
    assert n == {"observations": 3, "beliefs": 1, "blobs": 2, "log": 2, "windows_dropped": 3, "windows_rebuilt": 2}
    assert ids(memory.read("observations")) == ["o2", "o3", "o4"] and ids(memory.read("beliefs").selectExpr("cast(id as string) as id")) == ["8", "9"]
    assert sorted((r["src"], r["dst"]) for r in memory.read("edges").collect()) == [("8", "o3"), ("9", "o3")]
    assert sorted(r["digest"] for r in memory.read("blobs").collect()) == ["d2", "d4", "d5"], "d2 is used by what stays"
    assert {r["id"]: r["returned"] for r in memory.read("log").collect()} == {"l1": ["forgotten", "o3", "forgotten"], "l2": ["o3"], "l3": [], "l4": None, "l5": ["forgotten", "8"]}
    assert {r["id"]: r["text"] for r in memory.read("windows").collect()} == {"o2": "the weather is fine", "o3": "tea at five", "o4": "no session"}
    assert sorted((r["id"], r["kind"]) for r in memory.read("tombstones").collect()) == [("7", "belief"), ("a1", "observation"), ("a2", "observation"), ("d1", "audio"), ("d3", "audio"), ("o1", "observation")]
    assert memory.version() == before + 1
    for name in memory.schemas:
        for folder in memory.files.names(f"{memory.path}/{name}"):
            text = str(spark.read.parquet(f"{memory.path}/{name}/{folder}").collect())
            assert "4111" not in text, "the words are in no file"


@pytest.mark.parametrize("dies", ["scrub", "repair", "commit", "purge"])
def test_killed_while_forgetting(spark, memory, monkeypatch, dies):
    """Before the manifest is put nothing has happened, afterwards everything; done again, the end is the same."""
    before, seed = state(memory), spark.createDataFrame([("o1",)], "id string")

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(*{"scrub": (D, "scrub"), "repair": (D, "repair"), "commit": (memory.files, "put"), "purge": (memory, "purge")}[dies], die)
        with pytest.raises(RuntimeError, match="killed"):
            D.forget(memory, seed, "asked to", 50.0)
    seen = state(memory)
    assert (seen == before) == (dies != "purge")
    again = D.forget(memory, seed, "asked to", 50.0)
    assert again["observations"] == (0 if dies == "purge" else 3)
    assert ids(memory.read("observations")) == ["o2", "o3", "o4"] and len(memory.files.names(f"{memory.path}/observations")) == len(memory.manifest()["observations"])


def test_forgetting_by_session_and_time(spark, memory):
    assert D.forget_minutes(memory, 1.0, 160.0, purge=False)["observations"] == 4, "those of a minute, and what cites them in other sessions"
    assert ids(memory.read("observations", 2)) == ["a1", "a2", "o1", "o2", "o3", "o4"]
    assert D.forget_sessions(memory, [2], 300.0)["observations"] == 0 and D.forget_sessions(memory, [1], 300.0)["observations"] == 2
    assert {r["reason"] for r in memory.read("tombstones").collect()} == {"forget 1.0m", "forget sessions 1"}
    assert D.forget(memory, spark.createDataFrame([], "id string"), "x", 1.0)["observations"] == 0


def test_sweep_reports_before_it_deletes(memory):
    assert D.sweep(memory, 100_000.0) == {"blobs": 1, "bytes": 40} and memory.read("blobs").count() == 5
    assert D.sweep(memory, 100_000.0, apply=True) == {"blobs": 1, "bytes": 40}
    assert sorted(r["digest"] for r in memory.read("blobs").collect()) == ["d1", "d2", "d3", "d5"], "what is young stays"
    assert [(r["id"], r["kind"], r["reason"]) for r in memory.read("tombstones").collect()] == [("d4", "audio", D.SWEPT)]
    assert D.sweep(memory, 100_000.0, apply=True) == {"blobs": 0, "bytes": 0}


def test_beliefs_and_their_edges_come_together(spark, memory, monkeypatch):
    rows = spark.createDataFrame([(11, ["o3"], "tea", 8)], "id long, sources array<string>, about string, replaces long").selectExpr("*", "1L as owner", "'s' as statement", "'me' as author", "0.5D as certainty", "1.0D as weight", "0.0D as formed_at")
    before = state(memory)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="killed"):
        def die(c):
            raise RuntimeError("killed")

        memory.add_beliefs(rows, 9.0, then=die)
    assert state(memory) == before
    memory.add_beliefs(rows, 9.0, then=lambda c: c.append("meta", c.versions.spark.createDataFrame([("day", "1", 9.0)], "key string, value string, at double")))
    assert memory.read("beliefs").where("id = 11").count() == memory.read("meta").count() == 1 and memory.read("edges").where(F.col("src") == "11").count() == 2
