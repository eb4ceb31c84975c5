import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.plans import live as plans
from lorekeep.streaming import commits
from lorekeep.streaming import live as L

#: Rows at the first watermark, the epoch, count as late; clocks start after it.
START = 10**9


def frames(spark, said, session="s"):
    """A session's frames from a string: # loud, . quiet, P paused, C capturing."""
    rows = [(session, k * 0.032, k, 1.0 if c == "#" else 0.0, {"P": "paused", "C": "capturing"}.get(c)) for k, c in enumerate(said)]
    return spark.createDataFrame(rows, "session string, at double, id long, p double, move string")


SAID = "......##..#...." + "." * 10 + "##" + "#" * 5 + "P" + "." * 12 + "##...." + "C" + "." * 9 + "###" + "." * 30


def restated(said):
    """Segments (first, last, capturing, frames) and utterances of them, found from the whole string."""
    moves, plain = {}, []
    for k, c in enumerate(said):
        if c in "PC":
            moves[k] = c == "C"
        else:
            plain.append((k, c == "#"))
    out, begin, i = [], 0, 0
    while i + 1 < len(plain):
        if not (plain[i][1] and plain[i + 1][1]):
            i += 1
            continue
        end = next((j for j in range(i + 11, len(plain)) if not any(x for _, x in plain[j - 9 : j + 1])), None)
        if end is None:
            break
        own = plain[max(begin, i + 1 - 6) : end + 1]
        kept = [v for k, v in sorted(moves.items()) if k < plain[end][0]]
        places = [p for p, (_, x) in enumerate(own) if x]
        parts = 1 + sum(b - a > L.PAUSE_FRAMES for a, b in zip(places, places[1:], strict=False))
        out.append((own[0][0], own[-1][0], kept[-1] if kept else True, len(own), parts))
        begin = i = end + 1
    return out


def seen(spark, base):
    return {name: sorted(map(str, L.sink(spark, base, name).collect())) for name in L.SINKS}


@pytest.mark.parametrize("parts", [1, 4])
def test_sinks_hold_what_the_whole_string_says(spark, parts):
    want = restated(SAID)
    assert len(want) >= 3 and {w[2] for w in want} == {True, False}
    base = L.fed(L.slices(frames(spark, SAID), "at", parts), L.listening())
    got = sorted((r["segment"], round(r["t0"] / 0.032), round(r["t1"] / 0.032), r["capturing"]) for r in L.sink(spark, base, "channel").collect())
    assert got == [(k + 1, *w[:3]) for k, w in enumerate(want)]
    kept = {k + 1: w for k, w in enumerate(want) if w[2]}
    assert {r["segment"]: r["frames"] for r in L.sink(spark, base, "records").collect()} == {k: w[3] for k, w in kept.items()}
    assert {r["segment"]: r["n"] for r in L.sink(spark, base, "archive").collect()} == {k: w[3] for k, w in kept.items()}
    assert L.sink(spark, base, "store").groupBy("segment").count().collect() and {r["segment"]: r["count"] for r in L.sink(spark, base, "store").groupBy("segment").count().collect()} == {k: w[4] for k, w in kept.items()}


def test_killed_between_two_sinks(spark):
    """The second batch dies after its first sinks; no reader sees any of it, and the stream goes on as if nothing had been."""
    said = SAID * 2
    parts = L.slices(frames(spark, said), "at", 3)
    whole = seen(spark, L.fed(parts, L.listening()))

    class Killed(Exception):
        pass

    def dies(segments):
        raise Killed("between two sinks")

    broken = {k: dies if k == "records" else f for k, f in L.SINKS.items()}
    base = L.fed(parts[:1], L.listening())
    before = seen(spark, base)
    with pytest.raises(Exception, match="between two sinks"):
        L.fed(parts[1:2], L.listening(broken), base)
    assert commits.all_of(spark, base) == [0] and seen(spark, base) == before
    assert len(spark.read.parquet(f"{base}/channel").select("batch").distinct().collect()) == 1, "sinks are written in the order given"
    assert {r["batch"] for r in spark.read.parquet(f"{base}/archive").select("batch").distinct().collect()} <= {0, 1}
    L.go_on(spark, parts[0].schema, L.listening(), base)
    L.fed(parts[2:], L.listening(), base)
    assert seen(spark, base) == whole and commits.all_of(spark, base) == [0, 1, 2]


def test_a_committed_batch_is_not_written_again(spark):
    base = L.fed(L.slices(frames(spark, SAID), "at", 1), L.listening())
    held = seen(spark, base)
    L.to_sinks(base)(spark.createDataFrame([], L.Session.OUT), 0)
    assert seen(spark, base) == held and not commits.put(spark, base, 0)


def asked(spark, rows):
    return spark.createDataFrame(rows, "caller string, ms long, id long, kind string").selectExpr("caller", f"timestamp_millis(ms + {START}) as at", "id", "kind", f"ms + {START} as ms")


def test_requests_wait_until_the_deadline(spark):
    rows = [
        ("a", 0, 1, "ask"), ("a", 44_999, 2, "approve"),
        ("b", 0, 3, "ask"), ("b", 45_000, 4, "approve"),
        ("c", 0, 5, "ask"), ("c", 10_000, 6, "ask"), ("c", 20_000, 7, "look"), ("c", 46_000, 8, "deny"),
        ("d", 0, 9, "ask"), ("d", 0, 10, "approve"), ("d", 50_000, 11, "ask"),
    ]
    end = asked(spark, [("end", 10**9, 99, "end")])
    base = L.fed([*L.slices(asked(spark, rows), "ms", 3), end], L.timed(L.Waiting(45_000), "caller", "1 second"))
    got = sorted((r["caller"], r["id"], r["outcome"], r["resolved"] - START) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [("a", 1, "approved", 44_999), ("b", 3, "timeout", 45_000), ("c", 5, "timeout", 45_000), ("c", 6, "denied", 46_000), ("d", 9, "approved", 0), ("d", 11, "timeout", 95_000)]


def test_a_request_times_out_without_another_row_of_its_caller(spark):
    base = L.fed([asked(spark, [("a", 0, 1, "ask")]), asked(spark, [("z", 60_000, 2, "look")])], L.timed(L.Waiting(45_000), "caller", "1 second"))
    assert [(r["id"], r["outcome"]) for r in spark.read.parquet(f"{base}/out").collect()] == [(1, "timeout")]


def test_devices_stall_once_for_each_silence(spark):
    rows = [("a", t) for t in (0, 1_000, 7_000, 13_001, 30_000)] + [("b", 5_000)]
    blocks = spark.createDataFrame(rows, "device string, ms long").selectExpr("device", f"timestamp_millis(ms + {START}) as at", f"ms + {START} as ms")
    end = spark.createDataFrame([("end", 10**7)], "device string, ms long").selectExpr("device", f"timestamp_millis(ms + {START}) as at", f"ms + {START} as ms")
    base = L.fed([*L.slices(blocks, "ms", 4), end], L.timed(L.Stalled(6_000), "device", "1 second"))
    got = sorted((r["device"], r["last"] - START, r["blocks"]) for r in spark.read.parquet(f"{base}/out").where("device != 'end'").collect())
    assert got == [("a", 7_000, 3), ("a", 13_001, 4), ("a", 30_000, 5), ("b", 5_000, 1)]


def test_prints_equal_a_fold_over_all_vectors(spark, small):
    got = {(r["person"], r["place"]): (r["strength"], r["matches"], r["head"], r["seen"], r["confident"], r["borderline"], r["consolidations"]) for r in plans.people_learned(spark, small).collect()}
    people = {}
    for r in sorted(spark.read.parquet(f"{small}/embeddings.parquet").collect(), key=lambda r: r["vec_id"]):
        people.setdefault(r["label"], []).append((r["vec_id"], np.array(r["embedding"], np.float64)))
    names, want = sorted(people), {}
    norm = lambda v: v / np.linalg.norm(v)
    for k, name in enumerate(names):
        anchor, rival = norm(people[name][0][1]), norm(people[names[(k + 1) % len(names)]][0][1])
        prints, seen, sure, doubtful, since, rounds = [], 0, 0, 0, 0, 0
        for i, v in people[name]:
            e = norm(people[name][0][1] + (0.5, 1, 2, 4)[i % 4] * v)
            seen += 1
            far = [round(1 - v @ e, 9) for v in (anchor, *[p["v"] for p in prints])]
            best = far.index(min(far))
            if far[best] > 0.4 or 1 - rival @ e - far[best] < 0.1:
                doubtful += far[best] <= 0.7
                continue
            if best:
                prints[best - 1]["s"] += 1
                prints[best - 1]["m"] += 1
            prints.append({"v": e, "s": 1.0, "m": 1})
            sure, since = sure + 1, since + 1
            if since == 16 or len(prints) > 24:
                since, rounds = 0, rounds + 1
                for p in prints:
                    p["s"] *= 0.92
                prints = [p for p in prints if p["s"] >= 0.25]
                while len(prints) > 24:
                    pairs = [(1 - prints[a]["v"] @ prints[b]["v"], a, b) for a in range(len(prints)) for b in range(a + 1, len(prints))]
                    _, a, b = min(pairs)
                    p, q = prints[a], prints[b]
                    prints = [x for j, x in enumerate(prints) if j not in (a, b)] + [{"v": norm(p["v"] * p["s"] + q["v"] * q["s"]), "s": p["s"] + q["s"], "m": p["m"] + q["m"]}]
        want.update({(name, j): (p["s"], p["m"], p["v"][0], seen, sure, doubtful, rounds) for j, p in enumerate(prints)})
    assert got.keys() == want.keys() and sum(w[1] > 1 for w in want.values()) > 5 and any(w[6] for w in want.values()) and any(w[5] for w in want.values())
    assert [(k, got[k], w) for k, w in want.items() if got[k] != pytest.approx(w, abs=1e-5)] == []


def test_clock_equals_the_line_through_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    samples = rng.integers(1, 3000, 120)
    heard = np.cumsum(samples) / L.RATE
    at = 5.0 + heard * 1.03 + rng.normal(0, 0.01, 120)
    at.sort()
    rows = [("a", float(t), k, int(n)) for k, (t, n) in enumerate(zip(at, samples, strict=True))] + [("b", 1.0, 1, 700), ("b", 2.0, 2, None)]
    base = L.fed(L.slices(spark.createDataFrame(rows, "device string, at double, id long, samples long"), "at", 3), L.clocked)
    got = {r["device"]: r for r in sorted(spark.read.parquet(f"{base}/out").collect(), key=lambda r: r["blocks"])}
    x, y = heard - heard[0], at - at[0]
    assert got["a"]["rate"] == pytest.approx(np.polyfit(x, y, 1)[0]) and got["a"]["drift"] == pytest.approx((y - x)[-1])
    total = int(samples.sum())
    assert (got["a"]["samples"], got["a"]["frames"], got["a"]["carry"], got["a"]["dropped"]) == (total, total // 512, total % 512, max(0, total // 512 - L.QUEUE_MAX))
    assert (got["b"]["frames"], got["b"]["carry"], got["b"]["rate"]) == (1, 188, None)
