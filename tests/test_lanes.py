from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.streaming import gate
from lorekeep.streaming import live as L
from lorekeep.streaming.lanes import Lanes, laned

START = 10**9


class Held(dict):
    """A map state and a value state in memory."""

    def getMapState(self, *_):
        return self

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__


def test_a_lane_of_many_keys_is_one_call_and_one_frame():
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"device": [f"d{k % 500}" for k in range(4000)], "at": rng.permutation(4000) / 10, "id": range(4000), "samples": rng.integers(1, 3000, 4000)})

    def run(frames):
        p = Lanes(L.Clock(), "device")
        p.init(Held())
        return [f for part in frames for f in p.handleInputRows((0,), iter(part), None)]

    shared = run([[rows[:1500], rows[1500:3000]], [rows[3000:]]])
    assert [len(f) for f in shared] == [500, 500]
    alone = [run([[g[g.index < 3000]], [g[g.index >= 3000]]]) for _, g in rows.groupby("device")]
    order = lambda f: f.sort_values("device", ignore_index=True)
    for k in (0, 1):
        pd.testing.assert_frame_equal(order(shared[k]), order(pd.concat([a[k] for a in alone])), check_exact=True)


@pytest.mark.parametrize("lanes", [1, 50])
def test_lanes_change_nothing_and_one_timer_does_for_all(spark, lanes):
    rng = np.random.default_rng(2)
    blocks = {None if d == 0 else f"d{d}": sorted(rng.integers(0, 200_000, rng.integers(1, 12)).tolist()) for d in range(30)}
    rows = spark.createDataFrame([(d, t) for d, ts in blocks.items() for t in ts], "device string, ms long").selectExpr("device", f"timestamp_millis(ms + {START}) as at", f"ms + {START} as ms")
    end = spark.createDataFrame([("end", 10**7)], "device string, ms long").selectExpr("device", f"timestamp_millis(ms + {START}) as at", f"ms + {START} as ms")

    def start(stream, base):
        return laned(stream.withWatermark("at", "1 second"), "device", L.Stalled(6_000), lanes, ("at",)).writeStream.format("parquet").option("path", f"{base}/out")

    got = [(r["device"], r["last"] - START, r["blocks"]) for r in spark.read.parquet(f"{L.fed([*L.slices(rows, 'ms', 3), end], start)}/out").where("device is null or device != 'end'").collect()]
    want = [(d, a, k + 1) for d, ts in blocks.items() for k, (a, b) in enumerate(zip(ts, [*ts[1:], 10**9], strict=True)) if b - a > 6_000]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_streams_joined_within_spans_lose_no_pair(spark):
    """Around the edges of spans, against all pairs; each part is one batch."""
    rng = np.random.default_rng(4)
    edges = [datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(hours=gate.SPAN_H * k) for k in (1, 2, 3, 4, 30)]  # rows before 1970 count as late
    at = lambda: edges[rng.integers(len(edges))] + timedelta(seconds=int(rng.integers(-4200, 4200)))
    rows = [(int(rng.integers(2)), k, bool(rng.integers(2)), at()) for k in range(400)]
    rows.sort(key=lambda r: r[3])
    e = spark.createDataFrame(rows, "session long, id long, own boolean, a timestamp").withColumn("at", F.unix_millis("a"))

    def start(stream, base):
        said = stream.where("not own").selectExpr("session", "id", "a", "a + interval 20 minutes as b")
        own = stream.where("own").selectExpr("session", "a as c", "a + interval 10 minutes as d")
        return gate.self_heard_stream(said, own, delay="1000 days").writeStream.format("parquet").option("path", f"{base}/out")

    base = L.fed(L.slices(e, "at", 3), start, settings=L.JOINED)
    out = spark.read.parquet(f"{base}/out")
    got = sorted((r["id"], r["c"].timestamp()) for r in out.collect())
    want = [(i, c.timestamp()) for s, i, own, a in rows if not own for t, _, o, c in rows if o and s == t and a + timedelta(minutes=20) > c - timedelta(seconds=0.3) and a < c + timedelta(minutes=10, seconds=0.6) and abs(c - a) <= timedelta(hours=1)]
    assert got == sorted(want) and len(want) > 100
    commits = spark.read.text(f"{base}/state/commits").selectExpr("_metadata.file_name as f").distinct().collect()
    assert len(commits) == 3
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_a_deadline_at_the_very_watermark_is_not_forgotten(spark):
    """The timer fires at the watermark itself; a timer set anew for that moment would be gone with it."""
    part = lambda *rows: spark.createDataFrame(rows, "caller string, ms long, id long, kind string").selectExpr("caller", f"timestamp_millis(ms + {START}) as at", "id", "kind", f"ms + {START} as ms")

    def start(stream, base):
        return laned(stream.withWatermark("at", "1 second"), "caller", L.Waiting(45_000), 1, ("at",)).writeStream.format("parquet").option("path", f"{base}/out")

    base = L.fed([part(("a", 0, 1, "ask"), ("b", 30_000, 2, "ask")), part(("z", 46_000, 3, "look")), part(("z", 10**8, 4, "look"))], start)
    assert sorted((r["id"], r["outcome"], r["resolved"] - START) for r in spark.read.parquet(f"{base}/out").collect()) == [(1, "timeout", 45_000), (2, "timeout", 75_000)]
