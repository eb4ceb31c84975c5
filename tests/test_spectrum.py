import numpy as np
import pytest

from lorekeep.operators import spectrum as X


def by_fft(db, hop=X.HOP_S):
    lin = 10 ** (np.asarray(db) / 20)
    power = np.abs(np.fft.rfft((lin - lin.mean()) * np.hanning(len(lin)))) ** 2
    freq = np.fft.rfftfreq(len(lin), hop)
    fast, slow = power[(freq >= 4) & (freq < 16)].sum(), power[(freq >= 0.5) & (freq < 4)].sum()
    return 10 * np.log10(fast / slow) if slow > 0 else None


def frames(spark, tracks):
    rows = [(name, k, float(v)) for name, db in tracks.items() for k, v in enumerate(db)]
    return spark.createDataFrame(rows, "track string, at long, db double").repartition(5)


def test_bands_against_the_library_transform(spark):
    rng = np.random.default_rng(5)
    tracks = {str(n): np.round(50 + 10 * np.sin(np.arange(n) * 0.3) + rng.normal(0, 3, n), 2) for n in (25, 60, 97, 128, 1000, 1999, 3600)}
    got = {r["track"]: (r["n"], r["mod_ratio"]) for r in X.distance_proxies(frames(spark, tracks), "track").collect()}
    assert got == {k: (len(db), pytest.approx(by_fft(db), abs=1e-8)) for k, db in tracks.items()}


def test_effort_changes_nothing(spark):
    rng = np.random.default_rng(6)
    db = np.round(rng.normal(55, 9, 500), 2)
    quiet, loud = (X.distance_proxies(frames(spark, {"x": db + more}), "track").first() for more in (0.0, 20.0))
    assert loud["level"] == pytest.approx(quiet["level"] + 20)
    assert (loud["mod_ratio"], loud["dyn_range"]) == pytest.approx((quiet["mod_ratio"], quiet["dyn_range"]))


def test_echo_lowers_both(spark):
    """Smearing the envelope in time, as a room does, takes fast modulation and fills the valleys."""
    t = np.arange(800) * X.HOP_S
    dry = 0.01 + (1 + 0.9 * np.sin(2 * np.pi * 6 * t)) * (np.sin(2 * np.pi * t) > 0)
    wet = np.convolve(dry, np.exp(-np.arange(60) / 10), "full")[:800]
    tracks = {k: np.round(20 * np.log10(v) + 60, 2) for k, v in (("dry", dry), ("wet", wet))}
    got = {r["track"]: r for r in X.distance_proxies(frames(spark, tracks), "track").collect()}
    assert got["wet"]["mod_ratio"] < got["dry"]["mod_ratio"] - 3 and got["wet"]["dyn_range"] < got["dry"]["dyn_range"]


def test_short_and_still_tracks(spark):
    tracks = {"one": [50.0], "two": [50.0, 60.0], "few": [50.0, 60.0, 40.0] * 4, "still": [50.0] * 400}
    got = {r["track"]: r for r in X.distance_proxies(frames(spark, tracks), "track").collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: len(v) for k, v in tracks.items()}
    assert all(r["mod_ratio"] is None for r in got.values()) and got["still"]["dyn_range"] is None and got["still"]["level"] == 50
    assert X.distance_proxies(frames(spark, {"x": [1.0]}).limit(0), "track").count() == 0


def calibration(spark, mod, same, dyn=(1.0, 5.0, 2.0)):
    rows = [("c", k, 60.0 - 2 * k, float(m) if m is not None else None, d) for k, (m, d) in enumerate(zip(mod, dyn, strict=True))]
    rows += [("c", None, 55.0, float(v), 3.0) for v in same]
    out = X.calibrated(spark.createDataFrame(rows, "room string, distance int, level double, mod double, dyn double"), "room", ["mod", "dyn"])
    return {r["proxy"]: r for r in out.collect()}


def test_calibration_rules(spark):
    good = calibration(spark, [1, 2, 3], [1.0, 1.2, 1.4, 1.9])
    assert good["mod"]["usable"] and good["mod"]["chosen"] and not good["dyn"]["usable"] and not good["dyn"]["monotonic"]
    assert good["mod"]["slope"] == pytest.approx(-2) and good["mod"]["start"] == pytest.approx(62) and good["mod"]["same_range"] == pytest.approx(0.9)
    assert not calibration(spark, [1, 2, 3], [1.0, 1.2, 1.4, 2.0])["mod"]["usable"], "the span must exceed twice the spread, not reach it"
    assert not calibration(spark, [1, 2, 3], [1.0, 1.2, 1.4])["mod"]["usable"], "too few recordings at one distance"
    assert calibration(spark, [3, 2.8, 2], [1.0, 1.1, 1.2, 1.3])["mod"]["usable"], "a quarter of the largest step is enough"
    assert not calibration(spark, [3, 2.85, 2], [1.0, 1.1, 1.2, 1.3])["mod"]["usable"]
    assert not calibration(spark, [1, 1, 3], [1.0] * 4)["mod"]["monotonic"]
    assert not calibration(spark, [1, None, 3], [1.0] * 4)["mod"]["usable"]
    both = calibration(spark, [1, 2, 3], [1.0, 1.2, 1.4, 1.9], dyn=(9.0, 6.0, 1.0))
    assert both["dyn"]["usable"] and both["mod"]["chosen"] and not both["dyn"]["chosen"]
