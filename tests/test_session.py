import os
import uuid

from lorekeep import session


def test_cleared_removes_only_what_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    own = [f"{k}-{uuid.uuid4().hex}" for k in ("live", "stream", "recordings")] + ["lorekeep"]
    kept = [f"store-{uuid.uuid4().hex}", "live-notes", "theirs"]
    for name in own + kept:
        os.makedirs(tmp_path / name / "inside")
    assert session.cleared(spark) == len(own) and sorted(os.listdir(tmp_path)) == sorted(kept)
    assert session.cleared(spark, ("store",)) == 1 and session.cleared(spark) == 0
