import hashlib
import random
import re

import pytest

from lorekeep.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            n = min(10, len(b))
            runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in runs:
                    hit |= set(range(i, i + n))
                    items.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["é", "ÀB", "x9"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(k, line(rng.choice((1, 2, 3, 9, 10, 11, 25)))) for k in range(40)] + [(40, None), (41, "!!"), (None, line(12)), (5, line(14))]
    docs = []
    for k in range(150):
        parts = [line(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(bench)[1] or "", line(rng.randrange(8))]
        docs.append((k, rng.choice((" ", "\n", " - ")).join(parts).upper() if k % 5 == 0 else ", ".join(parts)))
    docs += [(None, None), (200, ""), (200, bench[6][1])]
    return docs, bench


@pytest.mark.parametrize("most", [100_000, 30])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)
    docs, bench = tables(spark)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, bench)


@pytest.mark.parametrize("most", [100_000, 30])
def test_stage_drops_what_is_contaminated(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)
    docs, bench = tables(spark)
    bench = [b for b in bench if len(words(b[1])) > 8]
    frame = spark.createDataFrame([(*d, "en", "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = D.stage(frame, spark.createDataFrame(bench, "item_id long, text string"))
    clean = [r[0] for r in brute(docs, bench) if not r[5]]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, clean)) and kept.columns == frame.columns


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "sat on the mat")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(odd, bench).collect()
    assert len(got) == 11 and sum(r["contaminated"] for r in got) == 3 and {r["n_hit"] for r in got} == {0, 4}
    assert not any(r["contaminated"] for r in D.contamination(odd, none).collect())
    assert D.contamination(empty, bench).count() == 0 and D.stage(empty, bench).count() == 0 and D.stage(odd, none).count() == 11
