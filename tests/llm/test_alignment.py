import hashlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import alignment as A
from lorekeep.llm import token_codec as C


@cache
def aligner():
    return A.Aligner(C.default_tokenizer(), A.default_pieces())


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(C.default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.default_pieces())


def plain(text):
    """Ids, groups and links of a whole text, every pair of tokens tried."""
    if not text:
        return [], [], [], []
    al, (a, b) = aligner(), libraries()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if b"".join(al.bytes_a[i] for i in ids_a) != raw or b"".join(al.bytes_b[i] for i in ids_b) != raw:
        return [], [], [], []

    def spans(ids, sizes):
        at, out = 0, []
        for i in ids:
            out.append((at, at + sizes[i]))
            at += sizes[i]
        return out

    sa, sb = spans(ids_a, al.size_a), spans(ids_b, al.size_b)
    links = [(x, y) for x, (s, e) in zip(ids_a, sa, strict=True) for y, (t, f) in zip(ids_b, sb, strict=True) if max(s, t) < min(e, f)]
    both = sorted({e for _, e in sa} & {f for _, f in sb})
    groups = [([x for x, (s, e) in zip(ids_a, sa, strict=True) if p <= s and e <= q], [y for y, (t, f) in zip(ids_b, sb, strict=True) if p <= t and f <= q]) for p, q in zip([0, *both], both, strict=False)]
    return ids_a, ids_b, groups, links


def shown(groups):
    text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def brute(rows):
    held, count = [(d, *plain(t)) for d, t in rows], defaultdict(int)
    for *_, links in held:
        for p in set(links):
            count[p] += 1
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted((str(d), len(a), len(b), len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), shown(g)) for d, a, b, g, k in held)


def table(df):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


BITS = ["a", "bc", " ", "  ", "\n", "\t", ".", "'s", "17", "é", " ", " ", "\x1c", "▁", "<|endoftext|>", "<s>", "<0x41>", "\U0001f600", "\x00", "Ünï", "Å", "\r\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=20).map("".join))
def test_words_are_the_whole_text(text):
    ids_a, ids_b, groups, links = plain(text)
    n_a, n_b, n_groups, n_links, sha, pairs, times = next(aligner().documents([text]))
    assert (n_a, n_b, n_groups, n_links) == (len(ids_a), len(ids_b), len(groups), len(links))
    assert sha == shown(groups)
    held = defaultdict(int)
    for x, y in links:
        held[x << 32 | y] += 1
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == held


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_align_against_all_pairs(size_a, random):
    total = sum(size_a)
    cuts = sorted(random.sample(range(1, total), random.randint(0, total - 1))) if total > 1 else []
    size_b = np.diff([0, *cuts, total])
    a, b, group_a, group_b = A.align(np.array(size_a), size_b)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    every = [(i, j) for i in range(len(size_a)) for j in range(len(size_b)) if max(end_a[i] - size_a[i], end_b[j] - size_b[j]) < min(end_a[i], end_b[j])]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == every
    both = np.array(sorted(set(end_a.tolist()) & set(end_b.tolist())))
    assert group_a.tolist() == np.searchsorted(both, end_a).tolist() and group_b.tolist() == np.searchsorted(both, end_b).tolist()


def test_query_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"]) < 3000]
    got = table(A.alignment_table(docs.where("length(text) < 3000")))
    assert got == brute(rows) and len(got) > 100


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_rows(spark, odd, empty, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(A, "small_enough", lambda *_: False)
    long = max((r["text"] or "" for r in odd.collect()), key=len)
    rows = [(r["doc_id"], (r["text"] or "").replace(long, long[:2000])) for r in odd.collect()]
    short = odd.withColumn("text", A.F.when(A.F.length("text") > 100_000, A.F.substring("text", 1, 2000)).otherwise(A.F.col("text")))
    assert table(A.alignment_table(short)) == brute(rows)
    assert A.alignment_table(empty).count() == 0


def test_very_long_texts(spark, odd, monkeypatch):
    """Links of long texts are gathered in parts, with the same result."""
    whole = table(A.alignment_table(odd))
    text = max((r["text"] or "" for r in odd.collect()), key=len)
    assert (len(libraries()[1].encode(text)), len(libraries()[0].encode(" " + text, add_special_tokens=False).ids)) in {(r[2], r[1]) for r in whole}
    parts = [next(aligner().documents([text]))]
    monkeypatch.setattr(A, "MOST_LINKS", 1000)
    parts.append(next(aligner().documents([text])))
    assert all(np.array_equal(x, y) for x, y in zip(*parts, strict=True))
