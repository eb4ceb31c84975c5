import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import token_codec as C


@cache
def _pieces():
    return C.Pieces(C.default_tokenizer())


@pytest.fixture(scope="module")
def pieces():
    return _pieces()


def plain(pieces, text):
    return pieces.tokenizer.encode(text, add_special_tokens=False).ids


BITS = ["a", "b", " ", "  ", "\n", "\t", ".", "'", "1", "é", "\u00a0", "\u2003", "\x1c", "'s", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25).map("".join))
def test_pieces_are_the_library(text):
    p = _pieces()
    assert np.frombuffer(p.encode([text])[0], "<u2").tolist() == plain(p, text)


def test_pieces_of_documents(spark, medium, pieces):
    texts = [r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").limit(300).collect()]
    assert [np.frombuffer(x, "<u2").tolist() for x in pieces.encode(texts)] == [plain(pieces, t) for t in texts]


@pytest.mark.parametrize("ids", [[], [7], [0] * 9000, [65535, 0] * 5000, list(range(50_000)), "zipf", "random"])
def test_round_trip(ids):
    rng = np.random.default_rng(4)
    drawn = {"zipf": np.minimum(rng.zipf(1.2, 60_000), 50_000), "random": rng.integers(0, 1 << 16, 30_000)}
    ids = np.array(drawn[ids] if isinstance(ids, str) else ids, np.int64)
    sizes = [len(ids) // 3, 0, len(ids) - len(ids) // 3]
    data = C.pack(ids, [5, None, -9], sizes)
    back, docs, n = C.unpack(data)
    assert (back == ids).all() and docs == [5, None, -9] and n == sizes


def test_predictions_pay():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 37), 3000)
    assert len(C.pack(ids, [1], [len(ids)])) < 0.12 * len(ids)


def test_damage_is_found():
    data = bytearray(C.pack(np.arange(20_000) % 777, [1], [20_000]))
    for at in (13, len(data) - 5):
        hurt = bytearray(data)
        hurt[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            C.unpack(bytes(hurt))
    with pytest.raises(ValueError, match="65,536"):
        C.pack(np.array([1 << 16]), [1], [1])


def brute(pieces, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = [*plain(pieces, text or ""), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents(spark, small, odd, empty, pieces, monkeypatch):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in C.token_table(docs).orderBy("start").collect()]
        assert got == brute(pieces, rows)
    assert C.token_table(empty).count() == 0


def test_tables_compress_better_than_halved_ones(monkeypatch):
    rng = np.random.default_rng(8)
    phrases = [rng.zipf(1.3, 12) % 20_000 for _ in range(600)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 600, 12_000)])
    whole = C.pack(ids, [1], [len(ids)])
    assert np.array_equal(C.unpack(whole)[0], ids)
    monkeypatch.setattr(C, "SLOT_BITS", 11)
    monkeypatch.setattr(C, "_SLOTS", (1 << 11) - 1)
    monkeypatch.setattr(C, "EPOCH", 64)
    assert len(whole) < len(C.pack(ids, [1], [len(ids)]))


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_words_beside_line_feeds_go_to_the_library_together():
    p = C.Pieces(C.default_tokenizer())
    texts = [" ".join(f"wo{chr(97 + k // 26)}{chr(97 + k % 26)}rt{n}.\nNext{chr(97 + k // 26)}{chr(97 + k % 26)}{n}" for k in range(100)) for n in range(4)]
    p.tokenizer = Counted(p.tokenizer)
    got = p.encode(texts)
    assert p.tokenizer.texts < 40
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain(p, t) for t in texts]
    p.tokenizer.texts = 0
    assert p.encode(texts) == got and p.tokenizer.texts == 0


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 20)
    p = C.Pieces(C.default_tokenizer())
    for n in range(6):
        texts = [f"a{n}. b{n}\nc{n} {k}x\n\n d\r\ne \n{'long' * 30}{n}" for k in range(30)] + ["", "a  ", "<|endoftext|> a"]
        assert [np.frombuffer(x, "<u2").tolist() for x in p.encode(texts)] == [plain(p, t) for t in texts]
        assert len(p.texts) < 200
