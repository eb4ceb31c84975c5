"""Cross-tokenizer alignment: token lists of two tokenizers over the same bytes, cut into the smallest groups that both end together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_enough, written
from .token_codec import Pieces, _Memory, default_tokenizer

#: Bytes of texts that are aligned at once; links of one document that are gathered at once.
SLICE = 6 << 20
MOST_LINKS = 4 << 20
#: Ways into which a pair's rows are split where the pairs' counts have to be shuffled.
SALTS = 32
#: Words that go to a tokenizer in one text; entries of one generation of a worker's memory of words, and the characters of the longest.
_TOGETHER = 200
REMEMBERED = 250_000
LONGEST = 64
_B_BITS = 32
_SPACE = re.compile(r"\s")
# No token of either tokenizer holds a space behind a sign that isn't white space, so all texts may be cut there.
_CUT = re.compile(r"(?<=\S) (?=\s*\S)")
_ODD = rf"(?:^|{Pieces._BLANK}) | {Pieces._BLANK}*\z"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Index:
    """A static index over the intervals that cut [0, n) without gaps: their ends, in order. A stab is one bisection."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum(sizes, dtype=np.int64)

    def overlapping(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last interval that shares a byte with each query [start, end)."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.ends, ends, "left")


def align(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) of two cuts of the same bytes into non-empty tokens, by place, and the group of every a and every b.

    Each a stabs the index over b with its first and its last byte and is linked with all between. A gap behind an a that its last b
    doesn't span is where a group ends.
    """
    index = Index(size_b)
    ends = np.cumsum(size_a, dtype=np.int64)
    first, last = index.overlapping(ends - size_a, ends)
    n = last - first + 1
    a = np.repeat(np.arange(len(size_a)), n)
    b = np.arange(len(a)) + np.repeat(first - (np.cumsum(n) - n), n)
    closes = index.ends[last] == ends
    group_a = np.cumsum(closes) - closes
    group_b = np.searchsorted(last[closes], np.arange(len(size_b)), "left")
    return a, b, group_a, group_b


class Aligner:
    """Both tokenizers, what tokens of theirs are in bytes, and a memory of words. Words recur far more than texts: each is tokenised when it is new and aligned once a slice."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Pieces(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.tokenizer.encode_special_tokens = True
        self.bytes_a, self.bytes_b = self._bytes_a(), self._bytes_b()
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        names_a, names_b = [list(map(str, range(len(x)))) for x in (self.bytes_a, self.bytes_b)]
        self.names = np.array([f"{x}{end}" for names, ends in ((names_a, ",|"), (names_b, ",;\n")) for end in ends for x in names], object)
        self.feed = self.b.encode("\n")[1:]
        self.memory = _Memory(REMEMBERED)

    def _bytes_a(self) -> list[bytes]:
        # byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        out = [b""] * self.a.tokenizer.get_vocab_size()
        for token, k in self.a.tokenizer.get_vocab().items():
            out[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out

    def _bytes_b(self) -> list[bytes]:
        of = lambda k: bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
        return [b"" if self.b.is_control(k) or self.b.is_unknown(k) else of(k) for k in range(self.b.get_piece_size())]

    def _ids_b(self, words: list[str]) -> list[bytes]:
        """Ids, two bytes each, of words behind a space, many in one text where no word has white space of its own; the tokenizer adds the first space."""
        out, together = [b""] * len(words), []
        for k, w in enumerate(words):
            if w and len(self.feed) == 1 and not _SPACE.search(w):
                together.append(k)
            elif w:
                out[k] = np.array(self.b.encode(w), "<u2").tobytes()
        for i in range(0, len(together), _TOGETHER):
            some = together[i : i + _TOGETHER]
            ids = np.array(self.b.encode("\n ".join([words[k] for k in some])), "<u2")
            ends, raw = (2 * np.flatnonzero(ids == self.feed[0])).tolist(), ids.tobytes()
            for k, s, e in zip(some, [-2, *ends], [*ends, len(raw)], strict=True):
                out[k] = raw[s + 2 : e]
        return out

    def _learnt(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both tokenizers for words behind a space; none where not both give back the word's bytes."""
        learnt = self.a._learn_words(words)
        ids_a, ids_b, raw = [learnt[w] for w in words], self._ids_b(words), [b" " + w.encode() for w in words]
        sizes = list(map(len, raw))
        if all(self._given_back(ids, of, size, raw, sizes) for ids, of, size in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b))):
            return list(zip(ids_a, ids_b, strict=True))
        back = lambda ids, of: b"".join([of[i] for i in memoryview(ids).cast("H")])
        return [(x, y) if back(x, self.bytes_a) == r == back(y, self.bytes_b) else (b"", b"") for x, y, r in zip(ids_a, ids_b, raw, strict=True)]

    @staticmethod
    def _given_back(ids: list[bytes], of: list[bytes], size: np.ndarray, raw: list[bytes], sizes: list[int]) -> bool:
        """Whether all words' ids stand for their bytes: the bytes of all together are the same, and each word's are as many as it has."""
        flat = np.frombuffer(b"".join(ids), "<u2")
        total = np.concatenate([[0], np.cumsum(size.take(flat))])
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 2)
        return np.diff(total[ends], prepend=0).tolist() == sizes and b"".join(map(of.__getitem__, flat.tolist())) == b"".join(raw)

    def _ids(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        self.memory.turn()
        known, before = self.memory.new, self.memory.old.get
        out = list(map(known.get, words))
        missing = [k for k, x in enumerate(out) if x is None]
        new = []
        for k in missing:
            if (x := before(words[k])) is None:
                new.append(k)
            else:
                known[words[k]] = out[k] = x
        for k, x in zip(new, self._learnt([words[k] for k in new]), strict=True):
            out[k] = x
            if len(words[k]) <= LONGEST:
                known[words[k]] = x
        return out

    def words(self, words: list[str]) -> dict:
        """What each word behind a space comes to: n_a, n_b, n_groups, n_links, the pairs of its links one word after another, its groups as text, and whether both tokenizers give back its bytes."""
        ids_a, ids_b = zip(*self._ids(words), strict=True) if words else ((), ())
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(words)) // 2 for x in (ids_a, ids_b))
        flat_a, flat_b = (np.frombuffer(b"".join(x), "<u2").astype(np.int64) for x in (ids_a, ids_b))
        whole = n_a > 0
        a, b, group_a, group_b = align(self.size_a.take(flat_a), self.size_b.take(flat_b))
        word_a = np.repeat(np.arange(len(words)), n_a)
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
        # groups as text: a's of a group, then its b's, each with the sign that follows it
        last_b = np.zeros(len(flat_b), np.int64)
        last_b[end_b - 1] = 1
        last_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
        last_a = np.zeros(len(flat_a), np.int64)
        last_a[end_a - 1] = 1
        order = np.empty(len(flat_a) + len(flat_b), np.int64)
        order[np.arange(len(flat_a)) + (end_b - in_b)[group_a]] = flat_a + last_a * len(self.bytes_a)
        order[np.arange(len(flat_b)) + end_a[group_b]] = flat_b + last_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        lines = iter("".join(self.names.take(order).tolist()).split("\n"))
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(word_a[last_a == 1], minlength=len(words)),
            "n_links": np.bincount(word_a[a], minlength=len(words)),
            "pairs": flat_a[a] << _B_BITS | flat_b[b],
            "groups": [next(lines) if n else "" for n in n_a.tolist()],
            "whole": whole,
        }

    @staticmethod
    def _cut(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
        """Distinct words of some texts, and each text's words by their numbers. Only texts with white space beside a space, or a space at an end, need more than a plain split at spaces."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        full = np.asarray(pc.binary_length(texts)) > 0
        codes = [np.zeros(0, np.int64)] * len(texts)
        plain = np.flatnonzero(full & ~odd)
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        coded = split.values.dictionary_encode()
        words, flat, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().tolist()
        for k, b, e in zip(plain.tolist(), ends, ends[1:], strict=False):
            codes[k] = flat[b:e]
        place: dict[str, int] = {}
        for k in np.flatnonzero(odd).tolist():
            codes[k] = len(words) + np.array([place.setdefault(w, len(place)) for w in _CUT.split(texts[k].as_py())], np.int64)
        return words + list(place), codes

    def documents(self, texts: list[str | None] | pa.Array) -> Iterator[tuple]:
        """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs and how often each is linked. Texts without tokens give zeros."""
        words, codes = self._cut(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        found = self.words(words)
        pairs, local = np.unique(found["pairs"], return_inverse=True)
        local, lines, sizes = local.astype(np.int32), found["groups"], found["n_links"]
        starts = np.cumsum(sizes) - sizes
        whole = found["whole"]
        counts = np.stack([found[c] for c in ("n_a", "n_b", "n_groups", "n_links")], axis=1)

        def linked(code: np.ndarray) -> np.ndarray:
            n = sizes.take(code)
            ends = np.cumsum(n)
            at = np.repeat(starts.take(code) - (ends - n), n)
            at += np.arange(len(at))
            return local.take(at)

        for code in codes:
            if not len(code) or not whole.take(code).all():
                yield 0, 0, 0, 0, "", pairs[:0], pairs[:0]
                continue
            sums = counts.take(code, axis=0).sum(axis=0).tolist()
            sha = hashlib.sha256()
            for i in range(0, len(code), 1 << 20):
                sha.update((";" * (i > 0) + ";".join([lines[k] for k in code[i : i + (1 << 20)].tolist()])).encode())
            if sums[3] <= MOST_LINKS:
                x = np.sort(linked(code))
                at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                own, times = x[at], np.diff(at, append=len(x))
            else:
                times = np.zeros(len(pairs), np.int64)
                step = max(1, MOST_LINKS * len(code) // sums[3])
                for i in range(0, len(code), step):
                    times += np.bincount(linked(code[i : i + step]), minlength=len(pairs))
                own = np.flatnonzero(times)
                times = times[own]
            yield *sums, sha.hexdigest(), pairs[own], times


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    """A worker loads both tokenizers once."""
    return Aligner(path_a, path_b)


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Each document by itself: its counts, the digest of its groups, its distinct linked id pairs (a << 32 | b) and how often each is linked.

    Texts that are null or empty, or whose tokens don't give back the bytes of space + text with both tokenizers, have zeros, no digest
    and no pairs. Repeated rows stand for themselves.
    """
    path_a, path_b = path_a or default_tokenizer(), path_b or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            reach = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + SLICE, side="right")))
                rows = list(aligner.documents(texts[i:j]))
                columns = list(zip(*rows, strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c), pa.int64())) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of all pairs in aligned rows: in how many documents a pair is linked, and whether no other pair of its A id is in more. Combined before the shuffle; one A id has no more pairs than B has ids."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    own = W.partitionBy(F.shiftright("pair", _B_BITS))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def alignment_table(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Documents are tokenised and aligned once and written with their distinct pairs. Counts of pairs are broadcast behind a size check and
    otherwise shuffled by pair and salt, as frequent pairs are in most documents. An empty table gives no rows.
    """
    rows = written(aligned(docs, path_a, path_b).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    linked = rows.select("rid", F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", "salt", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if small_enough(counts.count(), 48):
        linked = linked.join(F.broadcast(counts), "pair")
    else:
        linked = linked.join(counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["pair", "salt"])
    sums = linked.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
